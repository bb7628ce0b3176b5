"""All registered queries. Importing a module of queries registers them."""

from flowspark.plans import (  # noqa: F401
    alert_queries,
    evaluation_queries,
    file_queries,
    model_queries,
    offline_queries,
    operation_queries,
    packet_queries,
    stream_queries,
)
from flowspark.plans.registry import CHECKS, QUERIES  # noqa: F401
