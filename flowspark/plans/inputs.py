"""Inputs several queries share; derived once per application and data folder."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.alerts import flag_alerts, threshold_label
from flowspark.operators.flows import packets_to_flows
from flowspark.operators.segments import segment_packets
from flowspark.session import passing_tables, stored
from flowspark.sources import views

_derived: dict[tuple[str, str, str], DataFrame] = {}
ATTACK_VALUE = 60.0
EVENT_TTL_US = 43_200 * 1_000_000


def once(name: str, spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _derived:
        with passing_tables(spark):
            _derived[key] = stored(build(), keep=True)
    return _derived[key]


def labelled_packets(spark: SparkSession, folder: str) -> DataFrame:
    return once("labelled", spark, folder, lambda: segment_packets(views.packets(spark, folder)))


def flows(spark: SparkSession, folder: str) -> DataFrame:
    return once("flows", spark, folder, lambda: packets_to_flows(views.packets(spark, folder)))


def scored_detections(spark: SparkSession, folder: str) -> DataFrame:
    """Detections with a score between 0 and 1 and the label of a 60-point threshold."""
    prob = F.col("value") / (F.col("value") + F.lit(50.0))
    return views.detections(spark, folder).withColumns({
        "attack_prob": prob.cast("float"),
        "label": threshold_label("value", ATTACK_VALUE),
        "latency_us": (F.col("event_id") % 6000).cast("bigint"),
        "sport": (F.col("event_id") % 1000).cast("int"), "dsport": F.lit(443),
    })


def flagged_detections(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_detections(spark, folder)
    return flag_alerts(scored, order=["event_id"], ttl_us=EVENT_TTL_US)
