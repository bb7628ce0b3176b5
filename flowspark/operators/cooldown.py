"""First-fires-then-silence: a row fires unless one of its key fired less than ``ttl`` before it.

Repeats do not extend the silence, so whether a row fires hangs on the chain of rows that fired before
it. Spark sorts the rows by key and time; a task then hops from one firing row to the next.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.session import ship_package

DEFAULT_HOT_ROWS = 4_000_000


def fire_rows(ts: np.ndarray, last: int | None, ttl: int) -> tuple[np.ndarray, int | None]:
    """Which of one key's sorted times fire, given the key's last firing time; one hop per firing row."""
    fired = np.zeros(len(ts), dtype=bool)
    at = 0 if last is None else int(np.searchsorted(ts, last + ttl))
    while at < len(ts):
        fired[at], last = True, int(ts[at])
        at = int(np.searchsorted(ts, last + ttl))
    return fired, last


def run_starts(batch: pa.RecordBatch, keys: list[str], previous: tuple | None) -> tuple[list[int], tuple]:
    """Row numbers where the key differs from the row before, and the batch's last key."""
    n = batch.num_rows
    columns = [batch.column(c) for c in keys]
    starts = [] if tuple(c[0].as_py() for c in columns) == previous else [0]
    if n > 1:
        differs = None
        for c in columns:
            d = pc.not_equal(c.slice(1), c.slice(0, n - 1))
            differs = d if differs is None else pc.or_(differs, d)
        starts += [i + 1 for i in pc.indices_nonzero(differs).to_pylist()]
    return starts, tuple(c[n - 1].as_py() for c in columns)


def _flag_partition(batches: Iterator[pa.RecordBatch], keys: list[str], ts: str, ttl: int, name: str,
                    last: int | None = None, previous: tuple | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        times = batch.column(ts).to_numpy()
        fired = np.zeros(batch.num_rows, dtype=bool)
        starts, previous = run_starts(batch, keys, previous)
        at = 0
        for start in [*starts, batch.num_rows]:
            if start > at:
                fired[at:start], last = fire_rows(times[at:start], last, ttl)
            if start < batch.num_rows:
                last = None
            at = start
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(fired)], names=[*batch.schema.names, name]
        )


def with_cooldown(df: DataFrame, keys: list[str], ts: str, order: list[str], ttl: int,
                  name: str = "fires", hot_rows: int | None = DEFAULT_HOT_ROWS) -> DataFrame:
    """Add the boolean ``name``: the row is the first of its key, or ``ttl`` or more after the last one
    that fired. ``ts`` is a BIGINT; ``order`` breaks ties between equal times.

    Key columns must not be NULL. Keys above ``hot_rows`` rows are spread over several tasks.
    """
    from flowspark.operators.hot_cooldown import cooldown_hot, split_hot_keys

    ship_package(df.sparkSession)
    hashed = df.withColumn("_key_hash", F.xxhash64(*keys))
    cold, hot = (hashed, None) if hot_rows is None else split_hot_keys(hashed, "_key_hash", hot_rows)
    schema = T.StructType([*cold.schema.fields, T.StructField(name, T.BooleanType())])
    ordered = cold.repartition("_key_hash").sortWithinPartitions("_key_hash", *keys, ts, *order)
    out = ordered.mapInArrow(lambda batches: _flag_partition(batches, keys, ts, ttl, name), schema)
    if hot is not None:
        out = out.unionByName(cooldown_hot(hot, keys, ts, order, ttl, name, hot_rows))
    return out.select(*df.columns, name)
