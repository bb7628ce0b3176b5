"""Cooldown for keys too large for one task, exactly and without a serial pass over their rows.

The rows of hot keys are range-sorted into stretches of bounded size. What a stretch does to the key's
last firing time is a step function (enter with time A, leave with time B). Neighbouring functions are
composed level by level in groups of ``FANOUT``, then the entry times run back down the levels, so every
task works on a bounded stretch and the number of steps grows with the logarithm of the stretches.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.session import cut_lineage, stored

FANOUT = 16
MAX_BROADCAST_KEYS = 1_000_000
STRETCHES_A_CORE, LARGEST_STRETCH = 4, 4_000_000
FOREVER = np.iinfo(np.int64).max
STEP_SCHEMA = "stretch bigint, first_key string, last_key string, whole boolean, upto binary, leave binary"


def split_hot_keys(df: DataFrame, column: str, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """``df`` without and with the keys that have more than ``hot_rows`` rows (None when there are none).

    The counting pass reads the key columns only and combines before its shuffle. There can be at most
    rows / hot_rows hot keys.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    hot = stored(counts.select(column))
    found = hot.count()
    if not found:
        return df, None
    side = F.broadcast(hot) if found <= MAX_BROADCAST_KEYS else hot
    return df.join(side, column, "left_anti"), df.join(side, column, "left_semi")


def stretches(hot: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Hot rows sorted into tasks, fixed on disk, with the task's number.

    A task gets about half of ``rows`` rows, or more where that gives more stretches than keep the cores busy: every stretch
    is a task in each round and a state on the driver.
    """
    n, cores = hot.count(), hot.sparkSession.sparkContext.defaultParallelism
    tasks = max(2, min(-(-2 * n // rows), max(STRETCHES_A_CORE * cores, -(-2 * n // LARGEST_STRETCH))))
    placed = hot.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return cut_lineage(placed.withColumn("_stretch", F.spark_partition_id().cast("bigint")))


def step_function(ts: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, leave): entering with a last firing time A, the stretch is left with ``leave`` of the first
    ``upto`` >= A; with A itself if there is none."""
    n = len(ts)
    following = np.searchsorted(ts, ts + ttl)
    end = np.where(following < n, following, np.arange(n))
    while True:
        further = end[end]
        if np.array_equal(further, end):
            break
        end = further
    starts = np.arange(min(int(np.searchsorted(ts, ts[0] + ttl)) + 1, n))
    upto, leave = ts[starts] - ttl, ts[end[starts]]
    last = np.append(leave[1:] != leave[:-1], True)
    return upto[last], leave[last]


def constant(value: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array([FOREVER]), np.array([value])


def leaving(step: tuple[np.ndarray, np.ndarray], entry: int) -> int:
    at = int(np.searchsorted(step[0], entry))
    return entry if at == len(step[0]) else int(step[1][at])


def compose(first: tuple, second: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The step function of running through ``first`` and then ``second``."""
    at = np.searchsorted(second[0], first[1])
    through = np.where(at == len(second[0]), first[1], second[1][np.minimum(at, len(second[0]) - 1)])
    rest = second[0] > first[0][-1]
    upto, leave = np.append(first[0], second[0][rest]), np.append(through, second[1][rest])
    last = np.append(leave[1:] != leave[:-1], True)
    return upto[last], leave[last]


def _pack(step: tuple) -> tuple[bytes, bytes]:
    return step[0].astype(np.int64).tobytes(), step[1].astype(np.int64).tobytes()


def _unpack(upto: bytes, leave: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(upto, np.int64), np.frombuffer(leave, np.int64)


def entry_times(steps: DataFrame) -> dict[int, int]:
    """Entry time of every stretch, given (stretch, upto, leave) rows whose chain starts are constants.

    Only one number per stretch comes to the driver; the functions stay in the tasks.
    """
    levels = [steps.select("stretch", "upto", "leave")]
    while levels[-1].count() > FANOUT:
        grouped = levels[-1].groupBy(F.expr(f"stretch div {FANOUT}").alias("parent"))
        levels.append(cut_lineage(grouped.applyInPandas(_compose_group, levels[-1].schema)))
    entries = {0: FOREVER}
    for depth, level in enumerate(reversed(levels)):
        span = FOREVER if depth == 0 else FANOUT  # the top level is one group
        grouped = level.groupBy(F.expr(f"stretch div {span}").alias("parent"))
        found = grouped.applyInPandas(_descent(entries, span), "stretch bigint, entry bigint")
        entries = {r["stretch"]: r["entry"] for r in found.collect()}
    return entries


def _descent(known: dict[int, int], span: int):
    """Entry times of a group's members, from the entry time of the group."""
    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stretch")
        at, entered = known[int(pdf["stretch"].iloc[0]) // span], []
        for upto, leave in zip(pdf["upto"], pdf["leave"]):
            entered.append(at)
            at = leaving(_unpack(upto, leave), at)
        return pd.DataFrame({"stretch": pdf["stretch"], "entry": entered})

    return descend


def _compose_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("stretch")
    whole = None
    for upto, leave in zip(pdf["upto"], pdf["leave"]):
        step = _unpack(upto, leave)
        whole = step if whole is None else compose(whole, step)
    packed = _pack(whole)
    return pd.DataFrame({"stretch": [pdf["stretch"].iloc[0] // FANOUT], "upto": [packed[0]], "leave": [packed[1]]})


def _stretch_steps(batches: Iterator[pa.RecordBatch], keys: list[str], ts: str, ttl: int):
    """One row for the stretch: its first and last key, and its step function or its leaving time."""
    from flowspark.operators.cooldown import run_starts

    number, first_key, previous, whole, times = None, None, None, True, []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, last_key = run_starts(batch, keys, previous)
        if number is None:
            number = batch.column("_stretch")[0].as_py()
            first_key = tuple(batch.column(c)[0].as_py() for c in keys)
            starts = starts[1:]
        values = batch.column(ts).to_numpy()
        if starts:
            whole, times, values = False, [], values[starts[-1]:]
        times.append(values)
        previous = last_key
    if number is None:
        return
    step = step_function(np.concatenate(times), ttl)
    upto, leave = _pack(step if whole else constant(int(step[1][0])))
    arrays = [[number], [repr(first_key)], [repr(previous)], [whole], [upto], [leave]]
    names = ["stretch", "first_key", "last_key", "whole", "upto", "leave"]
    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def chain_starts(ends: list) -> dict[int, bool]:
    """Stretch number -> whether its first key began in an earlier stretch, from (number, first, last) rows."""
    ordered = sorted(ends)
    return {
        number: i > 0 and ordered[i - 1][2] == first for i, (number, first, _) in enumerate(ordered)
    }


def cooldown_hot(hot: DataFrame, keys: list[str], ts: str, order: list[str], ttl: int, name: str,
                 rows: int) -> DataFrame:
    from flowspark.operators.cooldown import _flag_partition

    # Without an order of its own, equal times are told apart by a row number, so copies can be split too.
    tied = hot if order else hot.withColumn("_tie", F.monotonically_increasing_id())
    placed = stretches(tied, [*keys, ts, *(order or ["_tie"])], rows)
    steps = cut_lineage(placed.mapInArrow(lambda b: _stretch_steps(b, keys, ts, ttl), STEP_SCHEMA))
    ends = [(r["stretch"], r["first_key"], r["last_key"])
            for r in steps.select("stretch", "first_key", "last_key").collect()]
    continued = chain_starts(ends)

    def fix_chain_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, row in pdf.iterrows():
                if not continued[row["stretch"]]:
                    upto, leave = _pack(constant(int(_unpack(row["upto"], row["leave"])[1][0])))
                    pdf.at[i, "upto"], pdf.at[i, "leave"] = upto, leave
            yield pdf[["stretch", "upto", "leave"]]

    entries = entry_times(steps.mapInPandas(fix_chain_starts, "stretch bigint, upto binary, leave binary"))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        number, last, previous = first.column("_stretch")[0].as_py(), None, None
        if continued[number]:
            last = entries[number]
            previous = tuple(first.column(c)[0].as_py() for c in keys)
        yield from _flag_partition(_chained(first, batches), keys, ts, ttl, name, last, previous)

    schema = T.StructType([*placed.schema.fields, T.StructField(name, T.BooleanType())])
    return placed.mapInArrow(flag, schema).drop("_stretch", "_tie")


def _chained(first, rest):
    yield first
    yield from rest
