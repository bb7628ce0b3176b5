"""Dense numbering of a whole table without sorting it in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowspark.session import stored


def with_ordinal(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... by ``order`` (which must be unique in the group).

    A range shuffle sorts the table across tasks, however large one group is; the place inside a task
    comes from the row's position, and the tasks' offsets from one row per task and group at its ends.
    The sorted table is stored because the offsets and the rows must see the same task bounds.
    """
    keys = [*groups, *order]
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(sorted_rows.withColumns({
        "_task": F.spark_partition_id(),
        "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
    }))
    counts = placed.groupBy(*groups, "_task").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = W.partitionBy(*groups).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *groups, "_task",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    joined = placed.join(stored(offsets), [*groups, "_task"])  # stored, its size is known and the rows stay where they are
    return joined.withColumn(name, F.col("_row") + F.col("_shift")).drop("_task", "_row", "_shift")


def with_running_totals(df: DataFrame, order: list, totals: dict[str, str],
                        groups: list[str] | None = None) -> DataFrame:
    """Add running sums (this row included) in ``order``, per group, or over the whole table without one.

    ``totals`` maps a new column to the summed one; ``order`` must be unique in a group. The table is
    range-sorted over tasks, each task sums its own stretch, and the stretches before it arrive as one
    offset row per task and group at its ends. Every row also gets the group's grand total, ``all_<name>``.
    """
    groups = groups or []
    keys = [*groups, *order]
    placed = stored(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_task", F.spark_partition_id())
    )
    sums = placed.groupBy(*groups, "_task").agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    # One row per task and group; ordering them is bounded by the partitions, not by the data.
    series = W.partitionBy(*groups).orderBy("_task")
    earlier, whole = (
        series.rowsBetween(W.unboundedPreceding, end) for end in (-1, W.unboundedFollowing)
    )
    offsets = sums.select(
        *groups, "_task",
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in totals],
        *[F.sum(f"_{n}").over(whole).alias(f"all_{n}") for n in totals],
    )
    within = W.partitionBy(*groups, "_task").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    running = placed.withColumns({n: F.sum(c).over(within) for n, c in totals.items()})
    joined = running.join(offsets, [*groups, "_task"])
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in totals}).drop(
        "_task", *[f"_{n}" for n in totals]
    )


def exact_places(df: DataFrame, groups: list[str], value: str, places: dict) -> DataFrame:
    """Per group, the values at 0-based sorted places; ``places`` maps a name to an expression of ``total``.

    Values are counted first, so the running count of distinct values tells which one holds a place.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_count"))
    running = with_running_totals(counted, [F.asc(value)], {"upto": "_count"}, groups)
    running = running.withColumn("total", F.col("all_upto"))
    held = {n: F.min(F.when(place < F.col("upto"), F.col(value))) for n, place in places.items()}
    return running.groupBy(*groups).agg(
        *[v.alias(n) for n, v in held.items()], F.max(value).alias("max"), F.max("total").alias("total")
    )
