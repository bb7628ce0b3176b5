"""Exploratory queries over a labelled table."""

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.encode import quoted

HIGH_CORRELATION = 0.9


def repeat_counts(df: DataFrame, row_id: str = "id") -> DataFrame:
    """Rows, rows left after dropping repeats, and rows removed."""
    others = [quoted(c) for c in df.columns if c != row_id]
    kinds = df.groupBy(*others).agg(F.count("*").alias("n"))
    total, kept = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return kinds.agg(total.alias("rows"), kept.alias("kept"), (total - kept).alias("removed"))


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), "value")
    return ordered if limit is None else ordered.limit(limit)


def top_categories(df: DataFrame, columns: list[str], limit: int = 15) -> DataFrame:
    """The most frequent values of each column, counted in one shuffle."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ]))
    counts = df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).filter(F.col("place") <= limit)


def column_kinds(df: DataFrame, label: str = "label") -> DataFrame:
    """Each column's kind and number of distinct values.

    The columns are melted and counted as (column, value) groups, so one shuffle of combined pairs serves
    all of them; a multi-column ``count(distinct)`` would expand every row once per column instead.
    """
    kinds = {
        f.name: "numeric" if isinstance(f.dataType, T.NumericType) else "categorical"
        for f in df.schema if f.name != label
    }
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), quoted(c).cast("string").alias("value"))
        for c, k in kinds.items()
    ]))
    seen = df.select(pairs.alias("p")).groupBy("p.column", "p.kind", "p.value").agg(F.lit(1).alias("one"))
    return seen.groupBy("column", "kind").agg(F.count("value").alias("distinct_values"))


def _melt(row: DataFrame, entries: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """A one-row aggregate turned into one row per entry."""
    structs = [F.struct(*[v.alias(n) for v, n in zip(entry, names)]) for entry in entries]
    return row.select(F.explode(F.array(*structs)).alias("e")).select("e.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, one pass over the data."""
    pairs = list(combinations(sorted(columns), 2))
    row = df.agg(*[F.corr(quoted(a), quoted(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = [(F.lit(a), F.lit(b), F.col(f"c{i}")) for i, (a, b) in enumerate(pairs)]
    return _melt(row, entries, ["a", "b", "r"])


def high_correlations(df: DataFrame, columns: list[str], above: float = HIGH_CORRELATION) -> DataFrame:
    strength = F.abs(F.col("r"))
    pairs = correlations(df, columns).filter(strength > above)
    return pairs.select("a", "b", F.round(strength, 3).alias("strength")).orderBy(F.desc("strength"), "a", "b")


def correlation_submatrix(df: DataFrame, columns: list[str], above: float = HIGH_CORRELATION) -> DataFrame:
    """Full signed matrix (both triangles and the diagonal) of the columns in any high pair."""
    pairs = correlations(df, columns)
    flagged = pairs.filter(F.abs(F.col("r")) > above).select(F.explode(F.array("a", "b")).alias("f")).distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    kept = both.join(flagged.withColumnRenamed("f", "a"), "a", "left_semi")
    kept = kept.join(flagged.withColumnRenamed("f", "b"), "b", "left_semi").select("a", "b", "r")
    return kept.unionByName(flagged.select(F.col("f").alias("a"), F.col("f").alias("b"), F.lit(1.0).alias("r")))


def summary_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean, sample deviation and range per column, widest range first."""
    measures = []
    for i, c in enumerate(columns):
        v = quoted(c).cast("double")
        measures += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.avg(v).alias(f"m{i}"),
                     F.stddev_samp(v).alias(f"s{i}")]
    entries = [
        (F.lit(c), F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"m{i}"), F.col(f"s{i}"), F.col(f"b{i}") - F.col(f"a{i}"))
        for i, c in enumerate(columns)
    ]
    names = ["column", "min", "max", "mean", "std", "range"]
    return _melt(df.agg(*measures), entries, names).orderBy(F.desc("range"), "column")


def histograms(df: DataFrame, columns: list[str], bins: int = 60) -> DataFrame:
    """Equal-width counts of each column, raw and log1p; the last bin includes the maximum.

    One pass for the bounds, one for the counts, whatever the number of columns.
    """
    series = {}
    for c in columns:
        series[(c, "raw")] = quoted(c).cast("double")
        series[(c, "log1p")] = F.log1p(quoted(c).cast("double"))
    keys = list(series)
    bounds = df.agg(*[b for i, k in enumerate(keys) for b in
                      (F.min(series[k]).alias(f"lo{i}"), F.max(series[k]).alias(f"hi{i}"))]).first()
    entries = []
    for i, (c, scale) in enumerate(keys):
        lo, hi = bounds[f"lo{i}"], bounds[f"hi{i}"]
        if lo is None:
            continue
        if lo == hi:  # a constant column is centred in a range of width 1
            lo, hi = lo - 0.5, hi + 0.5
        place = F.floor((series[(c, scale)] - F.lit(lo)) * bins / F.lit(hi - lo))
        entries.append(F.struct(
            F.lit(c).alias("column"), F.lit(scale).alias("scale"),
            F.least(place, F.lit(bins - 1)).alias("bin"),
        ))
    binned = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter("bin is not null")
    return binned.groupBy("column", "scale", "bin").agg(F.count("*").alias("n"))
