"""Operational queries: totals, rates, latency, lag and traffic breakdowns."""

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowspark.operators.ordinal import exact_places

# Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = [1e-6, 5e-6, 1e-5, 2.5e-5, 5e-5, 1e-4, 2.5e-4, 5e-4, 1e-3, 5e-3]

#: Size parameter of quantile sketches: ranks are off by less than 0.7 %, a sketch takes some ten kilobytes.
SKETCH_SIZE = 800


def running_totals(scored: DataFrame) -> DataFrame:
    """Ingested, scored, fired and suppressed counts in one row."""
    attack = F.col("label") == 1
    return scored.agg(
        F.count("*").alias("ingested"), F.count("label").alias("scored"),
        F.count_if(attack & F.col("alert")).alias("fired"),
        F.count_if(attack & ~F.col("alert")).alias("suppressed"),
    )


def sliding_rates(events: DataFrame, measures: dict[str, Column], ts: str = "ts_us", window_s: int = 60,
                  slide_s: int = 5) -> DataFrame:
    """Per-second rate of each counted condition over every sliding window that holds an event.

    Events are first counted per slide, so only one small row per slide is copied into its windows.
    """
    slide = slide_s * 1_000_000
    steps = events.groupBy(F.expr(f"{ts} div {slide}").alias("step")).agg(
        *[F.count_if(cond).alias(name) for name, cond in measures.items()]
    )
    shifts = F.explode(F.array(*[F.lit(i) for i in range(window_s // slide_s)]))
    spread = steps.withColumn("_shift", shifts).withColumn("window_start_us", (F.col("step") - F.col("_shift")) * slide)
    return spread.groupBy("window_start_us").agg(
        *[(F.sum(name) / F.lit(float(window_s))).alias(name) for name in measures]
    )


def latency_buckets(df: DataFrame, latency_us: str = "latency_us", by: list[str] | None = None) -> DataFrame:
    """Cumulative histogram: rows at or under each bound; the last bucket (NULL bound) counts all."""
    seconds = F.col(latency_us) / 1e6
    measures = [F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(LATENCY_BOUNDS)]
    measures.append(F.count(latency_us).alias(f"b{len(LATENCY_BOUNDS)}"))
    row = df.groupBy(*(by or [])).agg(*measures)
    bounds = [F.lit(b) for b in LATENCY_BOUNDS] + [F.lit(None).cast("double")]
    entries = [F.struct(b.alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return row.select(*(by or []), F.explode(F.array(*entries)).alias("e")).select(*(by or []), "e.*")


def histogram_quantile(buckets: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """Quantile by linear interpolation inside the bucket it falls in.

    A quantile in the open last bucket gives the last finite bound; an empty histogram gives NULL. The
    input has one row per bound and series, so its windows are as small as the series.
    """
    by = by or []
    order = F.asc_nulls_last("le")
    series = W.partitionBy(*by).orderBy(order)
    whole = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    marked = buckets.withColumns({
        "_rank": F.lit(q) * F.last("n").over(whole),
        "_below": F.coalesce(F.lag("n").over(series), F.lit(0)),
        "_from": F.coalesce(F.lag("le").over(series), F.lit(0.0)),
        "_total": F.last("n").over(whole),
    })
    hit = marked.filter(F.col("n") >= F.col("_rank"))
    place = F.struct(F.coalesce("le", F.lit(float("inf"))).alias("key"), "le", "n", "_below", "_from", "_rank", "_total")
    first = hit.groupBy(*by).agg(F.min(place).alias("h"))
    inside = F.col("h.n") - F.col("h._below")
    share = F.when(inside > 0, (F.col("h._rank") - F.col("h._below")) / inside).otherwise(0.0)
    value = F.when(F.col("h.le").isNull(), F.col("h._from")).otherwise(
        F.col("h._from") + (F.col("h.le") - F.col("h._from")) * share
    )
    return first.select(*by, F.lit(q).alias("q"), F.when(F.col("h._total") > 0, value).alias("value"))


def consumer_lag(latest: DataFrame, committed: DataFrame) -> DataFrame:
    """Messages not yet consumed per group: latest minus committed offset over the topic's partitions.

    ``latest``: (topic, partition, latest_offset); ``committed``: (group_id, topic, partition, offset).
    """
    joined = committed.join(latest, ["topic", "partition"])
    behind = F.greatest(F.col("latest_offset") - F.col("offset"), F.lit(0))
    return joined.groupBy("group_id").agg(F.sum(behind).alias("lag"))


def sustained_throughput(df: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Rows per second between the first and the last row; NULL when no time passes."""
    span = (F.max(ts) - F.min(ts)) / 1e6
    return df.agg(F.count("*").alias("n"), span.alias("active_s")).withColumn(
        "per_s", F.when(F.col("active_s") > 0, F.col("n") / F.col("active_s"))
    )


def exact_percentiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """Elements at sorted place ``floor(p * (n - 1))``, and the maximum."""
    places = {name: F.floor(F.lit(p) * (F.col("total") - 1)) for name, p in shares.items()}
    return exact_places(df, [], column, places).drop("total")


def rank_error(k: int) -> float:
    """Twice the normalised rank error that a KLL sketch of size ``k`` keeps to in 99 of 100 cases."""
    return 2 * 2.296 / k**0.9723


def latency_sketches(df: DataFrame, groups: list[str], column: str, k: int = SKETCH_SIZE) -> DataFrame:
    """One mergeable sketch of a whole-number column per group; map sides send sketches, not values. Nulls are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(*groups).agg(
        F.kll_sketch_agg_bigint(column, F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, groups: list[str], k: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of coarser groups, or one of everything, without going back to the rows."""
    merged = sketches.groupBy(*groups).agg(F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"), F.count("*").alias("parts"))
    return merged.where("parts > 0").drop("parts")


def sketched_percentiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The groups, ``n`` and an estimate per share; ranks are off by ``rank_error`` at most, the maximum (1.0) is exact."""
    groups = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(
        *groups, F.kll_sketch_get_n_bigint("sketch").alias("n"),
        *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(name) for name, p in shares.items()])


def rank_distances(df: DataFrame, groups: list[str], column: str, estimates: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``estimates`` and, as ``<name>_off``, how many places each lies from place ``floor(p * (n - 1))`` of its group's rows.

    ``estimates`` has a row per group; groups with a null in their key meet none. Equal values are counted once before
    they meet it. Sketches are drawn anew whenever they are computed, so only these rows belong to these distances.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, F.col(column).alias("__value")).agg(F.count("*").alias("__rows"))
    both = counts.join(estimates, groups) if groups else counts.join(estimates, F.lit(True))
    sums = both.groupBy(*groups, "n", *shares).agg(*[
        F.sum(F.when(compare(F.col("__value"), F.col(name)), F.col("__rows")).otherwise(0)).alias(f"__{side}_{name}")
        for name in shares for side, compare in (("below", operator.lt), ("upto", operator.le))])
    places = {name: F.floor(F.lit(p) * (F.col("n") - 1)) for name, p in shares.items()}
    return sums.select(*groups, "n", *shares, *[
        F.greatest(F.col(f"__below_{name}") - place, place - F.col(f"__upto_{name}") + 1, F.lit(0)).cast("long").alias(f"{name}_off")
        for name, place in places.items()])


def partition_spread(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Rows per topic partition when messages are keyed by ``key``."""
    place = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    return df.groupBy(place.alias("partition")).agg(F.count("*").alias("n"))


def traffic_breakdown(flows: DataFrame) -> DataFrame:
    """Flows, packets, bytes and unanswered flows by protocol, state and service."""
    return flows.groupBy("proto", "state", "service").agg(
        F.count("*").alias("flows"), F.sum(F.col("spkts") + F.col("dpkts")).alias("packets"),
        F.sum(F.col("sbytes") + F.col("dbytes")).alias("bytes"),
        F.count_if(F.col("dpkts") == 0).alias("no_reply"),
    )


def top_talkers(flows: DataFrame, n: int = 10) -> DataFrame:
    """Sources by their largest ``ct_src_ltm``."""
    peak = flows.groupBy("srcip").agg(F.max("ct_src_ltm").alias("peak"), F.count("*").alias("flows"))
    return peak.orderBy(F.desc("peak"), "srcip").limit(n)


def attack_log(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("prediction") == 1)


def reconcile_alerts(flagged: DataFrame) -> DataFrame:
    """Distinct alert keys against fired alerts; equal when the data lies within one TTL."""
    attacks = flagged.filter(F.col("label") == 1)
    per_key = attacks.groupBy("srcip", "dstip", "proto").agg(F.count_if("alert").alias("fired"))
    return per_key.agg(F.count("*").alias("unique_keys"), F.sum("fired").alias("fired"))
