"""Scores to labels, alerts, audit lines and subscriber deliveries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.contracts import ALERT_TTL_US, DEFAULT_THRESHOLD, ENDPOINTS, FEATURE_COUNT
from flowspark.functions.encode import endpoints
from flowspark.operators.cooldown import with_cooldown
from flowspark.operators.ordinal import with_ordinal

ALERT_KEY = ["srcip", "dstip", "proto"]
MAX_BROADCAST_SUBSCRIBERS = 100_000


def split_by_width(vectors: DataFrame, width: int = FEATURE_COUNT) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``features`` are ``width`` wide, and the rest."""
    fits = F.coalesce(F.size("features") == width, F.lit(False))
    return vectors.filter(fits), vectors.filter(~fits)


def threshold_label(prob: Column | str = "attack_prob", threshold: float = DEFAULT_THRESHOLD) -> Column:
    """1 where the probability reaches the DOUBLE threshold (a FLOAT probability is widened first)."""
    prob = F.col(prob) if isinstance(prob, str) else prob
    return (prob.cast("double") >= F.lit(float(threshold))).cast("int")


def flag_alerts(scored: DataFrame, ts: str = "ts_us", order: list[str] | None = None,
                ttl_us: int = ALERT_TTL_US, hot_rows: int | None = None) -> DataFrame:
    """Add ``alert``: an attack whose (source, destination, protocol) did not alert within ``ttl_us``.

    All rows stay. Only attacks take part in the keyed shuffle; normal rows pass by it. The input is read
    once for the attacks, once for the rest and once to look for hot keys, so pass a stored table of
    scores rather than a plan that would score them again.
    """
    attacks = scored.filter(F.col("label") == 1)
    others = scored.filter(~F.coalesce(F.col("label") == 1, F.lit(False)))
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    fired = with_cooldown(attacks, ALERT_KEY, ts, order or [], ttl_us, "alert", **options)
    return fired.unionByName(others.withColumn("alert", F.lit(False)))


def alert_totals(flagged: DataFrame) -> DataFrame:
    attack = F.col("label") == 1
    return flagged.agg(
        F.count("*").alias("scored"), F.count_if(attack).alias("attacks"),
        F.count_if(attack & F.col("alert")).alias("fired"),
        F.count_if(attack & ~F.col("alert")).alias("suppressed"),
    )


def alert_stream(scored: DataFrame) -> DataFrame:
    """Alerts only, in the delivered shape; absent fields take their defaults."""
    present = set(scored.columns)

    def value(name: str, kind: str) -> Column:
        got = F.col(name).cast(kind) if name in present else F.lit(None).cast(kind)
        return F.coalesce(got, F.lit(0).cast(kind)).alias(name)

    alerts = scored.filter(F.coalesce(F.col("alert"), F.lit(False)))
    return alerts.select(*endpoints(scored), value("attack_prob", "float"), value("latency_us", "bigint"))


def reaches(prob: Column, floor: Column) -> Column:
    """Whether a score reaches a subscriber's floor. A score or floor that is no number reaches nothing."""
    return (prob >= floor) & ~F.isnan(prob) & ~F.isnan(floor)


def filter_subscriber(alerts: DataFrame, min_prob: float = 0.0) -> DataFrame:
    return alerts.filter(reaches(F.col("attack_prob"), F.lit(min_prob).cast("float")))


def deliver(alerts: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Every subscriber gets every alert that reaches its ``min_prob``.

    The comparison is no equality, so the subscribers are broadcast, but only after they have been counted;
    more than ``MAX_BROADCAST_SUBSCRIBERS`` of them are joined chunk by chunk instead.
    """
    wanted = with_floor(subscribers)
    if wanted.limit(MAX_BROADCAST_SUBSCRIBERS + 1).count() > MAX_BROADCAST_SUBSCRIBERS:
        return _deliver_by_chunk(alerts, wanted)
    return alerts.join(F.broadcast(wanted), reaches(alerts["attack_prob"], wanted["min_prob"]))


def with_floor(subscribers: DataFrame) -> DataFrame:
    """Subscribers whose absent ``min_prob`` is 0."""
    floor = F.coalesce(F.col("min_prob"), F.lit(0.0).cast("float"))
    return subscribers.select("client_id", floor.alias("min_prob"))


def _deliver_by_chunk(alerts: DataFrame, wanted: DataFrame, chunk_rows: int = 10_000, salts: int = 16) -> DataFrame:
    """Delivery as an equi-join for many subscribers.

    Subscribers are numbered by their floor and cut into chunks of ``chunk_rows``. An alert visits the chunks whose
    lowest floor it reaches; the exact comparison is kept beside the equality. Nearly every alert visits the first
    chunk, so alerts are dealt over ``salts`` copies of each chunk.
    """
    numbered = with_ordinal(wanted.filter(~F.isnan("min_prob")), [], ["min_prob", "client_id"], "_n")
    placed = numbered.withColumn("_chunk", F.expr(f"_n div {chunk_rows}")).drop("_n")
    floors = placed.groupBy("_chunk").agg(F.min("min_prob").alias("_floor"))
    spread = alerts.join(F.broadcast(floors), reaches(alerts["attack_prob"], floors["_floor"])).drop("_floor")
    spread = spread.withColumn("_salt", F.pmod(F.xxhash64(*alerts.columns), F.lit(salts)))
    copies = placed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    joined = spread.join(copies, ["_chunk", "_salt"])
    return joined.filter(reaches(F.col("attack_prob"), F.col("min_prob"))).drop("_chunk", "_salt")


def audit_lines(scored: DataFrame, ts_ms: Column | None = None) -> DataFrame:
    """One line per scored flow, keyed ``src:sport->dst:dsport/proto``."""
    flow_id = F.concat(
        F.col("srcip"), F.lit(":"), F.col("sport").cast("string"), F.lit("->"), F.col("dstip"),
        F.lit(":"), F.col("dsport").cast("string"), F.lit("/"), F.col("proto"),
    )
    stamp = F.expr("ts_us div 1000") if ts_ms is None else ts_ms
    return scored.select(
        flow_id.alias("flow_id"), stamp.alias("ts_ms"), F.col("label").alias("prediction"),
        F.col("attack_prob").alias("confidence"), "alert",
        F.coalesce(F.col("latency_us"), F.lit(0)).cast("bigint").alias("latency_us"),
    )


def scored_columns(df: DataFrame) -> DataFrame:
    return df.select(*ENDPOINTS, "attack_prob", "label", "alert", "latency_us")
