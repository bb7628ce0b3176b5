"""Weighted rendezvous sharding, with gapless slots inside every shard.

A record goes to the shard with the highest score ``-weight / ln(u)``, where ``u`` in (0, 1) comes from hashing the
record's key with the shard's number. Adding a shard adds one more score, so records move only into the new shard,
and about its share of the weights. All of it is column expressions.

Slots: a shard is cut into buckets by a hash, rows are numbered within (shard, bucket), and bucket offsets are
running sums of counts. No task ever holds a whole shard.

Defined cases: a null key hashes as the text ``null``; a null text counts 0 bytes; rows that repeat a key share its
shard and get slots of their own, in no particular order; an empty table gives an empty result. Input columns named
like a result column are replaced, all others pass through, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.tables import free_name

SHARDS = 16
BUCKETS = 1024
_FRACTION = float(1 << 52)


def _hash52(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts joined by colons, as a double with an exact value."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key: highest weighted score, the lowest number among equals. Weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [
        F.struct(
            (F.lit(-float(weight)) / F.log((_hash52(name, F.lit(str(shard))) + 0.5) / _FRACTION)).alias("score"),
            F.lit(-shard).alias("minus"),
        )
        for shard, weight in enumerate(weights)
    ]
    return (-F.array_max(F.array(*scores))["minus"]).cast("int")


def assign(df: DataFrame, key: str, weights: list[float]) -> DataFrame:
    """``df`` with the shard of every row. No shuffle."""
    return df.withColumn("shard", rendezvous(F.col(f"`{key}`"), weights))


def with_slots(df: DataFrame, key: str, spread: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``df`` (with ``shard``) and a gapless ``slot`` from 0 within each shard.

    Slots follow (bucket, key); the bucket is a hash of the key and the ``spread`` columns, so many rows of one key
    are spread as long as they differ in one of those.
    """
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in spread]
    bucket, at, ahead, n = (free_name(df, x) for x in ("__bucket", "__at", "__before", "__n"))
    hashed = F.pmod(_hash52(name, *parts).cast("long"), F.lit(buckets)).cast("int")
    rows = df.drop("slot").withColumn(bucket, hashed)
    sums = rows.groupBy("shard", bucket).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x buckets rows, whatever the input.
    offsets = sums.select("shard", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    inside = Window.partitionBy("shard", bucket).orderBy(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in spread])
    numbered = rows.withColumn(at, F.row_number().over(inside))
    return (
        numbered.join(offsets, ["shard", bucket])
        .withColumn("slot", F.col(ahead) + F.col(at) - 1)
        .drop(bucket, ahead, at)
    )


def moved(df: DataFrame, key: str, old: list[float], new: list[float]) -> DataFrame:
    """Rows per (old shard, new shard) under two lists of weights."""
    both = df.select(
        rendezvous(F.col(f"`{key}`"), old).alias("shard"), rendezvous(F.col(f"`{key}`"), new).alias("new_shard"))
    return both.groupBy("shard", "new_shard").agg(F.count("*").alias("n_rows"))
