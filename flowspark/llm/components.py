"""Connected components of links between whole numbers, as rounds of joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.tables import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every number that has a link; the component is its smallest number.

    Large-star and small-star rounds: every node links its larger neighbours to the smallest number it sees, then
    every node links its smaller neighbours to the smallest of them, until nothing changes. Stars of any size take
    one round, and the number of rounds grows with the logarithm of a component's diameter. Each round is written to
    the shared folder; only a count reaches the driver. Null ends are ignored.
    """
    edges = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct()
    edges = stored(edges, "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: (u, v > u) becomes (v, m).
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("x")).join(stored(smallest, "smallest"), "u").select(
            F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        # Small star: (u, v < u) becomes (v, m) and (u, m), m the smallest below u.
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stored(small.where("u <> v").distinct(), "edges")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = after
