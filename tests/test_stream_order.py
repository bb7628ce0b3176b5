"""History counts of a stream do not depend on the order in which flows arrive within the delay."""

from pyspark.sql import functions as F

from flowspark.operators.history import add_history
from flowspark.plans.stream_queries import drained
from flowspark.streaming import jobs as J


def test_shuffled_batches_equal_batch(spark):
    df = spark.range(300).select(
        F.lit("cap").alias("capture_id"), F.col("id").alias("emit_no"), ((F.col("id") + 1) * 1000).alias("emit_us"),
        F.col("id").alias("stime_us"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("srcip"),
        F.concat(F.lit("d"), (F.col("id") % 5).cast("string")).alias("dstip"),
        (F.col("id") % 3).cast("int").alias("sport"), (F.col("id") % 4).cast("int").alias("dsport"),
        F.when(F.col("id") % 2 == 0, "http").otherwise("dns").alias("service"))
    later = [df.limit(1).withColumns({"capture_id": F.lit("end"), "emit_us": F.lit(k * 10**12)}) for k in (1, 2)]
    got = drained(df, lambda s: J.stream_history(s, "emit_no", delay="10 seconds"), later, batches=3)
    columns = ["capture_id", "emit_no", *J.HISTORY_COUNTS]
    rows = lambda d: sorted(map(str, d.filter("capture_id = 'cap'").select(*columns).collect()))
    assert rows(got) == rows(add_history(df))
