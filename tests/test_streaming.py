"""Streams give the same rows as batch jobs over the same data."""

import pytest
from packets import packet, random_packets, table
from pyspark.sql import functions as F

from flowspark.operators.alerts import flag_alerts
from flowspark.operators.flows import flow_aggregates, flow_measures
from flowspark.operators.history import add_history
from flowspark.operators.operations import sliding_rates
from flowspark.operators.segments import segment_packets
from flowspark.sources.sinks import publish_stream, write_batch_once
from flowspark.streaming import jobs as J

FAR = 4_000_000_000_000


def as_stream(spark, df, folder, files=3):
    df.repartition(files).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows_of(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("kind", ["tcp", "udp"])
def test_flow_stream_equals_batch(spark, tmp_path, kind):
    rows = random_packets(150, kind, 5)
    closing = [packet(FAR, (1, 1), (2, 2), proto=17, payload=1, number=10_000),
               packet(2 * FAR, (1, 1), (2, 2), proto=17, payload=1, number=10_001)]
    df = table(spark, rows)
    folder = str(tmp_path / "in")
    df.repartition(2).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    checkpoint, out = str(tmp_path / "check"), str(tmp_path / "out")
    aggregates = J.stream_flow_aggregates(stream)
    J.run_to_table(aggregates, out, checkpoint)
    for extra in closing:  # later packets move the watermark; the restarted query goes on from its checkpoint
        table(spark, [extra]).write.mode("append").parquet(folder)
        J.run_to_table(J.stream_flow_aggregates(stream), out, checkpoint)
    columns = [c for c in J.AGGREGATE_COLUMNS if c != "flow_seq"]
    batch = flow_aggregates(segment_packets(df, hot_rows=None))
    got = spark.read.parquet(out).filter("ip_a = 10")
    assert rows_of(got, columns) == rows_of(batch, columns)
    flow_measures(got).select("srcip", "state", "rate").collect()


def test_history_stream_equals_batch(spark, tmp_path):
    df = spark.range(400).select(
        F.concat(F.lit("cap"), (F.col("id") % 2).cast("string")).alias("capture_id"),
        F.expr("id div 2").alias("emit_no"), (F.col("id") * 1000).alias("emit_us"), F.col("id").alias("stime_us"),
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("srcip"),
        F.concat(F.lit("d"), (F.col("id") % 5).cast("string")).alias("dstip"),
        (F.col("id") % 3).cast("int").alias("sport"), (F.col("id") % 4).cast("int").alias("dsport"),
        F.when(F.col("id") % 2 == 0, "http").otherwise("dns").alias("service"),
    )
    stream = as_stream(spark, df, str(tmp_path / "in"), 1)
    J.run_to_table(J.stream_history(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    columns = ["capture_id", "emit_no", *J.HISTORY_COUNTS]
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), columns) == rows_of(add_history(df), columns)


def scored(spark):
    return spark.range(300).select(
        F.col("id").alias("event_id"), F.lit("a").alias("srcip"), F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("dstip"),
        F.lit("tcp").alias("proto"), (F.col("id") * 7_000_000 + 1_000_000_000).alias("ts_us"),
        (F.col("id") % 4 != 0).cast("int").alias("label"),
    )


def test_alert_stream_equals_batch(spark, tmp_path):
    df = scored(spark)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    df.repartition(2).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    J.run_to_table(J.stream_alerts(stream), out, checkpoint)
    late = df.limit(1).withColumns({"ts_us": F.lit(FAR), "srcip": F.lit("z"), "event_id": F.lit(-1).cast("bigint")})
    late.write.mode("append").parquet(folder)
    J.run_to_table(J.stream_alerts(stream), out, checkpoint)
    late.withColumn("ts_us", F.lit(2 * FAR)).write.mode("append").parquet(folder)
    J.run_to_table(J.stream_alerts(stream), out, checkpoint)
    columns = ["event_id", "label", "alert"]
    got = spark.read.parquet(out).filter("event_id >= 0")
    assert rows_of(got, columns) == rows_of(flag_alerts(df, order=["event_id"]), columns)


def test_rates_and_totals(spark, tmp_path):
    df = scored(spark).withColumn("ts", F.timestamp_micros("ts_us"))
    stream = as_stream(spark, df, str(tmp_path / "in"), 1)
    rates = J.stream_rates(stream, {"scored": F.lit(True)})
    J.run_to_table(rates, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = sliding_rates(df, {"scored": F.lit(True)})
    joined = got.join(want.withColumnRenamed("scored", "batch"), "window_start_us")
    assert got.count() > 0 and joined.filter("abs(scored - batch) > 1e-12").count() == 0
    assert joined.count() == got.count()
    query = J.stream_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(
        availableNow=True).start()
    query.awaitTermination()
    assert spark.table("totals").first().asDict() == {"scored": 300, "attacks": 225}
    assert J.progress_lag(query).columns == ["source", "lag"]


def test_idle_sessions_of_udp(spark, tmp_path):
    rows = [packet(t, proto=17, payload=1, number=i) for i, t in enumerate([0, 30_000_000, 95_000_000, FAR])]
    stream = as_stream(spark, table(spark, rows), str(tmp_path / "in"), 1)
    J.run_to_table(J.idle_sessions(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("stime_us").collect()
    assert [r["packets"] for r in got] == [2, 1]


def test_stream_sinks(spark, tmp_path):
    stream = as_stream(spark, scored(spark), str(tmp_path / "in"), 1)
    query = publish_stream(stream, str(tmp_path / "check"), "parquet", path=str(tmp_path / "topic"))
    query.awaitTermination()
    topic = spark.read.parquet(str(tmp_path / "topic"))
    assert topic.count() == 300 and topic.select("key").distinct().count() == 1
    for _ in range(2):
        write_batch_once(scored(spark), 4, str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 300
