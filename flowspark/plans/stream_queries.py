"""Queries that run as streams over the tables, and over capture files written from them.

The input is written to a folder as it would arrive; two later rows move the watermark past the end.
"""

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.contracts import HISTORY_COUNTS, PACKET_SCHEMA
from flowspark.operators.flows import flow_measures
from flowspark.plans.alert_queries import _DELIVERED, over_flagged
from flowspark.plans.inputs import EVENT_TTL_US, flagged_detections, flows, scored_detections
from flowspark.plans.operation_queries import _rate_sql
from flowspark.plans.oracle import PACKETS, over_flows
from flowspark.plans.packet_queries import PACKET_COLUMNS
from flowspark.plans.registry import query
from flowspark.session import scratch_folder, ship_package
from flowspark.sources import views
from flowspark.sources.captures import capture_rejects, place, read_frames, read_packets
from flowspark.sources.sinks import publish
from flowspark.sources.messages import decode_json
from flowspark.streaming import jobs as J
from flowspark.streaming.blocks import HistoryPath
from flowspark.streaming.live import LivePath

END_US = 4_000_000_000_000_000
LIVE_DELAY_US, HISTORY_DELAY_US, LIVE_BATCHES = 6 * 3_600_000_000, 2_000_000, 5
_live = {}


def drained(df: DataFrame, make: Callable[[DataFrame], DataFrame], later: list[DataFrame],
            batches: int | None = None) -> DataFrame:
    """Everything a stream over ``df`` gives, restarted once per row of ``later``; ``batches`` deals ``df`` out at random."""
    spark = df.sparkSession
    folder, out, checkpoint = (scratch_folder(spark, n) for n in ("arrivals", "results", "progress"))
    (df if batches is None else df.repartition(batches)).write.parquet(folder)
    reader = spark.readStream.schema(df.schema)
    stream = (reader if batches is None else reader.option("maxFilesPerTrigger", 1)).parquet(folder)
    J.run_to_table(make(stream), out, checkpoint)
    for rows in later:
        rows.write.mode("append").parquet(folder)
        J.run_to_table(make(stream), out, checkpoint)
    return spark.read.parquet(out)


def _end_rows(df: DataFrame, changes: dict) -> list[DataFrame]:
    one = df.limit(1)
    typed = lambda values: {c: F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()}
    return [one.withColumns(typed({**changes, "ts_us": END_US * k})) for k in (1, 2)]


_FLOW = ("capture_id string, srcip string, sport int, dstip string, dsport int, state string, service string, "
         "stime_us bigint, ltime_us bigint, spkts bigint, dpkts bigint, sbytes bigint, dbytes bigint, sloss bigint, "
         "dloss bigint, rate double, sjit double, tcprtt double")


@query(_FLOW, over_flows(f"select {', '.join(c.split()[0] for c in _FLOW.split(', '))} from flows"))
def stream_flows(spark, folder):
    packets = views.packets(spark, folder).select(*PACKET_SCHEMA.fieldNames())
    later = _end_rows(packets, {"capture_id": "end", "proto": 17})
    aggregates = drained(packets, J.stream_flow_aggregates, later)
    return flow_measures(aggregates.filter(F.col("capture_id") != "end"))


@query("capture_id string, emit_no bigint, " + ", ".join(f"{c} int" for c in HISTORY_COUNTS),
       over_flows(f"select capture_id, emit_no, {', '.join(HISTORY_COUNTS)} from flows"))
def stream_history(spark, folder):
    finished = flows(spark, folder).select(
        "capture_id", "emit_no", "srcip", "dstip", "sport", "dsport", "service", "stime_us",
        ((F.col("emit_no") + 1) * 1000).alias("emit_us"),  # the record has no emission time: a flow a millisecond
    )
    # Flows arrive up to two seconds late and in no order, over five batches, with a restart after three.
    at = F.col("emit_us") + F.pmod(F.xxhash64("capture_id", "emit_no"), F.lit(HISTORY_DELAY_US))
    arrivals, out, checkpoint = (scratch_folder(spark, n) for n in ("arrivals", "history", "progress"))
    path = HistoryPath(out, delay_us=HISTORY_DELAY_US)
    stream = lambda: spark.readStream.schema(finished.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    arrived = finished.withColumn("_at", at)
    edges = [float("-inf"), *arrived.approxQuantile("_at", [k / LIVE_BATCHES for k in range(1, LIVE_BATCHES)], 0.001),
             float("inf")]
    for k in range(LIVE_BATCHES):
        part = arrived.filter((F.col("_at") >= edges[k]) & (F.col("_at") < edges[k + 1])).drop("_at")
        part.orderBy(F.xxhash64("emit_no", "capture_id")).coalesce(1).write.mode("append").parquet(arrivals)
        if k == 2:
            path.run(stream(), checkpoint)
    path.run(stream(), checkpoint)
    path.finish(spark)
    return path.table(spark, "counted")


@query("event_id bigint, label int, alert boolean", over_flagged("select event_id, label, alert from flagged"))
def stream_alert_flags(spark, folder):
    scored = scored_detections(spark, folder)
    later = _end_rows(scored, {"srcip": "end", "event_id": -1})
    flagged = drained(scored, lambda s: J.stream_alerts(s, ttl_us=EVENT_TTL_US), later)
    return flagged.filter("event_id >= 0")


def live_arrivals(scored: DataFrame) -> list[DataFrame]:
    """Messages of the batches in which scored rows arrive: up to the delay late and in no order, with broken ones.

    The last batch also brings copies of some rows stamped long ago, which are late.
    """
    message = F.to_json(F.struct(*scored.columns)).alias("value")
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(LIVE_DELAY_US))
    arrived = scored.withColumn("_at", F.col("ts_us") + jitter)
    edges = [None, *arrived.approxQuantile("_at", [k / LIVE_BATCHES for k in range(1, LIVE_BATCHES)], 0.001), None]
    out = []
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = arrived if lo is None else arrived.filter(F.col("_at") >= lo)
        part = part if hi is None else part.filter(F.col("_at") < hi)
        rows = part.select(message)
        broken = part.filter("event_id % 50 = 0").select(F.concat(F.lit('{"event_id": "'), F.col("event_id")).alias("value"))
        rows = rows.union(broken)
        if k == LIVE_BATCHES - 1:
            rows = rows.union(scored.filter("event_id % 97 = 0").withColumn("ts_us", F.lit(1).cast("long")).select(message))
        out.append(rows.orderBy(F.xxhash64("value")))
    return out


def live_run(spark, folder):
    """The live path over shuffled arrivals, stopped and started again after three of the batches."""
    key = (spark.sparkContext.applicationId, folder)
    if key in _live:
        return _live[key]
    scored = scored_detections(spark, folder)
    arrivals, out, checkpoint = (scratch_folder(spark, n) for n in ("arrivals", "live", "progress"))
    path = LivePath(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema), lambda df: df, out,
                    views.subscribers(spark, folder), ["event_id"], LIVE_DELAY_US, EVENT_TTL_US)
    stream = lambda: spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(arrivals)
    for k, rows in enumerate(live_arrivals(scored)):
        rows.coalesce(1).write.mode("append").parquet(arrivals)
        if k == 2:
            path.run(stream(), checkpoint)
    path.run(stream(), checkpoint)
    path.finish(spark)
    _live[key] = path
    return path


@query("client_id bigint, alerts bigint, lowest float", _DELIVERED)
def live_deliveries(spark, folder):
    """What subscribers get from the live path equals what one batch job would send them."""
    return live_run(spark, folder).table(spark, "delivered").groupBy("client_id").agg(
        F.count("*").alias("alerts"), F.min("attack_prob").alias("lowest"))


@query("batches bigint, rejects bigint, late bigint, scored bigint, attacks bigint, alerts bigint", over_flagged(f"""
select {LIVE_BATCHES + 1} batches, count(*) filter (event_id % 50 = 0) rejects, count(*) filter (event_id % 97 = 0) late,
  count(*) scored, count(*) filter (label = 1) attacks, count(*) filter (alert) alerts from flagged"""))
def live_totals(spark, folder):
    """Rejects, late rows and flags of the live path; the messages of every batch are counted once."""
    path = live_run(spark, folder)
    done = path.table(spark, "progress").agg(
        F.count("*").alias("batches"), F.sum("rejects").alias("rejects"), F.sum("late").alias("late"))
    kept = path.table(spark, "scored").agg(
        F.count("*").alias("scored"), F.count_if(F.col("label") == 1).alias("attacks"), F.count_if("alert").alias("alerts"))
    return done.join(kept, F.lit(True))


@query("window_start_us bigint, scored double6", over_flagged(_rate_sql("scored:true")))
def stream_rates(spark, folder):
    scored = scored_detections(spark, folder).select("ts_us")
    rates = lambda s: J.stream_rates(s.withColumn("ts", F.timestamp_micros("ts_us")), {"scored": F.lit(True)})
    return drained(scored, rates, _end_rows(scored, {})).filter(F.col("window_start_us") < END_US // 2)


@query("srcip string, n bigint", over_flagged("select srcip, count(*) n from flagged group by 1"))
def topic_round_trip(spark, folder):
    """Scored rows sent as keyed messages and decoded again."""
    topic = scratch_folder(spark, "topic")
    publish(flagged_detections(spark, folder), "parquet", path=topic)
    good, _ = decode_json(spark.read.parquet(topic), "srcip string, label int, alert boolean", {"srcip": ""}, "key")
    return good.filter(F.col("key") == F.col("srcip")).groupBy("srcip").agg(F.count("*").alias("n"))


def _write_captures(frames: DataFrame, folder: str) -> None:
    """Frames as capture files, one per task and link type, and one file that is no capture.

    Files go through the file system of the folder's URI; a task that is run again overwrites its own.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        filesystem, inner = place(folder)
        filesystem.create_dir(inner, recursive=True)
        files = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                name = f"{inner}/{r.capture_id}-{r.linktype}-{TaskContext.get().partitionId()}.pcap"
                if name not in files:
                    files[name] = filesystem.open_output_stream(name)
                    files[name].write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, r.linktype))
                data = bytes(r.data)
                files[name].write(struct.pack("<IIII", r.ts_us // 1_000_000, r.ts_us % 1_000_000, len(data), len(data)))
                files[name].write(data)
        for f in files.values():
            f.close()
        if TaskContext.get().partitionId() == 0:
            with filesystem.open_output_stream(f"{inner}/notes.txt") as f:
                f.write(b"not packets")
        yield pd.DataFrame({"files": [len(files)]})

    ship_package(frames.sparkSession)
    frames.mapInPandas(write, "files int").count()


def write_captures(spark, folder):
    """The frame view as capture files in a new folder; returns the folder."""
    target = scratch_folder(spark, "captures")
    _write_captures(views.frames(spark, folder), target)
    return target


_NO_NUMBER = PACKET_COLUMNS.replace("pkt_no bigint, ", "")


@query(_NO_NUMBER, f"select {', '.join(c.split()[0] for c in _NO_NUMBER.split(', '))} from ({PACKETS}) p")
def capture_files(spark, folder):
    """Capture files read back, the large ones in byte ranges of 256 KiB."""
    packets = read_packets(spark, write_captures(spark, folder), split_bytes=1 << 18)
    return packets.withColumn("capture_id", F.substring_index("capture_id", "-", 1))


@query("path string, problem string, frames bigint", f"""
select 'notes.txt' path, 'not a capture file' problem,
  (select count(*) + count(*) filter (pkt_no % 7 in (1, 2)) from ({PACKETS}) p) frames""")
def capture_rejects_query(spark, folder):
    target = write_captures(spark, folder)
    total = read_frames(spark, target).agg(F.count("*").alias("frames"))
    bad = capture_rejects(spark, target)
    return bad.join(total, F.lit(True)).select(F.substring_index("path", "/", -1).alias("path"), "problem", "frames")
