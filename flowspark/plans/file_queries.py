"""File and message operators as write-and-read-back queries over the given tables."""

from pyspark.sql import functions as F

from flowspark.functions.encode import encode_flows
from flowspark.operators import prep
from flowspark.plans.alert_queries import over_flagged
from flowspark.plans.inputs import flagged_detections, flows
from flowspark.plans.offline_queries import _SCALED_COLUMNS, TOP
from flowspark.plans.oracle import LABELLED, over_flows
from flowspark.plans.packet_queries import IDENTITY
from flowspark.plans.registry import query
from flowspark.session import scratch_folder
from flowspark.sources import sinks, views
from flowspark.sources.messages import decode_json, read_labelled_csv, read_topic, read_vectors

_FLOW_FILE = f"{IDENTITY}, state string, spkts bigint, sbytes bigint, rate double, sjit double, emit_no bigint"
_FLOW_NAMES = [c.split()[0] for c in _FLOW_FILE.split(", ")]


@query(_FLOW_FILE, over_flows(f"select {', '.join(_FLOW_NAMES)} from flows"))
def flow_json_file(spark, folder):
    """Flow records as JSON lines, read again by their declared types."""
    path = scratch_folder(spark, "flows")
    sinks.write_json_lines(flows(spark, folder), path, _FLOW_NAMES)
    return spark.read.schema(_FLOW_FILE).json(path)


@query("srcip string, alerts bigint, lowest float", over_flagged(
    "select srcip, count(*) filter (alert) alerts, min(attack_prob) lowest from flagged group by 1"))
def topic_source(spark, folder):
    """Messages read from a topic's folder and decoded by the declared types."""
    path = scratch_folder(spark, "messages")
    sinks.as_messages(flagged_detections(spark, folder)).select("value").write.text(path)
    messages = read_topic(spark, "text", streaming=False, path=path)
    good, _ = decode_json(messages, "srcip string, alert boolean, attack_prob float")
    return good.groupBy("srcip").agg(F.count_if("alert").alias("alerts"), F.min("attack_prob").alias("lowest"))


_CSV = "id bigint, proto string, service string, state string, sload double, rate double, dur double, smean double, label int"


@query(_CSV, f"select {', '.join(c.split()[0] for c in _CSV.split(', '))} from ({LABELLED}) l")
def labelled_csv(spark, folder):
    """The labelled table as CSV files that begin with a byte-order mark."""
    path = scratch_folder(spark, "labelled")
    marked = views.labelled(spark, folder).withColumnRenamed("id", "﻿id")
    marked.write.option("header", True).csv(path)
    return read_labelled_csv(spark, path, spark.createDataFrame([], _CSV).schema)


_DISTINCT = f"select distinct on (proto, service, state, sload, rate, dur, smean, spkts, label) * from ({LABELLED}) l"


@query("name string, rows bigint, attacks bigint", f"""
select name, count(*) "rows", sum(label) attacks
from ({_DISTINCT}) d, (values ('full'), ('scaled'), ('tree')) n(name) group by 1""")
def prepared_tables(spark, folder):
    """The three outputs of preprocessing as stored tables; every one has each kept row and its label."""
    path = scratch_folder(spark, "prepared")
    full, scaled, tree, _ = prep.preprocess_train(views.labelled(spark, folder), top=TOP)
    outputs = {"full": full, "scaled": scaled, "tree": tree}
    sinks.write_prepared(outputs, path)
    parts = [
        spark.read.parquet(f"{path}/{name}").groupBy().agg(F.count("*").alias("rows"), F.sum("label").alias("attacks"))
        .select(F.lit(name).alias("name"), "rows", "attacks")
        for name in outputs
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LOGS = f"select *, ln(1 + sload) sload_log, ln(1 + rate) rate_log, ln(1 + spkts) spkts_log from ({_DISTINCT}) d"


@query("column string, mean double6, deviation double6", " union all ".join(
    f"""select '{c}' "column", round(avg({c}), 4) mean, round(stddev_pop({c}), 4) deviation from ({_LOGS}) g""" for c in _SCALED_COLUMNS))
def artifacts_stored(spark, folder):
    """The fitted scaler after it was saved and loaded."""
    path = scratch_folder(spark, "artifacts")
    prep.save_artifacts(spark, prep.preprocess_train(views.labelled(spark, folder), top=TOP)[3], path)
    scaler = prep.load_artifacts(spark, path)["scaler"]
    # Four digits: the sixth of a mean depends on the order of its sum.
    rows = [(c, round(m, 4), round(d, 4)) for c, (m, d) in scaler.items()]
    return spark.createDataFrame(rows, "column string, mean double, deviation double")


@query("sink string, rows bigint, packets bigint", over_flows("""
select sink, count(*) "rows", sum(spkts + dpkts) packets from flows, (values ('files'), ('messages')) s(sink) group by 1"""))
def two_sinks(spark, folder):
    """One result written to files and to messages."""
    files, topic = scratch_folder(spark, "files"), scratch_folder(spark, "messages")
    sinks.fan_out(flows(spark, folder), [
        lambda df: sinks.write_json_lines(df, files, _FLOW_NAMES + ["dpkts"]),
        lambda df: sinks.publish(df, "parquet", path=topic),
    ])
    counted = "spkts bigint, dpkts bigint"
    messages, _ = decode_json(spark.read.parquet(topic), counted)
    total = [F.count("*").alias("rows"), F.sum(F.col("spkts") + F.col("dpkts")).alias("packets")]
    return spark.read.schema(counted).json(files).agg(*total).select(F.lit("files").alias("sink"), "*").unionByName(
        messages.agg(*total).select(F.lit("messages").alias("sink"), "*"))


@query("vectors bigint, total double6", over_flows("""
select count(*) vectors, coalesce(sum(cast(cast(spkts as float) as double)), 0) total from flows where emit_no % 50 <> 0"""))
def vector_file(spark, folder):
    """Vectors as JSON lines, every 50th cut short; the cut ones are left out when they are read."""
    path = scratch_folder(spark, "vectors")
    vectors = encode_flows(flows(spark, folder), "emit_no", "spkts")
    cut = F.when(F.col("emit_no") % 50 == 0, F.slice("features", 1, 57)).otherwise(F.col("features"))
    vectors.select(cut.alias("features")).write.json(path)
    place = _place("spkts")
    return read_vectors(spark, path).agg(
        F.count("*").alias("vectors"), F.coalesce(F.sum(F.col("features")[place].cast("double")), F.lit(0.0)).alias("total"))


def _place(feature: str) -> int:
    from flowspark.contracts import MODEL_COLUMNS

    return MODEL_COLUMNS.index(feature)
