"""Where results go: files, topics, tables, and several of them at once."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowspark.contracts import DEFAULT_THRESHOLD, MODEL_COLUMNS

# Producer settings of the topic sink.
TOPIC_OPTIONS = {
    "kafka.compression.type": "lz4", "kafka.linger.ms": "10", "kafka.batch.size": str(1 << 20),
}


def write_json_lines(flows: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """One JSON object per row."""
    (flows.select(*columns) if columns else flows).write.mode(mode).json(path)


def as_messages(df: DataFrame, key: str = "srcip") -> DataFrame:
    """(key, value) messages; keying by source keeps a host's rows in one topic partition, in order."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def publish(df: DataFrame, target: str = "kafka", key: str = "srcip", **options: str) -> None:
    """Send a batch of rows to a topic, or to a folder of messages with ``target="parquet"``."""
    settings = {**TOPIC_OPTIONS, **options} if target == "kafka" else options
    as_messages(df, key).write.format(target).options(**settings).mode("append").save()


def publish_stream(df: DataFrame, checkpoint: str, target: str = "kafka", key: str = "srcip",
                   **options: str) -> StreamingQuery:
    settings = {**TOPIC_OPTIONS, **options} if target == "kafka" else options
    writer = as_messages(df, key).writeStream.format(target).options(**settings)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_audit_log(audit: DataFrame, path: str) -> None:
    """Audit lines as JSON, one folder per day."""
    day = F.date_from_unix_date(F.expr("cast(ts_ms div 86400000 as int)"))
    audit.withColumn("day", day).write.mode("append").partitionBy("day").json(path)


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """Write one result to several sinks, computing it once."""
    kept = df.persist()
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()


def write_batch_once(df: DataFrame, batch_id: int, path: str) -> None:
    """Sink for ``foreachBatch``: a batch that is run again replaces its own folder and adds nothing."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_prepared(outputs: dict[str, DataFrame], folder: str, format: str = "parquet") -> None:
    """Named tables (full, scaled and tree variants of train and test) under one folder."""
    for name, df in outputs.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if format == "csv" else writer).format(format).save(f"{folder}/{name}")


def write_contract(spark: SparkSession, path: str, threshold: float) -> None:
    """The model's input order and decision threshold, beside the model."""
    row = spark.createDataFrame([(MODEL_COLUMNS, float(threshold))], "columns array<string>, threshold double")
    row.coalesce(1).write.mode("overwrite").json(path)


def read_threshold(spark: SparkSession, path: str | None = None, override: float | None = None) -> float:
    """The threshold in force: ``override``, else the stored one, else the default. The stored input order
    must be the one this package encodes."""
    if override is not None:
        return float(override)
    if path is None:
        return DEFAULT_THRESHOLD
    row = spark.read.schema("columns array<string>, threshold double").json(path).first()
    if row["columns"] != MODEL_COLUMNS:
        raise ValueError("the stored model expects other columns")
    return row["threshold"]
