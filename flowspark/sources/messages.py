"""JSON messages: topic sources, decoding with rejects, and feature-vector files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.contracts import FEATURE_COUNT

BROKEN = "_broken"


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def decode_json(messages: DataFrame, schema: T.StructType | str, defaults: dict | None = None,
                *keep: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split messages into decoded rows and rejects.

    A message that is not a JSON object, or has a field of the wrong type, is a reject and stops nothing.
    An absent field takes its default (or NULL).
    """
    declared = _schema(schema)
    wanted = T.StructType([*declared.fields, T.StructField(BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    text = F.col(value).cast("string")
    parsed = messages.withColumn("_json", F.from_json(text, wanted, options))
    is_object = F.coalesce(F.startswith(F.ltrim(text), F.lit("{")), F.lit(False))
    fine = is_object & F.col("_json").isNotNull() & F.col(f"_json.{BROKEN}").isNull()
    fields = []
    for f in declared:
        got = F.col(f"_json.`{f.name}`")
        default = (defaults or {}).get(f.name)
        fields.append((got if default is None else F.coalesce(got, F.lit(default).cast(f.dataType))).alias(f.name))
    return parsed.filter(fine).select(*keep, *fields), parsed.filter(~fine).select(*keep, value)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files of one JSON message per line, as a ``value`` column."""
    return spark.read.text(path)


def read_topic(spark: SparkSession, source: str = "kafka", streaming: bool = True, **options: str) -> DataFrame:
    """A topic as ``key, value`` text rows from its earliest message on.

    ``source="kafka"`` needs the connector on the cluster; ``source="text"`` reads a folder of JSON lines.
    A restarted query goes on from its checkpoint, not from ``startingOffsets``.
    """
    reader = spark.readStream if streaming else spark.read
    if source == "kafka":
        options = {"startingOffsets": "earliest", **options}
        loaded = reader.format("kafka").options(**options).load()
        return loaded.selectExpr("cast(key as string) key", "cast(value as string) value")
    if source == "text":
        path = options.pop("path")
        return reader.options(**options).text(path).select(F.lit(None).cast("string").alias("key"), "value")
    return reader.format(source).options(**options).load()


def read_vectors(spark: SparkSession, path: str, width: int = FEATURE_COUNT) -> DataFrame:
    """``features`` of a JSON-lines file, rows of any other width left out."""
    rows = spark.read.schema("features array<float>").json(path)
    return rows.filter(F.size("features") == width)


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A labelled flow CSV. Columns are matched to the header by name; a byte-order mark is dropped."""
    from flowspark.contracts import labelled_schema

    schema = schema or labelled_schema()
    header = spark.read.option("header", True).csv(path).columns
    clean = [c.lstrip("﻿").strip() for c in header]
    known = {f.name: f.dataType for f in schema}
    as_read = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in clean])
    return spark.read.option("header", True).option("enforceSchema", True).schema(as_read).csv(path)
