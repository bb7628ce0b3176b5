"""Model input: category bucketing, fixed one-hot columns and the 58-wide vector."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.contracts import (
    ENDPOINTS, FEATURE_COUNT, MODEL_COLUMNS, NUMERIC_FEATURES, TOP_VALUES, one_hot_categories,
)


def quoted(name: str) -> Column:
    """A column whose name may hold ``-`` or ``.``."""
    return F.col(f"`{name}`")


def bucket(value: Column, top: list[str]) -> Column:
    return F.when(value.isin(top), value).otherwise("other")


def one_hot(bucketed: Column, prefix: str, categories: list[str]) -> list[Column]:
    return [(bucketed == c).cast("int").alias(f"{prefix}_{c}") for c in categories]


def bucketed(df: DataFrame, prefix: str) -> Column:
    """The bucket of a categorical; an absent or null value counts as ``-``."""
    value = F.coalesce(F.col(prefix), F.lit("-")) if prefix in df.columns else F.lit("-")
    return bucket(value, TOP_VALUES[prefix])


def encode_columns(df: DataFrame) -> list[Column]:
    """The 58 model columns in contract order."""
    columns = []
    for prefix in TOP_VALUES:
        columns += one_hot(bucketed(df, prefix), prefix, one_hot_categories(prefix))
    for name in NUMERIC_FEATURES:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)
        columns.append(value.alias(name))
    assert len(columns) == FEATURE_COUNT
    return columns


def feature_vector(df: DataFrame) -> Column:
    return F.array(*[c.cast("double") for c in encode_columns(df)]).alias("features")


def endpoints(df: DataFrame) -> list[Column]:
    """The 5-tuple with the defaults of an absent field: empty text, zero port."""
    kinds = {"sport": ("int", 0), "dsport": ("int", 0)}
    out = []
    for name in ENDPOINTS:
        kind, default = kinds.get(name, ("string", ""))
        value = F.coalesce(F.col(name).cast(kind), F.lit(default)) if name in df.columns else F.lit(default)
        out.append(value.alias(name))
    return out


def encode_flows(flows: DataFrame, *extra: str) -> DataFrame:
    """Flow records to model-ready rows: 5-tuple, ``features`` and any lineage columns asked for."""
    return flows.select(*endpoints(flows), feature_vector(flows), *extra)


def to_contract(df: DataFrame) -> DataFrame:
    """Any frame in the 58-column order as FLOAT, absent columns 0."""
    return df.select(*[
        (quoted(c) if c in df.columns else F.lit(0)).cast("float").alias(c) for c in MODEL_COLUMNS
    ])
