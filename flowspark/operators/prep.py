"""Preprocessing of the labelled flow table: dedup, buckets, one-hot, log1p, standardisation."""

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.contracts import DROPPED_COLUMNS, SKEWED_COLUMNS, TOP_VALUES
from flowspark.functions.encode import bucket, one_hot, quoted
from flowspark.session import cut_lineage

LABEL = "label"


def require_no_nulls(df: DataFrame) -> DataFrame:
    """``df`` itself, after one pass that fails if any value is null."""
    present = df.agg(*[F.count(quoted(c)).alias(c) for c in df.columns], F.count("*").alias("_rows")).first()
    broken = {c: present["_rows"] - present[c] for c in df.columns if present[c] < present["_rows"]}
    if broken:
        raise ValueError(f"null values in training data: {broken}")
    return df


def drop_repeats(df: DataFrame, row_id: str = "id") -> DataFrame:
    """Keep, of the rows equal on every other column, the one with the smallest ``row_id``.

    A grouped minimum combines before the shuffle, so a value copied a billion times stays one row per
    task; a window would bring every copy to one task.
    """
    others = [c for c in df.columns if c != row_id]
    kept = df.groupBy(*[quoted(c) for c in others]).agg(F.min(quoted(row_id)).alias(row_id))
    return kept.select(*[quoted(c) for c in df.columns])


def drop_irrelevant(df: DataFrame, columns: list[str] = DROPPED_COLUMNS) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def add_buckets(df: DataFrame, top: dict[str, list[str]] = TOP_VALUES) -> DataFrame:
    return df.withColumns({f"{p}_bucket": bucket(F.col(p), values) for p, values in top.items()})


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = (LABEL,)) -> list[str]:
    return sorted(
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    )


def fit_categories(df: DataFrame, prefixes: list[str]) -> dict[str, list[str]]:
    """Bucket values seen in ``df``, sorted; at most a top list plus ``other`` each."""
    row = df.agg(*[F.collect_set(f"{p}_bucket").alias(p) for p in prefixes]).first()
    return {p: sorted(row[p]) for p in prefixes}


def one_hot_columns(categories: dict[str, list[str]]) -> list[str]:
    return [f"{p}_{c}" for p, values in categories.items() for c in values]


def apply_one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """0/1 columns of the fitted categories; a value not seen in training is 0 everywhere."""
    columns = [h for p, values in categories.items() for h in one_hot(F.col(f"{p}_bucket"), p, values)]
    return df.select("*", *columns)


def skewed_present(columns: list[str], skewed: list[str] = SKEWED_COLUMNS) -> list[str]:
    return [c for c in skewed if c in columns]


def add_logs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_log": F.log1p(F.col(c)) for c in columns})


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, one pass; a constant column divides by 1."""
    if not columns:
        return {}
    measures = [m for i, c in enumerate(columns) for m in
                (F.avg(quoted(c)).alias(f"m{i}"), F.stddev_pop(quoted(c)).alias(f"s{i}"))]
    row = df.agg(*measures).first()
    return {c: (float(row[f"m{i}"]), float(row[f"s{i}"]) or 1.0) for i, c in enumerate(columns)}


def scaled(column: str, fitted: tuple[float, float]) -> Column:
    mean, deviation = fitted
    return ((quoted(column) - F.lit(mean)) / F.lit(deviation)).alias(f"{column}_scaled")


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select("*", *[scaled(c, fitted) for c, fitted in scaler.items()])


def three_outputs(df: DataFrame, artifacts: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Everything; one-hot + scaled + label; one-hot + raw numerics + label."""
    hot = [quoted(c) for c in one_hot_columns(artifacts["categories"])]
    scaled_columns = [quoted(f"{c}_scaled") for c in artifacts["scaler"]]
    numbers = [quoted(c) for c in artifacts["numeric"]]
    return df, df.select(*hot, *scaled_columns, LABEL), df.select(*hot, *numbers, LABEL)


def _prepared(df: DataFrame, row_id: str, top: dict) -> DataFrame:
    return add_buckets(drop_irrelevant(drop_repeats(df, row_id)), top)


def preprocess_train(df: DataFrame, row_id: str = "id", top: dict = TOP_VALUES,
                     skewed: list[str] = SKEWED_COLUMNS):
    """Fit and apply every step; returns (full, model, tree, artifacts)."""
    require_no_nulls(df)
    prepared = cut_lineage(_prepared(df, row_id, top))
    numeric = numeric_columns(prepared)
    logged = skewed_present(numeric, skewed)
    plain = [c for c in numeric if c not in skewed]
    with_logs = add_logs(prepared, logged)
    artifacts = {
        "top": top, "categories": fit_categories(prepared, list(top)), "numeric": numeric, "logged": logged,
        "scaler": fit_scaler(with_logs, [f"{c}_log" for c in logged] + plain),
    }
    full = apply_scaler(apply_one_hot(with_logs, artifacts["categories"]), artifacts["scaler"])
    return (*three_outputs(full, artifacts), artifacts)


def preprocess_test(df: DataFrame, artifacts: dict, row_id: str = "id"):
    """Apply fitted artifacts to another table; returns (full, model, tree)."""
    prepared = _prepared(df, row_id, artifacts["top"])
    full = apply_one_hot(add_logs(prepared, artifacts["logged"]), artifacts["categories"])
    return three_outputs(apply_scaler(full, artifacts["scaler"]), artifacts)


def save_artifacts(spark, artifacts: dict, path: str) -> None:
    """One JSON row; re-running overwrites it."""
    row = spark.createDataFrame([(json.dumps(artifacts),)], "artifacts string")
    row.coalesce(1).write.mode("overwrite").json(path)


def load_artifacts(spark, path: str) -> dict:
    loaded = json.loads(spark.read.schema("artifacts string").json(path).first()["artifacts"])
    loaded["scaler"] = {c: tuple(v) for c, v in loaded["scaler"].items()}
    return loaded


def features_and_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(features vector, label double) for ``pyspark.ml``."""
    from pyspark.ml.functions import array_to_vector

    inputs = [quoted(c).cast("double") for c in df.columns if c != label]
    return df.select(array_to_vector(F.array(*inputs)).alias("features"), F.col(label).cast("double").alias("label"))


def any_null(df: DataFrame) -> Column:
    return reduce(lambda a, b: a | b, [quoted(c).isNull() for c in df.columns])
