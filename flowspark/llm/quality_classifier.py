"""Quality classifier by co-training on two views of a document.

The text view sees which hashed words occur, and how they are written (marks around words, capitals, how
often words recur). The metadata view sees language, source and size. Both are logistic models, fitted on a bounded sample of labelled rows over those
features that the sample's labels depend on, each weighed by its log odds; over a few rounds each scores all
unlabelled documents and hands every confident label to the other. Both kinds weigh the same in a fit, and within a
kind the labels handed over weigh at most as much as the given ones. A last, small logistic model over the two views' log odds, fitted on labelled rows kept aside, calibrates and
combines them. A threshold that lets through all but a small share of the good rows kept aside decides.

A document counts as good when its quality label is 1 and it is not marked toxic.

All documents are scored, in one pass without a shuffle: weights have a fixed size and are sent to the tasks.

Defined cases: a null or empty text has no words and is judged by its metadata and the models' constants; null
metadata count as a value of their own; a null in a label row leaves the row out, and among label rows of one id the
worst counts; ids repeated in the documents are scored one by one, and a labelled one is fitted on its smallest features;
ties in sampling are broken by id; without labels of both kinds, in the part fitted on and in the part kept aside, there is
nothing to learn from and all documents are kept, with a score of 1; an empty document table gives an empty result; texts
of any length are read whole; columns named like a result are replaced.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowspark.llm.memory import alone, remembered
from flowspark.llm.tables import stored
from flowspark.session import ship_package

#: Labelled rows used for fitting, and the share of them kept aside for calibration. Unlabelled rows have no bound.
FIT_ROWS, ASIDE = 12_000, 0.25
ROUNDS, CONFIDENT = 2, 0.98
TEXT_BITS, META_BITS = 19, 10
GOOD_LOST, SIGNIFICANT = 0.003, 12.0
MEMORY_WORDS = 300_000
#: Rows of a batch that are unpacked at once.
SLICE_ROWS = 512

_SHAPE = regex.compile(r"\p{L}+|\p{N}+")


class _Features(dict):
    """Feature numbers of a word, filled on demand and emptied when full."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        body = _SHAPE.sub("a", word)
        low = word.lower().strip(".,;:!?\"'()")
        names = ["w" + low, "s" + body]
        if len(low) > 1 and word.isupper():
            names.append("c")
        value = self[word] = tuple(xxhash.xxh3_64_intdigest(n) & ((1 << TEXT_BITS) - 1) for n in names)
        return value


_features = remembered(_Features())


def text_features(text: str | None) -> np.ndarray:
    """Sorted numbers of the features that occur in a text."""
    every = (text or "").split()
    words = set(every)
    found = {f for w in words for f in _features[w]}
    variety = f"v{20 * len(words) // max(1, len(every))},{len(every).bit_length()}"
    found.add(xxhash.xxh3_64_intdigest(variety) & ((1 << TEXT_BITS) - 1))
    return np.array(sorted(found), np.int32)


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Sorted numbers of the metadata features: values, and the size in powers of two."""
    size = "none" if n_chars is None else str(max(0, int(n_chars)).bit_length())
    names = [f"lang={lang}", f"source={source}", f"size={size}", f"lang={lang},size={size}"]
    return np.array(sorted({xxhash.xxh3_64_intdigest(n) & ((1 << META_BITS) - 1) for n in names}), np.int32)


@dataclass(frozen=True)
class Models:
    """Weights and constants of both views, and of the model that combines their log odds."""

    text: np.ndarray
    text_constant: float
    meta: np.ndarray
    meta_constant: float
    combine: tuple[float, float, float]  # weight of text, weight of metadata, constant
    threshold: float

    def odds(self, text: np.ndarray, meta: np.ndarray) -> tuple[float, float]:
        return (float(self.text[text].sum()) + self.text_constant,
                float(self.meta[meta].sum()) + self.meta_constant)

    def score(self, text_odds, meta_odds):
        a, b, c = self.combine
        return 1 / (1 + np.exp(-np.clip(a * text_odds + b * meta_odds + c, -40, 40)))


def _mapped(df: DataFrame, key: str, text: str, meta: tuple[str, str, str], run, schema) -> DataFrame:
    columns = [F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("t"),
               F.col(f"`{meta[0]}`").cast("string").alias("a"), F.col(f"`{meta[1]}`").cast("string").alias("b"),
               F.col(f"`{meta[2]}`").cast("long").alias("c")]
    return df.select(*columns).mapInArrow(run, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray], list[np.ndarray]]]:
    """Ids and both views' feature numbers, a few rows at a time: a batch's texts are not unpacked all at once."""
    alone(_features)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            rows = part.to_pydict()
            yield (part.column("doc"), [text_features(t) for t in rows["t"]],
                   [meta_features(*m) for m in zip(rows["a"], rows["b"], rows["c"])])


def _feature_rows(df: DataFrame, key: str, text: str, meta: tuple[str, str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, words, extra in _read(batches):
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(words, pa.list_(pa.int32())), pa.array(extra, pa.list_(pa.int32()))],
                names=["doc", "words", "extra"])

    return _mapped(df, key, text, meta, run, "doc bigint, words array<int>, extra array<int>")


def _vector_rows(df: DataFrame, key: str, text: str, meta: tuple[str, str, str], views: dict) -> DataFrame:
    """(doc, text, meta), the views as vectors. Made where the texts are read, so a task has one Python worker."""
    sent = df.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = sent.value
        for doc, words, extra in _read(batches):
            yield pa.RecordBatch.from_arrays(
                [doc, _arrow_vectors(words, *views["text"]), _arrow_vectors(extra, *views["meta"])],
                names=["doc", "text", "meta"])

    return _mapped(df, key, text, meta, run, StructType([
        StructField("doc", LongType()), StructField("text", VectorUDT()), StructField("meta", VectorUDT())]))


def _informative(rows: DataFrame, column: str, bits: int, good: int, bad: int) -> tuple[np.ndarray, np.ndarray]:
    """For every feature number its place among the features kept (or -1), and its log odds of good to bad.

    Kept are features whose counts differ between good and bad rows by more than chance would let them (chi-squared
    over ``SIGNIFICANT``). At most 2^bits counts come to the driver, whatever the number of rows.
    """
    counts = rows.select("label", F.explode(column).alias("f")).groupBy("f").agg(
        F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).toArrow()
    seen = np.zeros((2, 1 << bits))
    at = counts.column("f").to_numpy()
    seen[0, at], seen[1, at] = counts.column("good").to_numpy(), counts.column("bad").to_numpy()
    total = seen.sum(axis=0)
    expected = np.maximum(total * good / (good + bad), 1e-9), np.maximum(total * bad / (good + bad), 1e-9)
    chi = (seen[0] - expected[0]) ** 2 / expected[0] + (seen[1] - expected[1]) ** 2 / expected[1]
    odds = np.log((seen[0] + 0.5) / (good + 1)) - np.log((seen[1] + 0.5) / (bad + 1))
    kept = np.flatnonzero((total > 0) & (chi > SIGNIFICANT))
    place = np.full(1 << bits, -1, np.int32)
    place[kept] = np.arange(len(kept))
    return place, odds


def _entries(numbers, place: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the features kept, by place."""
    numbers = np.array(numbers, np.int64)
    numbers = numbers[place[numbers] >= 0]
    at = place[numbers]
    order = np.argsort(at)
    return at[order], odds[numbers][order]


def _width(place: np.ndarray) -> int:
    return max(1, int(place.max()) + 1)


def _vector(place: np.ndarray, odds: np.ndarray):
    size = _width(place)
    return F.udf(lambda numbers: Vectors.sparse(size, *(x.tolist() for x in _entries(numbers, place, odds))), VectorUDT())


def _arrow_vectors(rows: list[np.ndarray], place: np.ndarray, odds: np.ndarray) -> pa.StructArray:
    """The rows' sparse vectors in the layout of ``VectorUDT``."""
    found = [_entries(numbers, place, odds) for numbers in rows]
    offsets = np.cumsum([0, *(len(at) for at, _ in found)]).astype(np.int32)
    indices = pa.ListArray.from_arrays(offsets, np.concatenate([at for at, _ in found]).astype(np.int32))
    values = pa.ListArray.from_arrays(offsets, np.concatenate([odds for _, odds in found]))
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(len(rows), np.int8)), pa.array(np.full(len(rows), _width(place), np.int32)), indices, values],
        names=["type", "size", "indices", "values"])


def _sample(labels: DataFrame, docs: DataFrame, key: str, good: str, bad: str) -> tuple[DataFrame, DataFrame]:
    """A bounded sample of labelled ids (doc, label, aside), chosen by hash, so at random; and all ids with a label."""
    clean = labels.where(F.col(f"`{key}`").isNotNull() & F.col(good).isNotNull()).groupBy(
        F.col(f"`{key}`").cast("long").alias("doc")).agg(
        (F.min(good).cast("int") - F.coalesce(F.max(bad), F.lit(0)).cast("int")).alias("v"))
    clean = clean.select("doc", (F.col("v") == 1).cast("double").alias("label"), F.xxhash64("doc").alias("h"))
    ids = docs.select(F.col(f"`{key}`").cast("long").alias("doc")).where("doc is not null").distinct()
    fit = clean.join(ids, "doc", "left_semi").orderBy("h", "doc").limit(FIT_ROWS)
    fit = fit.withColumn("aside", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1000)) < int(1000 * ASIDE)).drop("h")
    return fit, clean.select("doc")


def _weights(labelled: dict[float, int], given: dict[float, int]) -> tuple[dict, dict]:
    """Row weights by kind, of labelled rows and of those handed over."""
    share = {k: min(1.0, n / given[k]) if given.get(k) else 1.0 for k, n in labelled.items()}
    own = {k: 0.5 * sum(labelled.values()) / (n + share[k] * given.get(k, 0)) for k, n in labelled.items()}
    return own, {k: own[k] * share[k] for k in own}


def _weighed(rows: DataFrame, weights: dict[float, float]) -> DataFrame:
    return rows.withColumn("w", F.when(F.col("label") == 1, weights[1.0]).otherwise(weights[0.0]))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, meta: tuple[str, str, str], good: str = "quality",
        bad: str = "toxic") -> Models | None:
    """Fit both views; None where there are not labels of both kinds."""
    ship_package(docs.sparkSession)
    labelled, with_label = _sample(labels, docs, key, good, bad)
    wanted = stored(labelled, "sample")
    # At most FIT_ROWS ids, so they can be sent to every task.
    chosen = docs.join(F.broadcast(wanted.select("doc")), F.col(f"`{key}`").cast("long") == F.col("doc"), "left_semi")
    one = _feature_rows(chosen, key, text, meta).groupBy("doc").agg(F.min(F.struct("words", "extra")).alias("f"))
    numbered = one.select("doc", "f.*").join(F.broadcast(wanted), "doc")
    numbered = stored(numbered.coalesce(8), "sample")
    counts = {(r["label"], r["aside"]): r["n"]
              for r in numbered.groupBy("label", "aside").agg(F.count("*").alias("n")).collect()}
    if any(not counts.get((label, aside)) for label in (0.0, 1.0) for aside in (False, True)):
        return None
    train = numbered.where("not aside")
    views = {"text": _informative(train, "words", TEXT_BITS, counts[1.0, False], counts[0.0, False]),
             "meta": _informative(train, "extra", META_BITS, counts[1.0, False], counts[0.0, False])}
    vectors = [_vector(*views["text"])("words").alias("text"), _vector(*views["meta"])("extra").alias("meta")]
    rows = stored(numbered.select("label", "aside", *vectors), "features")
    # Features first: they are far smaller than the texts, which must not be dealt out to find labelled ids.
    every = stored(_vector_rows(docs, key, text, meta, views), "features")
    unknown = stored(every.where("doc is not null").join(with_label, "doc", "left_anti").unionByName(
        every.where("doc is null")).drop("doc"), "unlabelled")

    known = rows.where("not aside")
    labelled_counts = {label: counts[label, False] for label in (0.0, 1.0)}
    told = {"text": None, "meta": None}
    for round_ in range(ROUNDS + 1):
        models = {}
        for view in ("text", "meta"):
            given = {} if told[view] is None else {
                r["label"]: r["n"] for r in told[view].groupBy("label").agg(F.count("*").alias("n")).collect()}
            own, handed = _weights(labelled_counts, given)
            train = _weighed(known.select("label", view), own)
            if given:
                train = train.union(_weighed(told[view].select("label", view), handed))
            models[view] = LogisticRegression(
                featuresCol=view, labelCol="label", weightCol="w", maxIter=60, regParam=1e-3,
                standardization=False).fit(train)
        if round_ < ROUNDS:
            for view, other in (("text", "meta"), ("meta", "text")):
                p = F.array_max(vector_to_array(F.col("probability")))
                told[other] = models[view].transform(unknown).where(p >= CONFIDENT).select(
                    F.col("prediction").alias("label"), other)
    return _combined(rows.where("aside"), models, views)


def _combined(aside: DataFrame, models: dict, views: dict) -> Models:
    """Calibrate and join the views on rows kept aside (at most FIT_ROWS of two numbers each, on the driver)."""
    scored = aside.select("label", "text", "meta")
    for view, model in models.items():
        scored = model.setRawPredictionCol(f"{view}_raw").setProbabilityCol(f"{view}_p").setPredictionCol(
            f"{view}_is").transform(scored)
    table = scored.select("label", vector_to_array(F.col("text_raw"))[1].alias("t"), vector_to_array(F.col("meta_raw"))[1].alias("m")).toPandas()
    x = np.column_stack([table["t"], table["m"], np.ones(len(table))])
    y = table["label"].to_numpy()
    w = np.zeros(3)
    for _ in range(50):  # Newton steps of a ridge logistic model with three numbers
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    weights = {}
    for view, (place, odds) in views.items():
        weights[view] = np.where(place >= 0, models[view].coefficients.toArray()[np.maximum(place, 0)] * odds, 0.0)
    found = Models(weights["text"], float(models["text"].intercept), weights["meta"], float(models["meta"].intercept),
                   tuple(w), 0.5)
    good = found.score(table["t"].to_numpy(), table["m"].to_numpy())[y == 1]
    return Models(found.text, found.text_constant, found.meta, found.meta_constant, found.combine,
                  float(min(0.5, np.quantile(good, GOOD_LOST))))


def score(docs: DataFrame, models: Models | None, text: str, meta: tuple[str, str, str],
          keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with ``p_text``, ``p_meta``, ``score`` and ``kept``."""
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.drop("p_text", "p_meta", "score", "kept")
    names, at = base.columns, [base.columns.index(c) for c in (text, *meta)]
    names = [n for n in names if keep is None or n in keep]
    if models is None:
        unknown = [F.lit(None).cast("double").alias(c) for c in ("p_text", "p_meta")]
        return base.select(*[f"`{n}`" for n in names], *unknown, F.lit(1.0).alias("score"), F.lit(True).alias("kept"))
    held = [base.columns.index(n) for n in names]
    fields = ", ".join(f"`{n}` {base.schema[n].dataType.simpleString()}" for n in names)
    sent = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        alone(_features)
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                odds = np.array([m.odds(text_features(t.as_py()), meta_features(a.as_py(), b.as_py(), c.as_py()))
                                 for t, a, b, c in zip(*(part.column(i) for i in at))])
                total = m.score(odds[:, 0], odds[:, 1])
                text_p, meta_p = (1 / (1 + np.exp(-np.clip(o, -40, 40))) for o in odds.T)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in held] + [pa.array(text_p), pa.array(meta_p), pa.array(total), pa.array(total >= m.threshold)],
                    names=[*names, "p_text", "p_meta", "score", "kept"])

    return base.mapInArrow(run, fields + ", p_text double, p_meta double, score double, kept boolean")
