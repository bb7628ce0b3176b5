"""Training and hyper-parameter search with ``pyspark.ml``.

Input tables have a ``features`` vector, a 0/1 ``label`` and, where folds are used, an ``id``.
"""

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.ordinal import with_ordinal

SEED = 42
TASK_ROWS, MOST_TASK_ROWS, TASKS_A_CORE = 16_384, 524_288, 2

# The best settings of the comparison study.
BOOSTED_BEST = {"n_estimators": 1000, "max_depth": 4, "learning_rate": 0.01, "subsample": 0.7,
                "colsample_bytree": 0.8, "gamma": 0.1}
FOREST_BEST = {"n_estimators": 300, "max_depth": 10, "min_samples_leaf": 4, "max_features": 0.3, "bootstrap": True}
LOGISTIC_BEST = {"C": 897.9855655182433, "penalty": "elasticnet", "l1_ratio": 0.3433937943676302,
                 "class_weight": None, "max_iter": 2000}
NEURAL_BEST = {"hidden_layer_sizes": (128, 64), "batch_size": 256, "alpha": 1e-3, "max_iter": 300}

# The search spaces of the study. A pair ("log", lo, hi) or ("uniform", lo, hi) is continuous.
BOOSTED_SPACE = [{
    "n_estimators": [200, 300, 500, 700, 1000], "max_depth": [3, 4, 5, 6, 8],
    "learning_rate": [0.01, 0.05, 0.1, 0.2], "subsample": [0.6, 0.7, 0.8, 1.0],
    "colsample_bytree": [0.6, 0.7, 0.8, 1.0], "min_child_weight": [1, 3, 5], "gamma": [0, 0.1, 0.3, 0.5],
}]
FOREST_SPACE = [{
    "n_estimators": [100, 200, 300, 500], "max_depth": [None, 10, 20, 30, 40], "min_samples_leaf": [1, 2, 4, 8],
    "max_features": ["sqrt", "log2", 0.3, 0.5], "bootstrap": [True, False],
}]
LOGISTIC_SPACE = [
    {"C": ("log", 1e-3, 1e3), "penalty": ["l1", "l2"], "class_weight": [None, "balanced"], "max_iter": [2000]},
    {"C": ("log", 1e-3, 1e3), "penalty": ["elasticnet"], "l1_ratio": ("uniform", 0.1, 0.9),
     "class_weight": [None, "balanced"], "max_iter": [2000]},
]
NEURAL_SPACE = [{
    "hidden_layer_sizes": [(32,), (64,), (128,), (256,), (64, 32), (128, 64), (128, 32), (256, 128), (256, 32),
                           (128, 64, 32), (256, 128, 64), (256, 128, 64, 32)],
    "learning_rate_init": [1e-2, 1e-3, 5e-4, 3e-4, 1e-4], "batch_size": [32, 64, 128, 256],
}]
#: Settings of the study that Spark's learners have no counterpart for. Candidates that differ only in them are one.
WITHOUT_EFFECT = {"batch_size", "alpha", "reg_alpha", "reg_lambda", "min_samples_split", "activation"}
MAX_TREE_DEPTH = 30  # what Spark's trees allow; an unlimited depth becomes this


def class_counts(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).first()
    return row["n0"], row["n1"]


def with_attack_weight(df: DataFrame, name: str = "weight") -> DataFrame:
    """Weight n0/n1 on attacks and 1 on the rest."""
    n0, n1 = class_counts(df)
    return df.withColumn(name, F.when(F.col("label") == 1, n0 / n1).otherwise(1.0))


def with_balanced_weight(df: DataFrame, name: str = "weight") -> DataFrame:
    """Weight n / (2 n_c) on class c."""
    n0, n1 = class_counts(df)
    total = n0 + n1
    return df.withColumn(name, F.when(F.col("label") == 1, total / (2.0 * n1)).otherwise(total / (2.0 * n0)))


def boosted_trees(settings: dict = BOOSTED_BEST, weight: str | None = None, validation: str | None = None):
    """Gradient-boosted trees. Spark has no L1/L2 leaf penalties; ``gamma`` maps to the least gain."""
    s = {**BOOSTED_BEST, **settings}
    model = GBTClassifier(
        maxIter=s["n_estimators"], maxDepth=s["max_depth"], stepSize=s["learning_rate"],
        subsamplingRate=s["subsample"], featureSubsetStrategy=str(s["colsample_bytree"]),
        minInfoGain=float(s.get("gamma", 0)), minInstancesPerNode=s.get("min_child_weight", 1), seed=SEED,
    )
    if s["colsample_bytree"] >= 1.0:
        model.setFeatureSubsetStrategy("all")
    if weight:
        model.setWeightCol(weight)
    return model.setValidationIndicatorCol(validation) if validation else model


def random_forest(settings: dict = FOREST_BEST, weight: str | None = None):
    s = {**FOREST_BEST, **settings}
    model = RandomForestClassifier(
        numTrees=s["n_estimators"], maxDepth=min(s["max_depth"] or MAX_TREE_DEPTH, MAX_TREE_DEPTH),
        minInstancesPerNode=s["min_samples_leaf"], featureSubsetStrategy=str(s["max_features"]),
        bootstrap=s["bootstrap"], seed=SEED,
    )
    return model.setWeightCol(weight) if weight else model


def total_weight(df: DataFrame, weight: str | None = None) -> float:
    """The sum of the rows' weights, or their number without any."""
    return float(df.agg(F.count("*") if weight is None else F.sum(weight)).first()[0])


def logistic(total: float, settings: dict = LOGISTIC_BEST, weight: str | None = None):
    """Logistic regression; a penalty weight C over rows that weigh ``total`` is Spark's regParam 1 / (C total).

    Without weights ``total`` is the number of rows; with them their sum, as Spark divides the loss by it.
    """
    s = {**LOGISTIC_BEST, **settings}
    mix = {"l1": 1.0, "l2": 0.0}.get(s["penalty"], s.get("l1_ratio"))
    model = LogisticRegression(
        regParam=1.0 / (s["C"] * total), elasticNetParam=mix, maxIter=s["max_iter"], standardization=False
    )
    return model.setWeightCol(weight) if weight else model


def neural_net(inputs: int, settings: dict = NEURAL_BEST):
    """A multilayer perceptron with the study's layers; Spark's has sigmoid units and full batches.

    A learning rate asks for gradient descent, the only solver that takes steps of a given size; without one the
    quasi-Newton solver runs. Full batches leave nothing for ``batch_size`` to set.
    """
    s = {**NEURAL_BEST, **settings}
    rate = s.get("learning_rate_init")
    options = {} if rate is None else {"solver": "gd", "stepSize": rate}
    return MultilayerPerceptronClassifier(
        layers=[inputs, *s["hidden_layer_sizes"], 2], maxIter=s.get("max_iter", 300), seed=SEED, **options)


def loss_per_round(model, df: DataFrame) -> DataFrame:
    """Validation loss of a boosted model after every round."""
    losses = model.evaluateEachIteration(df)
    return df.sparkSession.createDataFrame(list(enumerate(map(float, losses), 1)), "round int, loss double")


def with_folds(df: DataFrame, k: int, row_id: str = "id", seed: int = SEED) -> DataFrame:
    """Add ``fold``: every class dealt out evenly over ``k`` folds in a seeded order.

    The deal is a distributed numbering per class, not a window over a class, which would be one task.
    """
    shuffled = df.withColumn("_order", F.xxhash64(row_id, F.lit(seed)))
    dealt = with_ordinal(shuffled, ["label"], ["_order", row_id], "_place")
    return dealt.withColumn("fold", (F.col("_place") % k).cast("int")).drop("_order", "_place")


def fit_tasks(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """How many tasks a fit should have: one for ``rows`` rows, but no more than cores can take in two turns.

    A fit runs thousands of jobs, and every task of a tree fit sends statistics of all open nodes. From
    ``MOST_TASK_ROWS`` rows a task on there are more tasks again, so that none holds too much.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(-(-n // rows), max(TASKS_A_CORE * cores, -(-n // MOST_TASK_ROWS))))


def packed(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` in at most ``fit_tasks`` tasks."""
    return df.coalesce(fit_tasks(df, rows))


def spread(df: DataFrame) -> DataFrame:
    """A stored table in the tasks of a fit, dealt out anew if its files would leave cores idle."""
    tasks, cores = fit_tasks(df), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < min(tasks, cores) else df.coalesce(tasks)


def draw(spaces: list[dict], n: int, seed: int = SEED) -> list[dict]:
    """``n`` seeded draws, each from one of the spaces; settings without effect are left out of them."""
    rng, out = random.Random(seed), []
    spaces = [{k: v for k, v in space.items() if k not in WITHOUT_EFFECT} for space in spaces]
    for _ in range(n):
        settings = {}
        for name, options in rng.choice(spaces).items():
            if isinstance(options, tuple):
                kind, lo, hi = options
                value = rng.uniform(math.log(lo), math.log(hi)) if kind == "log" else rng.uniform(lo, hi)
                settings[name] = math.exp(value) if kind == "log" else value
            else:
                settings[name] = rng.choice(options)
        out.append(settings)
    return out


def expand(grid: dict) -> list[dict]:
    """All combinations of a grid."""
    out = [{}]
    for name, options in grid.items():
        out = [{**settings, name: option} for settings in out for option in options]
    return out


def refined_grid(best: dict, points: int = 5) -> dict:
    """A tight grid around the best logistic settings: C half a decade either way, l1_ratio 0.2."""
    spread = lambda lo, hi: [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    middle = math.log10(best["C"])
    grid = {"C": [10 ** x for x in spread(middle - 0.5, middle + 0.5)], "penalty": [best["penalty"]],
            "class_weight": [None, "balanced"], "max_iter": [2000]}
    if best["penalty"] == "elasticnet":
        l1 = best["l1_ratio"]
        grid["l1_ratio"] = [min(max(x, 0.01), 0.99) for x in spread(l1 - 0.2, l1 + 0.2)]
    return grid


def evaluator(metric: str):
    if metric == "roc_auc":
        return BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)
    return MulticlassClassificationEvaluator(metricName=metric)


def search(df: DataFrame, build, candidates: list[dict], folds: int = 3, metric: str = "roc_auc",
           parallelism: int = 4) -> list[dict]:
    """Cross-validate every candidate; results best first, with ``rank``, mean, deviation and train mean.

    ``build(settings, total)`` gets the sum of the weights and makes an estimator; a ``class_weight`` of ``"balanced"`` is applied here.
    Fits run side by side, each of them distributed. Folds are cached once for all candidates.
    """
    dealt = packed(with_balanced_weight(with_folds(df, folds), "_balanced")).persist()
    score = evaluator(metric)

    def run(job: tuple[int, int]) -> tuple[float, float]:
        candidate, fold = job
        settings = candidates[candidate]
        train, held_out = dealt.filter(F.col("fold") != fold), dealt.filter(F.col("fold") == fold)
        balanced = settings.get("class_weight") == "balanced"
        estimator = build(settings, total_weight(train, "_balanced" if balanced else None))
        if balanced:
            estimator.setWeightCol("_balanced")
        model = estimator.fit(train)
        return score.evaluate(model.transform(held_out)), score.evaluate(model.transform(train))

    jobs = [(c, f) for c in range(len(candidates)) for f in range(folds)]
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            scores = dict(zip(jobs, pool.map(run, jobs)))
    finally:
        dealt.unpersist()
    results = []
    for c, settings in enumerate(candidates):
        held_out = [scores[c, f][0] for f in range(folds)]
        mean = sum(held_out) / folds
        results.append({
            "settings": settings, "mean_score": mean,
            "std_score": math.sqrt(sum((x - mean) ** 2 for x in held_out) / folds),
            "mean_train_score": sum(scores[c, f][1] for f in range(folds)) / folds,
        })
    results.sort(key=lambda r: -r["mean_score"])
    for rank, r in enumerate(results, 1):
        r["rank"] = rank
    return results


def search_table(spark, results: list[dict], top: int = 10) -> DataFrame:
    rows = [(r["rank"], json.dumps(r["settings"], default=str), r["mean_score"], r["std_score"],
             r["mean_train_score"]) for r in results[:top]]
    schema = "rank int, settings string, mean_score double, std_score double, mean_train_score double"
    return spark.createDataFrame(rows, schema)


def sweep_c(train: DataFrame, held_out: DataFrame, values: list[float] | None = None,
            settings: dict | None = None) -> DataFrame:
    """Train and validation accuracy per C, by default 20 values from 1e-3 to 1e3."""
    values = values or [10 ** (-3 + 6 * i / 19) for i in range(20)]
    rows, score = train.count(), evaluator("accuracy")
    out = []
    for c in values:
        model = logistic(rows, {"penalty": "l2", **(settings or {}), "C": c}).fit(train)
        out.append((c, score.evaluate(model.transform(train)), score.evaluate(model.transform(held_out))))
    return train.sparkSession.createDataFrame(out, "C double, train_acc double, val_acc double")


def best_c(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("val_acc"), "C").limit(1)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
