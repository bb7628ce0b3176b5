"""Classifier evaluation from (score, label) rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators.ordinal import exact_places, with_ordinal, with_running_totals

CLASS_NAMES = {0: "Normal", 1: "Attack"}


def attack_probability(column: str = "probability") -> Column:
    """Probability of class 1 out of a ``pyspark.ml`` probability vector."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))[1]


def predicted(prob: Column | str = "prob", threshold: float = 0.5) -> Column:
    prob = F.col(prob) if isinstance(prob, str) else prob
    return (prob >= F.lit(float(threshold))).cast("int")


def _cells(prediction: Column, label: str = "label") -> dict[str, Column]:
    attack, alarm = F.col(label) == 1, prediction == 1
    return {
        "tp": F.count_if(attack & alarm), "fp": F.count_if(~attack & alarm),
        "fn": F.count_if(attack & ~alarm), "tn": F.count_if(~attack & ~alarm),
    }


def confusion(df: DataFrame, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    cells = _cells(predicted(prob, threshold))
    return df.agg(*[cells[c].alias(c) for c in ("tn", "fp", "fn", "tp")])


def confusion_matrix(df: DataFrame, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    """All four cells as (actual, predicted, n) rows, empty cells included."""
    row = confusion(df, threshold, prob)
    cell = lambda a, p, c: F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
    cells = F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))
    return row.select(F.explode(cells).alias("c")).select("c.*")


def safe(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator).otherwise(0.0)


def f1(precision: Column, recall: Column) -> Column:
    return safe(2 * precision * recall, precision + recall)


def scalar_metrics(df: DataFrame, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    c = F.col
    return confusion(df, threshold, prob).select(
        F.lit(float(threshold)).alias("threshold"),
        safe(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"),
        safe(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        safe(c("tp"), c("tp") + c("fn")).alias("recall"),
    )


def classification_report(df: DataFrame, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    """Per-class precision, recall, f1 and support, then accuracy, macro and weighted rows."""
    c = F.col
    negatives, positives = c("tn") + c("fp"), c("tp") + c("fn")
    rows = {
        CLASS_NAMES[0]: (safe(c("tn"), c("tn") + c("fn")), safe(c("tn"), negatives), negatives),
        CLASS_NAMES[1]: (safe(c("tp"), c("tp") + c("fp")), safe(c("tp"), positives), positives),
    }
    scores = {name: (p, r, f1(p, r), n) for name, (p, r, n) in rows.items()}
    total = negatives + positives
    accuracy = safe(c("tp") + c("tn"), total)
    a, b = scores.values()
    mean = lambda i: (a[i] + b[i]) / 2
    weighted = lambda i: safe(a[i] * a[3] + b[i] * b[3], total)
    lines = {
        **scores, "accuracy": (accuracy, accuracy, accuracy, total),
        "macro avg": (*map(mean, range(3)), total), "weighted avg": (*map(weighted, range(3)), total),
    }
    names = ("precision", "recall", "f1", "support")
    entries = [
        F.struct(F.lit(label).alias("class"), *[v.alias(n) for v, n in zip(values, names)])
        for label, values in lines.items()
    ]
    return confusion(df, threshold, prob).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def score_groups(df: DataFrame, prob: str = "prob", label: str = "label") -> DataFrame:
    """Distinct scores from high to low with their own and running positive and negative counts."""
    attack = F.col(label) == 1
    groups = df.groupBy(F.col(prob).alias("threshold")).agg(
        F.count_if(attack).alias("pos"), F.count_if(~attack).alias("neg")
    )
    return with_running_totals(groups, [F.desc("threshold")], {"tps": "pos", "fps": "neg"})


def roc_curve(df: DataFrame, prob: str = "prob", drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) from the strictest threshold on, after the (0, 0) start with NULL threshold.

    ``drop_intermediate`` leaves out points inside a straight stretch: those whose score group has the
    same counts as the next lower score's.
    """
    groups = score_groups(df, prob)
    if drop_intermediate:
        ranked = with_ordinal(groups.withColumn("_down", -F.col("threshold")), [], ["_down"], "rank")
        following = ranked.select(
            (F.col("rank") - 1).alias("rank"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg")
        )
        corner = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        last_or_corner = F.coalesce(corner, F.lit(True))
        groups = ranked.join(following, "rank", "left").filter(last_or_corner)
    points = groups.select(
        "threshold", safe(F.col("fps"), F.col("all_fps")).alias("fpr"),
        safe(F.col("tps"), F.col("all_tps")).alias("tpr"),
    )
    start = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def pr_curve(df: DataFrame, prob: str = "prob") -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the (1, 0) end with NULL threshold."""
    points = score_groups(df, prob).select(
        "threshold", safe(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
        safe(F.col("tps"), F.col("all_tps")).alias("recall"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def ranking_metrics(df: DataFrame, prob: str = "prob") -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision (step sum) in one row."""
    c = F.col
    groups = score_groups(df, prob)
    # Pairs are summed in doubles: their number is quadratic in the rows and outgrows a BIGINT.
    ordered_pairs = c("neg").cast("double") * ((c("tps") - c("pos")) + c("pos") / 2.0)
    gained = c("pos") * safe(c("tps"), c("tps") + c("fps"))
    sums = groups.agg(
        F.sum(ordered_pairs).alias("pairs"), F.sum(gained).alias("gained"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
    )
    return sums.select(
        safe(c("pairs"), c("positives").cast("double") * c("negatives")).alias("roc_auc"),
        safe(c("gained"), c("positives")).alias("average_precision"),
    )


def threshold_sweep(df: DataFrame, first: int = 1, last: int = 99, prob: str = "prob") -> DataFrame:
    """f1, recall, precision and accuracy at thresholds ``first/100 .. last/100``, in one pass.

    Every row only says how many thresholds it reaches; about a hundred counters are summed from the top.
    """
    p = F.col(prob).cast("double")
    near = F.floor(p * 100).cast("int")
    reached = (
        F.when((near + 1) / F.lit(100.0) <= p, near + 1).when(near / F.lit(100.0) > p, near - 1).otherwise(near)
    )
    reached = F.least(F.greatest(reached, F.lit(first - 1)), F.lit(last))
    attack = F.col("label") == 1
    steps = df.groupBy(reached.alias("k")).agg(F.count_if(attack).alias("pos"), F.count_if(~attack).alias("neg"))
    grid = F.explode(F.sequence(F.lit(first), F.lit(last)))  # on at most last - first + 2 rows
    at = steps.withColumn("t", grid).groupBy("t").agg(
        F.sum(F.when(F.col("k") >= F.col("t"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("k") >= F.col("t"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("k") < F.col("t"), F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("k") < F.col("t"), F.col("neg")).otherwise(0)).alias("tn"),
    )
    c = F.col
    return at.select(
        (c("t") / F.lit(100.0)).alias("threshold"),
        safe(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        safe(c("tp"), c("tp") + c("fn")).alias("recall"),
        safe(c("tp"), c("tp") + c("fp")).alias("precision"),
        safe(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"),
    )


def best_threshold(df: DataFrame, metric: str = "f1", first: int = 1, last: int = 99,
                   prob: str = "prob") -> DataFrame:
    """The sweep row with the highest ``metric``; the smallest threshold wins a tie."""
    return threshold_sweep(df, first, last, prob).orderBy(F.desc(metric), "threshold").limit(1)


def compare_thresholds(df: DataFrame, thresholds: dict[str, float], prob: str = "prob") -> DataFrame:
    """Confusion cells at several named thresholds, one pass over the rows."""
    counts = {}
    for name, t in thresholds.items():
        for cell, count in _cells(predicted(prob, t)).items():
            counts[f"{name}_{cell}"] = count
    row = df.agg(*[v.alias(k) for k, v in counts.items()])
    entries = [
        F.struct(F.lit(name).alias("setting"), F.lit(float(t)).alias("threshold"),
                 *[F.col(f"{name}_{cell}").alias(cell) for cell in ("tn", "fp", "fn", "tp")])
        for name, t in thresholds.items()
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def attach_predictions(predictions: DataFrame, raw: DataFrame, row_id: str = "id") -> DataFrame:
    """Predictions joined to the raw rows they came from, by id."""
    return predictions.join(raw, row_id)


def attack_breakdown(df: DataFrame, threshold: float = 0.5, category: str = "attack_cat",
                     normal: str = "Normal", prob: str = "prob") -> DataFrame:
    """count, precision, recall and f1 (4 digits) per attack category, worst recall first."""
    cells = _cells(predicted(prob, threshold))
    grouped = df.filter(F.col(category) != normal).groupBy(category).agg(
        F.count("*").alias("count"), *[cells[c].alias(c) for c in ("tp", "fp", "fn")]
    )
    c = F.col
    precision, recall = safe(c("tp"), c("tp") + c("fp")), safe(c("tp"), c("tp") + c("fn"))
    return grouped.select(
        category, "count", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
        F.round(f1(precision, recall), 4).alias("f1"),
    ).orderBy("recall", category)


def seeded_sample(df: DataFrame, n: int, row_id: str = "id", seed: int = 42) -> DataFrame:
    """``n`` rows, the same ones on every run and any partitioning."""
    return df.orderBy(F.xxhash64(row_id, F.lit(seed)), row_id).limit(n)


def score_parity(a: DataFrame, b: DataFrame, row_id: str = "id", threshold: float = 0.5) -> DataFrame:
    """Largest score difference and share of equal labels between two scorings of the same rows."""
    left = a.select(row_id, F.col("prob").cast("double").alias("_pa"))
    right = b.select(row_id, F.col("prob").cast("double").alias("_pb"))
    same = ((F.col("_pa") >= threshold) == (F.col("_pb") >= threshold)).cast("int")
    return left.join(right, row_id).agg(
        F.count("*").alias("rows"), F.max(F.abs(F.col("_pa") - F.col("_pb"))).alias("max_diff"),
        F.avg(same).alias("label_match"),
    )


def subnet_check(scored: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Flagged and total flows with an endpoint under each named address prefix."""
    touches = lambda p: F.col("srcip").startswith(p) | F.col("dstip").startswith(p)
    measures = []
    for i, prefix in enumerate(prefixes.values()):
        measures += [
            F.count_if(touches(prefix)).alias(f"t{i}"),
            F.count_if(touches(prefix) & (F.col("label") == 1)).alias(f"f{i}"),
        ]
    entries = [
        F.struct(F.lit(name).alias("subnet"), F.col(f"f{i}").alias("flagged"), F.col(f"t{i}").alias("total"))
        for i, name in enumerate(prefixes)
    ]
    return scored.agg(*measures).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def unseen_categories(served: DataFrame, trained: DataFrame, columns: list[str]) -> DataFrame:
    """Category values that serving data has and training data lacks."""
    def values(df: DataFrame) -> DataFrame:
        pairs = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
        ]))
        return df.select(pairs.alias("p")).select("p.*").distinct()

    return values(served).join(values(trained), ["column", "value"], "left_anti")


def median_ratios(served: DataFrame, trained: DataFrame, columns: list[str]) -> DataFrame:
    """Median of each column in serving data over its median in training data (NULL over 0)."""
    def melted(df: DataFrame, side: str) -> DataFrame:
        pairs = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
        ]))
        return df.select(F.lit(side).alias("side"), pairs.alias("p")).select("side", "p.*")

    middles = {"low": F.expr("(total - 1) div 2"), "high": F.expr("total div 2")}
    middle = exact_places(
        melted(served, "served").unionByName(melted(trained, "trained")), ["side", "column"], "value", middles
    ).withColumn("median", (F.col("low") + F.col("high")) / 2)
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("median")))
    both = middle.groupBy("column").agg(of("served").alias("served"), of("trained").alias("trained"))
    ratio = F.when(F.col("trained") != 0, F.col("served") / F.col("trained"))
    return both.select("column", "served", "trained", ratio.alias("ratio"))


def evaluate(df: DataFrame, threshold: float = 0.5, prob: str = "prob") -> dict[str, DataFrame]:
    """All standard tables of one scored set."""
    return {
        "scalars": scalar_metrics(df, threshold, prob), "confusion": confusion_matrix(df, threshold, prob),
        "report": classification_report(df, threshold, prob), "ranking": ranking_metrics(df, prob),
        "roc": roc_curve(df, prob), "precision_recall": pr_curve(df, prob),
    }
