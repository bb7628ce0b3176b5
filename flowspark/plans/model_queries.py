"""Queries that train, search and explain classifiers on flows.

The label is the attacker subnet, so addresses are not among the inputs. Models have the best settings of the
study and searches its spaces, draws and folds. Models are fitted on four of five stratified folds and judged,
permuted and traced per round on the fifth. As in the study only the boosted trees weigh attacks; the other
models have no class weight. Fitting has no SQL form.
"""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowspark.contracts import MODEL_COLUMNS
from flowspark.functions.encode import encode_flows, feature_vector
from flowspark.operators import alerts as A
from flowspark.operators import evaluation as E
from flowspark.operators import explain as X
from flowspark.operators import paths as P
from flowspark.operators import training as M
from flowspark.operators.scoring import score_vectors
from flowspark.plans.inputs import flows, once
from flowspark.plans.oracle import over_flows
from flowspark.plans.registry import query
from flowspark.session import stored

PARTS = 5  # one of them is kept for judging
DRAWS, FOLDS, REPEATS = 50, 5, 10
INPUTS = [c for c in MODEL_COLUMNS if c not in ("sttl", "dttl", "ct_state_ttl")]
_models = {}


def training_table(spark, folder):
    """(id, features, label): scale-free inputs, without the TTLs that give the label away."""
    def build():
        df = flows(spark, folder)
        places = [MODEL_COLUMNS.index(c) for c in INPUTS]
        vector = feature_vector(df)
        kept = F.array(*[F.log1p(F.col("v")[i]) for i in places])
        return df.select(
            F.xxhash64("capture_id", "emit_no").alias("id"),
            F.startswith("srcip", F.lit("175.45.176.")).cast("double").alias("label"), vector.alias("v"),
        ).select("id", "label", array_to_vector(kept).alias("features"))

    return once("training", spark, folder, build)


def _parts(spark, folder):
    return once("parts", spark, folder, lambda: M.packed(M.with_folds(training_table(spark, folder), PARTS)))


def train_rows(spark, folder):
    return _parts(spark, folder).filter("fold > 0").drop("fold")


def test_rows(spark, folder):
    return _parts(spark, folder).filter("fold = 0").drop("fold")


def estimator(kind, df):
    """The study's model of a kind, for rows that carry ``weight``."""
    builders = {
        "boost": lambda: M.boosted_trees(weight="weight"),
        "forest": M.random_forest,
        "linear": lambda: M.logistic(M.total_weight(df)),
        "net": lambda: M.neural_net(len(INPUTS)),
    }
    return builders[kind]()


def fitted(kind, spark, folder):
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _models:
        df = M.with_attack_weight(M.spread(train_rows(spark, folder)))
        _models[key] = estimator(kind, df).fit(df)
    return _models[key]


def scores(kind, spark, folder):
    """Scores of the rows that no model was fitted on."""
    out = fitted(kind, spark, folder).transform(test_rows(spark, folder))
    return out.select("id", F.col("label").cast("int").alias("label"), E.attack_probability().alias("prob"))


def _quality(kind):
    def build(spark, folder):
        scored = scores(kind, spark, folder)
        return E.scalar_metrics(scored).join(E.ranking_metrics(scored), F.lit(True)).select(
            F.lit(kind).alias("model"), "accuracy", "f1", "recall", "roc_auc", "average_precision"
        )

    return build


_QUALITY = "model string, accuracy double6, f1 double6, recall double6, roc_auc double6, average_precision double6"
for _kind, _name in (("boost", "boosted_trees"), ("forest", "random_forest"), ("linear", "logistic_regression"),
                     ("net", "neural_net")):
    query(_QUALITY, None, f"{_name}_quality")(_quality(_kind))


_LABELS = "(select case when starts_with(srcip, '175.45.176.') then 1.0 else 0.0 end as \"label\" from flows) l"


def _judged(kind):
    def build(spark, folder):
        """The rows that the model was not fitted on all have a probability, and attacks rank above the rest."""
        scored = scores(kind, spark, folder)
        counted = scored.agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("attacks"),
                             F.bool_and(F.col("prob").between(0, 1)).alias("in_range"))
        ranked = E.ranking_metrics(scored).select((F.col("roc_auc") > 0.5).alias("above_chance"))
        return counted.join(ranked, F.lit(True)).select(F.lit(kind).alias("model"), "*")

    return build


for _kind, _name in (("boost", "boosted_trees"), ("forest", "random_forest"), ("linear", "logistic_regression"),
                     ("net", "neural_net")):
    query("model string, n bigint, attacks bigint, in_range boolean, above_chance boolean", over_flows(f"""
select '{_kind}' model, sum((n + {PARTS - 1}) // {PARTS})::bigint n, sum(case when "label" = 1 then (n + {PARTS - 1}) // {PARTS} else 0 end)::bigint attacks,
  true in_range, true above_chance
from (select "label", count(*) n from {_LABELS} group by 1) c"""), f"{_name}_judged")(_judged(_kind))


@query("label double, weight double6, n bigint", over_flows(f"""
select "label", sum(n) over () / cast(2 * n as double) weight, n
from (select "label", count(*) n from {_LABELS} group by 1) c"""))
def class_weights(spark, folder):
    weighted = M.with_balanced_weight(training_table(spark, folder))
    return weighted.groupBy("label", "weight").agg(F.count("*").alias("n"))


@query("label double, weight double6, n bigint", over_flows(f"""
select "label", case when "label" = 1 then (sum(n) over () - n) / cast(n as double) else 1.0 end weight, n
from (select "label", count(*) n from {_LABELS} group by 1) c"""))
def attack_weights(spark, folder):
    """Attacks weigh as much as all other flows together."""
    weighted = M.with_attack_weight(training_table(spark, folder))
    return weighted.groupBy("label", "weight").agg(F.count("*").alias("n"))


@query("features int, total double6, ordered boolean", f"select {len(INPUTS)} features, 1.0 total, true ordered")
def importance_totals(spark, folder):
    """Every input has an importance, they add up to one, and the ranking lists them largest first."""
    ranked = X.importances(spark, fitted("forest", spark, folder), INPUTS, top=len(INPUTS))
    values = F.collect_list("importance")
    return ranked.agg(F.count("*").alias("features"), F.sum("importance").alias("total"),
                      (values == F.sort_array(values, asc=False)).alias("ordered"))


@query("round int, loss double6", None)
def boosting_rounds(spark, folder):
    """All rounds: a validation column would let Spark stop as soon as a round gains less than one percent."""
    return M.loss_per_round(fitted("boost", spark, folder), test_rows(spark, folder).withColumn("weight", F.lit(1.0)))


@query("label double, fold int, n bigint", over_flows(f"""
select "label", fold, (n - fold + 4) // 5 n
from (select "label", count(*) n from {_LABELS} group by 1) c, (select unnest(range(5)) fold) f"""))
def stratified_folds(spark, folder):
    return M.with_folds(training_table(spark, folder), 5).groupBy("label", "fold").agg(F.count("*").alias("n"))


_SEARCH = "rank int, settings string, mean_score double6, std_score double6, mean_train_score double6"


def _searched(spark, folder):
    """The ranked draws, and their fits."""
    key = (spark.sparkContext.applicationId, folder, "searched")
    if key not in _models:
        _models[key] = P.search(train_rows(spark, folder), M.draw(M.LOGISTIC_SPACE, DRAWS), FOLDS)
    return _models[key]


def _swept(spark, folder):
    key = (spark.sparkContext.applicationId, folder, "swept")
    if key not in _models:
        _models[key] = P.sweep_c(train_rows(spark, folder), test_rows(spark, folder))
    return _models[key]


@query(_SEARCH, None)
def randomized_search(spark, folder):
    return M.search_table(spark, _searched(spark, folder)[0])


@query("draw int, fits int, optimal boolean, ranked boolean",
       f"select unnest(range({DRAWS})) draw, {FOLDS} fits, true optimal, true ranked")
def search_conditions(spark, folder):
    """Every draw was fitted on each fold to where the conditions of a minimum hold, and ranks follow the scores."""
    results, problems = _searched(spark, folder)
    scores = [r["mean_score"] for r in results]
    ranked = scores == sorted(scores, reverse=True) and [r["rank"] for r in results] == list(range(1, DRAWS + 1))
    rows = [(d, len(own), all(p.residual <= P.TOL for p in own), ranked)
            for d in range(DRAWS) for own in [problems[d * FOLDS:(d + 1) * FOLDS]]]
    return spark.createDataFrame(rows, "draw int, fits int, optimal boolean, ranked boolean")


@query(_SEARCH, None)
def grid_search(spark, folder):
    """The whole tight grid around the best settings of the randomized search."""
    grid = M.refined_grid(_searched(spark, folder)[0][0]["settings"])
    return M.search_table(spark, P.search(train_rows(spark, folder), M.expand(grid), FOLDS, "accuracy")[0])


@query("C double6, train_acc double6, val_acc double6", None)
def c_sweep(spark, folder):
    return _swept(spark, folder)[0]


@query("C double6, optimal boolean, shares boolean",
       "select pow(10, -3 + 6 * i / 19) C, true optimal, true shares from range(20) t(i)")
def c_sweep_conditions(spark, folder):
    """Every value of C has a fit that meets the conditions of a minimum, and two shares of rows."""
    table, problems = _swept(spark, folder)
    fits = spark.createDataFrame([(p.c, p.residual <= P.TOL) for p in problems], "C double, optimal boolean")
    share = F.col("train_acc").between(0, 1) & F.col("val_acc").between(0, 1)
    return table.join(fits, "C").select("C", "optimal", share.alias("shares"))


@query("feature string, importance double6", None)
def feature_importance(spark, folder):
    return X.importances(spark, fitted("forest", spark, folder), INPUTS)


@query("feature string, coefficient double6", None)
def coefficient_ranking(spark, folder):
    return X.coefficients(spark, fitted("linear", spark, folder), INPUTS)


@query("feature string, importance double6, deviation double6", None)
def permutation_importance(spark, folder):
    return X.permutation_importance(test_rows(spark, folder), fitted("linear", spark, folder), INPUTS, REPEATS)


@query("feature string, importance double6, deviation double6", None)
def neural_net_permutation(spark, folder):
    return X.permutation_importance(test_rows(spark, folder), fitted("net", spark, folder), INPUTS, REPEATS)


@query("features int, within boolean, ordered boolean, unused boolean",
       f"select {len(INPUTS)} as features, true as \"within\", true as ordered, true as unused")
def permutation_conditions(spark, folder):
    """Every input has a loss of at most all rows, largest first, and none where the coefficient is zero."""
    model = fitted("linear", spark, folder)
    silent = [n for n, w in zip(INPUTS, model.coefficients.toArray()) if w == 0]
    ranked = X.permutation_importance(test_rows(spark, folder), model, INPUTS, REPEATS)
    values = F.collect_list("importance")
    nothing = (F.col("importance") == 0) & (F.col("deviation") == 0)
    return ranked.agg(
        F.countDistinct("feature").cast("int").alias("features"),
        F.bool_and(F.col("importance").between(-1, 1) & (F.col("deviation") <= 1)).alias("within"),
        (values == F.sort_array(values, asc=False)).alias("ordered"),
        F.coalesce(F.bool_and(F.when(F.col("feature").isin(silent), nothing)), F.lit(True)).alias("unused"))


@query("largest_gap double6, n bigint", over_flows("select 0.0 largest_gap, count(*) n from flows"))
def linear_contributions_add_up(spark, folder):
    """A row's contributions and the margin of the mean row add up to the model's own margin."""
    model, df = fitted("linear", spark, folder), training_table(spark, folder)
    summed = X.linear_margins(df, model, len(INPUTS))
    own = vector_to_array(model.getRawPredictionCol())[1]
    gap = F.abs(own - F.col("total")) / F.greatest(F.lit(1.0), F.abs(own))
    return model.transform(summed).agg(F.round(F.max(gap), 6).alias("largest_gap"), F.count("*").alias("n"))


@query("feature string, mean_abs double6", None)
def linear_contributions(spark, folder):
    return X.linear_contributions(training_table(spark, folder), fitted("linear", spark, folder), INPUTS)


@query("feature string, mean_abs double6", None)
def tree_contributions(spark, folder):
    return X.tree_contributions(training_table(spark, folder), fitted("boost", spark, folder), INPUTS)


def _pipeline_model(spark, folder):
    """The study's forest on the plain 58-wide contract vector, as the scoring stage takes it; fitted on the train rows."""
    key = (spark.sparkContext.applicationId, folder, "contract")
    if key not in _models:
        df = flows(spark, folder)
        table = df.select(
            F.xxhash64("capture_id", "emit_no").alias("id"), array_to_vector(feature_vector(df)).alias("features"),
            F.startswith("srcip", F.lit("175.45.176.")).cast("double").alias("label"),
        )
        dealt = stored(M.packed(M.with_folds(table, PARTS)))
        _models[key] = M.random_forest().fit(M.spread(dealt.filter("fold > 0")))
    return _models[key]


def scored_flows(spark, folder):
    df = flows(spark, folder)
    vectors = encode_flows(df, "capture_id", "emit_no", F.col("ltime_us").alias("ts_us"))
    # The alert rule reads the scores several times, so they are materialised; every scored flow is kept anyway.
    scored = stored(score_vectors(vectors, _pipeline_model(spark, folder)))
    return A.flag_alerts(scored, order=["capture_id", "emit_no"])


@query("srcip string, dstip string, proto string, flows bigint, attacks bigint, alerts bigint", None)
def packets_to_alerts(spark, folder):
    """Packets, flows, vectors, scores and deduplicated alerts in one plan."""
    return scored_flows(spark, folder).groupBy("srcip", "dstip", "proto").agg(
        F.count("*").alias("flows"), F.sum("label").cast("bigint").alias("attacks"),
        F.count_if("alert").alias("alerts"),
    )
