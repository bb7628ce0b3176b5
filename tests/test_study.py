"""The registered model queries do the study's whole job: its settings, draws, folds, and rows kept for judging."""

from flowspark.operators import explain as X
from flowspark.operators import paths as P
from flowspark.operators import training as M
from flowspark.plans import model_queries as Q


def test_models_have_the_studys_settings(spark, data):
    df = M.with_attack_weight(Q.train_rows(spark, data))
    boost, forest, linear, net = (Q.estimator(k, df) for k in ("boost", "forest", "linear", "net"))
    assert (boost.getMaxIter(), boost.getMaxDepth(), boost.getStepSize()) == (1000, 4, 0.01)
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (300, 10, 4)
    assert linear.getMaxIter() == 2000 and abs(linear.getRegParam() * df.count() * M.LOGISTIC_BEST["C"] - 1) < 1e-9
    assert net.getLayers() == [len(Q.INPUTS), 128, 64, 2] and net.getMaxIter() == 300


def test_judged_rows_were_not_fitted_on(spark, data):
    train, test = Q.train_rows(spark, data).select("id", "label"), Q.test_rows(spark, data).select("id", "label")
    assert train.join(test, "id").count() == 0
    assert train.count() + test.count() == Q.training_table(spark, data).count()
    assert test.select("label").distinct().count() == 2


def test_searches_are_whole(spark, data):
    results, problems = Q._searched(spark, data)
    assert len(results) == 50 and len(problems) == 250 and all(p.max_iter == 2000 for p in problems)
    assert {r["settings"]["class_weight"] for r in results} == {None, "balanced"}
    assert all(p.residual <= P.TOL for p in problems)
    best = Q.grid_search(spark, data)
    assert best.count() == 10 and best.where("rank = 1").first()["mean_score"] >= best.where("rank = 2").first()["mean_score"]


def test_permutations_are_whole(spark, data, monkeypatch):
    """All inputs, all rows that are judged, ten repeats; a model of fewer iterations stands in for the fitted one."""
    train, rows = Q.train_rows(spark, data), Q.test_rows(spark, data)
    model = M.logistic(M.total_weight(train), {"C": 1.0, "penalty": "l2", "max_iter": 15}).fit(train)
    monkeypatch.setattr(Q, "fitted", lambda *_: model)
    paired, asked = X._paired_rows, []
    monkeypatch.setattr(X, "_paired_rows", lambda df, used, repeats, *more: asked.append((df.count(), repeats)) or paired(
        df, used, repeats, *more))
    ranked = Q.permutation_importance(spark, data).collect()
    assert asked == [(rows.count(), 10)]
    assert {r["feature"] for r in ranked} == set(Q.INPUTS) and len(ranked) == len(Q.INPUTS)
    assert ranked[0]["importance"] > 0 and all(r["deviation"] >= 0 for r in ranked)
