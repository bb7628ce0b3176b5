"""Training, scoring and explanation."""

import math

import numpy as np
import pytest
from onnx_file import linear_softmax
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import functions as F

from flowspark.contracts import FEATURE_COUNT
from flowspark.operators import evaluation as E
from flowspark.operators import explain as X
from flowspark.operators import training as M
from flowspark.operators.scoring import score_onnx, score_vectors

NAMES = ["signal", "weak", "noise"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (2 * x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=600) > 0.4).astype(int)
    rows = [(i, float(y[i]), [float(v) for v in x[i]]) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, label double, x array<double>")
    return df.select("id", "label", array_to_vector("x").alias("features")).cache()


def auc(model, df):
    scored = model.transform(df).select("label", E.attack_probability().alias("prob"))
    return E.ranking_metrics(scored).first()["roc_auc"]


@pytest.fixture(scope="module")
def boosted(table):
    return M.boosted_trees({"n_estimators": 6, "max_depth": 3, "learning_rate": 0.3}).fit(table)


@pytest.fixture(scope="module")
def linear(table):
    return M.logistic(600, {"C": 1.0, "max_iter": 50}).fit(table)


def test_every_model_separates(table, boosted, linear):
    forest = M.random_forest({"n_estimators": 10, "max_depth": 4}).fit(table)
    net = M.neural_net(3, {"hidden_layer_sizes": (5,), "max_iter": 60}).fit(table)
    for model in (boosted, linear, forest, net):
        assert auc(model, table) > 0.9


def test_class_weights(table):
    n0, n1 = M.class_counts(table)
    weight = lambda df: {r["label"]: r["w"] for r in df.groupBy("label").agg(F.max("weight").alias("w")).collect()}
    assert weight(M.with_attack_weight(table)) == {0.0: 1.0, 1.0: pytest.approx(n0 / n1)}
    assert weight(M.with_balanced_weight(table))[0.0] == pytest.approx(600 / (2 * n0))


def test_folds_are_stratified_and_repeatable(table):
    folds = M.with_folds(table, 5)
    counts = folds.groupBy("label", "fold").count().groupBy("label").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in counts)
    again = M.with_folds(table.repartition(3), 5)
    assert folds.join(again.select("id", F.col("fold").alias("f2")), "id").filter("fold <> f2").count() == 0


def test_search_ranks_and_refines(spark, table):
    draws = [{"C": c, "penalty": "l2", "max_iter": 20, "class_weight": w} for c, w in ((1e-4, None), (10.0, "balanced"))]
    results = M.search(table, lambda s, n: M.logistic(n, s), draws, folds=3)
    assert [r["rank"] for r in results] == [1, 2] and results[0]["mean_score"] >= results[1]["mean_score"]
    assert M.search_table(spark, results, 1).count() == 1
    grid = M.refined_grid({"C": 10.0, "penalty": "elasticnet", "l1_ratio": 0.1})
    assert grid["C"][0] == pytest.approx(10**0.5) and grid["l1_ratio"][0] == 0.01
    assert len(M.expand(grid)) == 5 * 2 * 5
    assert M.draw(M.BOOSTED_SPACE, 4) == M.draw(M.BOOSTED_SPACE, 4)
    for s in M.draw(M.FOREST_SPACE, 5):
        assert M.random_forest(s).getMaxDepth() <= 30
    for s in M.draw(M.BOOSTED_SPACE, 5):
        M.boosted_trees(s)
    assert all(1e-3 <= s["C"] <= 1e3 for s in M.draw(M.LOGISTIC_SPACE, 20))


def test_c_sweep(table):
    sweep = M.sweep_c(table, table, [1e-4, 1.0], {"max_iter": 20})
    assert sweep.count() == 2 and M.best_c(sweep).count() == 1


def test_validation_rounds(table):
    df = table.withColumn("held_out", F.col("id") % 4 == 0)
    model = M.boosted_trees({"n_estimators": 4, "max_depth": 2}, validation="held_out").fit(df)
    assert M.loss_per_round(model, df).count() >= 1


def test_tree_contributions_add_up(table, boosted):
    """Contributions plus the expected value give the margin, and equal brute force over all orders."""
    leaves = X.tree_leaves(boosted)
    rows = boosted.transform(table.limit(20)).select(vector_to_array("features").alias("x"), "rawPrediction").collect()
    x = np.array([r["x"] for r in rows])
    phi = X.contributions(x, leaves)
    known = lambda row, subset: sum(
        v * math.prod((low < row[f] <= high) if f in subset else share for f, low, high, share in path)
        for v, path in leaves)
    expected = known(x[0], set())
    margin = np.array([r["rawPrediction"][1] for r in rows]) / 2  # the raw score is twice the margin
    scale = margin / (phi.sum(axis=1) + expected)
    assert np.allclose(scale, scale[0])
    for row, got in zip(x[:5], phi[:5]):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            subsets = [set(), {others[0]}, {others[1]}, set(others)]
            weights = [1 / 3, 1 / 6, 1 / 6, 1 / 3]
            want = sum(w * (known(row, s | {i}) - known(row, s)) for w, s in zip(weights, subsets))
            assert got[i] == pytest.approx(want, abs=1e-9)


def test_rankings_put_the_signal_first(spark, table, boosted, linear):
    assert X.importances(spark, boosted, NAMES).first()["feature"] == "signal"
    assert X.tree_contributions(table, boosted, NAMES).first()["feature"] == "signal"
    assert X.linear_contributions(table, linear, NAMES).first()["feature"] == "signal"
    ranked = X.permutation_importance(table, linear, NAMES, 3).collect()
    assert ranked[0]["feature"] == "signal" and ranked[0]["importance"] > 0.2
    assert X.coefficients(spark, linear, NAMES, 2).count() == 2


def test_forest_leaves_average_to_the_probability(table):
    forest = M.random_forest({"n_estimators": 4, "max_depth": 3}).fit(table)
    leaves = X.tree_leaves(forest)
    rows = forest.transform(table.limit(10)).select(vector_to_array("features").alias("x"),
                                                    E.attack_probability().alias("p")).collect()
    for r in rows:
        reached = sum(v for v, path in leaves if all(low < r["x"][f] <= high for f, low, high, _ in path))
        assert reached == pytest.approx(r["p"])


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [("a", [float((i * j) % 5) for j in range(FEATURE_COUNT)]) for i in range(30)] + [("short", [1.0])]
    return spark.createDataFrame(rows, "srcip string, features array<double>")


def test_onnx_scores(spark, tmp_path, vectors):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(FEATURE_COUNT, 2)) / 20
    path = tmp_path / "m.onnx"
    path.write_bytes(linear_softmax(weights))
    got = score_onnx(vectors, str(path), 0.5)
    assert got.count() == 30 and got.filter("latency_us < 0").count() == 0
    one = vectors.filter("srcip = 'a'").limit(1).collect()[0]["features"]
    z = np.array(one, dtype=np.float32) @ weights.astype(np.float32)
    want = np.exp(z)[1] / np.exp(z).sum()
    assert any(abs(r["attack_prob"] - want) < 1e-5 for r in got.collect())


def test_spark_model_scores_and_survives_saving(spark, tmp_path, vectors):
    train = vectors.filter("srcip = 'a'").select(
        array_to_vector("features").alias("features"), (F.col("features")[1] > 2).cast("double").alias("label"))
    model = M.random_forest({"n_estimators": 3, "max_depth": 3, "min_samples_leaf": 1}).fit(train)
    scored = score_vectors(vectors, model, 0.5)
    assert scored.count() == 30 and scored.schema["attack_prob"].dataType.simpleString() == "float"
    M.save_model(PipelineModel([model]), str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    with_id = lambda df: df.withColumn("id", F.monotonically_increasing_id()).withColumnRenamed("attack_prob", "prob")
    parity = E.score_parity(with_id(scored), with_id(score_vectors(vectors, loaded, 0.5))).first()
    assert parity["max_diff"] == 0 and parity["label_match"] == 1
