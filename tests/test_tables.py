"""Preprocessing, exploration, evaluation, alerts and operations against brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.contracts import MODEL_COLUMNS, one_hot_categories
from flowspark.functions.encode import encode_flows, to_contract
from flowspark.functions.net import ip_number, ip_text
from flowspark.operators import alerts as A
from flowspark.operators import eda, evaluation, operations, prep
from flowspark.operators.cooldown import with_cooldown
from flowspark.operators.ordinal import exact_places, with_ordinal, with_running_totals


def test_contract_lists():
    assert len(MODEL_COLUMNS) == 58 == len(set(MODEL_COLUMNS))
    assert one_hot_categories("state") == ["CON", "FIN", "INT", "REQ", "other"]


def test_addresses_round_trip(spark):
    df = spark.createDataFrame([(0,), (2**32 - 1,), (3232235777,)], "n bigint")
    assert df.filter(ip_number(ip_text(F.col("n"))) != F.col("n")).count() == 0
    odd = spark.createDataFrame([("1.2.3",), ("a.b.c.d",)], "t string")
    assert odd.select(ip_number(F.col("t"))).distinct().collect()[0][0] is None


def test_encoding_defaults(spark):
    df = spark.createDataFrame([("icmp", None, "RST")], "proto string, service string, state string")
    row = encode_flows(df).first()
    hot = {MODEL_COLUMNS[i] for i, v in enumerate(row["features"]) if v}
    assert hot == {"proto_other", "service_-", "state_other"}
    assert (row["srcip"], row["sport"], row["proto"]) == ("", 0, "icmp")
    assert to_contract(df.select(F.lit(2).alias("spkts"))).first()["spkts"] == 2.0


@pytest.mark.parametrize("ttl, hot_rows", [(1, 40), (7, 100), (50, 40), (700, 100), (5000, 60)])
def test_cooldown_of_hot_keys(spark, ttl, hot_rows):
    rng = np.random.default_rng(ttl)
    rows = [(str(k), int(t), i) for i, (k, t) in enumerate(zip(rng.choice(list("aaaab"), 600), rng.integers(0, 900, 600)))]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint")
    want, last = set(), {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k not in last or t >= last[k] + ttl:
            want.add(i)
            last[k] = t
    for limit in (None, hot_rows):
        got = with_cooldown(df, ["k"], "t", ["i"], ttl, hot_rows=limit)
        assert {r["i"] for r in got.filter("fires").collect()} == want and got.count() == 600


def test_cooldown_splits_copies_of_one_row(spark):
    df = spark.range(200).select(F.lit("k").alias("k"), F.lit(5).cast("bigint").alias("t"))
    got = with_cooldown(df, ["k"], "t", [], 10, hot_rows=30)
    assert got.filter("fires").count() == 1 and got.count() == 200


def test_alert_at_exactly_the_limit_fires(spark):
    seconds = [0, 59.999999, 60, 119, 120]
    rows = [("a", "b", "tcp", int(s * 1e6), 1) for s in seconds] + [("a", "b", "tcp", 1, 0)]
    df = spark.createDataFrame(rows, "srcip string, dstip string, proto string, ts_us bigint, label int")
    got = A.flag_alerts(df).filter("label = 1").orderBy("ts_us").collect()
    assert [r["alert"] for r in got] == [True, False, True, False, True]


def test_float_threshold_rule(spark):
    df = spark.createDataFrame([(0.69,)], "attack_prob float")
    assert df.select(A.threshold_label()).first()[0] == 0


def test_null_gate(spark):
    df = spark.createDataFrame([(1, None)], "id int, x double")
    with pytest.raises(ValueError, match="x"):
        prep.require_no_nulls(df)


def test_prep_round_trip(spark, tmp_path):
    rows = [(i, "tcp" if i % 2 else "gre", "http", "FIN", float(i % 4), float(i % 3 + 1), 7.0, i % 2, "Normal") for i in range(24)]
    df = spark.createDataFrame(rows, "id bigint, proto string, service string, state string, dur double, sload double, "
                                     "rate double, label int, attack_cat string")
    full, model, tree, artifacts = prep.preprocess_train(df)
    assert full.count() == 12 and artifacts["categories"]["proto"] == ["other", "tcp"]
    assert model.columns == ["proto_other", "proto_tcp", "service_http", "state_FIN", "sload_log_scaled",
                             "rate_log_scaled", "dur_scaled", "label"]
    stats = model.agg(F.avg("dur_scaled"), F.stddev_pop("dur_scaled"), F.max(F.abs("rate_log_scaled"))).first()
    assert stats[0] == pytest.approx(0) and stats[1] == pytest.approx(1) and stats[2] == pytest.approx(0)
    prep.save_artifacts(spark, artifacts, str(tmp_path / "a"))
    again = prep.load_artifacts(spark, str(tmp_path / "a"))
    assert json.dumps(again) == json.dumps(artifacts)
    served = df.withColumn("proto", F.lit("sctp"))
    row = prep.preprocess_test(served, again)[2].first()
    assert row["proto_other"] == 0 and row["proto_tcp"] == 0
    assert prep.features_and_label(tree).columns == ["features", "label"]


def test_metrics_by_hand(spark):
    pairs = [(0.9, 1), (0.8, 0), (0.8, 1), (0.7, 1), (0.4, 0), (0.4, 0), (0.1, 1)]
    df = spark.createDataFrame(pairs, "prob double, label int")
    wins = np.mean([(p > q) + 0.5 * (p == q) for p, a in pairs if a for q, b in pairs if not b])
    tops = sorted({p for p, _ in pairs}, reverse=True)
    positives = sum(a for _, a in pairs)
    ap = before = 0.0
    for t in tops:
        hits = [a for p, a in pairs if p >= t]
        ap += (sum(hits) / positives - before) * sum(hits) / len(hits)
        before = sum(hits) / positives
    row = evaluation.ranking_metrics(df).first()
    assert row["roc_auc"] == pytest.approx(wins) and row["average_precision"] == pytest.approx(ap)
    sweep = {round(r["threshold"], 2): r for r in evaluation.threshold_sweep(df).collect()}
    assert len(sweep) == 99 and sweep[0.8]["recall"] == 0.5 and sweep[0.8]["precision"] == pytest.approx(2 / 3)
    assert evaluation.best_threshold(df).first()["threshold"] == pytest.approx(0.41)
    report = {r["class"]: r for r in evaluation.classification_report(df.withColumn("label", F.lit(1))).collect()}
    assert report["Normal"]["precision"] == 0 and report["Attack"]["precision"] == 1


def test_sample_is_repeatable(spark):
    ids = lambda df: {r["id"] for r in evaluation.seeded_sample(df, 10).collect()}
    assert ids(spark.range(100)) == ids(spark.range(100).repartition(7))


def test_numbering_and_totals(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), (F.col("id") % 3).alias("g"))
    got = with_ordinal(df, ["g"], ["v"], "n").collect()
    for g in range(3):
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["v"])] == list(
            range(sum(r["g"] == g for r in got)))
    sums = sorted(with_running_totals(df, [F.asc("v")], {"upto": "v"}).collect(), key=lambda r: r["v"])
    assert [r["upto"] for r in sums] == list(np.cumsum(range(500))) and sums[0]["all_upto"] == 124750
    place = exact_places(df, [], "v", {"mid": F.floor((F.col("total") - 1) * 0.5)}).first()
    assert place["mid"] == 249 and place["max"] == 499


def test_quantile_of_buckets(spark):
    df = spark.createDataFrame([(3,), (3,), (7,), (9000,)], "latency_us bigint")
    buckets = operations.latency_buckets(df)
    assert operations.histogram_quantile(buckets, 0.5).first()["value"] == pytest.approx(5e-6)
    assert operations.histogram_quantile(buckets, 0.99).first()["value"] == pytest.approx(5e-3)
    empty = operations.latency_buckets(df.filter("latency_us < 0"))
    assert operations.histogram_quantile(empty, 0.5).first()["value"] is None


def test_constant_column_histogram(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    rows = eda.histograms(df, ["x"]).filter("scale = 'raw'").collect()
    assert [(r["bin"], r["n"]) for r in rows] == [(30, 2)]


def test_deliveries_agree(spark):
    alerts = spark.range(50).select((F.col("id") / 49.0).cast("float").alias("attack_prob"), "id")
    wanted = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 1.0), (4, None)], "client_id bigint, min_prob float")
    count = lambda df: sorted((r["client_id"], r["count"]) for r in df.groupBy("client_id").count().collect())
    assert count(A.deliver(alerts, wanted)) == [(1, 50), (2, 25), (3, 1), (4, 50)]
    assert count(A._deliver_by_chunk(alerts, A.with_floor(wanted), 2, 3)) == [(1, 50), (2, 25), (3, 1), (4, 50)]


def test_scores_that_are_no_numbers_are_not_delivered(spark):
    alerts = spark.createDataFrame([(float("nan"),), (0.75,)], "attack_prob float")
    wanted = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "client_id bigint, min_prob float")
    for delivered in (A.deliver(alerts, wanted), A._deliver_by_chunk(alerts, A.with_floor(wanted))):
        assert [(r["client_id"], r["attack_prob"]) for r in delivered.collect()] == [(1, 0.75)]
    assert A.filter_subscriber(alerts, 0.0).count() == 1
