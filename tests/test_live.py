"""The live path and the streamed history: shuffled batches, batches run twice, restarts and late rows."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowspark.contracts import HISTORY_COUNTS
from flowspark.operators.alerts import alert_stream, deliver, flag_alerts
from flowspark.operators.history import add_history
from flowspark.operators.scoring import score_vectors
from flowspark.streaming.blocks import HistoryPath
from flowspark.streaming.live import LivePath

SCHEMA = "id long, srcip string, sport int, dstip string, dsport int, proto string, ts_us bigint, features array<double>"
SECOND = 1_000_000


@pytest.fixture(scope="module")
def model(spark):
    rows = [(float(i % 2), [float(i % 2 + (i % 7 == 0))] + [0.0] * 57) for i in range(40)]
    df = spark.createDataFrame(rows, "label double, x array<double>")
    return LogisticRegression().fit(df.select("label", array_to_vector("x").alias("features")))


def arrivals(n, seed, late):
    """Rows about a second apart, each up to ``late`` seconds late, in order of arrival."""
    rng = random.Random(seed)
    rows = [(i, f"s{rng.randrange(3)}", 1, f"d{rng.randrange(2)}", 2, "tcp", rng.randrange(n) * SECOND,
             [float(rng.random() < 0.6)] + [0.0] * 57) for i in range(n)]
    return sorted(rows, key=lambda r: r[6] + rng.randrange(late) * SECOND)


def batches(spark, rows, k):
    size = -(-len(rows) // k)
    for i in range(0, len(rows), size):
        df = spark.createDataFrame(rows[i:i + size], SCHEMA)
        yield df.select(F.to_json(F.struct(*df.columns)).alias("value"))


@pytest.mark.parametrize("seed", [1, 2])
def test_live_path_equals_one_batch(spark, tmp_path, model, seed):
    rows, subscribers = arrivals(200, seed, 20), spark.createDataFrame([(1, None), (2, 0.9)], "client_id int, min_prob float")
    path = LivePath(SCHEMA, lambda df: score_vectors(df, model), str(tmp_path / "out"), subscribers, ["id"], 20 * SECOND, 15 * SECOND)
    for batch_id, messages in enumerate(batches(spark, rows, 4)):
        broken = spark.createDataFrame([("{",), (None,), ('{"ts_us": "x"}',)], "value string")
        messages = messages.union(broken)
        path(messages, batch_id)
        if batch_id in (0, 2):
            path(messages, batch_id)  # a batch that failed after its work is run again
    path.finish(spark)
    whole = score_vectors(spark.createDataFrame(rows, SCHEMA), model)
    flagged = flag_alerts(whole, order=["id"], ttl_us=15 * SECOND)
    key = lambda df: sorted(map(tuple, df.select("id", "alert", "label", "attack_prob").collect()))
    assert key(path.table(spark, "scored")) == key(flagged)
    sent = lambda df: sorted(map(str, df.select("client_id", "srcip", "dstip", "attack_prob").collect()))
    assert sent(path.table(spark, "delivered")) == sent(deliver(alert_stream(flagged), subscribers))
    done = path.table(spark, "progress").orderBy("batch_id").collect()
    assert [r["rejects"] for r in done] == [3, 3, 3, 3, 0] and sum(r["late"] for r in done) == 0
    assert sum(r["scored"] for r in done) == 200 and all(r["latency_us"] > 0 for r in done[:4])
    assert sum(r["alerts"] for r in done) == flagged.filter("alert").count()


def test_late_rows_are_set_aside(spark, tmp_path):
    rows = [(i, "a", 1, "b", 2, "tcp", t * SECOND if t is not None else None, None)
            for i, t in enumerate([0, 100, 50, 95, None, 89, 101])]
    score = lambda df: df.withColumns({"attack_prob": F.lit(1.0).cast("float"), "label": F.lit(1)})
    none = spark.createDataFrame([], "client_id int, min_prob float")
    path = LivePath(SCHEMA, score, str(tmp_path / "out"), none, ["id"], 10 * SECOND, 30 * SECOND)
    for batch_id, messages in enumerate([*batches(spark, rows[:2], 1), *batches(spark, rows[2:], 1)]):
        path(messages, batch_id)
    path.finish(spark)
    assert sorted(r["id"] for r in path.table(spark, "late").collect()) == [2, 4, 5]
    flags = {r["id"]: r["alert"] for r in path.table(spark, "scored").collect()}
    assert flags == {0: True, 3: True, 1: False, 6: False}


def test_history_over_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, i, (i + 1) * 1000, f"s{rng.randrange(3)}", f"d{rng.randrange(3)}", rng.randrange(2), rng.randrange(2), "dns", i * 10)
            for c in ("x", "y") for i in range(700)]
    schema = ("capture_id string, emit_no bigint, emit_us bigint, srcip string, dstip string, sport int, dsport int, "
              "service string, stime_us bigint")
    rows.sort(key=lambda r: r[2] + rng.randrange(150) * 1000)
    path = HistoryPath(str(tmp_path / "out"), delay_us=150_000, block=128)
    for batch_id in range(4):
        part = spark.createDataFrame(rows[batch_id * 350:(batch_id + 1) * 350], schema)
        path(part, batch_id)
        if batch_id == 1:
            path(part, batch_id)
    path(spark.createDataFrame([("x", 3, 1000, "s", "d", 1, 1, "dns", 1)], schema), 4)
    path.finish(spark)
    key = lambda df: sorted(map(tuple, df.select("capture_id", "emit_no", *HISTORY_COUNTS).collect()))
    assert key(path.table(spark, "counted")) == key(add_history(spark.createDataFrame(rows, schema)))
    assert path.table(spark, "late").count() == 1
