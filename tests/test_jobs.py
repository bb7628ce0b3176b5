"""The three jobs, from files to results."""

import random

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from test_sources import ethernet, ip, pcap, tcp

from flowspark.contracts import NUMERIC_FEATURES
from flowspark.plans import jobs

RST = 4


def test_captures_to_alerts(spark, tmp_path):
    folder = tmp_path / "captures"
    folder.mkdir()
    frames = [(10 + i, 0, ethernet(ip(6, tcp(RST, i, sport=2000 + i), 40))) for i in range(12)]
    (folder / "a.pcap").write_bytes(pcap(frames))
    (folder / "b.txt").write_bytes(b"no")
    at = lambda n: str(tmp_path / n)
    rejects = jobs.extract_flows(spark, str(folder), at("packets"), at("flows"), {"target": "parquet", "path": at("topic")})
    assert rejects.count() == 1 and spark.read.parquet(at("topic")).count() == 12
    flows = spark.read.json(at("flows"))
    assert flows.filter("state = 'RST'").count() == 12 and flows.agg(F.max("ct_src_ltm")).first()[0] == 12

    rng = random.Random(4)
    header = ["id", "proto", "service", "state", *NUMERIC_FEATURES, "attack_cat", "label"]
    for name in ("train.csv", "test.csv"):
        lines = [",".join(header)]
        for i in range(300):
            attack = i % 2
            values = [str(rng.randint(5, 50) if c == "ct_src_ltm" and attack else rng.randint(0, 4)) for c in NUMERIC_FEATURES]
            lines.append(",".join([str(i), "tcp", "http", "RST" if attack else "FIN", *values, "DoS" if attack else "Normal", str(attack)]))
        (tmp_path / name).write_text("﻿" + "\n".join(lines) + "\n")
    result = jobs.train_detector(spark, at("train.csv"), at("test.csv"), at("detector"), {"n_estimators": 4, "learning_rate": 0.5})
    assert result["ranking"].first()["roc_auc"] > 0.95

    model = PipelineModel.load(at("detector/model"))
    flagged = jobs.score_flows(spark, flows, model, at("scored"), at("audit"), contract=at("detector/contract"))
    assert flagged.count() == 12 and spark.read.json(at("audit")).count() == 12
    fired = flagged.filter("alert").count()
    assert flagged.filter("label = 1").count() >= 1 and fired == 1
    people = spark.createDataFrame([(1, 0.0), (2, 1.0)], "client_id bigint, min_prob float")
    delivered = jobs.deliver_alerts(flagged, people)
    assert delivered.filter("client_id = 1").count() == fired
