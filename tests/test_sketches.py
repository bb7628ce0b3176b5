"""Quantile sketches: merged over groups, their ranks measured against all rows."""

import math
import random

from flowspark.operators import operations as O

SHARES = {"low": 0.01, "p50": 0.5, "p99": 0.99, "max": 1.0}


def test_ranks_of_sketches(spark):
    draw = random.Random(4)
    rows = [(i % 7, int(draw.lognormvariate(6, 2)) if i % 3 else 1000) for i in range(40_000)] + [(1, None), (99, None)]
    df = spark.createDataFrame(rows, "part int, v long").repartition(6)
    parts = O.latency_sketches(df, ["part"], "v")
    for groups, sketches in ((["part"], parts), ([], O.merge_sketches(parts, []))):
        found = O.sketched_percentiles(sketches, SHARES)
        answers = O.rank_distances(df, groups, "v", found, SHARES).collect()
        assert len(answers) == found.count() == (7 if groups else 1)
        for r in answers:
            part = r["part"] if groups else None
            values = sorted(v for p, v in rows if v is not None and (not groups or p == part))
            assert r["n"] == len(values) and r["max"] == values[-1]
            for name, share in SHARES.items():
                place = math.floor(share * (len(values) - 1))
                below, upto = sum(v < r[name] for v in values), sum(v <= r[name] for v in values)
                off = max(below - place, place - upto + 1, 0)
                assert r[f"{name}_off"] == off
                assert off <= O.rank_error(O.SKETCH_SIZE) * len(values) + 1


def test_nothing_to_sketch(spark):
    df = spark.createDataFrame([(1, None)], "part int, v long")
    parts = O.latency_sketches(df, ["part"], "v")
    assert parts.count() == 0
    assert O.sketched_percentiles(O.merge_sketches(parts, []), SHARES).count() == 0
