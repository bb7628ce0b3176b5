"""Flows that leave at a sweep, with many sweeps in a capture."""

import random

from flowspark.operators.flows import SWEEP_FANOUT, emitted_by_sweeps, sweep_levels


def test_flows_find_their_sweep_without_looking_at_all_of_them(spark):
    rng = random.Random(5)
    times = {"a": sorted(rng.randrange(50_000) for _ in range(3 * SWEEP_FANOUT**2 // 2)), "b": [7, 7, 9], "c": []}
    sweeps = spark.createDataFrame([(c, t) for c, ts in times.items() for t in ts] + [("b", None), (None, 3)],
                                   "capture_id string, now_us bigint")
    rows = [(i, rng.choice(["a", "b", "c", "a"]), rng.randrange(51_000), rng.choice([None, None, 4]), -1) for i in range(500)]
    rows += [(500, "b", 6, None, -1), (501, "b", 7, None, -1), (502, "b", 9, None, -1), (503, None, 1, None, -1),
             (504, "a", times["a"][-1], None, -1), (505, "a", times["a"][-1] - 1, None, -1)]
    flows = spark.createDataFrame(rows, "id int, capture_id string, ltime_us bigint, close_us bigint, emit_us bigint")
    got = emitted_by_sweeps(flows, sweeps, 0)
    assert sorted(got.columns) == sorted(flows.columns)
    for i, capture, last, close, emit in rows:
        later = [t for t in times.get(capture, []) if t > last]
        rows[i] = (i, later[0] if close is None and later else emit)
    assert sorted((r["id"], r["emit_us"]) for r in got.collect()) == rows
    levels = sweep_levels(sweeps)
    assert len(levels) == 3 and all(len(r["_times"]) <= SWEEP_FANOUT for level in levels for r in level.collect())
