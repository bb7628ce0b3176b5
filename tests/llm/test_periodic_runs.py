"""Lyndon lengths and runs, against their definitions."""

import hashlib
import random

import numpy as np

from flowspark.llm import periodic_runs as P


def lyndon(values):
    def is_lyndon(word):
        return all(word < word[k:] for k in range(1, len(word)))

    return [max(j - i for j in range(i + 1, len(values) + 1) if is_lyndon(values[i:j])) for i in range(len(values))]


def plain_runs(values, least_words=6, least_exponent=4):
    found = set()
    for q in range(1, len(values)):
        i = 0
        while i + q < len(values):
            end = i
            while end + q < len(values) and values[end] == values[end + q]:
                end += 1
            if end > i and end - i + q >= max(least_words, least_exponent * q):
                found.add((i, end - i + q, q))
            i = max(end, i + 1)
    return sorted(r for r in found if not any(s[:2] == r[:2] and s[2] < r[2] for s in found))


def sequences(count, seed=1):
    rng = random.Random(seed)
    for _ in range(count):
        values = [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(rng.randrange(40))]
        if values and rng.random() < 0.6:
            period, begin = rng.randrange(1, 6), rng.randrange(len(values))
            for i in range(begin + period, len(values)):
                values[i] = values[i - period]
        yield values


def test_lyndon_lengths():
    for values in sequences(200):
        if values:
            assert P.lyndon_lengths(values[:20]) == lyndon(values[:20])


def test_runs_in_whole_sequences():
    for values in sequences(500, 2):
        if values:
            assert sorted(P.runs_in(np.array(values))) == plain_runs(values)


def test_runs_of_many_documents():
    every = list(sequences(300, 3))
    found = P.runs_of_documents([[b"%d" % v for v in values] for values in every])
    assert found == [sorted(plain_runs(v), key=lambda r: (r[0], r[2])) for v in every]
    for exponent, words in ((2, 2), (3, 7)):
        found = P.runs_of_documents([[b"%d" % v for v in values] for values in every], words, exponent)
        assert [sorted(f) for f in found] == [plain_runs(v, words, exponent) for v in every]


def test_strongest_and_collapsed():
    assert P.strongest([(0, 8, 2), (9, 12, 3), (30, 9, 2)]) == (30, 9, 2)
    assert P.strongest([(0, 8, 2), (3, 4, 1)]) == (0, 8, 2) and P.strongest([]) is None
    words = b"a b a b a b a b c".split()
    assert P.without_repeats(words, [(0, 8, 2)]) == b"a b c".split()


def test_rows(spark):
    long = " ".join(["tick", "tock"] * 50_000)
    rows = [(1, "x y z"), (2, None), (2, ""), (None, "go\tgo\n go go go go"), (3, long + " end"), (3, "É é É é É é É é")]
    df = spark.createDataFrame(rows, "runs int, text string").selectExpr("runs", "text", "1 as period", "2 as n_runs")
    found = P.periodic_runs(df, "runs", "text")
    assert found.columns[0] == "runs" and found.count() == 6
    df = spark.createDataFrame(rows, "doc_id int, text string")
    rows = P.periodic_runs(df, "doc_id", "text", with_runs=True).collect()
    by = {(r["doc_id"], r["n_runs"], r["length"]): r for r in rows}
    assert by[None, 1, 6]["exponent_milli"] == 6000 and by[None, 1, 6]["collapsed"] == "go"
    assert by[3, 1, 100_000]["collapsed"] == "tick tock end" and by[3, 1, 8]["period"] == 2
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["start"], r["runs_sha256"], r["collapsed_sha256"]) for r in rows if r["doc_id"] == 2] == [(None, empty, empty)] * 2
    assert P.periodic_runs(df.limit(0), "doc_id", "text").count() == 0
