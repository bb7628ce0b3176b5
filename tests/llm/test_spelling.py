"""Near words and their forms, against a comparison of all pairs."""

import random

import pytest

from flowspark.llm import spelling
from flowspark.llm.queries import slips


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def vocabulary(seed, n=600):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abà") for _ in range(rng.randrange(1, 9))) for _ in range(n)}
    words |= {"a" * k for k in range(1, 30)} | {"ab" * 3000, "ab" * 2999 + "a", "b" + "ab" * 3000}
    return {w: rng.randrange(3, 400) for w in sorted(words)}


@pytest.mark.parametrize("half_rows, shards", [(16_384, 64), (20, 64), (20, 1)])
def test_near_pairs(spark, monkeypatch, half_rows, shards):
    monkeypatch.setattr(spelling, "HALF_ROWS", half_rows)
    monkeypatch.setattr(spelling, "LEAST_SHARDS", shards)
    counts = vocabulary(half_rows)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    wanted = sorted((a, b, counts[b]) for a in counts for b in counts if near(a, b))
    assert sorted(map(tuple, spelling.near_pairs(df).collect())) == wanted


def test_forms_and_roots(spark):
    text = " ".join(["house"] * 40 + ["Hous"] * 40 + ["housé"] * 9 + ["housés"] * 4 + ["hxuse"] * 40 + ["mouse"] * 3 + ["lone1lone"] * 3
                    + ["hausés"] * 2)
    df = spark.createDataFrame([(1, text), (1, None), (None, ""), (2, "house")], "n int, word string")
    found = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(df, "n", "word").collect()}
    assert found == {
        "house": (None, "house", 41, 3, None), "hxuse": (None, "hxuse", 40, 1, None),
        "housé": ("house", "house", 9, 2, 41), "housés": ("housé", "house", 4, 1, 9), "mouse": ("house", "house", 3, 1, 41)}
    assert spelling.spelling_variants(df.limit(0), "n", "word").count() == 0


def test_ties_go_to_the_smaller_word(spark):
    text = " ".join(["bxxxx"] * 8 + ["axxxx"] * 8 + ["cxxxx"] * 4)
    df = spark.createDataFrame([(1, text)], "id int, text string")
    found = {r["word"]: r["form"] for r in spelling.spelling_variants(df, "id", "text").collect()}
    assert found == {"axxxx": None, "bxxxx": None, "cxxxx": "axxxx"}


def test_slips_leave_out_one_letter():
    counts = {f"word{i}": i for i in range(500)}
    changed = [(a, b) for a, (b, _) in zip(counts, slips(7, counts)) if a != b]
    assert 0 < len(changed) < 20 and all(near(a, b) and len(b) == len(a) - 1 for a, b in changed)
    assert list(slips(None, {"ab": 2}))[0][1] == 2
