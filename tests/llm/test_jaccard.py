import random
import re

import pytest
from pyspark.sql import functions as F

from flowspark.llm import jaccard
from flowspark.llm.components import components


def sets_of(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows, size, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, sets_of(t, size)) for i, t in rows if i is not None]
    for n, (i, a) in enumerate(known):
        for j, b in known[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(sets_of(t, size)), 
                   None if i is None else root(i) if sets_of(t, size) else i) for i, t in rows)


def check(spark, rows, size=4, percent=85):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string").repartition(3)
    found = jaccard.jaccard_components(df, "doc_id", "text", size, percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert got == brute(rows, size, percent)


def families(seed, n):
    """Families of near copies around the threshold, with a passage that many documents share."""
    draw = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows, bases = [], []
    for i in range(n):
        if bases and draw.random() < 0.7:
            words = list(draw.choice(bases))
            for _ in range(draw.randint(0, 5)):
                at = draw.randrange(len(words))
                words[at:at + draw.randint(0, 1)] = [f"e{draw.randrange(9)}"]
        else:
            words = [f"w{draw.randrange(60)}" for _ in range(draw.randint(2, 120))]
            if draw.random() < 0.4:
                words += passage
            bases.append(words)
        rows.append((draw.randrange(10**6) * 1000 + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("percent", [60, 85])
def test_families(spark, percent):
    check(spark, families(percent, 220), percent=percent)


@pytest.mark.parametrize("seed", [3, 4])
def test_ids_with_several_texts(spark, seed):
    draw = random.Random(seed)
    rows = families(seed, 160)
    ids = [i for i, _ in rows]
    for at in draw.sample(range(len(rows)), 50):
        rows[at] = (draw.choice(ids), rows[at][1])
    check(spark, rows + [(ids[0], ""), (ids[1], None)])


def test_cases(spark):
    long = " ".join(f"v{i}" for i in range(3000))
    check(spark, [
        (1, None), (2, ""), (3, "  \n"), (4, "two words"), (5, "TWO\twords"), (6, "two words more"), (7, long), (8, long + " end"),
        (9, "a b c d e"), (9, "a b c d e"), (None, "a b c d e"), (10, "A B C D E"), (-5, "a b c d e"), (11, "ÉTÉ a b c"), (12, "été a b c"),
    ])


def test_many_copies_and_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 5)
    draw = random.Random(2)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(60)]
    for i in range(60, 160):
        words = list(base)
        for _ in range(draw.randint(1, 4)):
            words[draw.randrange(80)] = f"x{draw.randrange(1000)}"
        rows.append((i, " ".join(words)))
    check(spark, rows)


def test_sets_are_dealt_out_once_to_their_group(spark, monkeypatch):
    plans, stored = [], jaccard.stored

    def explained(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, name)

    monkeypatch.setattr(jaccard, "stored", explained)
    rows = families(5, 120)
    check(spark, rows + rows[:40])  # repeated rows are still one member of their group
    plan, = (plan for name, plan in plans if name == "groups" and "MapInArrow" in plan)
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", plan)) == 1


def test_empty(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_components(spark):
    chain = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(200, 400).select(F.lit(100).cast("long").alias("a"), F.col("id").alias("b"))
    high = spark.range(500, 600).select(F.lit(999).cast("long").alias("a"), F.col("id").alias("b"))
    odd = spark.createDataFrame([(7, 7), (None, 3), (4, None)], "a long, b long")
    found = {r.node: r.component for r in components(chain.union(star).union(high).union(odd)).collect()}
    want = {i: 1 for i in range(1, 61)} | {i: 100 for i in [100, *range(200, 400)]} | {i: 500 for i in [999, *range(500, 600)]}
    assert found == want
