import hashlib
from collections import defaultdict

import numpy as np

from flowspark.llm import line_dedup

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    """(doc_id, text) -> (n_lines, n_dropped, digest) by definition."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
            if len(key) >= 10 and doc is not None:
                holders[key].add(doc)
    out = []
    for doc, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            owners = holders.get(line.strip(" \t\n\x0b\x0c\r").translate(UPPER), set())
            if doc is None or len(owners) < 2 or min(owners) == doc:
                kept.append(line)
        out.append((-1 if doc is None else doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, n_lines string").repartition(parts)
    found = line_dedup.dedup_lines(df, "doc_id", "text", digests=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found) == brute(rows)
    texts = line_dedup.dedup_lines(df, "doc_id", "text")
    assert texts.columns == df.columns and {r.n_lines for r in texts.collect()} == {"extra"}
    kept = sorted((-1 if r.doc_id is None else r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in texts.collect())
    assert kept == sorted((d, s) for d, _, _, s in brute(rows))


def test_cases(spark):
    check(spark, [
        (5, "a common line here\nshort\nown line of five"), (3, "  A COMMON line here\t\nshort\n"), (9, None), (10, ""),
        (7, "a common line here\na common line here\nÉÉÉÉÉÉÉÉÉÉ"), (8, "éééééééééé\nÉÉÉÉÉÉÉÉÉÉ"), (None, "a common line here"),
        (11, "twice in one doc\ntwice in one doc"), (12, "x" * 200_000 + "\na common line here"), (3, "  A COMMON line here\t\nshort\n"),
    ])


def test_hot_line_over_many_tasks(spark):
    check(spark, [(i, f"a very common line\nline number {i % 7} again\n\nunique text {i}") for i in range(600)], 7)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(df, "doc_id", "text", digests=True).count() == 0


def test_columns_named_like_helpers(spark):
    rows = [(1, "a common line here", 5, "x", "y"), (2, "a common line here\nown", 6, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __doc int, __bitmap string, __ROW string")
    found = line_dedup.dedup_lines(df, "doc_id", "text")
    assert found.columns == df.columns
    assert sorted(tuple(r) for r in found.collect()) == [rows[0], (2, "own", *rows[1][2:])]


def test_bitmap_keeps_lines_past_its_end():
    bitmap = line_dedup.pack_bits(np.array([1, 9]))
    assert line_dedup.kept_lines(list(range(30)), bitmap) == [i for i in range(30) if i not in (1, 9)]
    assert line_dedup.kept_lines([1, 2], None) == [1, 2]
