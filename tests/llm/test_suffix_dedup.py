"""Windows removed by the radix sort, against a dictionary of all windows."""

import hashlib
import random

import pytest

from flowspark.llm import suffix_dedup

SCHEMA = "doc_id bigint, text string"


def plain(rows, depth):
    owner = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - depth + 1):
            if doc is not None:
                owner[data[i:i + depth]] = min(owner.get(data[i:i + depth], doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - depth + 1):
            if doc is not None and owner[data[i:i + depth]] < doc:
                gone[i:i + depth] = b"\1" * depth
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, x in zip(data, gone) if not x)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 30))) for _ in range(5)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(passages)[rng.randrange(0, 10):] + text[at:]
        if rows and rng.random() < 0.2:
            text = rng.choice(rows)[1] or ""
        if rng.random() < 0.1:
            text = "ab" * rng.randrange(0, 300)
        rows.append((i if rng.random() < 0.9 else rng.randrange(n), text if rng.random() < 0.97 else None))
    rows += [(None, passages[0]), (None, passages[0]), (n, passages[0]), (n, passages[0]), (n + 1, "")]
    return rows


@pytest.mark.parametrize("depth, chunk, hot", [(50, 500_000, 4096), (20, 150, 3), (7, 500_000, 40)])
def test_equals_plain_definition(spark, monkeypatch, depth, chunk, hot):
    monkeypatch.setattr(suffix_dedup, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(suffix_dedup, "HOT_SPANS", hot)
    rows = corpus(depth)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in suffix_dedup.dedup_digests(df, "doc_id", "text", depth).collect()), key=str)
    assert got == plain(rows, depth)


def test_long_texts_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    rng = random.Random(1)
    long = "".join(rng.choice("abc d") for _ in range(30_000))
    rows = [(1, long), (2, "x" * 40 + long[990:25_000] + "yz"), (3, "q" * 9000), (0, "q" * 500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in suffix_dedup.dedup_digests(df, "doc_id", "text").collect()), key=str)
    assert got == plain(rows, 50)


def test_columns_pass_through(spark):
    text = "one passage of more than fifty bytes that two documents hold, word by word"
    rows = [(1, text, "a", 5), (2, "é" + text + "!", "b", 6)]
    df = spark.createDataFrame(rows, "doc_id int, text string, __copy string, row int")
    found = {r["doc_id"]: r for r in suffix_dedup.without_repeats(df, "doc_id", "text").collect()}
    assert found[1]["kept"].decode() == text and found[2]["kept"].decode() == "é!"
    assert found[2]["__copy"] == "b" and found[2]["row"] == 6 and found[2]["text"] == "é" + text + "!"
    again = suffix_dedup.without_repeats(df.withColumnRenamed("row", "kept"), "doc_id", "text")
    assert again.columns == ["doc_id", "text", "__copy", "kept"]


def test_empty_table(spark):
    assert suffix_dedup.dedup_digests(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0
