import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 5, 63, 64, 65, 1000, 1365, 1366, 2048, 2049, 4095, 4096, 4097, 20_000])
def test_pieces_of_a_document_waste_little(n):
    lengths = packing.piece_lengths(n)
    assert sum(lengths) == n and min(lengths) > 0
    for length in lengths:
        k = packing.CAPACITY // length
        assert packing.CAPACITY - k * length <= max(packing.TOLERANCE * packing.CAPACITY, k)


def test_powers_of_two():
    assert packing.powers_of_two(0) == [] and packing.powers_of_two(13) == [8, 4, 1]


def test_chunks_equal_the_whole_tokenizer():
    whole = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as file:
        chunks = packing.ChunkTokens(file.read())
    texts = ["", "  ", "Don't STOP, it's 12³½!", "İstanbul ΣΑΣ é Å", "a\tb\x0bc\x85d e", "ª­x ﬁ 中文 😀", "end <|endoftext|> x",
             "a<|startoftext|>B <|ENDOFTEXT|>.", "<|endoftext|>" * 9,
             "\ttab", "é combining", "''s 'll''", "a\x1cb"]
    for text in texts:
        assert chunks.encode(text, 2).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]


def test_memory_forgets_without_changing_answers(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY_BYTES", 700)
    with open(PATH, encoding="utf-8") as file:
        chunks = packing.ChunkTokens(file.read())
    whole = Tokenizer.from_file(PATH)
    for text in ["one two three", "four one five two six", "seven " + "one" * 40 + " eight nine ten eleven", "one", "two one", "six"] * 3:
        assert chunks.encode(text, 2).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]
        assert len(chunks.chunks) < 9 and "one" * 40 not in chunks.chunks and chunks.chunks.bytes < 1700


def test_capitals_and_marks_share_answers(monkeypatch):
    with open(PATH, encoding="utf-8") as file:
        chunks = packing.ChunkTokens(file.read())
    asked = []
    monkeypatch.setattr(chunks, "tokenize", lambda word, whole=chunks.tokenize: asked.append(word) or whole(word))
    text = "Zorblat ZORBLAT, zorblat. (zorblat) Zorblat,\nzorblat's\n Éa éa"
    want = [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 2]
    assert chunks.encode(text, 2).tolist() == want
    assert len(asked) == len(set(asked)) and {"zorblat", ",", ".", "(", ")", "'s"} <= set(asked)
    assert {"zorblat", "zorblat,", "éa"} <= set(chunks.chunks) and not {"Zorblat", "ZORBLAT,", "Éa"} & set(chunks.chunks)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "long words " * 9000), (None, "no id")]
    rows += [(10 + i, "some words of text " * (i % 40)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = packing.pack_documents(df, "doc_id", "text", PATH, 2, with_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for key, text in rows:
        want[key].append([*whole.encode(text or "", add_special_tokens=False).ids, 2])
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in found:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, np.uint32)) == r.ids_crc32
        got[r.doc_id] += [(r.start, r.ids)]
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(want)
    for key, pieces in got.items():
        if len(want[key]) == 1:
            assert sum((ids for _, ids in sorted(pieces)), []) == want[key][0]
    padded = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
        padded += 4096 - end if end & (end - 1) else 0
    assert padded <= 0.01 * sum(r.length for r in found)
    assert packing.pack_documents(df.limit(0), "doc_id", "text", PATH, 2).count() == 0
