import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from flowspark.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", "a", "don't it'll 're", "  two  spaces ", "été naïve 中文 😀", "\n\n\t x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>",
       "x" * 5000, "\x00\x01", "!!!???...---"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, PATTERN)


def test_equals_the_library(encoder):
    draw = random.Random(5)
    texts = ODD + ["".join(draw.choice("abc é'.! \n1中") for _ in range(draw.randint(1, 60))) for _ in range(300)]
    for text in texts:
        assert encoder.encode(text) == LIBRARY.encode_ordinary(text)
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_prefix_table_holds_the_last_token_of_every_prefix(encoder):
    data = "Unbelievableness antidisestablishment".encode()
    table = bpe.Prefixes(encoder.vocabulary, data)
    for end in range(1, len(data) + 1):
        assert table.last[end - 1] == encoder.vocabulary.merge(data[:end])[-1]


def test_append_and_replace(encoder):
    draw = random.Random(7)
    for _ in range(60):
        data = bytes(draw.choice(b"theranionsbl e") for _ in range(draw.randint(1, 80)))
        table = bpe.Prefixes(encoder.vocabulary, data[:9])
        table.append(data[9:])
        assert table.ids() == encoder.vocabulary.merge(data)
        begin = draw.randint(0, len(data))
        end = draw.randint(begin, len(data))
        new = bytes(draw.choice(b"xyzthe") for _ in range(draw.randint(0, 6)))
        table.replace(begin, end, new)
        edited = data[:begin] + new + data[end:]
        assert table.data == edited and table.last == bpe.Prefixes(encoder.vocabulary, edited).last


def test_edit_refills_near_the_edit_only(encoder):
    data = b"the quick brown fox " * 400
    table = bpe.Prefixes(encoder.vocabulary, data)
    done = table.replace(100, 103, b"abc")
    assert done < 10 * encoder.vocabulary.longest < len(data)
    assert table.ids() == bpe.Prefixes(encoder.vocabulary, data[:100] + b"abc" + data[103:]).ids()


def test_growing_text(encoder):
    text = "I'll say it's   fine,\n\n and you're  right 'r"
    for cut in range(len(text)):
        draft = bpe.Draft(encoder, text[:cut])
        draft.append(text[cut:])
        assert draft.ids() == LIBRARY.encode_ordinary(text)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hello world", None), (3, "hello world", None), (None, "null id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode_rows(df, "text", ["doc_id"], path, PATTERN)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    by = sorted(((r.doc_id or 0, r.n_tokens, r.ids) for r in found.collect()))
    assert by == [(0, 2, LIBRARY.encode_ordinary("null id")), (1, 0, []), (2, 0, [])] + [(3, 2, LIBRARY.encode_ordinary("hello world"))] * 2
    assert {r.decoded_sha256 for r in found.collect() if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode_rows(df.limit(0), "text", ["doc_id"], path, PATTERN).count() == 0
