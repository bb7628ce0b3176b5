"""Harmonic packing of token sequences.

With capacity C, a piece of length n belongs to class k = floor(C / n), and a sequence of class k takes exactly k
pieces, so no search for room is needed and every task fills its sequences alone. A document is cut so that its
pieces waste little: whole sequences first, then, while the rest would leave more than ``tolerance`` of a class-k
sequence empty, a piece of floor(C / (k + 1)) tokens, the longest of the next class.

What is left at the end of a task (fewer than k pieces of each class) is strung together and cut at the capacity;
the last stretch is cut into powers of two, the sizes that need no padding. So only full class sequences are padded,
by less than ``tolerance``.

The ids are those of the whole tokenizer without tokens around a text; an added token's own string in a text is that
token, as by the library's default.

Defined cases: a null or empty text is a document of the closing id alone; very long texts are cut; documents of equal
length and repeated rows are packed one by one; an empty table gives an empty result. A task holds one unfilled
sequence per class, so its memory does not grow with the input.
"""

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from flowspark.llm.memory import alone, remembered
from flowspark.session import ship_package

CAPACITY, TOLERANCE = 4096, 0.005
#: Bytes of a generation of remembered chunks (those for the whole tokenizer have half of it), what an entry takes
#: beside its characters and ids, and the longest chunk that is remembered.
MEMORY_BYTES, ENTRY_BYTES, MEMORY_CHARS = 60_000_000, 190, 64
BATCH_PIECES = 20_000

_MARKS = "!#$%&*+,-./:;<=>?@[]^_`{|}~\"()"  # without the apostrophe, which may begin a contraction
_STRANGE = re.compile(r"[^\n -~\u00a1-\u024f]").search
#: The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = [chr(b if b in _PRINTABLE else 0x100 + sum(c not in _PRINTABLE for c in range(b))) for b in range(256)]


def piece_lengths(n: int, capacity: int = CAPACITY, tolerance: float = TOLERANCE) -> list[int]:
    """How a document of ``n`` tokens is cut."""
    lengths = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= tolerance * capacity:
            lengths.append(rest)
            break
        piece = capacity // (k + 1)
        lengths.append(piece)
        rest -= piece
    return lengths


def powers_of_two(n: int) -> list[int]:
    return [1 << bit for bit in range(n.bit_length() - 1, -1, -1) if n >> bit & 1]


class Packer:
    """Fills the sequences of one task. ``add`` and ``close`` yield (document, start, sequence, offset, ids)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, tolerance: float = TOLERANCE):
        self.next, self.capacity, self.tolerance = first_sequence, capacity, tolerance
        self.open: dict[int, list[tuple]] = {}

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for document, start, ids in pieces:
            yield document, start, self.next, offset, ids
            offset += len(ids)
        self.next += 1

    def add(self, document, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for length in piece_lengths(len(ids), self.capacity, self.tolerance):
            k = self.capacity // length
            waiting = self.open.setdefault(k, [])
            waiting.append((document, start, ids[start:start + length].copy()))  # not a view: it would keep the document
            start += length
            if len(waiting) == k:
                yield from self._sequence(self.open.pop(k))

    def close(self) -> Iterator[tuple]:
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        total = sum(len(ids) for _, _, ids in left)
        sizes = [self.capacity] * (total // self.capacity) + powers_of_two(total % self.capacity)
        self.open = {}
        for size in sizes:
            taken, room = [], size
            while room:
                document, start, ids = left[0]
                taken.append((document, start, ids[:room]))
                if len(ids) > room:
                    left[0] = (document, start + room, ids[room:])
                else:
                    left.pop(0)
                room -= min(room, len(ids))
            yield from self._sequence(taken)


class _Memory(dict):
    """Answers of ``make``, of two generations: a full one becomes the older, and what was not asked for since goes.

    Keys and answers count with the bytes that they and their entry take.
    """

    def __init__(self, make, limit: int, older: "dict | None" = None):
        super().__init__()
        self.make, self.limit, self.older, self.bytes = make, limit, older or {}, 0

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMORY_CHARS and self.bytes < 2 * self.limit:
            self[key] = value
            self.bytes += 2 * len(key) + len(value) + ENTRY_BYTES
        return value

    def next(self) -> "_Memory":
        """This memory, or where it is full an empty one that has it as its older generation."""
        if self.bytes < self.limit:
            return self
        self.older = {}
        return _Memory(self.make, self.limit, self)


class ChunkTokens:
    """Ids (as little-endian bytes) of the stretches between spaces and line ends, kept in bounded memories.

    The vocabulary's words end at white space, so a text's ids are those of its stretches one after the other. In
    printable Latin text normalising is lower-casing, so it is lower-cased as a whole, and each of its stretches is
    one of the pattern's pieces or several, which are looked up in the same memory. Texts with other characters, or with
    one of the vocabulary's added tokens, go stretch by stretch; the stretches concerned go through the whole tokenizer.
    """

    def __init__(self, description: str):
        self.tokenizer = Tokenizer.from_str(description)
        wanted = json.loads(description)
        normal = [n["type"] for n in wanted["normalizer"]["normalizers"]]
        split = wanted["pre_tokenizer"]["pretokenizers"][0]
        if normal != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError("a tokenizer that lower-cases and keeps a pattern's matches is needed")
        self.added = [t["content"].lower() for t in wanted["added_tokens"]]
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.tokenize = self.tokenizer.model.tokenize
        self.chunks, self.others = _Memory(self.make, MEMORY_BYTES), _Memory(self.whole, MEMORY_BYTES // 2)

    def piece(self, piece: str) -> bytes:
        """Ids of what the vocabulary's pattern cuts out of lower-case text."""
        word = piece if piece.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.tokenize(word)]).tobytes()

    def make(self, low: str) -> bytes:
        """Ids of a stretch of lower-case Latin characters."""
        word = low.rstrip(_MARKS)
        if word.isalpha():  # letters and then marks are two pieces
            return self.chunks[word] + self.chunks[low[len(word):]] if len(word) < len(low) else self.piece(low)
        pieces = self.find(low)
        return self.piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.chunks.__getitem__, pieces))

    def whole(self, chunk: str) -> bytes:
        """Ids of any stretch."""
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def has_added(self, low: str) -> bool:
        return any(map(low.__contains__, self.added))

    def of_chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        return self.others[chunk] if _STRANGE(chunk) or self.has_added(low) else self.chunks[low]

    def encode(self, text: str, closing: int) -> np.ndarray:
        self.chunks, self.others = self.chunks.next(), self.others.next()
        low = text.lower()
        if _STRANGE(text) or self.has_added(low):
            found = b"".join(map(self.of_chunk, text.replace("\n", " ").split(" ")))
        else:
            found = b"".join(map(self.chunks.__getitem__, low.split()))
        return np.frombuffer(found + closing.to_bytes(4, "little"), np.uint32)


_tokenizers: dict[str, ChunkTokens] = remembered({})


def pack_documents(df: DataFrame, key: str, text: str, tokenizer_path: str, closing: int, capacity: int = CAPACITY,
                   tolerance: float = TOLERANCE, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``sequence_id`` is the task's number shifted left by 40 bits plus a count, so a repeated task numbers alike. The
    tokenizer file is read by the driver and sent along; its size does not depend on the data.
    """
    spark = df.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    description, digest = spark.sparkContext.broadcast(content), hashlib.md5(content.encode()).hexdigest()
    kind = df.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
              "offset bigint") + ", ids array<bigint>" * with_ids
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(_tokenizers)
        if digest not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[digest] = ChunkTokens(description.value)
        tokens = _tokenizers[digest]
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, tolerance)
        rows, kind_of_key = [], None

        def batch_of() -> pa.RecordBatch:
            keys, starts, lengths, sums, totals, sequences, offsets, ids = zip(*rows)
            arrays = [pa.array(keys, kind_of_key)] + [
                pa.array(c, pa.int64()) for c in (starts, lengths, sums, totals, sequences, offsets)]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int64())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def put(pieces):
            for (name, total), start, sequence, offset, ids in pieces:
                rows.append((name, start, len(ids), zlib.crc32(ids), total, sequence, offset, ids if with_ids else None))

        for batch in batches:
            kind_of_key = batch.column(0).type
            for name, text_ in zip(batch.column(0), batch.column(1)):
                ids = tokens.encode(text_.as_py() or "", closing)
                put(packer.add((name.as_py(), len(ids)), ids))
                if len(rows) >= BATCH_PIECES:
                    yield batch_of()
        put(packer.close())
        if rows:
            yield batch_of()

    return df.selectExpr(f"`{key}`", f"`{text}`").mapInArrow(run, schema)
