"""Line deduplication across documents, returning per-document bitmaps of kept lines.

Line keys (a line stripped of ASCII white space, A-Z lower-cased) are hashed to 96 bits and range-partitioned by
(hash, document, position), so even a line that a third of all documents share is spread over many tasks. Each task
streams its sorted rows and marks every line whose hash came earlier in another document. The first hash of a task
may continue a run begun in an earlier one; those rows wait for a table of at most two runs per task, broadcast
because its size is bounded by the number of tasks.

What leaves is, for each document that loses lines, a compressed bitmap; texts are joined to it only when a caller
wants them.

Defined cases: a null or empty text is one empty line; keys shorter than ``shortest`` code points are never dropped;
a key repeated inside one document only is kept; rows that repeat a document id count as one document, each row
losing the same lines; rows without an id own nothing and lose nothing; texts of any length are read whole; an empty
table gives no bitmaps; other columns are left as they are, whatever their names.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.tables import stored
from flowspark.session import ship_package

SHORTEST = 10
_BLANK = b" \t\n\x0b\x0c\r"
_DROPPED, _WAITING, _RUN = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()  # bytes.lower() changes A-Z only


def _long_enough(key: bytes, shortest: int) -> bool:
    """Whether a UTF-8 key has at least ``shortest`` code points; a code point takes 1 to 4 bytes."""
    return len(key) >= 4 * shortest or (len(key) >= shortest and len(key.decode(errors="replace")) >= shortest)


def _hash_lines(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, at, positions = [], [], [], []
            for number, text in enumerate(batch.column("__text").cast(pa.binary())):
                for position, line in enumerate((text.as_py() or b"").split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, shortest):
                        value = xxhash.xxh3_128_intdigest(key)
                        high.append(value >> 64)
                        low.append(value & 0x7FFFFFFF)
                        at.append(number)
                        positions.append(position)
            number = np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(low, np.int32)),
                batch.column("__doc").take(number), batch.column("__row").take(number),
                pa.array(np.array(positions, np.int32)),
            ], names=["__h", "__l", "__doc", "__row", "__pos"])

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted rows: lines dropped for certain, lines that wait, and the owner of the first and last run."""
    owner, key, first = None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        h, low, doc, row, pos = (c.to_numpy() for c in batch.columns)
        starts = np.empty(len(h), bool)
        starts[0] = key != (h[0], low[0])
        starts[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
        heads = np.flatnonzero(starts)
        run = np.cumsum(starts) - 1  # -1: still the run that the batch before ended with
        owners = np.where(run >= 0, doc[heads[run]] if len(heads) else doc, owner if owner is not None else doc[0])
        waiting = np.zeros(len(h), bool)
        if first:
            until = heads[0] if key is not None and len(heads) else (heads[1] if key is None and len(heads) > 1 else len(h))
            waiting[:until] = True
            if key is None:
                yield _marked(h[:1], low[:1], doc[:1], row[:1], pos[:1], _RUN)
            first = until == len(h)
        dropped = (doc != owners) & ~waiting
        yield _marked(h[dropped], low[dropped], doc[dropped], row[dropped], pos[dropped], _DROPPED)
        yield _marked(h[waiting], low[waiting], doc[waiting], row[waiting], pos[waiting], _WAITING)
        key, owner = (h[-1], low[-1]), owners[-1]
    if key is not None:
        yield _marked(np.array([key[0]]), np.array([key[1]], np.int32), np.array([owner]), np.zeros(1, np.int64),
                      np.zeros(1, np.int32), _RUN)


def _marked(h, low, doc, row, pos, state: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(h), pa.array(low), pa.array(doc), pa.array(row), pa.array(pos),
         pa.array(np.full(len(h), state, np.int32))],
        names=["__h", "__l", "__doc", "__row", "__pos", "__state"])


def _identity(key: str, text: str) -> list[Column]:
    return [F.col(f"`{key}`").cast("long").alias("__doc"), F.xxhash64(F.col(f"`{text}`")).alias("__row")]


def repeated_lines(df: DataFrame, key: str, text: str, shortest: int = SHORTEST) -> DataFrame:
    """(``__doc``, ``__row``, ``__pos``) of every line that an earlier document holds.

    ``key`` must be a whole number; ``__row`` hashes the row's text.
    """
    ship_package(df.sparkSession)
    columns = "__h bigint, __l int, __doc bigint, __row bigint, __pos int"
    rows = df.select(*_identity(key, text), F.col(f"`{text}`").alias("__text"))
    lines = rows.where("__doc is not null").mapInArrow(_hash_lines(shortest), columns)
    order = ["__h", "__l", "__doc", "__row", "__pos"]
    spread = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = stored(spread.mapInArrow(_mark, columns + ", __state int"), "lines")
    owners = marked.where(f"__state = {_RUN}").groupBy("__h", "__l").agg(F.min("__doc").alias("__owner"))
    waiting = marked.where(f"__state = {_WAITING}").join(F.broadcast(owners), ["__h", "__l"])
    wanted = ["__doc", "__row", "__pos"]
    return marked.where(f"__state = {_DROPPED}").select(*wanted).union(
        waiting.where("__doc <> __owner").select(*wanted))


def keep_bitmaps(df: DataFrame, key: str, text: str, shortest: int = SHORTEST) -> DataFrame:
    """(``__doc``, ``__row``, ``__bitmap``) of documents that lose lines: zlib over bits, 1 for a line that stays.

    Bits past the end of a bitmap are 1.
    """
    dropped = repeated_lines(df, key, text, shortest).groupBy("__doc", "__row").agg(
        F.sort_array(F.collect_set("__pos")).alias("__positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps = [pack_bits(p.values.to_numpy()) for p in batch.column("__positions")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__doc"), batch.column("__row"), pa.array(bitmaps, pa.binary())],
                names=["__doc", "__row", "__bitmap"])

    return dropped.mapInArrow(run, "__doc bigint, __row bigint, __bitmap binary")


def pack_bits(dropped: np.ndarray) -> bytes:
    bits = np.ones(int(dropped.max()) // 8 * 8 + 8, bool)  # whole bytes, so that padding keeps lines too
    bits[dropped] = False
    return zlib.compress(np.packbits(bits).tobytes())


def kept_lines(lines: list, bitmap: bytes | None) -> list:
    if bitmap is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    keep = np.ones(len(lines), bool)
    keep[: min(len(bits), len(lines))] = bits[: len(lines)]
    return [line for line, stays in zip(lines, keep) if stays]


def dedup_lines(df: DataFrame, key: str, text: str, shortest: int = SHORTEST, digests: bool = False) -> DataFrame:
    """``df`` with ``text`` cut to its kept lines; with ``digests``, the key, line counts and a digest instead."""
    ship_package(df.sparkSession)
    at, names = df.columns.index(text), df.columns
    # By number, no column bears a helper's name.
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    key_, text_ = f"c{names.index(key)}", f"c{at}"
    bitmaps = keep_bitmaps(plain, key_, text_, shortest)
    whole = plain.select("*", *_identity(key_, text_))
    joined = whole.join(bitmaps, ["__doc", "__row"], "left").select(*plain.columns, "__bitmap")
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, bitmap in zip(batch.column(at).cast(pa.binary()), batch.column(len(names))):
                texts.append(b"\n".join(kept_lines((value.as_py() or b"").split(b"\n"), bitmap.as_py())))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, drops, sums = [], [], []
            for value, bitmap in zip(batch.column(at).cast(pa.binary()), batch.column(len(names))):
                lines = (value.as_py() or b"").split(b"\n")
                left = kept_lines(lines, bitmap.as_py())
                counts.append(len(lines))
                drops.append(len(lines) - len(left))
                sums.append(hashlib.sha256(b"\n".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(key)), pa.array(counts, pa.int64()), pa.array(drops, pa.int64()),
                 pa.array(sums, pa.string())],
                names=[key, "n_lines", "n_dropped", "kept_sha256"])

    if digests:
        return joined.mapInArrow(digest, f"`{key}` {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return joined.mapInArrow(cut, fields)
