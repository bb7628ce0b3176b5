"""Removal of byte windows that a document with a smaller id holds, by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``depth`` bytes, in passes that begin with the most significant digit. Digits are
long (strings of 16 or 32 bytes) and stand as 64-bit names; a group whose suffixes come from one document only leaves
after its pass, and groups that are equal through the last digit are exactly the repeated windows.

Pass 1. The first digit of a window is the 16-byte string of least name in it. Windows that begin side by side mostly
have the same one, so they travel as one span (about one row for 18 bytes), with a name of the span's whole bytes. A
window that occurs in two documents has the same first digit in both, so spans whose digit has one document only are
done. A span that is equal in a smaller document is covered whole; so only its smallest holder goes on.

Pass 2. The spans that are left are dealt by their first digit, with their bytes. Inside a task the windows of each
digit's spans are ordered by their next digits, the first 32 bytes and the rest; in each group of equal windows the
smallest id owns them, and all other documents are covered there. Spans of a digit that has very many of them do not
travel together: their windows are dealt one by one, by both digits.

Covered stretches are united per document and cut out. Texts equal to one with a smaller id never enter: they are
covered whole if they hold a window.

Every task works through its texts in chunks and settles within a chunk what it can: a hot digit, span or window leaves
a chunk once for each kind of neighbourhood, so no group gathers more rows than there are chunks (times the repeats
inside one document).

Defined cases: a null or empty text has no windows; texts of any length are read whole, in blocks; rows that repeat an
id are judged by their own texts and do not cover one another; rows without an id cover nothing and lose nothing; equal
windows inside one document stay unless a smaller id holds them; an empty table gives no rows; other columns are
ignored or, in :func:`without_repeats`, passed through. Windows are compared by names of 128 bits.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.tables import sized, stored
from flowspark.session import ship_package

DEPTH, FIRST_DIGIT = 50, 16
BLOCK, CHUNK_ROWS = 1 << 18, 500_000
#: From so many spans that are left on, the windows of a digit are dealt one by one; the result is the same.
HOT_SPANS = 4096

#: What a row of pass 1 says of its key: a digit that several documents have, a span under its digit, a span whose digit
#: is known to have several documents, under its own name, and a stretch that is covered for certain.
_SEVERAL, _SPAN, _NAMED, _COVERED = 0, 1, 2, 3

_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTES = (np.arange(1, 257, dtype=np.uint64) * _TWO) ^ (np.arange(1, 257, dtype=np.uint64) * _ONE >> np.uint64(17))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for every pair of names; the order of the two counts."""
    x = (a ^ (a >> np.uint64(29))) * _ONE
    x += b
    x ^= x >> np.uint64(32)
    x *= _TWO
    x ^= x >> np.uint64(31)
    return x


class Names:
    """Names of the substrings of ``data``, by doubling: equal strings have equal names."""

    def __init__(self, data: np.ndarray, longest: int):
        self.levels = [_BYTES[data]]  # level k: names of the 2^k bytes that begin at each place
        while (2 << (len(self.levels) - 1)) <= longest:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_mixed(last[:-half], last[half:]) if len(last) > half else last[:0])

    def at(self, places: np.ndarray, size: int) -> np.ndarray:
        """Names of the ``size`` bytes that begin at each of ``places``."""
        name, left, offset = None, size, 0
        for k in range(len(self.levels) - 1, -1, -1):
            while left >= 1 << k:
                part = self.levels[k][places + offset]
                name = part if name is None else _mixed(name, part)
                left, offset = left - (1 << k), offset + (1 << k)
        return name


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    more = width - have
    return np.minimum(out[:-more], out[more:]) if more else out


def _blocks(column: pa.Array, depth: int) -> Iterator[tuple]:
    """(bytes, first place, number of windows' places, ends): pieces of a batch's texts with the ends of their rows.

    A piece overlaps the next one by the bytes that its last windows need; ``ends`` gives for each of its places the end
    of the row's text.
    """
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(data, np.uint8)
    for begin in range(int(offsets[0]), int(offsets[-1]), BLOCK):
        end = min(begin + BLOCK, int(offsets[-1]))
        first, last = np.searchsorted(offsets, [begin, end - 1], "right") - 1
        rows = np.arange(first, last + 1)
        lengths = np.minimum(offsets[rows + 1], end) - np.maximum(offsets[rows], begin)
        rows = rows[lengths > 0].astype(np.int32)
        row = np.repeat(rows, lengths[lengths > 0])
        yield data[begin:min(end + depth - 1, int(offsets[-1]))], begin, end - begin, row, offsets


def _spans(column: pa.Array, depth: int) -> Iterator[tuple]:
    """(digit, name, row, begin, windows) of a batch's spans: neighbouring windows with the same first digit."""
    digit = min(FIRST_DIGIT, depth)
    width = depth - digit + 1
    for data, origin, places, row, offsets in _blocks(column, depth):
        room = len(data) - depth + 1
        if room <= 0:
            continue
        names = Names(data, digit)
        least = _least(names.levels[-1] if digit == 1 << (len(names.levels) - 1) else names.at(
            np.arange(len(data) - digit + 1), digit), width)[:min(places, room)]
        row, where = row[:len(least)], np.arange(origin, origin + len(least))
        whole = where + depth <= offsets[row + 1]
        head = whole.copy()
        head[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        heads = np.flatnonzero(head)
        if not len(heads):
            continue
        # A span ends before the next head or the first place that has no whole window.
        total = np.cumsum(whole)
        windows = np.diff(np.r_[total[heads] - 1, total[-1]])
        if windows.max() > width:  # periodic bytes: the same digit again and again
            parts = -(-windows // width)
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            heads, left = np.repeat(heads, parts) + step * width, np.repeat(windows, parts) - step * width
            windows = np.minimum(left, width)
        span = _mixed(_mixed(names.at(heads, depth), names.at(heads + windows - 1, depth)), windows.astype(np.uint64))
        yield least[heads], span, row[heads], where[heads] - offsets[row[heads]], windows


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _per_group(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value at each group's first row, for all its rows."""
    return values[np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))]


def _united(doc: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple:
    """Neighbouring rows whose stretches follow one another and touch, as one."""
    if not len(doc):
        return doc, row, begin, end
    fresh = _starts(doc, row)
    fresh[1:] |= (begin[1:] > end[:-1]) | (begin[1:] < begin[:-1])
    heads = np.flatnonzero(fresh)
    return doc[heads], row[heads], begin[heads], np.maximum.reduceat(end, heads)


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], names=names.split())


_SORTED = "key tag doc row place"


def _chunks(batches: Iterator[pa.RecordBatch], rows_of) -> Iterator[tuple]:
    """``rows_of(batch)``'s arrays, strung together to about CHUNK_ROWS rows."""
    held, count = [], 0
    for batch in batches:
        for arrays in rows_of(batch):
            held.append(arrays)
            count += len(arrays[0])
            if count >= CHUNK_ROWS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, count = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _first_pass(depth: int):
    """Rows (key, tag, doc, row, place) of pass 1. The tag is what the row says and 32 bits more of the name; the place
    is the first byte and the number of windows (of bytes, if covered)."""

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        doc, row = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
        for digit, span, at, begin, windows in _spans(batch.column("text"), depth):
            yield digit, span, doc[at], row[at], begin, windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digit, span, doc, row, begin, windows in _chunks(batches, rows_of):
            order = np.lexsort((begin, row, doc, span, digit))
            d, s, o, r, b = digit[order], span[order], doc[order], row[order], begin[order]
            group = _starts(d, s)
            again = ~_starts(d, s, o, r, b)  # the same row given twice
            covered = (o > _per_group(group, o)) & ~again
            # Covered spans, back in the order of places, where neighbours unite.
            at = np.sort(order[covered])
            stretches = _united(doc[at], row[at], begin[at], begin[at] + windows[at] + depth - 1)
            if len(stretches[0]):
                where = _mixed(stretches[0].astype(np.uint64), stretches[2].astype(np.uint64))
                yield _batch(_SORTED, where.view(np.int64), np.full(len(where), _COVERED << 32), *stretches[:2],
                             stretches[2] << 16 | np.minimum(stretches[3] - stretches[2], 0xFFFF))
                # A stretch longer than 16 bits hold goes on in rows of its own.
                yield from _long_stretches(where, *stretches)
            left = ~covered & ~again
            d, s, o, r, b, n = d[left], s[left], o[left], r[left], b[left], windows[order][left]
            if not len(d):
                continue
            heads = _starts(d)
            several = np.repeat(np.minimum.reduceat(o, np.flatnonzero(heads)) != np.maximum.reduceat(o, np.flatnonzero(heads)),
                                np.diff(np.r_[np.flatnonzero(heads), len(d)]))
            told = heads & several
            yield _batch(_SORTED, d[told].view(np.int64), np.full(int(told.sum()), _SEVERAL << 32), o[told], r[told],
                         np.zeros(int(told.sum()), np.int64))
            low = np.uint64(0xFFFFFFFF)
            key = np.where(several, s, d).view(np.int64)
            tag = np.where(several, _NAMED << 32, _SPAN << 32) | (np.where(several, d, s) & low).astype(np.int64)
            yield _batch(_SORTED, key, tag, o, r, b << 16 | n)

    return run


def _long_stretches(where, doc, row, begin, end) -> Iterator[pa.RecordBatch]:
    long = np.flatnonzero(end - begin > 0xFFFF)
    if len(long):
        parts = (end[long] - begin[long] - 1) // 0xFFFF
        at = np.repeat(long, parts)
        step = (np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts) + 1) * 0xFFFF
        yield _batch(_SORTED, where[at].view(np.int64), np.full(len(at), _COVERED << 32), doc[at], row[at],
                     (begin[at] + step) << 16 | np.minimum(end[at] - begin[at] - step, 0xFFFF))


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    """Arrays of sorted batches, cut so that no group of equal first ``columns`` columns is split."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [c.to_numpy() for c in batch.columns]
        if held is not None:
            arrays = [np.concatenate(pair) for pair in zip(held, arrays)]
        last = int(np.flatnonzero(_starts(*arrays[:columns]))[-1])
        if last:
            yield tuple(a[:last] for a in arrays)
        held = [a[last:].copy() for a in arrays]
    if held is not None:
        yield tuple(held)


def _settle_spans(depth: int):
    """Sorted rows of pass 1 to (doc, row, begin, end, windows, low): covered stretches (0 windows) and spans that go on,
    with the low bits of their digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, tag, doc, row, place in _whole_groups(batches, 1):
            kind, begin, size = tag >> 32, place >> 16, place & 0xFFFF
            covered = kind == _COVERED
            same = _starts(key, tag)
            beaten = ~covered & (kind != _SEVERAL) & (doc > _per_group(same, doc))
            under = kind <= _SPAN
            heads = np.flatnonzero(_starts(key))
            low = np.minimum.reduceat(np.where(under, doc, np.iinfo(np.int64).max), heads)
            high = np.maximum.reduceat(np.where(under, doc, np.iinfo(np.int64).min), heads)
            told = np.logical_or.reduceat(kind == _SEVERAL, heads)
            shared = np.repeat(told | (low < high), np.diff(np.r_[heads, len(key)]))
            goes_on = ~beaten & ((kind == _NAMED) | ((kind == _SPAN) & shared))
            out = covered | beaten | goes_on
            end = np.where(covered, begin + size, begin + size + depth - 1)
            low_bits = np.where(kind == _NAMED, tag, key) & 0xFFFFFFFF
            yield _batch("doc row begin end windows low", doc[out], row[out], begin[out], end[out],
                         np.where(goes_on, size, 0)[out], np.where(goes_on, low_bits, 0)[out])

    return run


def _window_names(names: Names, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The last two digits of windows: their first 32 bytes (or fewer), and the rest."""
    front = 1 << (len(names.levels) - 1)
    return names.at(at, front), names.at(at + front, depth - front) if depth > front else np.zeros(len(at), np.uint64)


def _front(depth: int) -> int:
    return 1 << (min(32, depth).bit_length() - 1)


def _places(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for ``count`` places of each."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


_WINDOWS = "key bigint, tag bigint, doc bigint, row bigint, begin bigint, end bigint, data binary"
_WINDOW_NAMES = [c.split()[0] for c in _WINDOWS.split(", ")]
#: The tag of covered stretches and of spans; those of windows are odd.
_DONE, _BYTES_TAG = 0, 2


def _window_batch(*columns, data: pa.Array | None = None) -> pa.RecordBatch:
    arrays = [pa.array(c.astype(np.int64, copy=False)) for c in columns]
    return pa.RecordBatch.from_arrays(
        [*arrays, pa.nulls(len(arrays[0]), pa.binary()) if data is None else data], names=_WINDOW_NAMES)


def _second_pass(depth: int):
    """Rows of pass 2: spans with their bytes, windows of hot digits, and stretches that are covered for certain."""
    digit = min(FIRST_DIGIT, depth)

    def cold(doc, row, begin, windows, places, data: np.ndarray) -> pa.RecordBatch:
        sizes = windows + depth - 1
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        taken = data[_places(places, sizes)]
        names = Names(taken, digit)
        start = _places(offsets[:-1].astype(np.int64), np.full(len(doc), depth - digit + 1))
        least = np.minimum.reduceat(names.at(start, digit), np.arange(len(doc)) * (depth - digit + 1))
        held = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(taken)])
        return _window_batch(least.view(np.int64), np.full(len(doc), _BYTES_TAG), doc, row, begin, begin + sizes, data=held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0
        for batch in batches:
            doc, row = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            lists = batch.column("spans")
            spans, owner = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            first, windows = spans.field("begin").to_numpy(), spans.field("windows").to_numpy()
            hot = spans.field("hot").to_numpy(zero_copy_only=False)
            column = batch.column("text").cast(pa.large_binary())
            origin = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)
            for part in range(0, len(owner), BLOCK // depth):
                here = np.arange(part, min(part + BLOCK // depth, len(owner)))
                calm = here[~hot[here]]
                if len(calm):
                    who = owner[calm]
                    yield cold(doc[who], row[who], first[calm], windows[calm], origin[who] + first[calm], data)
                busy = here[hot[here]]
                if len(busy):
                    who, sizes = owner[busy], windows[busy] + depth - 1
                    names = Names(data[_places(origin[who] + first[busy], sizes)], _front(depth))
                    at = _places(np.cumsum(sizes) - sizes, windows[busy])
                    who = np.repeat(who, windows[busy])
                    waiting.append((*_window_names(names, at, depth), doc[who], row[who], _places(first[busy], windows[busy])))
                    count += len(at)
            if count >= CHUNK_ROWS:
                yield from settled(waiting)
                waiting, count = [], 0
        if waiting:
            yield from settled(waiting)

    def settled(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
        """What a chunk's hot windows say of one another, and those that are left."""
        a, b, doc, row, begin = map(np.concatenate, zip(*waiting))
        order = np.lexsort((begin, row, doc, b, a))
        a, b, doc, row, begin = (x[order] for x in (a, b, doc, row, begin))
        beaten = doc > _per_group(_starts(a, b), doc)
        at = np.flatnonzero(beaten)
        at = at[np.lexsort((begin[at], row[at], doc[at]))]
        stretch = _united(doc[at], row[at], begin[at], begin[at] + depth)
        done = np.full(len(stretch[0]), _DONE)
        yield _window_batch(_mixed(stretch[0].astype(np.uint64), stretch[2].astype(np.uint64)).view(np.int64), done, *stretch)
        left = ~beaten & _starts(a, b, doc, row, begin)
        yield _window_batch(a[left].view(np.int64), b[left].view(np.int64) | 1, doc[left], row[left], begin[left],
                            begin[left] + depth)

    return run


def _settle_windows(depth: int):
    """Sorted rows of pass 2 to the stretches (doc, row, begin, end) that are covered."""

    def of_spans(key, doc, row, begin, end, data: pa.Array) -> Iterator[tuple]:
        sizes = end - begin
        windows = sizes - depth + 1
        names = Names(np.frombuffer(b"".join(data.to_pylist()), np.uint8), _front(depth))
        a, b = _window_names(names, _places(np.cumsum(sizes) - sizes, windows), depth)
        group, who = np.repeat(np.cumsum(_starts(key)), windows), np.repeat(np.arange(len(key)), windows)
        place = _places(begin, windows)
        order = np.lexsort((doc[who], b, a, group))
        first = _starts(group[order], a[order], b[order])
        beaten = np.sort(order[doc[who][order] > _per_group(first, doc[who][order])])
        yield _united(doc[who][beaten], row[who][beaten], place[beaten], place[beaten] + depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = int(np.flatnonzero(_starts(key, tag))[-1]) if len(key) else 0
            held = batch.slice(last)
            if last:
                yield from found(batch.slice(0, last))
        if held is not None and held.num_rows:
            yield from found(held)

    def found(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, tag, doc, row, begin, end = (c.to_numpy() for c in batch.columns[:6])
        spans = np.flatnonzero(tag == _BYTES_TAG)
        out = np.flatnonzero((tag == _DONE) | ((tag != _BYTES_TAG) & (doc > _per_group(_starts(key, tag), doc))))
        yield _batch("doc row begin end", doc[out], row[out], begin[out], end[out])
        if len(spans):
            data = batch.column(6).take(pa.array(spans))
            for stretch in of_spans(key[spans], doc[spans], row[spans], begin[spans], end[spans], data):
                yield _batch("doc row begin end", *stretch)

    return run


def covered_stretches(texts: DataFrame, depth: int) -> DataFrame:
    """(doc, row, begin, end) of bytes of ``texts`` (doc, row, text) under windows that a smaller doc holds."""
    rows = "key bigint, tag bigint, doc bigint, row bigint, place bigint"
    spans = texts.mapInArrow(_first_pass(depth), rows).repartition("key").sortWithinPartitions("key", "tag", "doc")
    settled = stored(spans.mapInArrow(_settle_spans(depth), (
        "doc bigint, row bigint, begin bigint, end bigint, windows bigint, low bigint")), "spans")
    left = settled.where("windows > 0")
    hot = stored(left.groupBy("low").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_SPANS).select("low"), "hot")
    going = left.join(sized(hot.withColumn("hot", F.lit(True))), "low", "left").groupBy("doc", "row").agg(
        F.collect_list(F.struct("begin", "windows", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("spans"))
    windows = texts.join(going, ["doc", "row"]).mapInArrow(_second_pass(depth), _WINDOWS)
    ordered = windows.repartition("key", "tag").sortWithinPartitions("key", "tag", "doc")
    found = stored(ordered.mapInArrow(_settle_windows(depth), "doc bigint, row bigint, begin bigint, end bigint"), "windows")
    return settled.where("windows = 0").select("doc", "row", "begin", "end").union(found)


def _helper(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def _with_stretches(df: DataFrame, key: str, text: str, depth: int) -> tuple[DataFrame, str, str]:
    """``df`` with a list of covered stretches, and a flag for rows whose whole text a smaller id has."""
    ship_package(df.sparkSession)
    whole = F.col(f"`{text}`")
    # Equal texts form a class; two 64-bit hashes and the length name it.
    named = [F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(1), whole).alias("g"), F.octet_length(whole).alias("n")]
    mine = df.select(F.col(f"`{key}`").cast("long").alias("doc"), *named, whole.alias("text")).where(
        (F.col("n") >= depth) & F.col("doc").isNotNull())
    classes = mine.groupBy("h", "g", "n").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    copies = sized(stored(classes.select("h", "g", "n", "first"), "copies"))
    ids = mine.groupBy("doc").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("doc")
    several = sized(stored(ids, "several"))
    # Only ids with several texts need a name for the row.
    firsts = mine.join(copies, ["h", "g", "n"], "left").where("first is null or doc = first").join(
        several.withColumn("many", F.lit(True)), "doc", "left")
    texts = firsts.select("doc", F.when(F.col("many"), F.col("h")).otherwise(F.lit(0)).alias("row"), "text")
    stretches = covered_stretches(texts, depth).groupBy("doc", "row").agg(
        F.collect_list(F.struct("begin", "end")).alias("stretches"))
    at, copy, doc, h, g, n, row = (_helper(df, x) for x in ("__stretches", "__copy", "__doc", "__h", "__g", "__n", "__row"))
    names = [F.col(f"`{c}`") for c in df.columns]
    every = df.select(*names, F.col(f"`{key}`").cast("long").alias(doc), *[c.alias(x) for c, x in zip(
        (F.xxhash64(whole), F.xxhash64(F.lit(1), whole), F.octet_length(whole)), (h, g, n))])
    every = every.join(copies.toDF(h, g, n, copy), [h, g, n], "left").join(
        several.select(F.col("doc").alias(doc), F.lit(True).alias(row)), doc, "left")
    # A shorter text under an id that has a longer one, too, is no part of it.
    every = every.select(*names, F.when(F.col(n) >= depth, F.col(doc)).alias(doc),
                         F.when(F.col(row), F.col(h)).otherwise(F.lit(0)).alias(row),
                         F.coalesce(F.col(copy) < F.col(doc), F.lit(False)).alias(copy))
    every = every.join(stretches.toDF(doc, row, at), [doc, row], "left")
    return every.select(*names, at, copy), at, copy


def kept_pieces(data: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of ``data``, the bytes taken out and the number of stretches they form."""
    if not len(begins):
        return data, 0, 0
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    fresh = np.r_[True, begins[1:] > ends[:-1]]
    heads = np.flatnonzero(fresh)
    begins, ends = begins[heads], ends[np.r_[heads[1:], len(ends)] - 1]
    pieces = [data[i:j] for i, j in zip(np.r_[0, ends].tolist(), np.r_[begins, len(data)].tolist())]
    return b"".join(pieces), int((ends - begins).sum()), len(heads)


def _cut(text: pa.Array, stretches: pa.Array, copy: pa.Array) -> Iterator[tuple]:
    none = np.empty(0, np.int64)
    for value, found, whole in zip(text.cast(pa.large_binary()), stretches, copy):
        data = value.as_py() or b""
        if whole.as_py():
            yield b"", len(data), 1, len(data)
        elif not found.is_valid:
            yield data, 0, 0, len(data)
        else:
            spans = found.values
            yield (*kept_pieces(data, spans.field("begin").to_numpy(), spans.field("end").to_numpy()), len(data))


def dedup_digests(df: DataFrame, key: str, text: str, depth: int = DEPTH) -> DataFrame:
    """(key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``) per row."""
    rows, at, copy = _with_stretches(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text, depth)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, gone, spans, hashlib.sha256(left).hexdigest())
                     for left, gone, spans, n in _cut(batch.column(1), batch.column(2), batch.column(3))]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array([f[3] for f in found], pa.string())],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select(F.col(f"`{key}`"), F.col(f"`{text}`"), at, copy).mapInArrow(
        run, f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(df: DataFrame, key: str, text: str, depth: int = DEPTH, kept: str = "kept") -> DataFrame:
    """``df`` with a column ``kept`` (replaced if there is one): the bytes of ``text`` that stay.

    It is binary, as windows may begin inside a character.
    """
    base = df.drop(kept)
    rows, at, copy = _with_stretches(base, key, text, depth)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    place, names = base.columns.index(text), [*base.columns, kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [f[0] for f in _cut(batch.column(place), *batch.columns[-2:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(left, pa.binary())], names=names)

    return rows.mapInArrow(run, f"{fields}, `{kept}` binary")
