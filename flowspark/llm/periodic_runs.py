"""Periodic runs of words, by Lyndon arrays under both orders.

A run is a longest stretch of words in which words ``q`` apart are identical, for its smallest such ``q``, the period.
Every run holds Lyndon words of length ``q`` under one of the two orders of words (an order and its reverse), each the
longest Lyndon word that begins at its place. Phase one of Baier's suffix sorter yields exactly those lengths: it
groups suffixes by their longest Lyndon prefix, from the highest group down, and each group lengthens the prefixes of
the lower suffixes right before its members. Each such root is then extended by the longest common extensions of its
two ends, to the left and to the right.

Only stretches in which every word recurs often enough go that way: in a run of ``least_exponent`` periods each word
occurs that often within the run, so words rarer than that in their stretch cut it, until nothing is cut any more. No
run is lost by this.

A document is one unit of work; documents are independent, so there is no shuffle. Work is linear in the words.

Defined cases: a null or empty text has no words, no run and an empty collapsed text; rows are judged one by one, also
where ids repeat; a null id is kept; equal exponents go to the smaller start, then the smaller period; texts of any
length are read whole (a task holds the words of one document at a time beyond ``BATCH_BYTES``); an empty table gives
no rows; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.session import ship_package

LEAST_WORDS, LEAST_EXPONENT = 6, 4
BATCH_BYTES = 2_000_000


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place.

    ``order`` lists the places group by group; a group is named by where it begins there. Groups are taken from the
    highest down, so that a place's group is final once it is taken.
    """
    n = len(ranks)
    order = sorted(range(n), key=ranks.__getitem__)
    at, group, size, length = [0] * n, [0] * n, [0] * n, [1] * n
    begin = 0
    for i, place in enumerate(order):
        at[place] = i
        if i and ranks[place] != ranks[order[i - 1]]:
            begin = i
        group[place] = begin
        size[begin] += 1
    before = [-1] * n  # the nearest earlier place of a lower group
    end = n
    while end:
        top = group[order[end - 1]]
        long = length[top]
        followed: dict[int, int] = {}
        for place in sorted(order[top:end]):
            j = place - 1
            while j >= 0 and group[j] >= top:
                j = before[j]
            before[place] = j
            if j >= 0:
                followed[j] = followed.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, count in followed.items():
            moves.setdefault((count, group[j]), []).append(j)
        for count, old in sorted(moves, reverse=True):  # those followed most often go highest
            moved = moves[count, old]
            slot = old + size[old]
            for j in moved:
                slot -= 1
                other, hole = order[slot], at[j]
                order[slot], order[hole] = j, other
                at[j], at[other] = slot, hole
            longer = length[old] + count * long
            size[old] -= len(moved)
            size[slot], length[slot] = len(moved), longer
            for j in moved:
                group[j] = slot
        end = top
    return [length[g] for g in group]


def _agree(a: np.ndarray, i: int, j: int) -> int:
    """How many values from ``i`` on equal those from ``j`` on, for i < j."""
    found, step = 0, 16
    while j + found < len(a):
        m = min(step, len(a) - j - found)
        differ = a[i + found:i + found + m] != a[j + found:j + found + m]
        first = int(differ.argmax())
        if differ[first]:
            return found + first
        found, step = found + m, min(4 * step, 1 << 16)
    return found


def runs_in(ranks: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> set[tuple]:
    """(start, length, period) of the runs of ``ranks`` with enough words and periods."""
    found = set()
    n, backward = len(ranks), ranks[::-1]
    for values in (ranks, -ranks):
        roots = np.array(lyndon_lengths(values.tolist()), np.int64)
        places = np.arange(n)
        # A run's first root is followed by at least least_exponent - 2 whole periods more.
        ahead = places + roots
        fits = places + (least_exponent - 1) * roots <= n
        places = places[fits][ranks[places[fits]] == ranks[np.minimum(ahead[fits], n - 1)]]
        known: dict[int, int] = {}  # by period, the end of the last region looked at
        for i, q in zip(places.tolist(), roots[places].tolist()):
            if i + q <= known.get(q, 0):
                continue
            right, left = _agree(ranks, i, i + q), _agree(backward, n - i - q, n - i)
            known[q] = i + q + right
            words = left + q + right
            if words >= max(least_words, least_exponent * q):
                found.add((i - left, words, q))
    return found


def _stretches(codes: np.ndarray, document: np.ndarray, least_words: int, least_exponent: int) -> Iterator[tuple]:
    """(begin, end) of the stretches that can hold a run: each word occurs ``least_exponent`` times in its stretch."""
    at, part = np.arange(len(codes)), document.astype(np.int64)
    while len(at):
        _, where, counts = np.unique(part << 32 | codes[at], return_inverse=True, return_counts=True)
        stays = counts[where] >= least_exponent
        kept, part_ = at[stays], part[stays]
        fresh = np.r_[True, (np.diff(kept) != 1) | (np.diff(part_) != 0)] if len(kept) else np.empty(0, bool)
        number = np.cumsum(fresh) - 1
        long = (np.bincount(number) >= least_words)[number] if len(kept) else fresh
        if stays.all() and long.all() and len(np.unique(part)) == (number[-1] + 1):
            heads = np.flatnonzero(fresh)
            yield from zip(kept[heads], kept[np.r_[heads[1:], len(kept)] - 1] + 1)
            return
        at, part = kept[long], number[long]


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def runs_of_documents(documents: list[list[bytes]], least_words: int = LEAST_WORDS,
                      least_exponent: int = LEAST_EXPONENT) -> list[list[tuple]]:
    """Every document's runs (start, length, period), by start and period."""
    codes, sizes = _Codes(), np.array([len(d) for d in documents], np.int64)
    every = np.fromiter((codes[w] for d in documents for w in d), np.int64, int(sizes.sum()))
    found = [[] for _ in documents]
    owner, begins = np.repeat(np.arange(len(documents)), sizes), np.cumsum(sizes) - sizes
    for begin, end in _stretches(every, owner, least_words, least_exponent):
        shift = int(begin - begins[owner[begin]])
        runs = runs_in(every[begin:end], least_words, least_exponent)
        found[owner[begin]] += [(start + shift, length, period) for start, length, period in runs]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def strongest(runs: list[tuple]) -> tuple | None:
    """The run of the greatest exponent."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def without_repeats(words: list[bytes], runs: list[tuple]) -> list[bytes]:
    """``words`` with one period left of every run."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [word for word, covers in zip(words, np.cumsum(edges).tolist()) if not covers]


def _described(words: list[bytes], runs: list[tuple]) -> tuple:
    best = strongest(runs)
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), b" ".join(without_repeats(words, runs)))


def periodic_runs(df: DataFrame, key: str, text: str, least_words: int = LEAST_WORDS,
                  least_exponent: int = LEAST_EXPONENT, with_runs: bool = False) -> DataFrame:
    """Per row: key, ``n_runs``, the strongest run, and digests; with ``with_runs`` also the runs and the collapsed text.

    ``start``, ``length``, ``period`` and ``exponent_milli`` are those of the run with the greatest length / period.
    """
    ship_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    names = [key, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    schema = (f"`{key}` {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
              "runs_sha256 string, collapsed_sha256 string")
    if with_runs:
        names += ["runs", "collapsed"]
        schema += ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

    def answer(keys: pa.Array, documents: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of_documents(documents, least_words, least_exponent)
        rows = [_described(words, found) for words, found in zip(documents, runs)]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        columns += [pa.array([r[5] for r in rows]), pa.array([hashlib.sha256(r[6]).hexdigest() for r in rows])]
        if with_runs:
            fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
            columns.append(pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs],
                                    pa.list_(pa.struct(fields))))
            columns.append(pa.array([r[6] for r in rows], pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays([keys, *columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin, held, documents = batch.column(1).cast(pa.binary()), 0, 0, []
            for row, value in enumerate(texts):
                data = value.as_py() or b""
                documents.append(data.split())  # white space of bytes is space and 9 to 13
                held += len(data)
                if held >= BATCH_BYTES:
                    yield answer(batch.column(0).slice(begin, row + 1 - begin), documents)
                    begin, held, documents = row + 1, 0, []
            if documents:
                yield answer(batch.column(0).slice(begin), documents)

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)
