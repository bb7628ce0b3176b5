"""Spelling variants: words of a vocabulary that differ by one letter, and the form each of them stands for.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code point makes one of the
other. One such change leaves a half of a word as it is, so the search matches either half exactly and extends across
the other, allowing one error. Both directions of a bidirectional FM-index serve this: the index of the words extends
matches to the left, the index of the reversed words to the right. A match is an interval of suffix ranks, a step is
one rank query at each end, and the delimiter at the far end turns an interval into the number of a word.

The vocabulary is dealt over shards by the halves that a match needs, so a query meets only the words that share a half
with it, and an index has a bounded number of words. A half that very many words share is cut into parts, and its
queries visit all of them. Steps run over all queries of a shard at once.

A word's form is its near word of largest count, if that is at least ``ratio`` times its own; roots follow forms to the
last one by pointer jumping. Counts grow along a chain, so there are no circles and chains are short.

Defined cases: a null or empty text has no words; texts of any length are read whole; rows count one by one, also where
ids repeat or are null; equal counts go to the smaller word in code-point order; an empty table, or one without frequent
words, gives no rows; other columns are ignored.
"""

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.tables import sized, stored
from flowspark.session import ship_package

LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
MEMORY_WORDS = 200_000
SHARD_ROWS, HALF_ROWS, LEAST_SHARDS = 32_768, 16_384, 64
BLOCK_CELLS = 60_000
_words = re.compile("[A-Za-zÀ-ÿ]+").findall


def word_counts(df: DataFrame, key: str, text: str,
                change: Callable[[int | None, dict], Iterable[tuple[str, int]]] | None = None) -> DataFrame:
    """(word, n) over all texts, A-Z lower-cased. ``change`` may replace the counts of a document's words."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = Counter(_words((value.as_py() or b"").lower().decode()))  # bytes.lower() changes A-Z only
                if change is None:
                    total.update(found)
                else:
                    for word, n in change(doc, found):
                        total[word] += n
                if len(total) > MEMORY_WORDS:
                    yield listed(total)
                    total.clear()
        if total:
            yield listed(total)

    def listed(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = df.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class SuffixRanks:
    """FM-index of ``$w0$w1...$`` for sorted distinct words, searched backward.

    The delimiters count as different letters, ordered as their words are, so rank i of the text's suffixes begins with
    the delimiter before word i, which a step by a delimiter reaches as i + 1.
    """

    def __init__(self, words: list[np.ndarray], letters: int):
        sizes = np.array([len(w) for w in words])
        n = int(sizes.sum()) + len(words) + 1
        text = np.zeros(n, np.int64)
        ends = np.cumsum(sizes + 1)
        inside = np.ones(n, bool)
        inside[np.r_[0, ends]] = False
        text[inside] = np.concatenate(words)
        rank = text + len(words)
        rank[~inside] = np.arange(len(words) + 1)
        width = 1
        order = np.argsort(rank, kind="stable")
        while True:  # by doubling; no suffix is compared beyond a delimiter
            ahead = np.r_[rank[width:], np.full(min(width, n), -1)][:n] + 1
            pair = rank * (n + letters + len(words) + 2) + ahead
            order = np.argsort(pair, kind="stable")
            fresh = np.r_[False, pair[order][1:] != pair[order][:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            width *= 2
            if rank[order[-1]] == n - 1:
                break
        self.last = text[order - 1]  # the letter before each suffix
        self.n, self.letters = n, letters
        # Nothing stands before the text's first letter; that it sorts first makes up for the last delimiter, which
        # stands before nothing.
        self.places = np.sort(np.where(order == 0, -1, self.last) * (n + 1) + np.arange(n))
        self.words = len(words)

    def step(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first rank of suffixes that begin with ``letter`` and then go on as those from rank ``at`` on."""
        return np.searchsorted(self.places, letter * (self.n + 1) + at)

    def before(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval's number, letter, lo, hi) for every letter before the suffixes of each interval, but delimiters."""
        wide = hi - lo > 2 * self.letters
        many = np.flatnonzero(wide)
        state = np.repeat(many, self.letters)
        letter = np.tile(np.arange(1, self.letters + 1), len(many))
        few = np.flatnonzero(~wide)
        sizes = (hi - lo)[few]
        rows = np.repeat(lo[few] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        pairs = np.unique(np.repeat(few, sizes) * (self.letters + 1) + self.last[rows])
        state = np.r_[state, pairs // (self.letters + 1)]
        letter = np.r_[letter, pairs % (self.letters + 1)]
        real = letter > 0
        state, letter = state[real], letter[real]
        new_lo, new_hi = self.step(letter, lo[state]), self.step(letter, hi[state])
        found = new_lo < new_hi
        return state[found], letter[found], new_lo[found], new_hi[found]

    def near(self, queries: np.ndarray, sizes: np.ndarray, exact: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs: words that end like the query's last ``exact`` letters and have one error before them.

        ``queries`` holds the letters from the last to the first.
        """
        who = np.arange(len(sizes))
        lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.words + 1)
        for i in range(int(exact.max())):
            go = exact[who] > i
            letter = queries[who[go], i]
            lo[go], hi[go] = self.step(letter, lo[go]), self.step(letter, hi[go])
            left = lo < hi
            who, lo, hi = who[left], lo[left], hi[left]
        place = exact[who]
        one = [np.empty(0, np.int64)] * 4  # query, place, interval: with the error behind them
        while len(who) or len(one[0]):
            done = one[1] == sizes[one[0]]
            zero = np.zeros(int(done.sum()), np.int64)
            first, last = self.step(zero, one[2][done]), self.step(zero, one[3][done])
            whole = first < last
            yield one[0][done][whole], first[whole] - 1
            one = self._next(queries, *(x[~done] for x in one))
            open_ = place < sizes[who]
            state, letter, new_lo, new_hi = self.before(lo, hi)
            # A letter more than the query's next one, unless it is that one: then it is more after it.
            wanted = np.where(open_, queries[who, np.minimum(place, queries.shape[1] - 1)], -1)[state]
            other = letter != wanted
            state, new_lo, new_hi = state[other], new_lo[other], new_hi[other]
            inside = open_[state]
            one = [np.concatenate(parts) for parts in zip(
                one, (who[state], place[state], new_lo, new_hi),  # inserted
                (who[state][inside], place[state][inside] + 1, new_lo[inside], new_hi[inside]),  # replaced
                (who[open_], place[open_] + 1, lo[open_], hi[open_]))]  # deleted
            who, place, lo, hi = self._next(queries, who[open_], place[open_], lo[open_], hi[open_])

    def _next(self, queries, who, place, lo, hi) -> list[np.ndarray]:
        letter = queries[who, place] if len(who) else who
        lo, hi = self.step(letter, lo), self.step(letter, hi)
        left = lo < hi
        return [who[left], place[left] + 1, lo[left], hi[left]]


def _coded(words: list[str]) -> tuple[list[np.ndarray], int]:
    """Letters as numbers from 1 on, in code-point order."""
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    every = np.unique(np.concatenate(points))
    return [np.searchsorted(every, p) + 1 for p in points], len(every)


def near_words(words: list[str], asking: list[str], leftward: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of (asking, word) that are near, with the error in the left half, or else in the right half."""
    ordered = np.array(sorted(range(len(words)), key=lambda i: words[i] if leftward else words[i][::-1]))
    coded, letters = _coded(words + asking)
    if not leftward:
        coded = [c[::-1] for c in coded]
    index = SuffixRanks([coded[i] for i in ordered], letters)
    queries = coded[len(words):]
    sizes = np.array([len(q) for q in queries])
    begin, by_size = 0, np.argsort(sizes, kind="stable")
    while begin < len(by_size):
        # Blocks of queries of about one length, with a bounded number of cells.
        end = begin + 1
        while end < len(by_size) and (end - begin + 1) * sizes[by_size[end]] <= BLOCK_CELLS:
            end += 1
        block = by_size[begin:end]
        cells = np.zeros((len(block), int(sizes[block].max())), np.int64)
        for row, query in enumerate(block):
            cells[row, :sizes[query]] = queries[query][::-1]
        half = sizes[block] // 2
        # A pair may be found in more than one way, as by leaving out either of two equal letters.
        found = [who * len(words) + word for who, word in index.near(
            cells, sizes[block], sizes[block] - half if leftward else half)]
        pairs = np.unique(np.concatenate(found))
        yield block[pairs // len(words)], ordered[pairs % len(words)]
        begin = end


def _search(table: pa.Table) -> pa.Table:
    """One shard: the near words of its queries among its words, each pair by one of its halves only."""
    found = []
    for leftward in (False, True):
        rows = table.filter(pc.equal(table["leftward"], leftward))
        held, asks = rows.filter(rows["held"]), rows.filter(rows["asks"])
        names = held["word"].to_pylist()
        count = dict(zip(names, held["n"].to_pylist()))
        # Where a half has parts, a word may also be here for another half; it then counts in its own part only.
        here = set(zip(names, held["half"].to_pylist()))
        words, asking = list(count), list(dict.fromkeys(asks["word"].to_pylist()))
        if not words or not asking:
            continue
        for who, word in near_words(words, asking, leftward):
            for q, w in zip(who.tolist(), word.tolist()):
                a, b = asking[q], words[w]
                first = a[:len(a) // 2]
                # A pair that agrees in the first half is found from there.
                if b.startswith(first) != leftward and (b, a[len(a) // 2:] if leftward else first) in here:
                    found.append((a, b, count[b]))
    a, b, n = zip(*found) if found else ((), (), ())
    return pa.table({"word": pa.array(a, pa.string()), "near": pa.array(b, pa.string()), "near_n": pa.array(n, pa.int64())})


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n) for all near words of a stored table (word, n); every pair both ways."""
    ship_package(vocabulary.sparkSession)
    size = F.length("word")
    # The halves of words one letter shorter or longer, and its own (the first in either list).
    first = F.array_distinct(F.array(F.floor(size / 2), F.floor((size - 1) / 2), F.floor((size + 1) / 2)))
    last = F.array_distinct(F.array(F.ceil(size / 2), F.ceil((size - 1) / 2), F.ceil((size + 1) / 2)))
    halves = F.concat(
        F.transform(first, lambda x, i: F.struct(
            F.lit(False).alias("leftward"), F.left("word", x).alias("half"), (i == 0).alias("asks"))),
        F.transform(last, lambda x, i: F.struct(
            F.lit(True).alias("leftward"), F.right("word", x).alias("half"), (i == 0).alias("asks"))))
    rows = vocabulary.select("word", "n", F.explode(halves).alias("x")).select("word", "n", "x.*")
    many = rows.groupBy("leftward", "half").agg(F.count("*").alias("rows")).where(F.col("rows") > HALF_ROWS)
    parts = stored(many.select("leftward", "half", F.ceil(F.col("rows") / HALF_ROWS).cast("int").alias("parts")), "halves")
    dealt = rows.join(sized(parts), ["leftward", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    visits = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    dealt = dealt.withColumn("own", own).withColumn("part", F.explode(visits))
    shards = max(LEAST_SHARDS, -(-4 * vocabulary.count() // SHARD_ROWS))
    placed = dealt.select(
        F.pmod(F.xxhash64("leftward", "half", "part"), F.lit(shards)).alias("shard"), "leftward", "half", "word", "n", "asks",
        (F.col("part") == F.col("own")).alias("held"))
    return placed.groupBy("shard").applyInArrow(_search, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last one. Each round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = sized(now.select(F.col("word").alias("root"), F.col("root").alias("next")))
        further = stored(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = further.select("word", "root")
        if further.where("moved").isEmpty():
            return now


def spelling_variants(df: DataFrame, key: str, text: str, change=None, least_letters: int = LEAST_LETTERS,
                      least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``) for the words that are long and frequent enough."""
    counts = word_counts(df, key, text, change).where((F.length("word") >= least_letters) & (F.col("n") >= least_count))
    vocabulary = stored(counts, "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best)
    chosen = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    words = stored(vocabulary.join(near, "word", "left").select(
        "word", F.when(chosen, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, -F.col("best.less")).alias("form_n")), "words")
    roots = sized(_roots(words.where("form is not null")))
    return words.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
