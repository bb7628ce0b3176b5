"""Exact Jaccard join on word shingles by a token-group matrix.

1. Texts become sets of shingle hashes (64 bits); documents with equal sets form a class, and only its smallest id
   goes on.
2. Tokens have one global order: by hash, very frequent ones last. Two sets that qualify must share a token among
   the first n - ceil(t n) + 1 of each, and in fact quite a number of them (:func:`least_shared`). Those prefix
   tokens are shuffled once into buckets.
3. Similar documents are put in groups: in every bucket each document is compared with the bucket's lead only. Exact
   checks of those pairs give components; these and the leads, cut by size into groups of a bounded number of rows,
   are the partition.
4. The matrix holds each group's union of prefix tokens. The documents of a group are queried together: the overlap of
   their union with another group's bounds what any of them shares with it. Only groups that could hold a partner
   outside a document's component are opened, and their members checked exactly, many at once. Inside a component
   nothing is left to find, because the result is components.

No link between different sets is lost: a pair is either in one component after step 3 or meets in a bucket in step 4,
where the bound is an upper one. Nothing is capped; the list of frequent tokens only moves work, and is bounded.

Defined cases: a null or empty text has an empty set, links with nothing and is its own component; a text shorter than
a shingle is one shingle; rows that repeat an id are one document, linked by each of their texts; rows without an id take
no part and get no component; an empty table gives an empty result; texts of any length are read whole; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.components import components
from flowspark.llm.memory import alone, remembered
from flowspark.llm.tables import sized, stored
from flowspark.session import ship_package

MEMORY_WORDS = 400_000
#: A token is frequent from this many documents on; at most so many of the most frequent ones are listed.
FREQUENT, MOST_FREQUENT = 64, 100_000
GROUP_ROWS = 128
#: Prefix tokens have small hashes, so only hashes in this lower share of the range are counted.
COUNTED_SHARE = 0.4


class _Words(dict):
    """Hashes of words, filled on demand and emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = remembered(_Words())


def shingles(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; ASCII white space separates, A-Z are lower-cased."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    mixed = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(words) - size + 1 + i]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def prefix_size(n, percent: int):
    """n - ceil(t n) + 1 for whole numbers or arrays."""
    return n - (percent * n + 99) // 100 + 1


def _prefix_size(n: Column, percent: int) -> Column:
    return n - F.floor((F.lit(percent) * n + 99) / 100) + 1


def least_shared(n: Column, m: Column, percent: int) -> Column:
    """Prefix tokens that two sets of n and m tokens share at least if they link.

    Say the last prefix token of the first set comes no later than the other's. Common tokens up to it lie in both
    prefixes, and at most n - prefix follow, so the overlap is at most shared + n - prefix. An overlap of
    t / (1 + t) (n + m) is needed. The larger allowance of the two sets is safe.
    """
    needed = F.ceil(F.lit(percent) * (n + m) / (100 + percent) - 1e-9)
    allowance = F.greatest(n - _prefix_size(n, percent), m - _prefix_size(m, percent))
    return F.greatest(F.lit(1), needed - allowance)


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def frequent_tokens(texts: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the most frequent shingles, counted over all texts. Bounded, whatever the input.

    Tasks leave out what they saw once only; the list steers work and never decides about a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(_words)
        limit = np.uint64(int(COUNTED_SHARE * 2**64))
        waiting, held = [], 0

        def counted():
            values, counts = np.unique(np.concatenate(waiting), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["token", "n"])

        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                found = shingles(text.as_py() or b"", size)
                waiting.append(found[:np.searchsorted(found, limit)])
                held += len(waiting[-1])
            if held > 2_000_000:
                yield counted()
                waiting, held = [], 0
        if waiting:
            yield counted()

    counts = texts.select("text").mapInArrow(run, "token bigint, n bigint")
    top = counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = top.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def signatures(texts: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Per row of (doc, text): set size, 128-bit set key, number of tokens that are not frequent, and the prefix."""
    listed = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(_words)
        heavy = listed.value
        for batch in batches:
            counts, keys, rests, prefixes = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                found = shingles(text.as_py() or b"", size)
                key = xxhash.xxh3_128_intdigest(found.tobytes())
                if len(heavy) and len(found):
                    at = np.minimum(np.searchsorted(heavy, found), len(heavy) - 1)
                    often = heavy[at] == found
                    ordered = np.concatenate([found[~often], found[often]])
                    rest = int((~often).sum())
                else:
                    ordered, rest = found, len(found)
                counts.append(len(found))
                keys.append((key >> 64, key & (2**64 - 1)))
                rests.append(rest)
                prefixes.append(ordered[:prefix_size(len(found), percent) if len(found) else 0].view(np.int64))
            halves = np.array(keys, np.uint64).view(np.int64)
            offsets = np.cumsum([0] + [len(p) for p in prefixes]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), pa.array(counts, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                pa.array(rests, pa.int32()), pa.ListArray.from_arrays(offsets, np.concatenate(prefixes)),
            ], names=["doc", "n", "k1", "k2", "rest", "prefix"])

    return texts.mapInArrow(run, "doc bigint, n int, k1 bigint, k2 bigint, rest int, prefix array<bigint>")


def _shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token: those whose token another row has too, with the bucket's first document and its size."""
    held, first = None, None  # the last row so far (not sent yet) and the first of its bucket
    for batch in batches:
        if not batch.num_rows:
            continue
        token, doc, n = (batch.column(c).to_numpy() for c in ("token", "doc", "n"))
        if held is not None:
            token, doc, n = (np.concatenate([[h], a]) for h, a in zip(held, (token, doc, n)))
        starts = np.empty(len(token), bool)
        starts[0] = held is None or first is None
        starts[1:] = token[1:] != token[:-1]
        heads = np.flatnonzero(starts)
        run = np.cumsum(starts) - 1
        lead_doc = np.where(run >= 0, doc[heads[run]], first[0] if first else 0) if len(heads) else np.full(len(token), first[0])
        lead_n = np.where(run >= 0, n[heads[run]], first[1] if first else 0) if len(heads) else np.full(len(token), first[1])
        pair = np.zeros(len(token), bool)
        same = token[1:] == token[:-1]
        pair[1:] |= same
        pair[:-1] |= same
        pair[0] |= first is not None and not starts[0]
        last_pair = pair[-1]
        send = pair.copy()
        send[-1] = False
        yield _bucket_batch(token[send], doc[send], n[send], lead_doc[send], lead_n[send])
        held = (token[-1], doc[-1], n[-1])
        first = (lead_doc[-1], lead_n[-1]) if last_pair else None
    if held is not None and first is not None:
        yield _bucket_batch(*(np.array([v]) for v in (*held, *first)))


def _bucket_batch(token, doc, n, lead_doc, lead_n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(token.astype(np.int64)), pa.array(doc.astype(np.int64)), pa.array(n.astype(np.int32)),
         pa.array(lead_doc.astype(np.int64)), pa.array(lead_n.astype(np.int32))],
        names=["token", "doc", "n", "lead", "lead_n"])


def prefix_buckets(signed: DataFrame) -> DataFrame:
    """(token, doc, n, lead, lead_n) for class representatives and prefix tokens that two or more of them have.

    A bucket's lead is the document with the fewest tokens that are not frequent: in a large family of near copies,
    the one with the fewest edits of its own.
    """
    first = signed.where("n > 0").groupBy("n", "k1", "k2").agg(F.min(F.struct("doc", "rest", "prefix")).alias("r"))
    tokens = first.select(F.explode("r.prefix").alias("token"), F.col("r.doc").alias("doc"), "n", F.col("r.rest").alias("rest"))
    ordered = tokens.repartition("token").sortWithinPartitions("token", "rest", "doc")
    return ordered.mapInArrow(_shared_buckets, "token bigint, doc bigint, n int, lead bigint, lead_n int")


def _sets(batches_column: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(_words)
        for batch in batches:
            sets = [shingles(t.as_py() or b"", size).view(np.int64).tobytes()
                    for t in batch.column("text").cast(pa.binary())]
            at = batch.schema.get_field_index("text")
            columns, names = list(batch.columns), list(batch.schema.names)
            columns[at], names[at] = pa.array(sets, pa.binary()), batches_column
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def linked(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of a stored table whose sets link. ``a`` may be in very many pairs.

    The sets of ``b`` are made where the texts are read; those of ``a``, once each, meet them in a join that Spark can
    split where one ``a`` has many rows.
    """
    right = texts.join(sized(pairs), F.col("doc") == F.col("b")).select("a", "b", "text").mapInArrow(
        _sets("set_b", size), "a bigint, b bigint, set_b binary")
    hubs = sized(stored(pairs.select("a").distinct(), "hubs"))
    left = texts.join(hubs, F.col("doc") == F.col("a")).select("a", "text").mapInArrow(
        _sets("set_a", size), "a bigint, set_a binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    met = right.join(left.hint("merge"), "a").select("a", "b", "set_a", "set_b")
    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def _groups(met: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, component, grp) for documents that met a lead or have a link.

    A large component is cut into groups of its own; other documents go by their closest lead, apart from one another
    where one is close and one is not. Groups hold documents of about the same size, ``GROUP_ROWS`` or so.
    """
    led = met.groupBy(F.col("b").alias("doc")).agg(
        F.max_by(F.struct("a", "close"), F.struct("close", "shared", -F.col("a"))).alias("by"), F.first("m").alias("n"))
    leads = met.groupBy(F.col("a").alias("doc")).agg(F.first("n").alias("n")).join(
        led.select("doc"), "doc", "left_anti").select("doc", F.col("doc").alias("lead"), "n", F.lit(True).alias("close"))
    led = led.select("doc", F.col("by.a").alias("lead"), "n", F.col("by.close").alias("close"))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    tied = found.join(sizes, "component").select(F.col("node").alias("doc"), "component", "size")
    joined = led.union(leads).join(tied, "doc", "left").select(
        "doc", F.coalesce("component", "doc").alias("component"),
        F.when(F.col("size") > GROUP_ROWS, F.xxhash64("component", F.lit("own"))).otherwise(
            F.xxhash64("lead", "close", F.lit("lead"))).alias("base"),
        F.floor(F.log(F.col("n").cast("double")) / 0.05).alias("band"))
    joined = stored(joined, "bases")
    parts = joined.groupBy("base", "band").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("parts"))
    return joined.join(sized(stored(parts, "parts")), ["base", "band"]).select(
        "doc", "component", F.xxhash64("base", "band", F.pmod(F.xxhash64("doc"), F.col("parts"))).alias("grp"))


def opened_groups(buckets: DataFrame, groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(g, h) pairs of groups that the matrix cannot rule out, and (g, doc, component) of all groups.

    The documents of g are the queries, all with one look at the matrix: what any of them shares with the union of h
    lies in both unions. Pairs are looked at from one side; those inside a single component are left out.
    """
    entries = stored(buckets.join(sized(groups), "doc", "left").select(
        "token", "doc", "n", F.coalesce("component", "doc").alias("component"),
        F.coalesce("grp", F.xxhash64("doc", F.lit("alone"))).alias("g")), "entries")
    mixed = entries.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    entries = stored(entries.join(mixed.select("token"), "token"), "mixed")
    members = stored(entries.select("g", "doc", "n", "component").distinct(), "members")
    extent = members.groupBy("g").agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"),
                                      F.min("component").alias("lo"), F.max("component").alias("hi"))
    matrix = stored(entries.select("token", "g").distinct().join(extent, "g"), "matrix")
    names = ("g", "rows", "least", "most", "lo", "hi")
    other = matrix.select("token", *[F.col(c).alias(f"{c}_") for c in names])
    one = (F.col("lo") == F.col("hi")) & (F.col("lo_") == F.col("hi_")) & (F.col("lo") == F.col("lo_"))
    near = ~one & (100 * F.col("most") >= percent * F.col("least_")) & (100 * F.col("most_") >= percent * F.col("least"))
    met = matrix.join(other, "token").where(((F.col("g") < F.col("g_")) | ((F.col("g") == F.col("g_")) & (F.col("rows") > 1))) & near)
    shared = met.groupBy("g", "g_", "least", "most", "least_", "most_").agg(F.count("*").alias("shared"))
    # The least any two members may need, from the smallest and largest sizes that fit together.
    smallest = [F.greatest(F.col(x), F.ceil(F.lit(percent) * F.col(y) / 100)) for x, y in (("least", "least_"), ("least_", "least"))]
    largest = [F.least(F.col(x), F.floor(100 * F.col(y) / percent)) for x, y in (("most", "most_"), ("most_", "most"))]
    needed = F.ceil(F.lit(percent) * (smallest[0] + smallest[1]) / (100 + percent) - 1e-9)
    allowance = F.greatest(*[n - _prefix_size(n, percent) for n in largest])
    opened = shared.where(F.col("shared") >= F.greatest(F.lit(1), needed - allowance)).select("g", F.col("g_").alias("h"))
    return stored(opened, "opened"), members.select("g", "doc", "component")


def links_in_groups(texts: DataFrame, opened: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): for every document of an opened pair of groups, a link to each other component that it has there.

    Sets are large, so they are dealt out once to their group, and then once more to each group that is to be asked.
    """
    wanted = opened.select("g").union(opened.select("h")).distinct()
    inside = sized(stored(members.join(wanted, "g", "left_semi").distinct(), "inside"))
    sets = texts.join(inside, "doc").select("g", "doc", "component", "text").mapInArrow(
        _sets("set", size), "g bigint, doc bigint, component bigint, set binary")
    # Rows that repeat an id and a text are one member; tasks leave them out before they send.
    whole = stored(sets.groupBy("g").agg(F.collect_set(F.struct("doc", "component", "set")).alias("held")), "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_links_between(_unpacked(x.values), _unpacked(y.values), percent)
                     for x, y in zip(batch.column("asking"), batch.column("asked"))]
            a, b = (np.concatenate([np.empty(0, np.int64), *side]) for side in ([f[0] for f in found], [f[1] for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # Both sides read the same columns by g, so that where the pairs are too many to broadcast one exchange serves both.
    asking = whole.join(sized(opened), "g").select("h", F.col("held").alias("asking"))
    met = asking.join(whole, F.col("h") == F.col("g")).select("asking", F.col("held").alias("asked"))
    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def _unpacked(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    sets = [np.frombuffer(v.as_buffer(), np.int64) for v in rows.field("set")]
    return rows.field("doc").to_numpy(), rows.field("component").to_numpy(), sets


def _links_between(asking: tuple, asked: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two lists of sets, one for each query and component of the other side."""
    docs, own, sets = asking
    others, components_, held = asked
    tokens = np.concatenate(held)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(held)), [len(h) for h in held])[order]
    sizes = np.array([len(h) for h in held])
    a, b = [], []
    for doc, component, mine in zip(docs, own, sets):
        begin, end = np.searchsorted(tokens, mine), np.searchsorted(tokens, mine, "right")
        lengths = end - begin
        at = np.repeat(begin - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.bincount(owner[at], minlength=len(held))
        good = (100 * both >= percent * (len(mine) + sizes - both)) & (components_ != component)
        for other in np.unique(components_[good], return_index=True)[1]:
            a.append(doc)
            b.append(others[good][other])
    return np.array(a, np.int64), np.array(b, np.int64)


def _several_texts(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): an id with different texts is one document, so it links the classes of all its texts."""
    key = F.struct("n", "k1", "k2")
    ids = signed.where("n > 0 and doc is not null").groupBy("doc").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    several = sized(stored(ids.where("lo <> hi").select("doc"), "several"))
    rows = signed.where("n > 0").join(several, "doc").select("doc", "n", "k1", "k2").distinct()
    return rows.join(classes, ["n", "k1", "k2"]).select(F.col("first").alias("a"), F.col("doc").alias("b"))


def jaccard_components(df: DataFrame, key: str, text: str, size: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) per row; two rows link from a Jaccard similarity of ``percent`` / 100 on.

    ``key`` must be a whole number; the component's id is the smallest key in it.
    """
    ship_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    known = texts.where("doc is not null")
    signed = stored(signatures(texts, size, percent, frequent_tokens(known, size)), "signatures")
    buckets = stored(prefix_buckets(signed.where("doc is not null")), "buckets")
    counted = buckets.where("lead <> doc").groupBy(F.col("lead").alias("a"), F.col("doc").alias("b")).agg(
        F.first("lead_n").alias("n"), F.first("n").alias("m"), F.count("*").alias("shared"))
    # Only grouping depends on these pairs, so half of the shared tokens is asked for: a bucket may have another lead.
    close = _sizes_fit(F.col("n"), F.col("m"), percent) & (
        2 * F.col("shared") >= least_shared(F.col("n"), F.col("m"), percent))
    met = stored(counted.withColumn("close", close), "met")
    star = stored(met.where("close").select("a", "b"), "star")
    classes = signed.where("n > 0 and doc is not null").groupBy("n", "k1", "k2").agg(F.min("doc").alias("first"))
    found = stored(components(linked(known, star, size, percent).union(_several_texts(signed, classes))), "found")
    opened, members = opened_groups(buckets, stored(_groups(met, found), "groups"), percent)
    more = links_in_groups(known, opened, members, size, percent)
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    parts = classes.join(sized(stored(found, "components")), F.col("first") == F.col("node"), "left").select(
        "n", "k1", "k2", F.coalesce("component", "first").alias("component"))
    # Stored, so that the join of plain tables can be split where one class holds very many rows.
    named = signed.select("doc", "n", "k1", "k2").join(stored(parts, "classes"), ["n", "k1", "k2"], "left")
    return named.select(
        F.col("doc").cast(kind).alias(key), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))
