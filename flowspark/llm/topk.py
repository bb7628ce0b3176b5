"""Exact top-k inner-product search: ball trees per shard, branch and bound.

Vectors are quantised to whole numbers and spread over shards by a hash of their row; every shard gets a ball tree. A
task takes a block of queries and lets one shard's tree after the other pass by. In a tree it goes down level by
level, keeps for every query the nodes whose upper bound ``q.center + |q| radius`` reaches its current kth score, and
opens the leaves that are left in the order of their bounds, first one, then two, then four at a time. The kth score
goes along from shard to shard, so later trees are pruned by all that was found before. A block has seen every shard
when it ends, so its rows are final and need no merge.

Blocks and shards are bounded in bytes, and trees go through the tasks one by one. Ties go to the smaller id, also in
the bound: a node as good as the kth score is opened only if it holds a smaller id.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; a
vector shorter than others, or empty, counts zeros for what it lacks; a row is never its own candidate, but other rows
with its id are, and each row that asks gets its own list, also where ids repeat; equal vectors are kept apart, and of
equal ones only the k + 1 smallest ids are looked at; fewer than k candidates give fewer rows; an empty table gives no
rows; other columns are ignored. Components of any size are exact: products that could pass 2^53 are taken in 64-bit or
unbounded whole numbers, and a score beyond 64 bits counts as the nearest 64-bit number, in the ranking too.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.tables import stored
from flowspark.session import ship_package

#: Vectors of a shard and queries of a block take at most so many bytes as doubles.
SHARD_BYTES = BLOCK_BYTES = 32 << 20
LEAST_SHARDS, LEAST_BLOCKS, LEAF_ROWS = 16, 12, 64
#: Queries that go down a tree together, and the most leaves that each of them opens in a round.
TOGETHER, ROUND_LEAVES = 1024, 32
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _peak(a: np.ndarray) -> float:
    return float(max(a.max(initial=0), -float(a.min(initial=0))))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, clipped to 64 bits."""
    most = _peak(a) * _peak(b) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    return np.clip(exact(a) @ exact(b).T, LOWEST, HIGHEST).astype(np.int64)


class BallTree:
    """Leaves of at most ``LEAF_ROWS`` vectors, or of equal ones, halved along the line between two far points.

    Nodes are numbered from the root (0); ``left`` is -1 in leaves. ``rows``, ``ids`` and ``vectors`` go leaf by leaf,
    in the order of ids within a leaf.
    """

    FIELDS = ("left", "right", "begin", "end", "centers", "radii", "least_id", "ids", "rows", "vectors")

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.vectors = ids[order], vectors[order]
        nodes, pieces = [], []
        with np.errstate(all="ignore"):
            self._split(np.arange(len(ids)), 0, nodes, pieces)
        at = np.concatenate(pieces)
        self.left, self.right, self.begin, self.end = (np.array([n[i] for n in nodes], np.int64) for i in range(4))
        self.centers, self.radii = np.array([n[4] for n in nodes]), np.array([n[5] for n in nodes])
        self.least_id = np.array([n[6] for n in nodes], np.int64)
        self.ids, self.rows, self.vectors = self.ids[at], rows[order][at], self.vectors[at]
        kind = next((t for t in (np.int8, np.int16, np.int32) if _peak(self.vectors) <= np.iinfo(t).max), np.float64)
        self.vectors = self.vectors.astype(kind)

    def _split(self, members: np.ndarray, begin: int, nodes: list, pieces: list) -> int:
        points = self.vectors[members]
        center = points.mean(axis=0)
        distance = np.sqrt(((points - center) ** 2).sum(axis=1))
        radius = distance.max()
        at = len(nodes)
        nodes.append(None)
        left = right = -1
        if len(members) <= LEAF_ROWS or (points == points[0]).all():
            pieces.append(members)
        else:
            a = points[distance.argmax()]
            b = points[((points - a) ** 2).sum(axis=1).argmax()]
            side = np.argsort(points @ (b - a), kind="stable")
            half = len(members) // 2
            left = self._split(np.sort(members[side[:half]]), begin, nodes, pieces)
            right = self._split(np.sort(members[side[half:]]), begin + half, nodes, pieces)
        nodes[at] = (left, right, begin, begin + len(members), center, radius, self.ids[members].min())
        return at

    def bounds(self, queries: np.ndarray, norms: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores in nodes; the margin covers the rounding of doubles, overflow gives no bound."""
        centers, radii = self.centers[nodes], self.radii[nodes]
        with np.errstate(all="ignore"):
            reach = queries @ centers.T + norms[:, None] * radii
            margin = 1e-9 * norms[:, None] * (np.sqrt((centers**2).sum(axis=1)) + radii) + 1e-6
            bound = np.floor(reach + margin)
            return np.clip(np.where(np.isfinite(bound), bound, np.inf), LOWEST, HIGHEST)

    def to_bytes(self) -> bytes:
        sink = pa.BufferOutputStream()
        for field in self.FIELDS:
            pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(getattr(self, field))), sink)
        return sink.getvalue().to_pybytes()

    @classmethod
    def from_bytes(cls, data) -> "BallTree":
        tree, source = cls.__new__(cls), pa.BufferReader(data)
        for field in cls.FIELDS:
            setattr(tree, field, pa.ipc.read_tensor(source).to_numpy())
        return tree


class Block:
    """Queries with what was found for them so far; ``visit`` takes one more tree into account."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.rows, self.vectors, self.k = ids, rows, vectors, k
        with np.errstate(all="ignore"):
            self.norms = np.sqrt((vectors**2).sum(axis=1))
        # (query, id, score) of the best so far, by query, score and id; kth score and id, where there are k.
        self.found = [np.empty(0, np.int64)] * 3
        self.kth, self.kth_id = np.full(len(ids), LOWEST), np.full(len(ids), HIGHEST)

    def visit(self, tree: BallTree) -> None:
        for start in range(0, len(self.ids), TOGETHER):
            self._visit(tree, np.arange(start, min(start + TOGETHER, len(self.ids))))

    def _floor(self, query: np.ndarray) -> np.ndarray:
        """Current kth scores as doubles: exact below 2^53, else one step down, as they may have been rounded up."""
        kth = self.kth[query].astype(np.float64)
        return np.where(np.abs(kth) < 2**53, kth, np.nextafter(kth, -np.inf))

    def _open(self, bound: np.ndarray, least_id: np.ndarray, query: np.ndarray) -> np.ndarray:
        floor = self._floor(query)
        tie = (bound == floor) & (np.abs(floor) < 2**53)
        return np.where(tie, least_id < self.kth_id[query], bound >= floor)

    def _visit(self, tree: BallTree, query: np.ndarray) -> None:
        points, norms = self.vectors[query], self.norms[query]
        leaves, bounds = [], []
        nodes, alive = np.zeros(1, np.int64), np.ones((len(query), 1), bool)
        while len(nodes):
            bound = np.where(alive, tree.bounds(points, norms, nodes), -np.inf)
            alive &= self._open(bound, tree.least_id[nodes][None, :], query[:, None])
            bound[~alive] = -np.inf
            wanted, leaf = alive.any(axis=0), tree.left[nodes] < 0
            leaves.append(nodes[wanted & leaf])
            bounds.append(bound[:, wanted & leaf])
            inner, alive = nodes[wanted & ~leaf], alive[:, wanted & ~leaf]
            nodes, alive = np.concatenate([tree.left[inner], tree.right[inner]]), np.concatenate([alive, alive], axis=1)
        leaves, bounds = np.concatenate(leaves), np.concatenate(bounds, axis=1)
        order = np.argsort(-bounds, axis=1, kind="stable")
        bounds = np.take_along_axis(bounds, order, axis=1)
        at, width = 0, 1
        while at < len(leaves):
            bound, node = bounds[:, at:at + width], leaves[order[:, at:at + width]]
            wanted = (bound > -np.inf) & self._open(bound, tree.least_id[node], query[:, None])
            who, slot = np.nonzero(wanted)
            if len(who):
                self._score(tree, query[who], node[who, slot])
            elif not (bounds[:, at] >= self._floor(query)).any():
                break
            at, width = at + width, min(2 * width, ROUND_LEAVES)

    def _score(self, tree: BallTree, query: np.ndarray, node: np.ndarray) -> None:
        """Score the queries against the leaves opened for them and keep the k best."""
        order = np.argsort(node, kind="stable")
        query, node = query[order], node[order]
        cuts = np.flatnonzero(np.diff(node)) + 1
        more = [self.found]
        for who, leaf in zip(np.split(query, cuts), node[np.r_[0, cuts]]):
            # A leaf of more than LEAF_ROWS holds equal vectors: after k + 1 smallest ids none can enter.
            begin = tree.begin[leaf]
            rows = slice(begin, min(tree.end[leaf], begin + max(LEAF_ROWS, self.k + 1)))
            scores = _product(self.vectors[who], tree.vectors[rows])
            q, c = np.nonzero(scores >= self.kth[who][:, None])
            other = tree.rows[rows][c] != self.rows[who[q]]
            q, c = q[other], c[other]
            more.append([who[q], tree.ids[rows][c], scores[q, c]])
        query, ids, scores = (np.concatenate([m[i] for m in more]) for i in range(3))
        order = np.lexsort((ids, ~scores, query))  # ~ turns the order of whole numbers round
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, query, "left")
        place = np.arange(len(query)) - first
        last = place == self.k - 1
        self.kth[query[last]], self.kth_id[query[last]] = scores[last], ids[last]
        self.found = [x[place < self.k] for x in (query, ids, scores)]

    def result(self) -> pa.RecordBatch:
        query, ids, scores = self.found
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left") + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[query]), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(scores)],
            names=["query_id", "rank", "vec_id", "score"])


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    out, lengths = np.zeros((len(lists), width)), np.asarray(lists.value_lengths().fill_null(0))
    inside = np.arange(width)[None, :] < lengths[:, None]
    out[inside] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component x as a double; vectors that take no part are left out.

    A product beyond the largest double counts as that.
    """
    largest = float(np.finfo(np.float64).max)

    def whole(x):
        y = F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(largest)), F.lit(-largest))
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    column = F.col(f"`{vector}`")
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    fine = df.where(F.col(f"`{key}`").isNotNull() & column.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return fine.select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(column, whole).alias("v"))


def top_k(df: DataFrame, key: str, vector: str, queries: str, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``df`` that satisfy the SQL condition ``queries`` on ``id``."""
    ship_package(df.sparkSession)
    rows = stored(quantised(df, key, vector, scale).select(
        F.monotonically_increasing_id().alias("row"), "id", "v",
        F.coalesce(F.expr(queries), F.lit(False)).alias("asks")), "vectors")
    count, asking, width = rows.agg(
        F.count("*"), F.count_if("asks"), F.greatest(F.max(F.size("v")), F.lit(1))).first()
    width = width or 1
    shards = max(LEAST_SHARDS, -(-count * width * 8 // SHARD_BYTES))
    blocks = max(LEAST_BLOCKS, -(-asking * width * 8 // BLOCK_BYTES))

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        tree = BallTree(group["id"].to_numpy(), group["row"].to_numpy(), _matrix(group["v"].combine_chunks(), width))
        return pa.table({"shard": group["shard"][:1], "tree": pa.array([tree.to_bytes()], pa.binary())})

    dealt = rows.select("id", "row", "v", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
    trees = stored(dealt.groupBy("shard").applyInArrow(build, "shard int, tree binary"), "trees")

    # Blocks without a query are dropped before trees are sent to them.
    asked = rows.where("asks").withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
    wanted = asked.groupBy("block").agg(F.lit(True).alias("wanted"))
    sent = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(wanted, "block", "left_semi")
    none = F.lit(None)
    parts = asked.select("block", F.lit(-1).alias("shard"), "id", "row", "v", none.cast("binary").alias("tree")).unionByName(
        sent.select("block", "shard", none.cast("long").alias("id"), none.cast("long").alias("row"),
                    none.cast("array<double>").alias("v"), "tree"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, number = None, [], None

        def ready():
            nonlocal held, waiting
            if waiting:
                held = Block(*(np.concatenate([w[i] for w in waiting]) for i in range(3)), k)
                waiting = []
            return held

        for batch in batches:
            block, shard = batch.column("block").to_numpy(), batch.column("shard").to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(shard) != 0)) + 1
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(block)]):
                if block[start] != number:
                    if number is not None:
                        yield ready().result()
                    held, number = None, block[start]
                if shard[start] < 0:
                    part = batch.slice(start, end - start)
                    waiting.append((part.column("id").to_numpy(), part.column("row").to_numpy(),
                                    _matrix(part.column("v"), width)))
                else:
                    ready().visit(BallTree.from_bytes(batch.column("tree")[int(start)].as_buffer()))
        if number is not None:
            yield ready().result()

    in_order = parts.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "shard")
    return in_order.mapInArrow(run, "query_id bigint, rank int, vec_id bigint, score bigint")
