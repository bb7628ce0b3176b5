"""Byte-level BPE by a dynamic program over prefixes.

For every prefix of a byte string there is exactly one token that can end its encoding: a token ``t`` that is a
suffix of the prefix and whose predecessor, the last token of the prefix before it, forms a pair with ``t`` that
merging would leave as it is. :class:`Prefixes` stores that last token for each position. Encoding walks back from
the end, appending continues the table, and after an edit the table is refilled only until it agrees with the old
one over as many positions as the longest token has bytes.

A text is first cut by a pattern into pieces that are encoded on their own; pieces that were seen before come from
a bounded memory. Nothing is shuffled.

Defined cases: a null text counts as empty and has no ids; texts of any length are encoded whole, in time linear in
their length; repeated rows are encoded one by one; an empty table gives an empty result; other columns pass through
only where ``keep`` names them.
"""

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from flowspark.llm.memory import alone, remembered
from flowspark.session import ship_package

#: Bounds of what a task remembers: pieces and prefixes (two generations of each), pairs of tokens, bytes of a piece.
MEMORY_PIECES, MEMORY_PREFIXES, MEMORY_PAIRS, MEMORY_BYTES = 250_000, 400_000, 600_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64, space, number)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks, token bytes and the answers already found about pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Encoding of a short byte string by merging its pairs in rank order; used to judge tokens and pairs."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while True:
            at, best = -1, None
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    at, best = i, rank
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def reachable(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(self.bytes[token]) == [token]
        return known

    def stays(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are left unmerged and uncut."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMORY_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.bytes[left] + self.bytes[right]) == [left, right]
        return known


class Prefixes:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _last_of(self, end: int, data: bytes) -> int:
        """The unique token that ends the encoding of ``data[:end]``; longest suffix first."""
        v, ranks = self.vocabulary, self.vocabulary.ranks
        for start in range(max(0, end - v.longest), end):
            token = ranks.get(data[start:end])
            if token is not None and v.reachable(token) and (start == 0 or v.stays(self.last[start - 1], token)):
                return token
        raise ValueError(f"bytes {data[max(0, end - 8):end]!r} cannot be encoded")

    def append(self, more: bytes) -> None:
        """Continue the table; what stood before keeps its entries."""
        begin = len(self.data)
        self.data += more
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._last_of(end, self.data))

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of ``data[begin:end]``; returns how many entries had to be found anew."""
        old, tail = self.last, end
        data = self.data[:begin] + new + self.data[end:]
        shift = len(new) - (end - begin)
        self.last, same, done = old[:begin], 0, 0
        for stop in range(begin + 1, len(data) + 1):
            token = self._last_of(stop, data)
            self.last.append(token)
            done += 1
            at = stop - 1 - shift
            same = same + 1 if at >= tail and old[at] == token else 0
            if same >= self.vocabulary.longest:  # later entries look back no further than this
                self.last += old[at + 1:]
                break
        self.data = data
        return done

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes[found[-1]])
        return found[::-1]


class Memory(dict):
    """A bounded memory: when it is full, what was not asked for since it last was is forgotten."""

    def __init__(self, size: int, make: Callable):
        super().__init__()
        self.size, self.make, self.older = size, make, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class _Pieces(Memory):
    """Ids of pieces. Words share beginnings, so the last tokens of prefixes are remembered across pieces."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(MEMORY_PIECES, self.encode)
        self.vocabulary, self.prefixes, self.older_prefixes = vocabulary, {}, {}

    def __missing__(self, piece: str) -> list[int]:
        return super().__missing__(piece) if len(piece) <= MEMORY_BYTES else self.encode(piece)

    def encode(self, piece: str) -> list[int]:
        data = piece.encode()
        token = self.vocabulary.ranks.get(data)
        # A token that merging reaches is its own encoding.
        if token is not None and self.vocabulary.reachable(token):
            return [token]
        if len(data) > MEMORY_BYTES:
            return Prefixes(self.vocabulary, data).ids()
        if len(self.prefixes) >= MEMORY_PREFIXES:
            self.older_prefixes, self.prefixes = self.prefixes, {}
        found, size = [], self.vocabulary.bytes
        while data:
            found.append(self.last_token(data))
            data = data[:-len(size[found[-1]])]
        return found[::-1]

    def last_token(self, prefix: bytes) -> int:
        """The token that ends the encoding of a prefix, from memory or from the shorter prefixes it depends on."""
        token = self.prefixes.get(prefix)
        if token is None:
            token = self.older_prefixes.get(prefix)
            if token is None:
                token = self._find_last(prefix)
            self.prefixes[prefix] = token
        return token

    def _find_last(self, prefix: bytes) -> int:
        v, rank = self.vocabulary, self.vocabulary.ranks.get
        for start in range(len(prefix)):
            token = rank(prefix[start:])
            if token is not None and v.reachable(token) and (
                    start == 0 or v.stays(self.last_token(prefix[:start]), token)):
                return token
        raise ValueError(f"bytes {prefix[-8:]!r} cannot be encoded")


class Encoder:
    """Text to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.find = Vocabulary(ranks), regex.compile(pattern).findall
        self.pieces = _Pieces(self.vocabulary)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


class Draft:
    """A text that grows: an append re-encodes its last few pieces only.

    The pattern looks one character past a piece, and a contraction is two pieces until it is complete; cutting the
    last three pieces again is therefore enough.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.parts = encoder, encoder.find(text)

    def append(self, more: str) -> None:
        kept, tail = self.parts[:-3], "".join(self.parts[-3:])
        self.parts = kept + self.encoder.find(tail + more)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(map(self.encoder.pieces.__getitem__, self.parts)))


_encoders: dict[str, Encoder] = remembered({})


def encode_rows(df: DataFrame, text: str, keep: list[str], ranks_path: str, pattern: str, ids: bool = True) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, unless ``ids`` is false, ``ids``.

    The rank file is read once, by the driver, and sent to the tasks: its size does not depend on the data.
    """
    spark = df.sparkSession
    ship_package(spark)
    table = spark.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [(f.name, f.dataType.simpleString()) for f in df.select(*[f"`{c}`" for c in keep]).schema]
    schema = ", ".join([f"`{n}` {t}" for n, t in fields] + ["n_tokens bigint, ids_sha256 string, decoded_sha256 string"]
                       + ["ids array<int>"] * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{ranks_path}\n{pattern}"
        alone(_encoders)
        if key not in _encoders:
            _encoders[key] = Encoder(table.value, pattern)
        encoder = _encoders[key]
        names = {i: str(i) for i in encoder.vocabulary.bytes}
        for batch in batches:
            rows = []
            for value in batch.column(0):
                found = encoder.encode(value.as_py() or "")
                said = " ".join(map(names.__getitem__, found))
                rows.append((len(found), hashlib.sha256(said.encode()).hexdigest(),
                             hashlib.sha256(encoder.decode(found)).hexdigest(), found if ids else None))
            columns = list(batch.columns[1:]) + [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.string()),
            ] + ([pa.array([r[3] for r in rows], pa.list_(pa.int32()))] if ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields]
                                             + ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    return df.selectExpr(f"`{text}`", *[f"`{c}` as __keep_{i}" for i, c in enumerate(keep)]).mapInArrow(run, schema)
