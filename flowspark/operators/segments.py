"""Packets to flow segments: duplicate copies, closes, reopens, idle splits and retransmissions.

Every packet depends on the state its predecessors left in the 5-tuple's slot. Spark groups and sorts the
packets by 5-tuple; whole 5-tuples of a batch are labelled as columns (:mod:`flowspark.operators.runs`), and
only those with odd cases are walked row by row, which keeps a few scalars. A 5-tuple with more than ``hot_rows`` packets is cut into
several tasks (see :mod:`flowspark.operators.hot_segments`), so no task holds a whole hot key.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.contracts import (
    ACK, DUPLICATE_WINDOW_US, FIN, IDLE_TIMEOUT_US, KEY_COLUMNS, RST, SWEEP_EVERY_PACKETS, SYN, TCP,
)
from flowspark.functions.net import canonical_key
from flowspark.operators.cooldown import run_starts
from flowspark.operators.ordinal import with_ordinal
from flowspark.operators.runs import Labels, label_runs
from flowspark.session import ship_package, stored

ACCEPTED, DUPLICATE, STRAGGLER = 0, 1, 2
FRESH, OPEN, CLOSED = 0, 1, 2
DEFAULT_HOT_ROWS = 4_000_000

# A packet crosses to Python as a few integers, because every column costs a conversion per row. Field
# widths are those of the IPv4 and TCP headers.
TASK_KEYS = ["capture_id", "end_a", "end_b"]
SORT_KEYS = ["key_hash", *TASK_KEYS, "ts_us", "pkt_no"]
HEAD_FIELDS = {"from_a": (0, 1), "tcp_flags": (8, 8), "ttl": (16, 8), "tcp_window": (24, 16)}
BODY_FIELDS = {"payload_len": (0, 16), "ip_total_len": (16, 16), "tcp_seq": (32, 32)}
WALK_COLUMNS = ["ts_us", "now_us", "from_a", "tcp_flags", "tcp_seq", "ip_total_len", "payload_len", "proto"]
CARRIED_COLUMNS = [*KEY_COLUMNS, "ts_us", "pkt_no", "from_a", "tcp_flags", "ip_total_len", "ttl", "tcp_window"]
LABEL_TYPES = {
    "flow_seq": pa.int64(), "verdict": pa.int8(), "from_src": pa.bool_(), "lost": pa.int8(),
    "gap_us": pa.int64(), "jitter_us": pa.int64(), "after_synack": pa.bool_(), "closes": pa.bool_(),
}
_LABEL_FIELDS = [
    T.StructField("flow_seq", T.LongType()), T.StructField("verdict", T.ByteType()),
    T.StructField("from_src", T.BooleanType()), T.StructField("lost", T.ByteType()),
    T.StructField("gap_us", T.LongType()), T.StructField("jitter_us", T.LongType()),
    T.StructField("after_synack", T.BooleanType()), T.StructField("closes", T.BooleanType()),
]


# How rows of one flow are merged, by measure.
SUMS = [f"{p}{m}" for p in "sd" for m in ("pkts", "bytes", "loss", "_gap_sum", "_gaps", "_jit_sum", "_jits")]
UNIONS = ["s_flags", "d_flags"]
LARGEST = ["sttl", "swin", "dttl", "dwin", "src_is_a", "ltime_us", "close_us"]
SMALLEST = ["stime_us", "syn_us", "synack_us", "ack_us"]
PARTIAL_MEASURES = [*SUMS, *UNIONS, *LARGEST, *SMALLEST]


class Slot:
    """What one 5-tuple remembers between packets. Sides are endpoint a (True) and endpoint b (False)."""

    __slots__ = ("phase", "flow", "fins", "synacks", "init", "accepted_ts", "sig", "sig_ts", "last", "before",
                 "top")

    def __init__(self):
        self.phase, self.flow, self.accepted_ts, self.sig, self.sig_ts = FRESH, -1, 0, None, 0
        self.open_flow(None)
        self.phase = FRESH

    def open_flow(self, side):
        self.phase, self.fins, self.synacks, self.init = OPEN, 0, 0, side
        self.last, self.before, self.top = [None, None], [None, None], [None, None]


def walk(slot: Slot, rows, idle_us: int) -> Iterator[tuple]:
    """Label the packets of one 5-tuple in order, advancing ``slot``; one tuple of labels per packet."""
    for ts, now, side, flags, seq, length, payload, proto in rows:
        if slot.phase and now is not None and now > slot.accepted_ts + idle_us:
            slot.phase = FRESH
        sig = (side, seq, length, flags)
        if slot.phase and sig == slot.sig and ts - slot.sig_ts < DUPLICATE_WINDOW_US:
            yield slot.flow, DUPLICATE, None, 0, None, None, False, False
            continue
        slot.sig, slot.sig_ts = sig, ts
        if slot.phase == CLOSED:
            if flags & (SYN | ACK) != SYN:
                yield slot.flow, STRAGGLER, None, 0, None, None, False, False
                continue
            slot.phase, slot.sig = FRESH, None  # a reused slot forgets the packet that reopened it
        if slot.phase == FRESH:
            slot.flow += 1
            slot.open_flow(side)
        slot.accepted_ts = ts
        last, before = slot.last[side], slot.before[side]
        gap = None if last is None else ts - last
        jitter = None if before is None else abs(gap - (last - before))
        slot.last[side], slot.before[side] = ts, last
        lost, closes = 0, False
        after_synack = bool(slot.synacks & (1 << (not side)))
        if proto == TCP:
            if payload > 0:
                top = slot.top[side]
                if top is not None and (seq - top) & 0xFFFFFFFF >= 0x80000000:
                    lost = 1
                else:
                    slot.top[side] = (seq + payload) & 0xFFFFFFFF
            bit = 1 << side
            if flags & (SYN | ACK) == SYN | ACK:
                slot.synacks |= bit
            if flags & FIN:
                slot.fins |= bit
            if flags & RST or slot.fins == 3:
                slot.phase, closes = CLOSED, True
        yield slot.flow, ACCEPTED, side == slot.init, lost, gap, jitter, after_synack, closes


def key_starts(batch: pa.RecordBatch, previous: tuple | None) -> tuple[list[int], tuple]:
    """Row numbers where the 5-tuple differs from the row before, and the batch's last 5-tuple."""
    return run_starts(batch, TASK_KEYS, previous)


def packet_fields(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The packed integers of a batch as header fields."""
    column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    out = {"ts_us": column("ts_us"), "proto": column("end_a") >> 48}
    for packed, fields in (("head", HEAD_FIELDS), ("body", BODY_FIELDS)):
        values = column(packed)
        out.update({f: (values >> shift) & ((1 << width) - 1) for f, (shift, width) in fields.items()})
    return out


def walk_rows(batch: pa.RecordBatch, fields: dict[str, np.ndarray], begin: int = 0, end: int | None = None) -> list[tuple]:
    """Rows [begin, end) of a batch as the walk takes them."""
    at = slice(begin, end)
    values = {c: v[at].tolist() for c, v in fields.items()}
    if "now_us" in batch.schema.names:
        values["now_us"] = batch.column("now_us").slice(begin, None if end is None else end - begin).to_pylist()
    else:
        values["now_us"] = values["ts_us"]
    return list(zip(*[values[c] for c in WALK_COLUMNS]))


def label_partition(batches: Iterator[pa.RecordBatch], idle_us: int, finish, slot: Slot | None = None,
                    previous: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """Label a sorted partition and turn each batch, its fields and its labels into a result batch.

    5-tuples that lie whole inside a batch are labelled as columns where they can be; the one that goes on from the
    batch before, the last one, and those with odd cases are walked. ``slot`` and ``previous`` continue a 5-tuple begun
    in another task.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        starts, previous = key_starts(batch, previous)
        fields, labels = packet_fields(batch), Labels(n)
        walked = [(0, starts[0] if starts else n)]
        if len(starts) > 1:
            begin, end = starts[0], starts[-1]
            whole = np.array(starts[:-1])
            now = None
            if "now_us" in batch.schema.names:
                now = batch.column("now_us").slice(begin, end - begin).fill_null(np.iinfo(np.int64).min).to_numpy(
                    zero_copy_only=False)
            odd = label_runs(labels, begin, {c: v[begin:end] for c, v in fields.items()}, now, whole - begin, idle_us)
            walked += [(starts[i], starts[i + 1]) for i in odd.tolist()]
        walked += [(starts[-1], n)] if starts else []
        for begin, end in walked:
            if begin == end:
                continue
            if begin or starts and starts[0] == 0:
                slot = Slot()
            labels.put_walked(begin, list(walk(slot, walk_rows(batch, fields, begin, end), idle_us)))
        yield finish(batch, fields, label_arrays(labels))


def label_arrays(labels: Labels) -> dict[str, pa.Array]:
    return {
        "flow_seq": pa.array(labels.flow), "verdict": pa.array(labels.verdict),
        "from_src": pa.array(labels.src, mask=~labels.has_src), "lost": pa.array(labels.lost),
        "gap_us": pa.array(labels.gap, mask=~labels.has_gap), "jitter_us": pa.array(labels.jitter, mask=~labels.has_jitter),
        "after_synack": pa.array(labels.after), "closes": pa.array(labels.closes),
    }


def packed(fields: dict[str, tuple[int, int]]) -> Column:
    out = F.lit(0).cast("bigint")
    for name, (shift, _) in fields.items():
        out = out.bitwiseOR(F.shiftleft(F.col(name).cast("int").cast("bigint") if name == "from_a"
                                        else F.col(name).cast("bigint"), shift))
    return out


def unpacked(source: str, fields: dict[str, tuple[int, int]]) -> dict[str, Column]:
    return {
        name: F.shiftrightunsigned(source, shift).bitwiseAND((1 << width) - 1)
        for name, (shift, width) in fields.items()
    }


def unpacked_key() -> dict[str, Column]:
    part = lambda c, shift, width: F.shiftright(c, shift).bitwiseAND((1 << width) - 1)
    return {
        "ip_a": part("end_a", 16, 32), "port_a": part("end_a", 0, 16).cast("int"),
        "ip_b": part("end_b", 16, 32), "port_b": part("end_b", 0, 16).cast("int"),
        "proto": part("end_a", 48, 8).cast("int"),
    }


def keyed_packets(packets: DataFrame) -> DataFrame:
    """Packets packed for the walk: 5-tuple, order, two integers of header fields, and ``now_us`` if the
    idle policy needs one. ``key_hash`` only speeds up grouping and sorting."""
    end = lambda ip, port: F.shiftleft(F.col(ip), 16).bitwiseOR(F.col(port).cast("bigint"))
    keyed = packets.withColumns(canonical_key())
    keyed = keyed.withColumns({
        "end_a": end("ip_a", "port_a").bitwiseOR(F.shiftleft(F.col("proto").cast("bigint"), 48)),
        "end_b": end("ip_b", "port_b"), "head": packed(HEAD_FIELDS), "body": packed(BODY_FIELDS),
    })
    clock = [c for c in ("now_us",) if c in packets.columns]
    return keyed.withColumn("key_hash", F.xxhash64(*TASK_KEYS)).select(*SORT_KEYS, "head", "body", *clock)


def sweep_times(numbered: DataFrame, every: int) -> DataFrame:
    """(capture_id, sweep_no, now_us): a sweep after every ``every`` packets, and the newest time seen by then."""
    return numbered.filter((F.col("nth") + 1) % every == 0).select(
        "capture_id", F.expr(f"(nth + 1) div {every}").alias("sweep_no"), F.col("ts_us").alias("now_us"))


def in_capture_order(packets: DataFrame) -> DataFrame:
    """Add ``nth``, the packet's place in its capture."""
    return with_ordinal(packets, ["capture_id"], ["ts_us", "pkt_no"], "nth")


def with_clock(packets: DataFrame, idle: str, every: int = SWEEP_EVERY_PACKETS) -> DataFrame:
    """Add ``now_us``, the time a slot's idleness is judged against.

    ``gap``: the packet's own time, so nothing is added. ``none``: never. ``sweep``: the newest time seen at the last sweep,
    one per ``every`` packets of a capture. Packets that have ``nth`` already are not numbered again.
    """
    if idle == "gap":
        return packets
    if idle == "none":
        return packets.withColumn("now_us", F.lit(None).cast("bigint"))
    if idle != "sweep":
        raise ValueError(f"unknown idle policy {idle!r}")
    numbered = packets if "nth" in packets.columns else in_capture_order(packets)
    sweeps = stored(sweep_times(numbered, every))  # one row for many packets; its size is known
    numbered = numbered.withColumn("sweep_no", F.expr(f"(nth + 1) div {every}"))
    return numbered.join(sweeps, ["capture_id", "sweep_no"], "left").drop("nth", "sweep_no")


def _walked(packets: DataFrame, idle: str, idle_us: int, hot_rows: int | None, finish, needed: list[str],
            added: list[T.StructField], every: int = SWEEP_EVERY_PACKETS) -> DataFrame:
    """Run the walk; ``finish`` makes the rows that leave a task: the ``needed`` columns and ``added`` ones."""
    from flowspark.operators.hot_segments import label_hot, split_hot

    ship_package(packets.sparkSession)
    keyed = keyed_packets(with_clock(packets, idle, every))
    cold, hot = (keyed, None) if hot_rows is None else split_hot(keyed, hot_rows)
    schema = T.StructType([*[keyed.schema[c] for c in needed], *added])
    # The hash is taken anew behind the shuffle: its bytes do not compress.
    key_hash = F.xxhash64(*TASK_KEYS)
    dealt = cold.drop("key_hash").repartition(key_hash).withColumn("key_hash", key_hash)
    ordered = dealt.sortWithinPartitions(*SORT_KEYS)
    passed = [c for c in keyed.columns if c != "key_hash" and (c != "pkt_no" or c in needed)]
    out = ordered.select(*passed).mapInArrow(
        lambda batches: label_partition(batches, idle_us, finish), schema
    )
    return out if hot is None else out.unionByName(label_hot(hot, idle_us, hot_rows, finish, schema))


def segment_packets(packets: DataFrame, idle: str = "gap", idle_us: int = IDLE_TIMEOUT_US,
                    hot_rows: int | None = DEFAULT_HOT_ROWS, every: int = SWEEP_EVERY_PACKETS) -> DataFrame:
    """Label every packet with its flow (``flow_seq`` within the 5-tuple) and its verdict.

    Columns: the 5-tuple key, the packet's order and header fields, and ``flow_seq, verdict`` (0 accepted,
    1 duplicate, 2 straggler)``, from_src, lost, gap_us, jitter_us, after_synack, closes``.
    ``hot_rows=None`` skips the count that looks for hot 5-tuples. That count reads the key columns of
    ``packets`` once more, so a table decoded from captures is best stored first.
    """
    needed = [*TASK_KEYS, "ts_us", "pkt_no", "head", "body"]

    def keep(batch: pa.RecordBatch, fields: dict, labels: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in needed], *labels.values()], names=[*needed, *labels]
        )

    walked = _walked(packets, idle, idle_us, hot_rows, keep, needed, _LABEL_FIELDS, every)
    fields = {**unpacked_key(), **unpacked("head", HEAD_FIELDS), **unpacked("body", BODY_FIELDS)}
    kinds = {"from_a": "boolean", "ip_total_len": "bigint"}
    fields.update({c: fields[c].cast(kinds.get(c, "int")) for c in ("from_a", "tcp_flags", "ttl", "tcp_window")})
    return walked.withColumns(fields).select(*CARRIED_COLUMNS, *LABEL_TYPES)


def partial_flows(packets: DataFrame, idle: str = "gap", idle_us: int = IDLE_TIMEOUT_US,
                  hot_rows: int | None = DEFAULT_HOT_ROWS, every: int = SWEEP_EVERY_PACKETS) -> DataFrame:
    """Like ``segment_packets``, with the packets of a batch already combined to one row per flow.

    Rows of one flow from different batches are still to be merged; sums, extremes and bit unions do that.
    """
    measures = [T.StructField(c, T.LongType()) for c in ("flow_seq", *PARTIAL_MEASURES)]
    walked = _walked(packets, idle, idle_us, hot_rows, combine_flows, TASK_KEYS, measures, every)
    return walked.withColumns(unpacked_key()).select(*KEY_COLUMNS, "flow_seq", *PARTIAL_MEASURES)


def combine_flows(batch: pa.RecordBatch, fields: dict, labels: dict) -> pa.RecordBatch:
    """Accepted packets of a labelled batch to one row per flow, whole columns at a time.

    A flow's packets lie next to each other, so every measure is one reduction over its stretch. A missing
    extreme is NULL; a missing sum is 0.
    """
    plain = lambda c, none=None: (labels[c] if none is None else pc.fill_null(labels[c], none)).to_numpy(
        zero_copy_only=False)
    kept = np.flatnonzero(plain("verdict") == ACCEPTED)
    n = len(kept)
    flow = plain("flow_seq")[kept]
    keys = [batch.column(c).take(pa.array(kept)) for c in TASK_KEYS]
    fresh = np.ones(n, dtype=bool)
    if n > 1:
        fresh[1:] = flow[1:] != flow[:-1]
        for column in keys:
            fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(fresh)
    ts, flags, length, ttl, window, from_a = (
        fields[c][kept] for c in ("ts_us", "tcp_flags", "ip_total_len", "ttl", "tcp_window", "from_a"))
    src, gap, jitter = plain("from_src", False)[kept].astype(bool), plain("gap_us", -1)[kept], plain("jitter_us", -1)[kept]
    lost, closes, later = (plain(c)[kept] for c in ("lost", "closes", "after_synack"))
    first, handshake = gap < 0, flags & (SYN | ACK)

    def reduce(ufunc, keep, values, none) -> np.ndarray:
        chosen = np.where(keep, values, np.int64(none))
        return ufunc.reduceat(chosen, starts) if n else chosen

    columns: dict[str, np.ndarray] = {}
    for p, side in (("s", src), ("d", ~src)):
        again = side & (jitter >= 0)
        for name, keep, values in (
            ("pkts", side, np.int64(1)), ("bytes", side, length), ("loss", side, lost),
            ("_gap_sum", side & ~first, gap), ("_gaps", side & ~first, np.int64(1)),
            ("_jit_sum", again, jitter), ("_jits", again, np.int64(1)),
        ):
            columns[p + name] = reduce(np.add, keep, values, 0)
        columns[f"{p}_flags"] = reduce(np.bitwise_or, side, flags, 0)
        columns[f"{p}ttl"] = reduce(np.maximum, side & first, ttl, 0)
        columns[f"{p}win"] = reduce(np.maximum, side & first, window, 0)
    latest, soonest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    columns["src_is_a"] = reduce(np.maximum, src & first, from_a, latest)
    columns["stime_us"], columns["ltime_us"] = reduce(np.minimum, True, ts, 0), reduce(np.maximum, True, ts, 0)
    columns["close_us"] = reduce(np.maximum, closes, ts, latest)
    columns["syn_us"] = reduce(np.minimum, src & (handshake == SYN), ts, soonest)
    columns["synack_us"] = reduce(np.minimum, ~src & (handshake == SYN | ACK), ts, soonest)
    columns["ack_us"] = reduce(np.minimum, src & (handshake == ACK) & later, ts, soonest)
    at = pa.array(starts)
    arrays = [
        pa.array(columns[c], pa.int64(), mask=(columns[c] == latest) | (columns[c] == soonest)) for c in PARTIAL_MEASURES
    ]
    return pa.RecordBatch.from_arrays(
        [*[c.take(at) for c in keys], pa.array(flow[starts]), *arrays], names=[*TASK_KEYS, "flow_seq", *PARTIAL_MEASURES]
    )
