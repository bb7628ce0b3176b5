"""The flow walk for 5-tuples too large for one task.

Hot 5-tuples are range-sorted into stretches. Each stretch is walked from a guessed entry state at the
same time as all others; then the exits are chained on the driver (one small state per stretch). A
stretch whose true entry differs from the guess is walked again, until every guess was right, so the
labels are exactly those of one long walk. Fields that only pass through (flow number, initiator, last
times, a side's silence) never make a guess wrong; long floods of one repeated packet, whose duplicate
phase hangs on the very first packet, get their guess from the composed step functions of
:mod:`flowspark.operators.hot_cooldown`.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.contracts import DUPLICATE_WINDOW_US
from flowspark.operators import hot_cooldown as H
from flowspark.operators import segments as S

WALK_SCHEMA = "stretch bigint, first_key string, last_key string, whole boolean, unbroken boolean, leave binary"


def split_hot(keyed: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    return H.split_hot_keys(keyed, "key_hash", hot_rows)


def control(slot: S.Slot) -> tuple:
    """The part of a state that decides what happens next."""
    sig = slot.sig if slot.phase else None
    return (slot.phase, slot.fins, slot.accepted_ts, sig, slot.sig_ts if sig else 0, tuple(slot.top))


def neutral(entry: S.Slot) -> S.Slot:
    """A state with the same control part and nothing else, as a starting point of a walk."""
    slot = S.Slot()
    slot.flow = 0
    slot.phase, slot.fins, slot.accepted_ts = entry.phase, entry.fins, entry.accepted_ts
    slot.sig, slot.sig_ts, slot.top = entry.sig, entry.sig_ts, list(entry.top)
    return slot


def first_guess() -> S.Slot:
    slot = S.Slot()
    slot.flow, slot.phase, slot.accepted_ts = 0, S.OPEN, None
    return slot


def carry(entry: S.Slot, guess: S.Slot, left: S.Slot) -> S.Slot:
    """State after a stretch entered with ``entry``, given that ``guess`` left it as ``left``.

    Exact when the control parts of ``entry`` and ``guess`` agree; a good guess otherwise.
    """
    out = pickle.loads(pickle.dumps(left))
    out.flow = entry.flow + left.flow - guess.flow
    if left.flow != guess.flow:
        return out
    out.init, out.synacks = entry.init, entry.synacks | left.synacks
    out.fins = entry.fins | left.fins
    for side in (0, 1):
        if left.last[side] is None:
            out.last[side], out.before[side] = entry.last[side], entry.before[side]
        elif left.before[side] is None:
            out.before[side] = entry.last[side]
        if left.top[side] == guess.top[side]:
            out.top[side] = entry.top[side]
    if left.accepted_ts == guess.accepted_ts:
        out.accepted_ts = entry.accepted_ts
    if left.sig == guess.sig and left.sig_ts == guess.sig_ts:
        out.sig, out.sig_ts = entry.sig, entry.sig_ts
    if left.phase == guess.phase:
        out.phase = entry.phase
    return out


def _same_packet(batch: pa.RecordBatch, before: tuple | None) -> tuple[bool, tuple]:
    """Whether the batch only repeats one packet with less than the duplicate window in between."""
    fields = S.packet_fields(batch)
    columns = [fields[c] for c in ("from_a", "tcp_seq", "ip_total_len", "tcp_flags")]
    ts = batch.column("ts_us").to_numpy()
    same = all((c == c[0]).all() for c in columns) and (np.diff(ts) < DUPLICATE_WINDOW_US).all()
    first, last = tuple(c[0] for c in columns), tuple(c[-1] for c in columns)
    if before is not None:
        same = same and before[0] == first and ts[0] - before[1] < DUPLICATE_WINDOW_US
    return bool(same), (last, ts[-1])


def _leave_states(batches: Iterator[pa.RecordBatch], guesses: dict[int, S.Slot], idle_us: int):
    """Walk a stretch and report the state its last 5-tuple is left in."""
    number, first_key, previous, whole, unbroken, tail = None, None, None, True, True, None
    slot = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, last_key = S.key_starts(batch, previous)
        if number is None:
            number, first_key = batch.column("_stretch")[0].as_py(), tuple(
                batch.column(c)[0].as_py() for c in S.TASK_KEYS
            )
            starts = starts[1:]
            slot = pickle.loads(pickle.dumps(guesses.get(number) or first_guess()))
            if slot.accepted_ts is None:
                slot.accepted_ts = batch.column("ts_us")[0].as_py()
        if starts:
            whole, slot = False, S.Slot()
            batch = batch.slice(starts[-1])
        same, tail = _same_packet(batch, tail)
        unbroken = unbroken and same
        for _ in S.walk(slot, S.walk_rows(batch, S.packet_fields(batch)), idle_us):
            pass
        previous = last_key
    if number is None:
        return
    arrays = [[number], [repr(first_key)], [repr(previous)], [whole], [unbroken and whole], [pickle.dumps(slot)]]
    names = ["stretch", "first_key", "last_key", "whole", "unbroken", "leave"]
    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def _walk_stretches(placed: DataFrame, guesses: dict[int, S.Slot], idle_us: int) -> dict[int, dict]:
    rows = placed.mapInArrow(lambda b: _leave_states(b, guesses, idle_us), WALK_SCHEMA).collect()
    return {r["stretch"]: {**r.asDict(), "leave": pickle.loads(r["leave"])} for r in rows}


def _flood_entries(placed: DataFrame, walked: dict[int, dict], continued: dict[int, bool]) -> dict[int, int]:
    """Entry times of the duplicate rule, as if every stretch of one repeated packet were open."""
    spark = placed.sparkSession
    floods = [n for n, w in walked.items() if w["unbroken"] and continued[n]]
    others = [(n, *H._pack(H.constant(w["leave"].sig_ts))) for n, w in walked.items() if n not in set(floods)]

    def steps(batches: Iterator[pa.RecordBatch]):
        times, number = [], None
        for batch in batches:
            if batch.num_rows:
                number = batch.column("_stretch")[0].as_py()
                times.append(batch.column("ts_us").to_numpy())
        if number is not None:
            upto, leave = H._pack(H.step_function(np.concatenate(times), DUPLICATE_WINDOW_US))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([upto]), pa.array([leave])], names=["stretch", "upto", "leave"]
            )

    schema = "stretch bigint, upto binary, leave binary"
    measured = placed.filter(F.col("_stretch").isin(floods)).mapInArrow(steps, schema)
    return H.entry_times(measured.unionByName(spark.createDataFrame(others, schema)) if others else measured)


def entry_states(placed: DataFrame, idle_us: int) -> tuple[dict[int, S.Slot | None], dict[str, int]]:
    """The exact entry state of every stretch (None where its first 5-tuple starts), and how many walks
    that took."""
    walked = _walk_stretches(placed, {}, idle_us)
    continued = H.chain_starts([(n, w["first_key"], w["last_key"]) for n, w in walked.items()])
    guesses: dict[int, S.Slot] = {}
    for number, w in walked.items():
        guesses[number] = first_guess() if w["whole"] and continued[number] else None
    # A whole stretch that begins its 5-tuple was walked from a guess too; it has to start fresh.
    fresh = {n: S.Slot() for n, w in walked.items() if w["whole"] and not continued[n]}
    if fresh:
        walked.update(_walk_stretches(placed.filter(F.col("_stretch").isin(list(fresh))), fresh, idle_us))
    flood = {}
    if any(w["unbroken"] and continued[n] for n, w in walked.items()):
        flood = _flood_entries(placed, walked, continued)
    rounds, walks = 0, len(walked) + len(fresh)
    while True:
        entries, wrong, state = {}, {}, None
        for number in sorted(walked):
            w = walked[number]
            entry = state if continued[number] else None
            entries[number] = entry
            if entry is None or not w["whole"]:
                state = w["leave"]
                continue
            state = carry(entry, guesses[number], w["leave"])
            if control(entry) != control(guesses[number]):
                wrong[number] = neutral(entry)
                if not rounds and number in flood and entry.phase == S.OPEN and flood[number] != H.FOREVER:
                    wrong[number].sig_ts = flood[number]
                    if w["unbroken"]:
                        wrong[number].accepted_ts = flood[number]
        if not wrong:
            return entries, {"rounds": rounds, "walks": walks, "stretches": len(walked)}
        guesses.update(pickle.loads(pickle.dumps(wrong)))
        some = placed.filter(F.col("_stretch").isin(list(wrong)))
        for number, w in _walk_stretches(some, wrong, idle_us).items():
            walked[number] = w
        rounds, walks = rounds + 1, walks + len(wrong)


def label_hot(hot: DataFrame, idle_us: int, hot_rows: int, finish, schema) -> DataFrame:
    placed = H.stretches(hot, S.SORT_KEYS, hot_rows)
    entries, _ = entry_states(placed, idle_us)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        entry, previous = entries[first.column("_stretch")[0].as_py()], None
        if entry is not None:
            previous = tuple(first.column(c)[0].as_py() for c in S.TASK_KEYS)
        yield from S.label_partition(H._chained(first, batches), idle_us, finish, entry, previous)

    return placed.mapInArrow(label, schema)
