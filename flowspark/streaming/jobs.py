"""Structured Streaming versions of the flow walk, the history counts and the alert rules."""

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery

from flowspark.contracts import (
    ACK, ALERT_TTL_US, HISTORY_COUNTS, HISTORY_FLOWS, IDLE_TIMEOUT_US, KEY_COLUMNS, SYN,
)
from flowspark.functions.net import canonical_key
from flowspark.operators.alerts import ALERT_KEY
from flowspark.operators.segments import ACCEPTED, WALK_COLUMNS, Slot, walk
from flowspark.session import ship_package

STATE_SCHEMA = "state binary"
PACKET_FIELDS = [*WALK_COLUMNS, "ttl", "tcp_window", "pkt_no"]
COUNTERS = [f"{side}{m}" for side in "sd" for m in
            ("pkts", "bytes", "loss", "ttl", "win", "_flags", "_gap_sum", "_gaps", "_jit_sum", "_jits")]
TIMES = ["stime_us", "ltime_us", "close_us", "syn_us", "synack_us", "ack_us"]
AGGREGATE_SCHEMA = (
    "capture_id string, ip_a bigint, port_a int, ip_b bigint, port_b int, proto int, flow_seq bigint, "
    + ", ".join(f"{c} {'int' if c[1:] in ('ttl', 'win', '_flags') else 'bigint'}" for c in COUNTERS)
    + ", src_is_a boolean, " + ", ".join(f"{t} bigint" for t in TIMES)
)

AGGREGATE_COLUMNS = [c.split()[0] for c in AGGREGATE_SCHEMA.split(", ")]


def _new_flow(row: tuple, seq: int) -> dict:
    flow = dict.fromkeys(COUNTERS, 0)
    flow.update(dict.fromkeys(TIMES), flow_seq=seq, src_is_a=bool(row[2]), stime_us=row[0])
    return flow


def _add_packet(flow: dict, row: tuple, label: tuple) -> None:
    """Fold one accepted packet into its flow's counters; the same measures as the batch aggregate."""
    ts, _, _, flags, _, length, _, _, ttl, window, _ = row
    _, _, from_src, lost, gap, jitter, after_synack, closes = label
    p = "s" if from_src else "d"
    if not flow[f"{p}pkts"]:
        flow[f"{p}ttl"], flow[f"{p}win"] = ttl, window
    flow[f"{p}pkts"] += 1
    flow[f"{p}bytes"] += length
    flow[f"{p}loss"] += lost
    flow[f"{p}_flags"] |= flags
    for name, value in (("gap", gap), ("jit", jitter)):
        if value is not None:
            flow[f"{p}_{name}_sum"] += value
            flow[f"{p}_{name}s"] += 1
    handshake = flags & (SYN | ACK)
    seen = {"syn_us": from_src and handshake == SYN, "synack_us": not from_src and handshake == SYN | ACK,
            "ack_us": from_src and handshake == ACK and after_synack}
    for name, hit in seen.items():
        if hit and flow[name] is None:
            flow[name] = ts
    flow["ltime_us"] = ts
    if closes:
        flow["close_us"] = ts


def stream_flow_aggregates(packets: DataFrame, delay: str = "10 seconds",
                           idle_us: int = IDLE_TIMEOUT_US) -> DataFrame:
    """Finished flows of a packet stream, with the columns of ``flow_aggregates``.

    Packets wait until the watermark has passed them, then go through the walk in time order, so arrival
    order within ``delay`` does not matter. A flow comes out when it closes or has been idle for
    ``idle_us``; packets behind the watermark are dropped by Spark and show in its progress.
    """
    ship_package(packets.sparkSession)
    numbers = [F.col(c).cast("bigint") for c in PACKET_FIELDS]
    timed = packets.withColumns(canonical_key()).withColumn("now_us", F.col("ts_us")).select(
        # Few columns per group: each costs a conversion for every 5-tuple of a batch.
        F.concat_ws("|", *KEY_COLUMNS[1:], KEY_COLUMNS[0]).alias("flow_key"),
        F.array(*numbers).alias("packet"), F.timestamp_micros("ts_us").alias("ts"),
    ).withWatermark("ts", delay)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slot, flow, waiting = pickle.loads(state.get[0]) if state.exists else (Slot(), None, [])
        if not state.hasTimedOut:
            for pdf in frames:
                waiting.extend(tuple(p.tolist()) for p in pdf["packet"])
        limit = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: (r[0], r[-1]))
        cut = sum(1 for r in waiting if r[0] < limit)
        ready, waiting, done = waiting[:cut], waiting[cut:], []
        for row in ready:
            before = slot.flow
            label = next(walk(slot, [row[: len(WALK_COLUMNS)]], idle_us))
            if slot.flow != before:
                if flow is not None:
                    done.append(flow)
                flow = _new_flow(row, slot.flow)
            if label[1] == ACCEPTED:
                _add_packet(flow, row, label)
                if label[-1]:
                    done.append(flow)
                    flow = None
        expired = slot.phase and slot.accepted_ts + idle_us < limit
        if expired and flow is not None:
            done.append(flow)
            flow = None
        deadlines = [waiting[0][0]] if waiting else []
        if slot.phase and not expired:
            deadlines.append(slot.accepted_ts + idle_us)
        if deadlines:
            state.update((pickle.dumps((slot, flow, waiting)),))
            state.setTimeoutTimestamp(max(min(deadlines) // 1000 + 1, limit // 1000 + 1))
        elif state.exists:
            # The sequence number must outlive the flow only while packets of the 5-tuple may still come.
            state.remove()
        if not done:
            return
        *numbers, capture = key[0].split("|", len(KEY_COLUMNS) - 1)
        names = {"capture_id": capture, **dict(zip(KEY_COLUMNS[1:], map(int, numbers)))}
        yield pd.DataFrame([{**names, **f} for f in done], columns=AGGREGATE_COLUMNS, dtype=object)

    return timed.groupBy("flow_key").applyInPandasWithState(
        advance, AGGREGATE_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_history(flows: DataFrame, order: str = "emit_us", delay: str | None = None,
                   time: str = "emit_us") -> DataFrame:
    """History counts of a flow stream: a ring of the last 100 flows per capture.

    With a ``delay``, flows wait until the watermark of ``time`` has passed them and are counted by ``order``, which
    has to follow ``time``; so arrival order within ``delay`` does not matter, and later flows must move the
    watermark. Without one, flows are counted as they arrive, sorted within a micro-batch only: counts are those
    of the batch job only if no flow comes in a later batch than one it precedes.

    The ring is one small state per capture, so captures run side by side but a capture's flows follow
    each other in one task.
    """
    ship_package(flows.sparkSession)
    needed = ["srcip", "dstip", "sport", "dsport", "service"]
    columns = flows.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flows.schema)
    ordered = list(dict.fromkeys([order, "stime_us", "srcip", "sport", "dstip", "dsport"]))

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring, waiting = pickle.loads(state.get[0]) if state.exists else ([], [])
        if not state.hasTimedOut:
            for pdf in frames:
                waiting.extend(pdf[columns].to_dict("records"))
        waiting.sort(key=lambda r: tuple((r[c] is not None, r[c]) for c in ordered))
        if delay is None:
            ready, waiting = waiting, []
        else:
            limit = state.getCurrentWatermarkMs() * 1000
            ready, waiting = [r for r in waiting if r[time] < limit], [r for r in waiting if r[time] >= limit]
        for flow in ready:
            ring = [*ring, {c: flow[c] for c in needed}][-HISTORY_FLOWS:]
            for name, keys in HISTORY_COUNTS.items():
                flow[name] = sum(all(o[k] == flow[k] for k in keys) for o in ring)
        state.update((pickle.dumps((ring, waiting)),))
        if waiting:
            state.setTimeoutTimestamp(max(min(r[time] for r in waiting) // 1000 + 1, limit // 1000 + 1))
        if ready:
            yield pd.DataFrame(ready, columns=[*columns, *HISTORY_COUNTS], dtype=object)

    out = fields + ", " + ", ".join(f"{c} int" for c in HISTORY_COUNTS)
    timed, timeout = flows, GroupStateTimeout.NoTimeout
    if delay is not None:
        timed = flows.withColumn("_ts", F.timestamp_micros(time)).withWatermark("_ts", delay)
        timeout = GroupStateTimeout.EventTimeTimeout
    return timed.groupBy("capture_id").applyInPandasWithState(advance, out, STATE_SCHEMA, "append", timeout)


def stream_alerts(scored: DataFrame, delay: str = "10 seconds", ttl_us: int = ALERT_TTL_US) -> DataFrame:
    """Add ``alert`` to a scored stream: one alert per (source, destination, protocol) and ``ttl_us``.

    Rows wait for the watermark like packets do, so the flags equal the batch ones. Normal rows have no
    part in the rule but keep their place in the stream.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema)
    columns = scored.columns
    others = [c for c in columns if c not in ALERT_KEY]

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = pickle.loads(state.get[0]) if state.exists else (None, [])
        if not state.hasTimedOut:
            for pdf in frames:
                waiting.extend(pdf[others].to_dict("records"))
        limit = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: r["ts_us"])
        cut = sum(1 for r in waiting if r["ts_us"] < limit)
        ready, waiting = waiting[:cut], waiting[cut:]
        for row in ready:
            row["alert"] = False
            if row["label"] == 1 and (last is None or row["ts_us"] >= last + ttl_us):
                row["alert"], last = True, row["ts_us"]
        silent = last is not None and last + ttl_us >= limit
        if waiting or silent:
            state.update((pickle.dumps((last, waiting)),))
            due = waiting[0]["ts_us"] if waiting else last + ttl_us
            state.setTimeoutTimestamp(max(due // 1000 + 1, limit // 1000 + 1))
        elif state.exists:
            state.remove()
        if not ready:
            return
        names = dict(zip(ALERT_KEY, key))
        yield pd.DataFrame([{**names, **r} for r in ready], columns=[*columns, "alert"], dtype=object)

    ship_package(scored.sparkSession)
    timed = scored.withColumn("_ts", F.timestamp_micros("ts_us")).withWatermark("_ts", delay)
    return timed.groupBy(*ALERT_KEY).applyInPandasWithState(
        advance, f"{fields}, alert boolean", STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_rates(events: DataFrame, conditions: dict, delay: str = "10 seconds") -> DataFrame:
    """Per-second rates over sliding minutes, final once the watermark passes a window."""
    window = F.window("ts", "60 seconds", "5 seconds")
    counts = [(F.count_if(cond) / F.lit(60.0)).alias(name) for name, cond in conditions.items()]
    return events.withWatermark("ts", delay).groupBy(window).agg(*counts).select(
        F.unix_micros("window.start").alias("window_start_us"), *conditions
    )


def stream_totals(scored: DataFrame) -> DataFrame:
    """Running totals; for the ``complete`` output mode."""
    attack = F.col("label") == 1
    return scored.groupBy().agg(F.count("*").alias("scored"), F.count_if(attack).alias("attacks"))


def idle_sessions(packets: DataFrame, delay: str = "10 seconds", idle: str = "60 seconds") -> DataFrame:
    """Packets and bytes per idle-bounded session of UDP and ICMP, which have no closing packets."""
    timed = packets.filter(F.col("proto") != 6).withColumns(canonical_key()).withColumn(
        "ts", F.timestamp_micros("ts_us")
    )
    return timed.withWatermark("ts", delay).groupBy(F.session_window("ts", idle), *KEY_COLUMNS).agg(
        F.count("*").alias("packets"), F.sum("ip_total_len").alias("bytes")
    ).select(*KEY_COLUMNS, F.unix_micros("session_window.start").alias("stime_us"), "packets", "bytes")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is available to a parquet table, restartable from ``checkpoint``; waits for the end."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def progress_lag(query: StreamingQuery) -> DataFrame:
    """(source, lag) of a query's last progress: messages available but not yet read, where reported."""
    from pyspark.sql import SparkSession

    progress = query.lastProgress
    sources = progress.sources if progress else []
    rows = [(s.description, int((s.metrics or {}).get("maxOffsetsBehindLatest", 0))) for s in sources]
    return SparkSession.active().createDataFrame(rows, "source string, lag bigint")
