"""Flow records: per-flow aggregates of labelled packets, names and states, and the emission order."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.contracts import (
    ACK, FLOW_COLUMNS, FLOW_SCHEMA, IDLE_TIMEOUT_US, KEY_COLUMNS, LINEAGE_COLUMNS, PAYLOAD_FEATURES, SYN,
)
from flowspark.functions.net import (
    connection_state, has_flag, ip_text, proto_name, ratio, service_name, state_ttl_bucket,
)
from flowspark.operators.history import add_history
from flowspark.operators.ordinal import with_ordinal
from flowspark.operators.segments import (
    ACCEPTED, DEFAULT_HOT_ROWS, LARGEST, SMALLEST, SUMS, SWEEP_EVERY_PACKETS, UNIONS, in_capture_order, partial_flows,
    sweep_times,
)
from flowspark.session import stored

OPEN_AT_END_US, SWEEP_FANOUT = 1 << 62, 32
ORDER_COLUMNS = ["emit_us", "stime_us", "ip_a", "port_a", "ip_b", "port_b", "proto", "flow_seq"]


def flow_aggregates(labelled: DataFrame) -> DataFrame:
    """One row per flow with raw counters.

    Every buffer is fixed width, so the hash aggregate runs in generated code and combines before the
    shuffle: a task's packets of one flow cross the network as one row, however many there are.
    """
    src, flags = F.col("from_src"), F.col("tcp_flags")
    dst = ~src
    syn, ack = has_flag(flags, SYN), has_flag(flags, ACK)
    first = F.col("gap_us").isNull()

    def total(side: Column, value: Column | str) -> Column:
        return F.coalesce(F.sum(F.when(side, value)), F.lit(0))

    def earliest(side: Column, column: str) -> Column:
        return F.coalesce(F.max(F.when(side & first, F.col(column))), F.lit(0))

    measures = []
    for p, side in (("s", src), ("d", dst)):
        measures += [
            F.count_if(side).alias(f"{p}pkts"),
            total(side, F.col("ip_total_len")).alias(f"{p}bytes"),
            total(side, F.col("lost").cast("bigint")).alias(f"{p}loss"),
            earliest(side, "ttl").alias(f"{p}ttl"),
            earliest(side, "tcp_window").alias(f"{p}win"),
            F.coalesce(F.bit_or(F.when(side, flags)), F.lit(0)).alias(f"{p}_flags"),
            total(side, F.col("gap_us")).alias(f"{p}_gap_sum"),
            F.count(F.when(side, F.col("gap_us"))).alias(f"{p}_gaps"),
            total(side, F.col("jitter_us")).alias(f"{p}_jit_sum"),
            F.count(F.when(side, F.col("jitter_us"))).alias(f"{p}_jits"),
        ]
    return labelled.filter(F.col("verdict") == ACCEPTED).groupBy(*KEY_COLUMNS, "flow_seq").agg(
        *measures,
        F.max(F.when(src & first, F.col("from_a"))).alias("src_is_a"),
        F.min("ts_us").alias("stime_us"), F.max("ts_us").alias("ltime_us"),
        F.max(F.when(F.col("closes"), F.col("ts_us"))).alias("close_us"),
        F.min(F.when(src & syn & ~ack, F.col("ts_us"))).alias("syn_us"),
        F.min(F.when(dst & syn & ack, F.col("ts_us"))).alias("synack_us"),
        F.min(F.when(src & ack & ~syn & F.col("after_synack"), F.col("ts_us"))).alias("ack_us"),
    )


def merged_flows(partial: DataFrame) -> DataFrame:
    """The columns of ``flow_aggregates`` out of partly combined flows, one small row per flow and batch."""
    merges = {F.sum: SUMS, F.bit_or: UNIONS, F.max: LARGEST, F.min: SMALLEST}
    kept = partial.groupBy(*KEY_COLUMNS, "flow_seq").agg(
        *[merge(c).alias(c) for merge, columns in merges.items() for c in columns]
    )
    narrow = {c: F.col(c).cast("int") for c in [*UNIONS, "sttl", "swin", "dttl", "dwin"]}
    return kept.withColumns({**narrow, "src_is_a": F.col("src_is_a") == 1})


def flow_measures(aggregates: DataFrame, idle: str = "gap", idle_us: int = IDLE_TIMEOUT_US) -> DataFrame:
    """Endpoints, labels and guarded ratios of every flow, plus the time it is emitted."""
    c = F.col
    tcp = c("proto") == 6
    pick = lambda yes, no: F.when(c("src_is_a"), c(yes)).otherwise(c(no))
    ends = aggregates.withColumns({
        "src_ip": pick("ip_a", "ip_b"), "sport": pick("port_a", "port_b"),
        "dst_ip": pick("ip_b", "ip_a"), "dsport": pick("port_b", "port_a"),
        "dur": (c("ltime_us") - c("stime_us")) / 1e6,
        "handshake_us": F.when(tcp, c("synack_us")),
    })
    seconds = lambda later, sooner: F.coalesce(F.when(tcp, (c(later) - c(sooner)) / 1e6), F.lit(0.0))
    millis = lambda total, n: F.when(c(n) > 0, c(total) / c(n) / 1000.0).otherwise(0.0)
    never_closed = c("ltime_us") + idle_us if idle == "gap" else F.lit(OPEN_AT_END_US)
    out = ends.withColumns({
        "srcip": ip_text(c("src_ip")), "dstip": ip_text(c("dst_ip")),
        "state": connection_state(c("proto"), c("s_flags"), c("d_flags"), c("spkts"), c("dpkts"),
                                  c("handshake_us").isNotNull()),
        "service": service_name(c("sport"), c("dsport")),
        "proto_name": proto_name(c("proto")),
        "smean": ratio(c("sbytes"), c("spkts")), "dmean": ratio(c("dbytes"), c("dpkts")),
        "sload": ratio(c("sbytes") * 8.0, c("dur")), "dload": ratio(c("dbytes") * 8.0, c("dur")),
        "rate": ratio(c("spkts") + c("dpkts"), c("dur")),
        "sinpkt": millis("s_gap_sum", "s_gaps"), "dinpkt": millis("d_gap_sum", "d_gaps"),
        "sjit": millis("s_jit_sum", "s_jits"), "djit": millis("d_jit_sum", "d_jits"),
        "synack": seconds("synack_us", "syn_us"), "ackdat": seconds("ack_us", "synack_us"),
        "is_sm_ips_ports": (
            (c("src_ip") == c("dst_ip")) & (c("sport") == c("dsport"))
        ).cast("int"),
        "emit_us": F.coalesce(c("close_us"), never_closed),
    })
    return out.withColumn("tcprtt", c("synack") + c("ackdat")).withColumn(
        "ct_state_ttl", state_ttl_bucket(c("state"), c("sttl"), c("dttl"))
    )


def sweep_levels(sweeps: DataFrame, fanout: int = SWEEP_FANOUT) -> list[DataFrame]:
    """(capture_id, _node, _times): the sweep times of every capture in order, ``fanout`` to a node; then the last times
    of the nodes in the same way, up to one node per capture."""
    times = sweeps.filter("now_us is not null").select("capture_id", "now_us").distinct()
    last, levels = with_ordinal(times, ["capture_id"], ["now_us"], "_n"), []
    while not levels or not levels[-1].filter("_node > 0").isEmpty():
        nodes = last.groupBy("capture_id", F.expr(f"_n div {fanout}").alias("_node"))
        levels.append(stored(nodes.agg(F.sort_array(F.collect_list("now_us")).alias("_times"))))
        last = levels[-1].select("capture_id", F.col("_node").alias("_n"), F.array_max("_times").alias("now_us"))
    return levels


def emitted_by_sweeps(measures: DataFrame, sweeps: DataFrame, idle_us: int = IDLE_TIMEOUT_US) -> DataFrame:
    """``emit_us`` of flows that never close: the first sweep that finds them idle, else the end of the capture.

    A flow goes down the levels of its capture's sweep times and looks at a few times on each of them.
    """
    found = measures.withColumn("_node", F.lit(0).cast("bigint"))
    levels = sweep_levels(sweeps)
    passed = F.size(F.filter("_times", lambda t: t <= F.col("ltime_us") + idle_us))
    for level in reversed(levels[1:]):
        found = found.join(level, ["capture_id", "_node"], "left").withColumn(
            "_node", F.col("_node") * SWEEP_FANOUT + passed).drop("_times")
    evicted = F.when(F.col("close_us").isNull(), F.get("_times", passed))
    return found.join(levels[0], ["capture_id", "_node"], "left").withColumn(
        "emit_us", F.coalesce(evicted, "emit_us")).drop("_node", "_times")


def emission_order(measures: DataFrame) -> DataFrame:
    """``emit_no``: place of the flow among its capture's flows, in the order they end."""
    return with_ordinal(measures, ["capture_id"], ORDER_COLUMNS, "emit_no")


def flow_records(numbered: DataFrame, payload: DataFrame | None = None) -> DataFrame:
    """The 44 declared flow fields plus lineage columns.

    ``payload`` may supply the payload-inspection features per (capture_id, flow_seq and 5-tuple text).
    """
    with_history = add_history(numbered)
    if payload is not None:
        keys = ["capture_id", "srcip", "sport", "dstip", "dsport", "flow_seq"]
        with_history = with_history.join(payload, keys, "left")
    present = set(with_history.columns)
    payload_values = {
        f: F.coalesce(F.col(f), F.lit(0)) if f in present else F.lit(0) for f in PAYLOAD_FEATURES
    }
    named = with_history.withColumns(payload_values).drop("proto").withColumnRenamed("proto_name", "proto")
    return named.select(
        *[F.col(c).cast(FLOW_SCHEMA[c].dataType).alias(c) for c in FLOW_COLUMNS], *LINEAGE_COLUMNS
    )


def packets_to_flows(packets: DataFrame, idle: str = "gap", idle_us: int = IDLE_TIMEOUT_US,
                     hot_rows: int | None = DEFAULT_HOT_ROWS, every: int = SWEEP_EVERY_PACKETS) -> DataFrame:
    """Captured packets to finished flow records, all captures of the table in one job.

    With ``idle="sweep"`` a sweep follows every ``every`` packets of a capture.
    """
    if idle == "sweep":
        packets = in_capture_order(packets)
    # Stored, so that the packets' shuffle is gone before the flows are ordered.
    aggregates = merged_flows(stored(partial_flows(packets, idle, idle_us, hot_rows, every)))
    measures = flow_measures(aggregates, idle, idle_us)
    if idle == "sweep":
        measures = emitted_by_sweeps(measures, sweep_times(packets, every), idle_us)
    spent = {*aggregates.columns} - {*FLOW_COLUMNS, *LINEAGE_COLUMNS, *ORDER_COLUMNS}
    return flow_records(emission_order(measures.drop(*spent)))
