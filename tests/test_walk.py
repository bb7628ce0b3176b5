"""Edge cases of the packet walk, each from its definition, and golden totals."""

import pytest
from packets import A, ACK, B, FIN, RST, SYN, packet, random_packets, table
from pyspark.sql import functions as F

from flowspark.operators import hot_cooldown as H
from flowspark.operators import hot_segments as HS
from flowspark.operators import segments as S
from flowspark.operators.flows import flow_aggregates, flow_measures, packets_to_flows

MIN = 60_000_000


def labels(spark, rows, idle="gap", **options):
    df = S.segment_packets(table(spark, rows), idle, hot_rows=None, **options)
    return [(r["verdict"], r["flow_seq"], r["lost"]) for r in df.orderBy("ts_us", "pkt_no").collect()]


def verdicts(spark, rows, **options):
    return [v for v, _, _ in labels(spark, rows, **options)]


def flow_rows(spark, rows, idle="gap"):
    df = packets_to_flows(table(spark, rows), idle, hot_rows=None)
    return df.orderBy("capture_id", "emit_no").collect()


def test_third_copy_after_eight_ms_is_kept(spark):
    assert verdicts(spark, [packet(0), packet(4_000), packet(8_000)]) == [0, 1, 0]


def test_copy_at_exactly_five_ms_is_kept(spark):
    assert verdicts(spark, [packet(0), packet(5_000)]) == [0, 0]


def test_ttl_does_not_tell_copies_apart(spark):
    assert verdicts(spark, [packet(0), packet(900, ttl=61)]) == [0, 1]


def test_straggler_belongs_to_no_flow_and_syn_reopens(spark):
    rows = [packet(0, A, B, FIN | ACK, 1), packet(10_000, B, A, FIN | ACK, 2), packet(20_000, A, B, ACK, 3),
            packet(30_000, A, B, SYN, 4)]
    assert [x[:2] for x in labels(spark, rows)] == [(0, 0), (0, 0), (2, 0), (0, 1)]


def test_syn_ack_after_reset_is_absorbed(spark):
    assert verdicts(spark, [packet(0, flags=RST), packet(10_000, B, A, SYN | ACK)]) == [0, 2]


def test_copy_of_reopening_syn_counts(spark):
    rows = [packet(0, flags=RST), packet(10_000, flags=SYN, seq=7), packet(10_900, flags=SYN, seq=7),
            packet(11_500, flags=SYN, seq=7)]
    assert verdicts(spark, rows) == [0, 0, 0, 1]


@pytest.mark.parametrize("gap, flows", [(MIN, 1), (MIN + 1, 2)])
def test_idle_limit_is_strict(spark, gap, flows):
    assert len({f for _, f, _ in labels(spark, [packet(0), packet(gap)])}) == flows


def test_no_idle_policy_never_splits(spark):
    assert {f for _, f, _ in labels(spark, [packet(0), packet(10 * MIN)], idle="none")} == {0}


def test_sweep_splits_only_after_a_sweep(spark):
    rows = [packet(0), packet(1, (1, 1), (2, 2)), packet(2 * MIN, (1, 1), (2, 2)), packet(2 * MIN + 1)]
    got = labels(spark, rows, idle="sweep", every=3)
    assert [f for _, f, _ in got] == [0, 0, 1, 1]
    assert [f for _, f, _ in labels(spark, rows[:2] + rows[3:], idle="sweep", every=3)] == [0, 0, 1]


def test_swept_flows_leave_before_later_ones(spark):
    rows = [packet(0), packet(1, (1, 1), (2, 2)), packet(2 * MIN, (3, 3), (4, 4)), packet(2 * MIN + 1, (5, 5), (6, 6), flags=RST),
            packet(9 * MIN, (7, 7), (8, 8))]
    df = packets_to_flows(table(spark, rows), "sweep", hot_rows=None, every=3).orderBy("emit_no")
    assert [r["stime_us"] for r in df.collect()] == [0, 1, 2 * MIN + 1, 2 * MIN, 9 * MIN]


def test_sequence_wrap_and_old_segments(spark):
    rows = [packet(0, seq=2**32 - 100, payload=100), packet(10_000, seq=0, payload=100),
            packet(20_000, seq=50, payload=10), packet(30_000, seq=60, payload=100), packet(40_000, seq=105, payload=20)]
    assert [lost for _, _, lost in labels(spark, rows)] == [0, 0, 1, 1, 0]


def test_syn_ack_without_syn(spark):
    rows = [packet(0, A, B, ACK), packet(10_000, B, A, SYN | ACK), packet(30_000, A, B, ACK, 5)]
    flow = flow_rows(spark, rows)[0]
    assert flow["synack"] == 0 and flow["ackdat"] == 0.02 and flow["tcprtt"] == 0.02 and flow["state"] == "CON"


def test_one_packet_flow_has_no_ratios(spark):
    flow = flow_rows(spark, [packet(5, payload=60)])[0]
    zero = ["dur", "dmean", "sload", "dload", "rate", "sinpkt", "dinpkt", "sjit", "djit", "synack", "ackdat", "tcprtt"]
    assert flow["smean"] == 100 and all(flow[c] == 0 for c in zero) and flow["state"] == "INT"


def test_land_packets_come_from_the_source_only(spark):
    same = (10, 80)
    rows = [packet(i * 10_000, same, same, FIN | ACK, i) for i in range(3)]
    flow = flow_rows(spark, rows)[0]
    assert (flow["is_sm_ips_ports"], flow["spkts"], flow["dpkts"], flow["state"]) == (1, 3, 0, "INT")


@pytest.mark.parametrize("proto, both, state", [(17, False, "INT"), (17, True, "CON"), (1, True, "ECO")])
def test_states_without_handshake(spark, proto, both, state):
    rows = [packet(0, proto=proto, payload=1)] + ([packet(10_000, B, A, proto=proto, payload=2)] if both else [])
    assert flow_rows(spark, rows)[0]["state"] == state


def test_initiator_port_names_the_service(spark):
    assert flow_rows(spark, [packet(0, (10, 53), (20, 80))])[0]["service"] == "dns"


def test_history_counts_stop_at_a_hundred(spark):
    rows = [packet(i * 1_000_000, (10, 2_000 + i), B, RST) for i in range(101)]
    last = flow_rows(spark, rows)[-1]
    assert last["ct_src_ltm"] == 100 and last["ct_src_dport_ltm"] == 100 and last["emit_no"] == 100


def test_jitter_and_gaps(spark):
    rows = [packet(t, seq=i) for i, t in enumerate([0, 10_000, 30_000, 35_000])]
    flow = flow_rows(spark, rows)[0]
    assert flow["sinpkt"] == pytest.approx(35 / 3) and flow["sjit"] == pytest.approx((10 + 15) / 2)


@pytest.mark.parametrize("kind", ["tcp", "udp", "bulk", "flood", "half"])
@pytest.mark.parametrize("idle", ["gap", "none"])
def test_hot_key_equals_plain_walk(spark, kind, idle):
    rows = random_packets(300, "bulk" if kind == "half" else kind, 7)
    if kind == "half":
        rows[5][8] = FIN | ACK
    df = table(spark, rows)
    names = ["ts_us", "pkt_no", "flow_seq", "verdict", "from_src", "lost", "gap_us", "jitter_us", "after_synack", "closes"]
    shown = lambda labelled: sorted(map(str, labelled.select(*names).collect()))
    assert shown(S.segment_packets(df, idle, hot_rows=60)) == shown(S.segment_packets(df, idle, hot_rows=None))


def test_hot_stretches_settle_after_one_more_walk(spark):
    keyed = S.keyed_packets(S.with_clock(table(spark, random_packets(300, "flood", 3)), "gap"))
    placed = H.stretches(keyed, S.SORT_KEYS, 50)
    _, info = HS.entry_states(placed, MIN)
    assert info["rounds"] == 1 and info["stretches"] > 5


@pytest.mark.parametrize("seed", [1, 2])
def test_conservation(spark, seed):
    """Every packet gets one verdict, flows add up to the accepted packets, closes end a flow."""
    df = table(spark, random_packets(400, "tcp", seed))
    labelled = S.segment_packets(df, hot_rows=None).cache()
    assert labelled.count() == 400
    accepted = labelled.filter("verdict = 0").count()
    flows = flow_measures(flow_aggregates(labelled))
    assert flows.agg(F.sum(F.col("spkts") + F.col("dpkts"))).first()[0] == accepted
    per_flow = labelled.groupBy("flow_seq").agg(F.count_if("closes").alias("n")).agg(F.max("n")).first()[0]
    assert per_flow <= 1


def test_small_limits_do_not_make_a_stretch_of_every_few_packets(spark):
    """Stretches are tasks and states on the driver, so their number follows the cores once there are enough."""
    cores = spark.sparkContext.defaultParallelism
    rows = [p for k in range(20 * cores) for p in random_packets(12, "bulk", k)]
    df = table(spark, [[f"c{i // 12}", *r[1:]] for i, r in enumerate(rows)])
    placed = H.stretches(S.keyed_packets(df), S.SORT_KEYS, 4)
    assert placed.select("_stretch").distinct().count() <= 4 * cores
    shown_rows = lambda f: sorted(map(str, f.collect()))
    assert shown_rows(S.segment_packets(df, hot_rows=4)) == shown_rows(S.segment_packets(df, hot_rows=None))
