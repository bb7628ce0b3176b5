"""Queries over frames, packets and the flow walk."""

from pyspark.sql import functions as F

from flowspark.contracts import KEY_COLUMNS, PACKET_SCHEMA
from flowspark.functions.binary import decode_frames
from flowspark.functions.net import canonical_key
from flowspark.operators.flows import emission_order, flow_aggregates, flow_measures, packets_to_flows
from flowspark.operators.segments import ACCEPTED, DUPLICATE, STRAGGLER, segment_packets
from flowspark.plans.inputs import flows, labelled_packets
from flowspark.plans.oracle import FLOW_RECORD, PACKETS, over_flows, over_labelled
from flowspark.plans.registry import query
from flowspark.sources import views

_TYPES = {"LongType()": "bigint", "IntegerType()": "int", "StringType()": "string"}
PACKET_COLUMNS = ", ".join(f"{f.name} {_TYPES[str(f.dataType)]}" for f in PACKET_SCHEMA)
IDENTITY = "capture_id string, srcip string, sport int, dstip string, dsport int, proto string, flow_seq bigint"
VERDICTS = "capture_id string, accepted bigint, duplicates bigint, stragglers bigint, closes bigint, lost bigint"


@query(PACKET_COLUMNS, PACKETS)
def packet_table(spark, folder):
    return views.packets(spark, folder)


@query(PACKET_COLUMNS, PACKETS)
def frame_decode(spark, folder):
    return decode_frames(views.frames(spark, folder))


@query("linktype int, kept bigint, payload bigint", f"""
select case when pkt_no % 4 < 2 then 1 else 113 end linktype, count(*) kept, sum(payload_len) payload
from ({PACKETS}) p group by 1""")
def link_layer_totals(spark, folder):
    frames = views.frames(spark, folder)
    linktypes = frames.select("pkt_no", "linktype", "caplen", "data", "capture_id", "ts_us")
    decoded = decode_frames(linktypes)
    kind = F.when(F.col("pkt_no") % 4 < 2, 1).otherwise(113)
    return decoded.groupBy(kind.alias("linktype")).agg(
        F.count("*").alias("kept"), F.sum("payload_len").alias("payload")
    )


@query("capture_id string, ip_a bigint, port_a int, ip_b bigint, port_b int, proto int, packets bigint, "
       "from_a bigint", f"""
select capture_id, ip_a, port_a, ip_b, port_b, proto, count(*) packets, sum(case when a then 1 else 0 end) from_a
from (
  select capture_id, proto, a, case when a then src_ip else dst_ip end ip_a,
    case when a then src_port else dst_port end port_a, case when a then dst_ip else src_ip end ip_b,
    case when a then dst_port else src_port end port_b
  from (select *, src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port) a from ({PACKETS}) p) q) r
group by all""")
def flow_keys(spark, folder):
    keyed = views.packets(spark, folder).withColumns(canonical_key())
    return keyed.groupBy(*KEY_COLUMNS).agg(
        F.count("*").alias("packets"), F.count_if("from_a").alias("from_a")
    )


def _verdict_totals(labelled):
    verdict = F.col("verdict")
    return labelled.groupBy("capture_id").agg(
        F.count_if(verdict == ACCEPTED).alias("accepted"), F.count_if(verdict == DUPLICATE).alias("duplicates"),
        F.count_if(verdict == STRAGGLER).alias("stragglers"), F.count_if("closes").alias("closes"),
        F.sum("lost").alias("lost"),
    )


_VERDICT_SQL = """
select capture_id, count(*) filter (verdict = 0) accepted, count(*) filter (verdict = 1) duplicates,
  count(*) filter (verdict = 2) stragglers, count(*) filter (closes) closes, count(*) filter (lost) lost
from labelled group by 1"""


@query(VERDICTS, over_labelled(_VERDICT_SQL))
def walk_totals_gap(spark, folder):
    return _verdict_totals(labelled_packets(spark, folder))


@query(VERDICTS, over_labelled(_VERDICT_SQL, None))
def walk_totals_no_idle(spark, folder):
    return _verdict_totals(segment_packets(views.packets(spark, folder), idle="none"))


SWEEP_PACKETS = 1_000  # so that sweeps occur in small tables as well


@query(VERDICTS, over_labelled(_VERDICT_SQL, every=SWEEP_PACKETS))
def walk_totals_sweep(spark, folder):
    """Idleness looked at once per 1,000 packets of a capture."""
    return _verdict_totals(segment_packets(views.packets(spark, folder), idle="sweep", every=SWEEP_PACKETS))


@query("capture_id string, ts_us bigint, pkt_no bigint, flow_seq bigint, verdict int, closes boolean", over_labelled(
    "select capture_id, ts_us, pkt_no, flow_seq, verdict, closes from labelled"))
def flow_segments(spark, folder):
    return labelled_packets(spark, folder)


@query("capture_id string, ts_us bigint, pkt_no bigint", over_labelled(
    "select capture_id, ts_us, pkt_no from labelled where verdict = 1"))
def tap_duplicates(spark, folder):
    return labelled_packets(spark, folder).filter(F.col("verdict") == DUPLICATE)


@query("capture_id string, ts_us bigint, pkt_no bigint", over_labelled(
    "select capture_id, ts_us, pkt_no from labelled where lost"))
def retransmissions(spark, folder):
    return labelled_packets(spark, folder).filter(F.col("lost") == 1)


@query("capture_id string, flows bigint, idle_split bigint", over_labelled("""
select capture_id, count(*) flows, count(*) filter (flow_seq > 0) idle_split
from (select distinct capture_id, kid, flow_seq from labelled) f group by 1"""))
def idle_splits(spark, folder):
    """Flows per capture and how many of them are not their 5-tuple's first."""
    distinct = labelled_packets(spark, folder).select(*KEY_COLUMNS, "flow_seq").distinct()
    return distinct.groupBy("capture_id").agg(
        F.count("*").alias("flows"), F.count_if(F.col("flow_seq") > 0).alias("idle_split")
    )


def flow_query(name: str, columns: str):
    """A projection of the flow records, identified by 5-tuple and sequence number."""
    names = ", ".join(c.split()[0] for c in f"{IDENTITY}, {columns}".split(","))
    query(f"{IDENTITY}, {columns}", over_flows(f"select {names} from flows"), name)(flows)


flow_query("flow_counters", "spkts bigint, dpkts bigint, sbytes bigint, dbytes bigint")
flow_query("first_packet_attributes", "sttl int, dttl int, swin int, dwin int")
flow_query("interarrival", "sinpkt double, dinpkt double")
flow_query("jitter", "sjit double, djit double")
flow_query("flow_loss", "sloss bigint, dloss bigint")
flow_query("handshake_timing", "synack double, ackdat double, tcprtt double")
flow_query("flow_duration", "dur double, stime_us bigint, ltime_us bigint")
flow_query("flow_ratios", "smean double, dmean double, sload double, dload double, rate double")
flow_query("connection_state", "state string")
flow_query("service_label", "service string")
flow_query("land_attack", "is_sm_ips_ports int")
flow_query("payload_features", "trans_depth int, response_body_len int, ct_flw_http_mthd int, "
                               "is_ftp_login int, ct_ftp_cmd int")
flow_query("emission_number", "emit_no bigint")
flow_query("history_by_service", "ct_srv_src int, ct_srv_dst int")
flow_query("history_by_address", "ct_dst_ltm int, ct_src_ltm int, ct_dst_src_ltm int")
flow_query("history_by_port", "ct_src_dport_ltm int, ct_dst_sport_ltm int")
flow_query("state_ttl", "ct_state_ttl int")

_FLOW_TYPES = {"LongType()": "bigint", "IntegerType()": "int", "StringType()": "string", "DoubleType()": "double"}


def _record_columns() -> str:
    from flowspark.contracts import FLOW_SCHEMA

    return ", ".join(f"{f.name} {_FLOW_TYPES[str(f.dataType)]}" for f in FLOW_SCHEMA)


@query(_record_columns(), over_flows(f"select {FLOW_RECORD} from flows"))
def flow_record(spark, folder):
    """The 44-field record, straight from packets."""
    return packets_to_flows(views.packets(spark, folder))


@query(_record_columns(), over_flows(f"select {FLOW_RECORD} from flows", None))
def flow_record_no_idle(spark, folder):
    return packets_to_flows(views.packets(spark, folder), idle="none")


@query(_record_columns(), over_flows(f"select {FLOW_RECORD} from flows", every=SWEEP_PACKETS))
def flow_record_sweep(spark, folder):
    """Idle flows leave at the sweep that finds them, which also sets the order the history counts follow."""
    return packets_to_flows(views.packets(spark, folder), idle="sweep", every=SWEEP_PACKETS)


#: Packets whose two ends are one, handshakes that lack their second packet, and low and high lifetimes.
_ODD_SQL = f"""
select * replace (case when pkt_no % 40 = 0 then src_ip else dst_ip end as dst_ip,
  case when pkt_no % 40 = 0 then src_port else dst_port end as dst_port,
  case when src_ip % 3 = 0 then 31 when src_ip % 3 = 1 then 255 else ttl end as ttl)
from ({PACKETS}) odd where not (tcp_flags = 18 and src_port % 2 = 0)"""


def _odd_packets(spark, folder):
    p = views.packets(spark, folder).filter("not (tcp_flags = 18 and src_port % 2 = 0)")
    land = F.col("pkt_no") % 40 == 0
    return p.withColumns({
        "dst_ip": F.when(land, F.col("src_ip")).otherwise(F.col("dst_ip")),
        "dst_port": F.when(land, F.col("src_port")).otherwise(F.col("dst_port")),
        "ttl": F.expr("case when src_ip % 3 = 0 then 31 when src_ip % 3 = 1 then 255 else ttl end").cast("int"),
    })


@query(f"{IDENTITY}, is_sm_ips_ports int, state string, ct_state_ttl int, sttl int, dttl int", over_flows(
    "select capture_id, srcip, sport, dstip, dsport, proto, flow_seq, is_sm_ips_ports, state, ct_state_ttl, sttl, dttl from flows",
    packets=_ODD_SQL))
def odd_flows(spark, folder):
    """Land packets, unanswered handshakes and unusual lifetimes."""
    return packets_to_flows(_odd_packets(spark, folder))


@query(_record_columns(), over_flows(f"select {FLOW_RECORD} from flows"))
def flow_record_hot(spark, folder):
    """The record with 5-tuples of more than 20 packets cut into stretches that are walked side by side."""
    return packets_to_flows(views.packets(spark, folder), hot_rows=20)


@query("capture_id string, src_ip bigint, sport int, dst_ip bigint, dsport int, flow_seq bigint, proto int, "
       "s_flags int, d_flags int, src_is_a boolean", over_flows("""
select capture_id, src src_ip, sport, dst dst_ip, dsport, flow_seq, proto, s_flags, d_flags, src_is_a
from named"""))
def initiator_and_flags(spark, folder):
    measures = flow_measures(flow_aggregates(labelled_packets(spark, folder)))
    return measures


@query("capture_id string, flows bigint, last_no bigint", over_flows(
    "select capture_id, count(*) flows, max(emit_no) last_no from flows group by 1"))
def dense_emission(spark, folder):
    measures = flow_measures(flow_aggregates(labelled_packets(spark, folder)))
    return emission_order(measures).groupBy("capture_id").agg(
        F.count("*").alias("flows"), F.max("emit_no").alias("last_no")
    )


@query("capture_id string, flows bigint, packets bigint", over_flows("""
select capture_id, count(*) flows, sum(spkts + dpkts) packets from flows group by 1"""))
def captures_in_one_job(spark, folder):
    return flows(spark, folder).groupBy("capture_id").agg(
        F.count("*").alias("flows"), F.sum(F.col("spkts") + F.col("dpkts")).alias("packets")
    )
