"""Schemas and the fixed column contracts shared by every stage."""

from pyspark.sql import types as T

# Category lists, in the order the model was trained with.
PROTO_TOP = ["tcp", "udp", "unas", "arp", "ospf", "sctp"]
SERVICE_TOP = ["-", "http", "dns", "smtp", "ftp-data", "ftp", "ssh", "pop3"]
STATE_TOP = ["FIN", "INT", "CON", "REQ"]

# The 37 numeric model inputs, in model order.
NUMERIC_FEATURES = [
    "ackdat", "ct_dst_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm", "ct_flw_http_mthd", "ct_ftp_cmd",
    "ct_src_dport_ltm", "ct_src_ltm", "ct_srv_dst", "ct_srv_src", "ct_state_ttl", "dbytes", "dinpkt",
    "djit", "dload", "dloss", "dmean", "dpkts", "dttl", "dur", "dwin", "is_ftp_login",
    "is_sm_ips_ports", "rate", "response_body_len", "sbytes", "sinpkt", "sjit", "sload", "sloss",
    "smean", "spkts", "sttl", "swin", "synack", "tcprtt", "trans_depth",
]

# Columns the offline study drops and columns it log-transforms.
DROPPED_COLUMNS = ["id", "attack_cat", "stcpb", "dtcpb"]
SKEWED_COLUMNS = [
    "sload", "dload", "sbytes", "dbytes", "sjit", "djit", "rate", "sinpkt", "dinpkt", "spkts",
    "dpkts", "sloss", "dloss", "response_body_len",
]

TOP_VALUES = {"proto": PROTO_TOP, "service": SERVICE_TOP, "state": STATE_TOP}


def one_hot_categories(prefix: str) -> list[str]:
    """Categories of a one-hot group: the kept values plus ``other``, in byte order."""
    return sorted([*TOP_VALUES[prefix], "other"])


ONE_HOT_COLUMNS = [f"{p}_{c}" for p in TOP_VALUES for c in one_hot_categories(p)]
MODEL_COLUMNS = ONE_HOT_COLUMNS + NUMERIC_FEATURES
FEATURE_COUNT = len(MODEL_COLUMNS)
assert FEATURE_COUNT == 58

# Features that need payload inspection; 0 unless a payload table supplies them.
PAYLOAD_FEATURES = ["trans_depth", "response_body_len", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd"]

HISTORY_COUNTS = {
    "ct_srv_src": ["service", "srcip"],
    "ct_srv_dst": ["service", "dstip"],
    "ct_dst_ltm": ["dstip"],
    "ct_src_ltm": ["srcip"],
    "ct_src_dport_ltm": ["srcip", "dsport"],
    "ct_dst_sport_ltm": ["dstip", "sport"],
    "ct_dst_src_ltm": ["srcip", "dstip"],
}

FIN, SYN, RST, ACK = 0x01, 0x02, 0x04, 0x10
ICMP, TCP, UDP = 1, 6, 17

IDLE_TIMEOUT_US = 60_000_000
DUPLICATE_WINDOW_US = 5_000
SWEEP_EVERY_PACKETS = 500_000
HISTORY_FLOWS = 100
DEFAULT_THRESHOLD = 0.69
ALERT_TTL_US = 60_000_000

KEY_COLUMNS = ["capture_id", "ip_a", "port_a", "ip_b", "port_b", "proto"]
ENDPOINTS = ["srcip", "sport", "dstip", "dsport", "proto"]


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "float": T.FloatType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
    "array<double>": T.ArrayType(T.DoubleType()),
}


def _struct(spec: str) -> T.StructType:
    """``"a int, b string"`` as a StructType; needs no running session, unlike the DDL parser."""
    pairs = (field.split() for field in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FRAME_SCHEMA = _struct(
    "capture_id string, pkt_no bigint, ts_us bigint, linktype int, caplen int, data binary"
)
PACKET_SCHEMA = _struct(
    "capture_id string, pkt_no bigint, ts_us bigint, src_ip bigint, dst_ip bigint, src_port int, "
    "dst_port int, proto int, tcp_flags int, ttl int, tcp_window int, tcp_seq bigint, "
    "payload_len bigint, ip_total_len bigint"
)
FLOW_SCHEMA = _struct(
    "srcip string, sport int, dstip string, dsport int, proto string, state string, service string, "
    "dur double, sloss bigint, dloss bigint, spkts bigint, dpkts bigint, sbytes bigint, dbytes bigint, "
    "sttl int, dttl int, swin int, dwin int, smean double, dmean double, sload double, dload double, "
    "rate double, sinpkt double, dinpkt double, sjit double, djit double, synack double, ackdat double, "
    "tcprtt double, is_sm_ips_ports int, ct_srv_src int, ct_srv_dst int, ct_dst_ltm int, ct_src_ltm int, "
    "ct_src_dport_ltm int, ct_dst_sport_ltm int, ct_dst_src_ltm int, ct_state_ttl int, trans_depth int, "
    "response_body_len int, ct_flw_http_mthd int, is_ftp_login int, ct_ftp_cmd int"
)
FLOW_COLUMNS = FLOW_SCHEMA.fieldNames()
LINEAGE_COLUMNS = ["capture_id", "flow_seq", "emit_no", "stime_us", "ltime_us"]
VECTOR_SCHEMA = _struct(
    "srcip string, sport int, dstip string, dsport int, proto string, features array<double>"
)
SCORED_SCHEMA = _struct(
    "srcip string, sport int, dstip string, dsport int, proto string, attack_prob float, label int, "
    "alert boolean, latency_us bigint"
)
ALERT_SCHEMA = _struct(
    "srcip string, sport int, dstip string, dsport int, proto string, attack_prob float, latency_us bigint"
)
SUBSCRIBER_SCHEMA = _struct("client_id bigint, min_prob float")
AUDIT_SCHEMA = _struct(
    "flow_id string, ts_ms bigint, prediction int, confidence float, alert boolean, latency_us bigint"
)


def labelled_schema() -> T.StructType:
    """The labelled flow table: id, three categoricals, the numerics, two sequence columns, labels."""
    whole = {f.name for f in FLOW_SCHEMA if isinstance(f.dataType, (T.LongType, T.IntegerType))}
    fields = [T.StructField("id", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in TOP_VALUES]
    fields += [
        T.StructField(c, T.LongType() if c in whole else T.DoubleType()) for c in NUMERIC_FEATURES
    ]
    fields += [T.StructField(c, T.LongType()) for c in ("stcpb", "dtcpb")]
    return T.StructType([*fields, T.StructField("attack_cat", T.StringType()),
                         T.StructField("label", T.IntegerType())])
