"""Column expressions for addresses, protocols, connection states and guarded arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.contracts import FIN, ICMP, RST, TCP, UDP

# Well-known port -> service, protocol number -> name.
SERVICE_PORTS = {
    80: "http", 8080: "http", 53: "dns", 25: "smtp", 20: "ftp-data", 21: "ftp", 22: "ssh", 110: "pop3",
}
PROTO_NAMES = {TCP: "tcp", UDP: "udp", ICMP: "icmp"}

# Fixed values: (state, source TTLs, destination TTLs, bucket) of ct_state_ttl.
STATE_TTL_RULES = [
    ("FIN", [62, 63, 254, 255], [252, 253], 1),
    ("INT", [0, 62, 254], [0], 2),
    ("CON", [62, 254], [60, 252, 253], 3),
    ("REQ", [254], [0], 6),
]


def lookup(value: Column, table: dict, default: Column | None = None) -> Column:
    """A CASE over a small fixed table; NULL (or ``default``) when nothing matches."""
    out = F.lit(None) if default is None else default
    for key, result in reversed(table.items()):
        out = F.when(value == key, F.lit(result)).otherwise(out)
    return out


def proto_name(proto: Column) -> Column:
    return lookup(proto, PROTO_NAMES, F.lit("other"))


def service_name(initiator_port: Column, responder_port: Column) -> Column:
    """Service of the initiator's port, else of the responder's, else ``-``."""
    return F.coalesce(
        lookup(initiator_port, SERVICE_PORTS), lookup(responder_port, SERVICE_PORTS), F.lit("-")
    )


def ip_text(ip: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def ip_number(text: Column) -> Column:
    """Dotted quad to its unsigned 32-bit value; NULL when the text is not four octets."""
    parts = F.split(text, r"\.")
    octets = [F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") for i in range(4)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(F.size(parts) == 4, value)


def source_is_a() -> Column:
    """Whether the packet's source is endpoint ``a`` (the smaller ip, then the smaller port)."""
    return (F.col("src_ip") < F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port"))
    )


def canonical_key() -> dict[str, Column]:
    """Direction-independent endpoints of a packet, plus ``from_a`` for its direction."""
    a = source_is_a()
    pick = lambda yes, no: F.when(a, F.col(yes)).otherwise(F.col(no))
    return {
        "ip_a": pick("src_ip", "dst_ip"), "port_a": pick("src_port", "dst_port"),
        "ip_b": pick("dst_ip", "src_ip"), "port_b": pick("dst_port", "src_port"),
        "from_a": a,
    }


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def connection_state(proto: Column, s_flags: Column, d_flags: Column, spkts: Column, dpkts: Column,
                     synack_seen: Column) -> Column:
    tcp = (
        F.when(has_flag(s_flags.bitwiseOR(d_flags), RST), "RST")
        .when(has_flag(s_flags, FIN) & has_flag(d_flags, FIN), "FIN")
        .when(dpkts == 0, "INT").when(synack_seen, "CON").otherwise("REQ")
    )
    udp = F.when((spkts > 0) & (dpkts > 0), "CON").otherwise("INT")
    return F.when(proto == TCP, tcp).when(proto == UDP, udp).otherwise("ECO")


def state_ttl_bucket(state: Column, sttl: Column, dttl: Column) -> Column:
    out = F.lit(0)
    for name, source, destination, bucket in STATE_TTL_RULES:
        out = F.when((state == name) & sttl.isin(source) & dttl.isin(destination), bucket).otherwise(out)
    return out


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 for a zero (or missing) denominator."""
    return F.when(denominator > 0, numerator / denominator).otherwise(0.0)
