"""Decoding captured frames to packets with column expressions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.contracts import ICMP, PACKET_SCHEMA, TCP, UDP

# Link type -> bytes before the IP header; EtherType of IPv4.
LINK_HEADER_BYTES = {1: 14, 113: 16}
ETHERTYPE_IPV4 = "0800"
DECODED_BYTES = 16 + 60 + 20  # the longest link, IP and TCP headers any field is read from


def _hex_at(offset: Column | int, n: int) -> Column:
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.substring(F.col("_hex"), at * 2 + 1, F.lit(n * 2))


def _number(offset: Column | int, n: int) -> Column:
    """Big-endian unsigned integer of ``n`` bytes at ``offset``."""
    return F.conv(_hex_at(offset, n), 16, 10).cast("bigint")


def decode_frames(frames: DataFrame) -> DataFrame:
    """IPv4 TCP, UDP and ICMP packets of a frame table; everything else is dropped.

    Each step only adds columns and filters, so the whole decode is one stage without a shuffle. As in
    the format's own tools here, VLAN tags are not unwrapped, and neither the IP version nor the fragment
    offset is looked at.
    """
    link = F.lit(None).cast("int")
    for linktype, size in LINK_HEADER_BYTES.items():
        link = F.when(F.col("linktype") == linktype, size).otherwise(link)
    caplen = F.col("caplen")
    ip = (
        frames.withColumn("_link", link)
        .filter(F.col("_link").isNotNull() & (caplen >= F.col("_link") + 20))
        .withColumn("_hex", F.hex(F.substring("data", 1, DECODED_BYTES)))
        .filter(_hex_at(F.col("_link") - 2, 2) == ETHERTYPE_IPV4)
        .withColumn("_ihl", (_number(F.col("_link"), 1).bitwiseAND(15) * 4).cast("int"))
        .filter(F.col("_ihl") >= 20)
        .withColumn("proto", _number(F.col("_link") + 9, 1).cast("int"))
        .withColumn("_l4", F.col("_link") + F.col("_ihl"))
    )
    proto, l4 = F.col("proto"), F.col("_l4")
    needed = F.when(proto == TCP, 20).when(proto == UDP, 8).otherwise(0)
    whole = ip.filter(proto.isin(TCP, UDP, ICMP)).filter((proto == ICMP) | (caplen >= l4 + needed))
    ported = proto.isin(TCP, UDP)
    tcp_field = lambda offset, n: F.when(proto == TCP, _number(l4 + offset, n)).otherwise(0)
    transport = F.when(proto == TCP, F.shiftright(_number(l4 + 12, 1), 4) * 4).when(proto == UDP, 8).otherwise(0)
    total = _number(F.col("_link") + 2, 2)
    values = {
        "src_ip": _number(F.col("_link") + 12, 4), "dst_ip": _number(F.col("_link") + 16, 4),
        "src_port": F.when(ported, _number(l4, 2)).otherwise(0),
        "dst_port": F.when(ported, _number(l4 + 2, 2)).otherwise(0),
        "tcp_flags": tcp_field(13, 1), "ttl": _number(F.col("_link") + 8, 1),
        "tcp_window": tcp_field(14, 2), "tcp_seq": tcp_field(4, 4),
        "payload_len": F.greatest(total - F.col("_ihl") - transport, F.lit(0)),
        "ip_total_len": total,
    }
    return whole.withColumns(values).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in PACKET_SCHEMA]
    )
