"""Network-shaped views over the star-schema test tables, so every job has input that grows with them.

The SQL text runs on Spark and on the checking engine; the few braces stand for spellings that differ.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.contracts import PACKET_SCHEMA

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

# One order is one conversation and its lines are packets; two thirds of the lines get a second copy
# a few ms later (a capture tap), and every 50th order reuses its neighbour's 5-tuple 100 s later.
# pkt_no only has to order packets of equal time, so it is built from the row's own key.
PACKETS_SQL = """
select 'cap' || cast(kk % 2 as varchar(1)) capture_id,
  cast(k * 256 + i * 2 + dup as bigint) pkt_no,
  cast(ts_us as bigint) ts_us,
  cast(case when from_server then sip else cip end as bigint) src_ip,
  cast(case when from_server then cip else sip end as bigint) dst_ip,
  cast(case when proto = 1 then 0 when from_server then sport else cport end as int) src_port,
  cast(case when proto = 1 then 0 when from_server then cport else sport end as int) dst_port,
  cast(proto as int) proto,
  cast(case when proto <> 6 then 0 when i = 1 then 2 when i = 2 then 18
       when i = n and rf = 'R' then 4 when i >= n - 1 and i > 3 then 17 else 16 end as int) tcp_flags,
  cast(case when from_server then 252 when kk % 10 = 4 then 254 else 62 end - dup as int) ttl,
  cast(case when proto = 6 then 255 * (1 + k % 3) else 0 end as int) tcp_window,
  cast(case when proto = 6 then (4294960000 + (k % 11) * 100000 + i * q * 40) % 4294967296
       else 0 end as bigint) tcp_seq,
  cast(case when i <= 3 then 0 else q * 30 end as bigint) payload_len,
  cast(case when proto = 6 then 40 when proto = 17 then 28 else 20 end
    + case when i <= 3 then 0 else q * 30 end as bigint) ip_total_len
from (
  select *, 1704067200000000 + late + k * 250000 + i * (20000 + (sk % 7) * 1000)
            + dup * (900 + (k % 9) * 600) ts_us
  from (
    select c.*, d.dup
    from (
      select *,
        case when kk % 20 = 0 then 1 when kk % 20 in (1, 2, 3) then 17 else 6 end proto,
        case when kk % 10 = 4 then 2939006976 + kk % 4 else 1000734720 + kk % 10 end cip,
        2511044096 + case when kk % 20 = 0 then kk % 2400 else kk % 20 end sip,
        1024 + (kk * 7) % 60000 cport,
        case kk % 9 when 0 then 80 when 1 then 53 when 2 then 25 when 3 then 21 when 4 then 22
                    when 5 then 110 when 6 then 8080 when 7 then 443 else 20 end sport,
        (i = 2 or (i > 3 and pk % 2 = 0)) from_server
      from (
        select l_orderkey k,
          case when l_orderkey % 50 = 8 then l_orderkey - 1 else l_orderkey end kk,
          case when l_orderkey % 50 = 8 then 100000000 else 0 end late,
          row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) i,
          count(*) over (partition by l_orderkey) n,
          l_partkey pk, l_suppkey sk, cast(l_quantity as bigint) q, l_returnflag rf
        from lineitem) b) c
    {copies}
    where d.dup = 0 or c.sk % 3 <> 0) x) y
"""

# Alerts in event time, and score/label pairs, out of the events table.
DETECTIONS_SQL = """
select event_id, cast(user_id as varchar(20)) srcip, event_type dstip, 'tcp' proto,
  cast(epoch_us as bigint) ts_us, value
from (select event_id, user_id, event_type, value, {micros} epoch_us from events) e
"""
SCORES_SQL = """
select event_id id, value / (value + 50.0) prob,
  cast(case when event_type in ('error', 'signup') then 1 else 0 end as int) label,
  case when event_type = 'click' then 'Normal' else event_type end attack_cat
from events
"""

# A labelled table with skewed and plain numerics, categoricals and exact duplicates.
LABELLED_SQL = """
select l_orderkey * 256 + l_linenumber * 8 + l_partkey % 8 id,
  l_returnflag proto, l_linestatus service, o_orderpriority state,
  l_extendedprice sload, o_totalprice rate, l_discount dur, l_tax smean, l_quantity spkts,
  cast(case when l_returnflag = 'R' then 1 else 0 end as int) label
from lineitem join orders on l_orderkey = o_orderkey
"""


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(spark: SparkSession, folder: str, text: str, *tables: str) -> DataFrame:
    """Run view text over the named tables without leaving temp views behind."""
    return spark.sql(
        _parametrised(text, tables), **{t: read_table(spark, folder, t) for t in tables}
    )


def _parametrised(text: str, tables: tuple[str, ...]) -> str:
    for t in tables:
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return text


def packets(spark: SparkSession, folder: str) -> DataFrame:
    text = PACKETS_SQL.replace("{copies}", "lateral view explode(array(0, 1)) d as dup")
    return _query(spark, folder, text, "lineitem").select(*PACKET_SCHEMA.fieldNames())


def detections(spark: SparkSession, folder: str) -> DataFrame:
    micros = (
        "unix_date(cast(ts as date)) * 86400000000 + (hour(ts) * 3600 + minute(ts) * 60) * 1000000L "
        "+ cast(extract(second from ts) * 1000000 as bigint)"
    )
    text = DETECTIONS_SQL.replace("{micros}", micros)
    return _query(spark, folder, text, "events")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return _query(spark, folder, SCORES_SQL, "events")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return _query(spark, folder, LABELLED_SQL, "lineitem", "orders")


def subscribers(spark: SparkSession, folder: str) -> DataFrame:
    region = read_table(spark, folder, "region")
    return region.select(
        F.col("r_regionkey").cast("bigint").alias("client_id"),
        (F.col("r_regionkey") / F.lit(5.0)).cast("float").alias("min_prob"),
    )


def _bytes(value, n: int):
    return F.lpad(F.hex(value), 2 * n, "0")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """The packet view as captured frames, alternating Ethernet and Linux cooked headers, with ARP frames
    and cut-off frames in between that a decoder has to drop."""
    c, zero = F.col, F.lit("0000")
    ethernet = c("pkt_no") % 4 < 2
    ip = F.concat(
        F.lit("4500"), _bytes(c("ip_total_len"), 2), F.lit("00000000"), _bytes(c("ttl"), 1),
        _bytes(c("proto"), 1), zero, _bytes(c("src_ip"), 4), _bytes(c("dst_ip"), 4),
    )
    ports = F.concat(_bytes(c("src_port"), 2), _bytes(c("dst_port"), 2))
    tcp = F.concat(
        ports, _bytes(c("tcp_seq"), 4), F.lit("00000000"), F.lit("50"), _bytes(c("tcp_flags"), 1),
        _bytes(c("tcp_window"), 2), F.lit("00000000"),
    )
    udp = F.concat(ports, F.lit("0008"), zero)
    l4 = F.when(c("proto") == 6, tcp).when(c("proto") == 17, udp).otherwise(F.lit("0800000000000000"))
    link = F.when(ethernet, F.lit("00" * 12)).otherwise(F.lit("00" * 14))
    shapes = F.array(
        F.struct(F.lit(0).alias("kind"), F.concat(link, F.lit("0800"), ip, l4).alias("hex")),
        F.struct(F.lit(1).alias("kind"), F.concat(link, F.lit("0806"), ip, l4).alias("hex")),
        F.struct(F.lit(2).alias("kind"), F.concat(link, F.lit("0800"), F.substring(ip, 1, 30)).alias("hex")),
    )
    shaped = packets(spark, folder).select(
        "capture_id", "pkt_no", "ts_us", F.when(ethernet, 1).otherwise(113).alias("linktype"),
        F.explode(shapes).alias("shape"),
    ).filter((c("shape.kind") == 0) | (c("pkt_no") % 7 == c("shape.kind")))
    data = F.unhex("shape.hex")
    return shaped.select(
        "capture_id", "pkt_no", "ts_us", "linktype", F.length(data).alias("caplen"), data.alias("data")
    )
