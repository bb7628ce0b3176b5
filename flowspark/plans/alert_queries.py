"""Queries over feature vectors, scores and alerts."""

from pyspark.sql import functions as F

from flowspark.contracts import MODEL_COLUMNS, NUMERIC_FEATURES, TOP_VALUES, one_hot_categories
from flowspark.functions.encode import encode_columns, encode_flows, feature_vector, quoted, to_contract
from flowspark.operators import alerts as A
from flowspark.operators.cooldown import with_cooldown
from flowspark.plans.inputs import EVENT_TTL_US, flagged_detections, flows, scored_detections
from flowspark.plans.oracle import DETECTIONS, over_flows
from flowspark.plans.registry import query
from flowspark.sources import views
from flowspark.sources.messages import decode_json

SCORED = f"""
select *, cast(value / (value + 50.0) as float) attack_prob, case when value >= 60.0 then 1 else 0 end label,
  event_id % 6000 latency_us, cast(event_id % 1000 as integer) sport, 443 dsport
from ({DETECTIONS}) d0"""


def flagged_ctes(ttl_us: int = EVENT_TTL_US, scored: str = SCORED) -> str:
    """CTE ``flagged``: scored rows with ``alert``, stepping through each key's attacks in time order."""
    return f"""
attacks as materialized (
  select *, row_number() over (partition by srcip, dstip, proto order by ts_us, event_id) rn
  from ({scored}) s where label = 1),
fired as (
  select event_id, srcip, dstip, proto, rn, ts_us last_us, true alert from attacks where rn = 1
  union all
  select a.event_id, a.srcip, a.dstip, a.proto, a.rn,
    case when a.ts_us >= f.last_us + {ttl_us} then a.ts_us else f.last_us end,
    a.ts_us >= f.last_us + {ttl_us}
  from fired f join attacks a
    on a.srcip = f.srcip and a.dstip = f.dstip and a.proto = f.proto and a.rn = f.rn + 1),
flagged as materialized (
  select s.*, coalesce(f.alert, false) alert from ({SCORED}) s left join fired f on s.event_id = f.event_id)"""


def over_flagged(select: str, ttl_us: int = EVENT_TTL_US, extra: str = "", scored: str = SCORED) -> str:
    return f"with recursive {flagged_ctes(ttl_us, scored)}{', ' + extra if extra else ''} {select}"


def _bucket_sql(prefix: str) -> str:
    values = ", ".join(f"'{v}'" for v in TOP_VALUES[prefix])
    return f"case when {prefix} in ({values}) then {prefix} else 'other' end"


_ONE_HOT_SQL = [
    f"case when {_bucket_sql(p)} = '{c}' then 1 else 0 end \"{p}_{c}\""
    for p in TOP_VALUES for c in one_hot_categories(p)
]
_IDENTITY = "capture_id string, emit_no bigint"


@query("proto_bucket string, service_bucket string, state_bucket string, n bigint", over_flows(f"""
select {_bucket_sql("proto")} proto_bucket, {_bucket_sql("service")} service_bucket,
  {_bucket_sql("state")} state_bucket, count(*) n from flows group by all"""))
def category_buckets(spark, folder):
    from flowspark.operators.prep import add_buckets

    bucketed = add_buckets(flows(spark, folder))
    return bucketed.groupBy("proto_bucket", "service_bucket", "state_bucket").agg(F.count("*").alias("n"))


@query(_IDENTITY + ", " + ", ".join(f"{p}_{c} int" for p in TOP_VALUES for c in one_hot_categories(p)),
       over_flows(f"select capture_id, emit_no, {', '.join(_ONE_HOT_SQL)} from flows"))
def one_hot_columns(spark, folder):
    df = flows(spark, folder)
    return df.select("capture_id", "emit_no", *encode_columns(df)[:21])


@query(_IDENTITY + ", place int, value double", over_flows(f"""
select capture_id, emit_no, cast(place as integer) - 1 place, value from (
  select capture_id, emit_no, unnest(v) as value, generate_subscripts(v, 1) place from (
    select capture_id, emit_no, [{", ".join(["cast(" + h.rsplit(' "', 1)[0] + " as double)" for h in _ONE_HOT_SQL]
      + [f"cast({c} as double)" for c in NUMERIC_FEATURES])}] v from flows) x) y"""))
def feature_vectors(spark, folder):
    vectors = encode_flows(flows(spark, folder), "capture_id", "emit_no")
    return vectors.select("capture_id", "emit_no", F.posexplode("features").alias("place", "value"))


@query("srcip string, sport int, dstip string, dsport int, proto string, n bigint", over_flows("""
select srcip, sport, dstip, dsport, proto, count(*) n from flows group by all"""))
def vector_metadata(spark, folder):
    vectors = encode_flows(flows(spark, folder))
    return vectors.groupBy("srcip", "sport", "dstip", "dsport", "proto").agg(F.count("*").alias("n"))


@query("column string, total double6, present bigint", over_flows(
    " union all ".join(
        f"""select '{c}' "column", cast(sum(cast({c} as float)) as double) total, count(*) present from flows"""
        if c in ("ct_src_ltm", "spkts", "sttl") else
        f"""select '{c}' "column", cast(0 as double) total, count(*) present from flows"""
        for c in ("ct_src_ltm", "spkts", "sttl", "proto_arp", "trans_depth"))))
def contract_reindex(spark, folder):
    """Frames that lack columns still come out in contract order, absent columns as 0."""
    partial = flows(spark, folder).select("ct_src_ltm", "spkts", "sttl")
    ordered = to_contract(partial)
    assert ordered.columns == MODEL_COLUMNS
    names = ["ct_src_ltm", "spkts", "sttl", "proto_arp", "trans_depth"]
    row = ordered.agg(F.count("*").alias("_n"), *[F.sum(quoted(c)).alias(c) for c in names])
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("total"),
                        F.col("_n").alias("present")) for c in names]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


@query("fits boolean, n bigint", over_flows("select emit_no % 50 <> 0 fits, count(*) n from flows group by 1"))
def vector_width_check(spark, folder):
    """Every 50th vector is cut short; the width check has to find exactly those."""
    df = flows(spark, folder)
    vector = feature_vector(df)
    cut = F.when(F.col("emit_no") % 50 == 0, F.slice(vector, 1, 57)).otherwise(vector)
    good, bad = A.split_by_width(df.select("emit_no", cut.alias("features")))
    tag = lambda part, fits: part.agg(F.count("*").alias("n")).select(F.lit(fits).alias("fits"), "n")
    return tag(good, True).unionByName(tag(bad, False))


@query("event_id bigint, attack_prob float, label int", f"""
select event_id, attack_prob, case when cast(attack_prob as double) >= 0.69 then 1 else 0 end label
from ({SCORED}) s""")
def threshold_labels(spark, folder):
    scored = scored_detections(spark, folder)
    return scored.select("event_id", "attack_prob", A.threshold_label().alias("label"))


@query("event_id bigint, label int, alert boolean", over_flagged("select event_id, label, alert from flagged"))
def alert_dedup(spark, folder):
    return flagged_detections(spark, folder)


@query("event_id bigint, label int, alert boolean", over_flagged(
    "select event_id, label, alert from flagged", 60_000_000))
def alert_dedup_60s(spark, folder):
    return A.flag_alerts(scored_detections(spark, folder), order=["event_id"])


@query("event_id bigint, label int, alert boolean", over_flagged(
    "select event_id, label, alert from flagged", 60_000_000,
    scored=f"select * replace (ts_us // 2000 as ts_us) from ({SCORED}) s0"))
def alert_dedup_bursts(spark, folder):
    """Time runs 2,000 times faster, so that many repeats fall within 60 seconds of an alert."""
    scored = scored_detections(spark, folder)
    return A.flag_alerts(scored.withColumn("ts_us", F.expr("ts_us div 2000")), order=["event_id"])


_BY_TYPE = f"""with recursive
a as materialized (
  select *, row_number() over (partition by dstip order by ts_us, event_id) rn from ({SCORED}) s where label = 1),
f as (
  select event_id, dstip, rn, ts_us last_us, true fires from a where rn = 1
  union all
  select a.event_id, a.dstip, a.rn, case when a.ts_us >= f.last_us + 600000000 then a.ts_us else f.last_us end,
    a.ts_us >= f.last_us + 600000000
  from f join a on a.dstip = f.dstip and a.rn = f.rn + 1)
select event_id, dstip, fires from f"""


@query("event_id bigint, dstip string, fires boolean", _BY_TYPE)
def cooldown_of_hot_keys(spark, folder):
    """Ten minutes of silence per event type: a handful of keys hold everything and are each split."""
    attacks = scored_detections(spark, folder).filter(F.col("label") == 1)
    return with_cooldown(attacks, ["dstip"], "ts_us", ["event_id"], 600_000_000, "fires",
                         hot_rows=max(attacks.count() // 16, 1))


@query("scored bigint, attacks bigint, fired bigint, suppressed bigint", over_flagged("""
select count(*) scored, count(*) filter (label = 1) attacks, count(*) filter (label = 1 and alert) fired,
  count(*) filter (label = 1 and not alert) suppressed from flagged"""))
def alert_totals(spark, folder):
    return A.alert_totals(flagged_detections(spark, folder))


ALERT_COLUMNS = ("srcip string, sport int, dstip string, dsport int, proto string, attack_prob float, "
                 "latency_us bigint")
_ALERTS = "select srcip, sport, dstip, dsport, proto, attack_prob, latency_us from flagged where alert"


@query(ALERT_COLUMNS, over_flagged(_ALERTS))
def alert_projection(spark, folder):
    return A.alert_stream(flagged_detections(spark, folder))


@query(ALERT_COLUMNS, over_flagged(_ALERTS + " and attack_prob >= cast(0.6 as float)"))
def subscriber_filter(spark, folder):
    return A.filter_subscriber(A.alert_stream(flagged_detections(spark, folder)), 0.6)


_DELIVERED = over_flagged("""
select r_regionkey client_id, count(*) alerts, min(attack_prob) lowest
from flagged join region on attack_prob >= cast(r_regionkey / 5.0 as float)
where alert group by 1""")


@query("client_id bigint, alerts bigint, lowest float", _DELIVERED)
def subscriber_fan_out(spark, folder):
    alerts = A.alert_stream(flagged_detections(spark, folder))
    delivered = A.deliver(alerts, views.subscribers(spark, folder))
    return delivered.groupBy("client_id").agg(F.count("*").alias("alerts"), F.min("attack_prob").alias("lowest"))


@query("client_id bigint, alerts bigint, lowest float", _DELIVERED)
def subscriber_fan_out_equi(spark, folder):
    """Delivery for too many subscribers to broadcast."""
    alerts = A.alert_stream(flagged_detections(spark, folder))
    delivered = A._deliver_by_chunk(alerts, views.subscribers(spark, folder))
    return delivered.groupBy("client_id").agg(F.count("*").alias("alerts"), F.min("attack_prob").alias("lowest"))


@query("client_id bigint, alerts bigint, lowest float", over_flagged("""
select c_custkey client_id, count(*) alerts, min(attack_prob) lowest
from flagged join customer on attack_prob >= cast(c_custkey % 1000 / 1000.0 as float)
where alert group by 1"""))
def customer_fan_out(spark, folder):
    """Every customer subscribes with a floor of its own; chunks of 500 subscribers."""
    alerts = A.alert_stream(flagged_detections(spark, folder))
    people = views.read_table(spark, folder, "customer").select(
        F.col("c_custkey").cast("bigint").alias("client_id"),
        (F.col("c_custkey") % 1000 / F.lit(1000.0)).cast("float").alias("min_prob"))
    delivered = A._deliver_by_chunk(alerts, A.with_floor(people), chunk_rows=500)
    return delivered.groupBy("client_id").agg(F.count("*").alias("alerts"), F.min("attack_prob").alias("lowest"))


@query("srcip string, sport int, dstip string, dsport int, proto string, attack_prob float, label int, "
       "alert boolean, latency_us bigint", over_flagged("""
select srcip, sport, dstip, dsport, proto, attack_prob, label, alert, latency_us from flagged"""))
def scored_rows(spark, folder):
    return A.scored_columns(flagged_detections(spark, folder))


AUDIT_COLUMNS = "flow_id string, ts_ms bigint, prediction int, confidence float, alert boolean, latency_us bigint"
AUDIT_SQL = """
select srcip || ':' || cast(sport as varchar) || '->' || dstip || ':' || cast(dsport as varchar) || '/' || proto
    flow_id, ts_us // 1000 ts_ms, label prediction, attack_prob confidence, alert, latency_us
from flagged"""


@query(AUDIT_COLUMNS, over_flagged(AUDIT_SQL))
def audit_log(spark, folder):
    return A.audit_lines(flagged_detections(spark, folder))


@query("kind string, n bigint, total bigint", """
select case when event_id % 97 = 0 then 'reject' when event_id % 89 = 0 then 'reject'
            when event_id % 83 = 0 then 'default' else 'value' end kind, count(*) n,
  coalesce(sum(case when event_id % 97 = 0 or event_id % 89 = 0 or event_id % 83 = 0 then 0
                    else cast(json_extract_string(props, '$.k') as bigint) end), 0) total
from events group by 1""")
def json_decode(spark, folder):
    """Broken and wrong-typed messages are set aside; an absent field takes its default."""
    events = views.read_table(spark, folder, "events")
    message = (
        F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("{"), "props"))
        .when(F.col("event_id") % 89 == 0, F.lit('{"k": "many"}'))
        .when(F.col("event_id") % 83 == 0, F.lit("{}")).otherwise(F.col("props"))
    )
    good, rejects = decode_json(events.select(message.alias("value"), "event_id"), "k bigint", {"k": 0}, "event_id")
    kind = F.when(F.col("event_id") % 83 == 0, "default").otherwise("value")
    counted = good.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))
    return counted.unionByName(
        rejects.groupBy(F.lit("reject").alias("kind")).agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("total"))
    )
