"""Operational queries over scored flows, alerts and traffic."""

from pyspark.sql import functions as F

from flowspark.operators import alerts as A
from flowspark.operators import operations as O
from flowspark.plans.alert_queries import AUDIT_COLUMNS, AUDIT_SQL, over_flagged
from flowspark.plans.inputs import flagged_detections, flows, scored_detections
from flowspark.plans.oracle import over_flows
from flowspark.plans.registry import query
from flowspark.sources import views

BOUNDS = ", ".join(f"({b!r})" for b in O.LATENCY_BOUNDS)
BUCKETS = f"""buckets as (
  select le, count(*) filter (latency_us / 1e6 <= le) n from flagged, (values {BOUNDS}) b(le) group by 1
  union all select null, count(*) from flagged)"""


@query("ingested bigint, scored bigint, fired bigint, suppressed bigint", over_flagged("""
select count(*) ingested, count(label) scored, count(*) filter (label = 1 and alert) fired,
  count(*) filter (label = 1 and not alert) suppressed from flagged"""))
def running_totals(spark, folder):
    return O.running_totals(flagged_detections(spark, folder))


def _rate_sql(*measures: str) -> str:
    sums = ", ".join(f"count(*) filter ({cond}) / 60.0 {name}" for name, cond in (m.split(":") for m in measures))
    return f"""
select (ts_us // 5000000 - shift) * 5000000 window_start_us, {sums}
from flagged, (select unnest(range(12)) shift) r group by 1"""


@query("window_start_us bigint, encoded double6, scored double6", over_flagged(
    _rate_sql("encoded:true", "scored:label is not null")))
def per_second_rates(spark, folder):
    return O.sliding_rates(flagged_detections(spark, folder),
                           {"encoded": F.lit(True), "scored": F.col("label").isNotNull()})


@query("window_start_us bigint, fired double6, suppressed double6", over_flagged(
    _rate_sql("fired:label = 1 and alert", "suppressed:label = 1 and not alert")))
def alert_rates(spark, folder):
    attack = F.col("label") == 1
    return O.sliding_rates(flagged_detections(spark, folder),
                           {"fired": attack & F.col("alert"), "suppressed": attack & ~F.col("alert")})


@query("le double, n bigint", over_flagged("select le, n from buckets", extra=BUCKETS))
def latency_histogram(spark, folder):
    return O.latency_buckets(flagged_detections(spark, folder))


_QUANTILE = """
select q, case when total = 0 then null when le is null then prev
          else prev + (le - prev) * case when n > below then (q * total - below) / (n - below) else 0 end end as "value"
from (
  select q, le, n, coalesce(lag(n) over w, 0) below, coalesce(lag(le) over w, 0) prev,
    max(n) over (partition by q) total
  from buckets, (values (0.5), (0.99)) v(q) window w as (partition by q order by le nulls last)) x
where n >= q * total qualify row_number() over (partition by q order by le nulls last) = 1"""


@query("q double, value double6", over_flagged(_QUANTILE, extra=BUCKETS))
def latency_quantiles(spark, folder):
    buckets = O.latency_buckets(flagged_detections(spark, folder))
    return O.histogram_quantile(buckets, 0.5).unionByName(O.histogram_quantile(buckets, 0.99))


@query("group_id string, lag bigint", """
with latest as (select event_type topic, user_id % 8 part, max(event_id) last from events group by all),
done as (select 'g' || cast(user_id % 3 as varchar) group_id, event_type topic, user_id % 8 part, max(event_id) last
         from events where value < 60 group by all)
select group_id, sum(greatest(latest.last - done.last, 0)) lag from done join latest using (topic, part) group by 1""")
def consumer_lag(spark, folder):
    events = views.read_table(spark, folder, "events").select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 8).alias("partition"), "event_id", "value",
        F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("group_id"),
    )
    latest = events.groupBy("topic", "partition").agg(F.max("event_id").alias("latest_offset"))
    committed = events.filter("value < 60").groupBy("group_id", "topic", "partition").agg(
        F.max("event_id").alias("offset")
    )
    return O.consumer_lag(latest, committed)


@query("n bigint, active_s double6, per_s double6", over_flagged("""
select count(*) n, (max(ts_us) - min(ts_us)) / 1e6 active_s, count(*) / ((max(ts_us) - min(ts_us)) / 1e6) per_s
from flagged"""))
def sustained_throughput(spark, folder):
    return O.sustained_throughput(scored_detections(spark, folder))


@query("p50 bigint, p99 bigint, max bigint", over_flagged("""
select list_sort(list(latency_us))[cast(floor(0.5 * (count(*) - 1)) as bigint) + 1] p50,
  list_sort(list(latency_us))[cast(floor(0.99 * (count(*) - 1)) as bigint) + 1] p99, max(latency_us) as "max"
from flagged"""))
def exact_percentiles(spark, folder):
    return O.exact_percentiles(scored_detections(spark, folder), "latency_us", {"p50": 0.5, "p99": 0.99})


HOUR_US = 3_600_000_000
SHARES = {"p50": 0.5, "p99": 0.99, "max": 1.0}


@query("hour bigint, n bigint, max bigint, p50_near boolean, p99_near boolean", over_flagged(f"""
select ts_us // {HOUR_US} "hour", count(*) n, max(latency_us) as "max", true p50_near, true p99_near from flagged group by 1
union all select null, count(*), max(latency_us), true, true from flagged"""))
def sketched_percentiles(spark, folder):
    """Sketches per hour and, merged from them, of all hours; each estimate held against its exact place among all rows."""
    rows = scored_detections(spark, folder).select(F.expr(f"ts_us div {HOUR_US}").alias("hour"), "latency_us")
    hours = O.latency_sketches(rows, ["hour"], "latency_us")
    answers = []
    for groups, sketches in ((["hour"], hours), ([], O.merge_sketches(hours, []))):
        found = O.sketched_percentiles(sketches, SHARES)
        off = O.rank_distances(rows, groups, "latency_us", found, SHARES)
        near = [(F.col(f"{s}_off") <= O.rank_error(O.SKETCH_SIZE) * F.col("n") + 1).alias(f"{s}_near") for s in ("p50", "p99")]
        hour = F.col("hour") if groups else F.lit(None).cast("bigint").alias("hour")
        answers.append(off.select(hour, "n", "max", *near))
    return answers[0].unionByName(answers[1])


@query("rows bigint, used bigint", over_flows("select count(*) as \"rows\", least(8, count(distinct srcip)) used from flows"))
def partition_spread(spark, folder):
    """Summarised: every row lands on one of the partitions, and enough keys reach all of them."""
    spread = O.partition_spread(flows(spark, folder), "sport", 8)
    return spread.agg(F.sum("n").alias("rows"), F.count("*").alias("used"))


@query("proto string, state string, service string, flows bigint, packets bigint, bytes bigint, no_reply bigint",
       over_flows("""
select proto, state, service, count(*) flows, sum(spkts + dpkts) packets, sum(sbytes + dbytes) bytes,
  count(*) filter (dpkts = 0) no_reply from flows group by 1, 2, 3"""))
def traffic_breakdown(spark, folder):
    return O.traffic_breakdown(flows(spark, folder))


@query("srcip string, peak int, flows bigint", over_flows("""
select srcip, max(ct_src_ltm) peak, count(*) flows from flows group by 1 order by 2 desc, 1 limit 10"""))
def top_talkers(spark, folder):
    return O.top_talkers(flows(spark, folder))


@query("prefix string, touched bigint", over_flows("""
select 'no_reply' prefix, count(*) touched from flows where dpkts = 0"""))
def unanswered_flows(spark, folder):
    silent = flows(spark, folder).filter(F.col("dpkts") == 0)
    return silent.agg(F.count("*").alias("touched")).select(F.lit("no_reply").alias("prefix"), "touched")


@query(AUDIT_COLUMNS, over_flagged(AUDIT_SQL + " where label = 1"))
def attack_log(spark, folder):
    return O.attack_log(A.audit_lines(flagged_detections(spark, folder)))


@query("unique_keys bigint, fired bigint", over_flagged("""
select count(distinct (srcip, dstip, proto)) filter (label = 1) unique_keys, count(*) filter (alert) fired from flagged"""))
def alert_reconciliation(spark, folder):
    return O.reconcile_alerts(flagged_detections(spark, folder))
