"""Queries that evaluate scores against labels."""

from pyspark.sql import functions as F

from flowspark.operators import evaluation as E
from flowspark.plans.inputs import flows
from flowspark.plans.oracle import SCORES, over_flows
from flowspark.plans.registry import query
from flowspark.sources import views

CELLS = """count(*) filter (label = 0 and prob < {t}) tn, count(*) filter (label = 0 and prob >= {t}) fp,
  count(*) filter (label = 1 and prob < {t}) fn, count(*) filter (label = 1 and prob >= {t}) tp"""
RAW = "id bigint, prob double, label int"


def cells_sql(t: float) -> str:
    return f"select {CELLS.format(t=t)} from ({SCORES}) s"


def div(a: str, b: str) -> str:
    return f"case when ({b}) <> 0 then ({a}) / cast(({b}) as double) else 0.0 end"


def _pr(p: str, r: str) -> str:
    return div(f"2 * ({p}) * ({r})", f"({p}) + ({r})")


@query("id bigint, predicted int", f"select id, case when prob >= 0.5 then 1 else 0 end predicted from ({SCORES}) s")
def label_at_threshold(spark, folder):
    return views.scores(spark, folder).select("id", E.predicted("prob", 0.5).alias("predicted"))


@query("actual int, predicted int, n bigint", f"""
select a.a actual, p.p predicted, count(s.id) n from (values (0), (1)) a(a) cross join (values (0), (1)) p(p)
left join ({SCORES}) s on s.label = a.a and (case when s.prob >= 0.5 then 1 else 0 end) = p.p group by 1, 2""")
def confusion_matrix(spark, folder):
    return E.confusion_matrix(views.scores(spark, folder))


_P0, _R0 = div("tn", "tn + fn"), div("tn", "tn + fp")
_P1, _R1 = div("tp", "tp + fp"), div("tp", "tp + fn")
_ACC = div("tp + tn", "tp + tn + fp + fn")
_MEAN = lambda a, b: f"(({a}) + ({b})) / 2"
_WEIGHTED = lambda a, b: div(f"({a}) * (tn + fp) + ({b}) * (tp + fn)", "tp + tn + fp + fn")


@query("class string, precision double6, recall double6, f1 double6, support bigint", f"""
with c as ({cells_sql(0.5)})
select 'Normal' as "class", {_P0} as "precision", {_R0} recall, {_pr(_P0, _R0)} f1, tn + fp support from c
union all select 'Attack', {_P1}, {_R1}, {_pr(_P1, _R1)}, tp + fn from c
union all select 'accuracy', {_ACC}, {_ACC}, {_ACC}, tp + tn + fp + fn from c
union all select 'macro avg', {_MEAN(_P0, _P1)}, {_MEAN(_R0, _R1)}, {_MEAN(_pr(_P0, _R0), _pr(_P1, _R1))},
  tp + tn + fp + fn from c
union all select 'weighted avg', {_WEIGHTED(_P0, _P1)}, {_WEIGHTED(_R0, _R1)},
  {_WEIGHTED(_pr(_P0, _R0), _pr(_P1, _R1))}, tp + tn + fp + fn from c""")
def classification_report(spark, folder):
    return E.classification_report(views.scores(spark, folder))


@query("threshold double, accuracy double6, f1 double6, recall double6", f"""
select cast(0.5 as double) threshold, {_ACC} accuracy, {div("2 * tp", "2 * tp + fp + fn")} f1, {_R1} recall
from ({cells_sql(0.5)}) c""")
def scalar_metrics(spark, folder):
    return E.scalar_metrics(views.scores(spark, folder))


GROUPS = f"""groups as (
  select prob threshold, count(*) filter (label = 1) pos, count(*) filter (label = 0) neg from ({SCORES}) s group by 1),
curve as (
  select *, sum(pos) over (order by threshold desc) tps, sum(neg) over (order by threshold desc) fps,
    sum(pos) over () all_pos, sum(neg) over () all_neg, row_number() over (order by threshold desc) rn,
    lead(pos) over (order by threshold desc) npos, lead(neg) over (order by threshold desc) nneg
  from groups)"""


@query("threshold double, fpr double6, tpr double6", f"""
with {GROUPS} select threshold, {div("fps", "all_neg")} fpr, {div("tps", "all_pos")} tpr from curve
union all select null, 0.0, 0.0""")
def roc_points_all(spark, folder):
    return E.roc_curve(views.scores(spark, folder), drop_intermediate=False)


@query("threshold double, fpr double6, tpr double6", f"""
with {GROUPS} select threshold, {div("fps", "all_neg")} fpr, {div("tps", "all_pos")} tpr from curve
where npos is null or npos <> pos or nneg <> neg
union all select null, 0.0, 0.0""")
def roc_points(spark, folder):
    return E.roc_curve(views.scores(spark, folder))


@query("threshold double, precision double6, recall double6", f"""
with {GROUPS} select threshold, {div("tps", "tps + fps")} as "precision", {div("tps", "all_pos")} recall from curve
union all select null, 1.0, 0.0""")
def precision_recall_points(spark, folder):
    return E.pr_curve(views.scores(spark, folder))


@query("roc_auc double6, average_precision double6", f"""
with {GROUPS}
select sum(neg * (tps - pos + pos / 2.0)) / max(all_pos * all_neg) roc_auc,
  sum(pos * ({div("tps", "tps + fps")})) / max(all_pos) average_precision from curve""")
def ranking_metrics(spark, folder):
    return E.ranking_metrics(views.scores(spark, folder))


def sweep_sql(first: int, last: int) -> str:
    return f"""
select t / cast(100 as double) threshold, {div("2 * tp", "2 * tp + fp + fn")} f1, {_R1} recall, {_P1} as "precision",
  {_ACC} accuracy
from (select t, {CELLS.format(t="(t / cast(100 as double))")}
      from ({SCORES}) s, (select unnest(range({first}, {last + 1})) t) g group by t) c"""


SWEEP = "threshold double, f1 double6, recall double6, precision double6, accuracy double6"


@query(SWEEP, sweep_sql(1, 99))
def f1_threshold_sweep(spark, folder):
    return E.threshold_sweep(views.scores(spark, folder))


@query("threshold double, f1 double6", f"""
select threshold, f1 from ({sweep_sql(1, 99)}) w order by round(f1, 12) desc, threshold limit 1""")
def best_f1_threshold(spark, folder):
    return E.best_threshold(views.scores(spark, folder))


@query("threshold double, accuracy double6", f"""
select threshold, accuracy from ({sweep_sql(10, 90)}) w order by round(accuracy, 12) desc, threshold limit 1""")
def best_accuracy_threshold(spark, folder):
    return E.best_threshold(views.scores(spark, folder), "accuracy", 10, 90)


@query("setting string, threshold double, tn bigint, fp bigint, fn bigint, tp bigint", f"""
select 'default' setting, cast(0.5 as double) threshold, {CELLS.format(t=0.5)} from ({SCORES}) s
union all select 'tuned', 0.3, {CELLS.format(t=0.3)} from ({SCORES}) s""")
def threshold_comparison(spark, folder):
    return E.compare_thresholds(views.scores(spark, folder), {"default": 0.5, "tuned": 0.3})


_B = f"""select attack_cat, count(*) "count", count(*) filter (label = 1 and prob >= 0.5) tp,
  count(*) filter (label = 0 and prob >= 0.5) fp, count(*) filter (label = 1 and prob < 0.5) fn
from ({SCORES}) s where attack_cat <> 'Normal' group by 1"""


@query("attack_cat string, count bigint, precision double, recall double, f1 double", f"""
select attack_cat, "count", round({_P1}, 4) as "precision", round({_R1}, 4) recall, round({_pr(_P1, _R1)}, 4) f1
from ({_B}) b""")
def attack_breakdown(spark, folder):
    scores = views.scores(spark, folder)
    joined = E.attach_predictions(scores.select("id", "prob", "label"), scores.select("id", "attack_cat"))
    return E.attack_breakdown(joined)


@query("id bigint, prob double, attack_cat string, user_id bigint", f"""
select s.id, prob, attack_cat, user_id from ({SCORES}) s join events e on s.id = e.event_id""")
def predictions_with_raw_rows(spark, folder):
    raw = views.read_table(spark, folder, "events").select(F.col("event_id").alias("id"), "user_id")
    return E.attach_predictions(views.scores(spark, folder), raw)


@query("rows bigint, distinct_ids bigint", "select least(2000, count(*)) as \"rows\", least(2000, count(*)) distinct_ids from events")
def seeded_sample(spark, folder):
    sample = E.seeded_sample(views.scores(spark, folder), 2000)
    return sample.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("distinct_ids"))


@query("rows bigint, max_diff double6, label_match double6", f"""
select count(*) as "rows", max(abs(prob - cast(cast(prob as float) as double))) max_diff,
  avg(case when (prob >= 0.5) = (cast(cast(prob as float) as double) >= 0.5) then 1 else 0 end) label_match
from ({SCORES}) s""")
def score_parity(spark, folder):
    scores = views.scores(spark, folder)
    narrowed = scores.withColumn("prob", F.col("prob").cast("float"))
    return E.score_parity(scores, narrowed)


SUBNETS = {"attacker": "175.45.176.", "normal": "59.166."}


@query("subnet string, flagged bigint, total bigint", over_flows(" union all ".join(
    f"""select '{n}' subnet, count(*) filter (ct_src_ltm > 20) flagged, count(*) total from flows
    where starts_with(srcip, '{p}') or starts_with(dstip, '{p}')""" for n, p in SUBNETS.items())))
def subnet_check(spark, folder):
    busy = flows(spark, folder).withColumn("label", (F.col("ct_src_ltm") > 20).cast("int"))
    return E.subnet_check(busy, SUBNETS)


@query("column string, value string", over_flows("""
select distinct 'service' "column", service "value" from flows where capture_id = 'cap0' and service not in
  (select service from flows where capture_id = 'cap1' and service < 'h')
union all select distinct 'state', state from flows where capture_id = 'cap0' and state not in
  (select state from flows where capture_id = 'cap1' and service < 'h')"""))
def unseen_categories(spark, folder):
    df = flows(spark, folder)
    trained = df.filter((F.col("capture_id") == "cap1") & (F.col("service") < "h"))
    return E.unseen_categories(df.filter(F.col("capture_id") == "cap0"), trained, ["service", "state"])


@query("column string, served double, trained double, ratio double6", over_flows(" union all ".join(
    f"""select '{c}' "column", s served, t trained, case when t <> 0 then s / t end ratio from (
    select median({c}) filter (capture_id = 'cap0') s, median({c}) filter (capture_id = 'cap1') t
    from (select * from flows where proto = 'tcp' and state = 'FIN') x) m""" for c in ("sbytes", "dbytes", "dur"))))
def median_ratios(spark, folder):
    like = flows(spark, folder).filter((F.col("proto") == "tcp") & (F.col("state") == "FIN"))
    part = lambda c: like.filter(F.col("capture_id") == c)
    return E.median_ratios(part("cap0"), part("cap1"), ["sbytes", "dbytes", "dur"])
