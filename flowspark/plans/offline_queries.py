"""Queries of the offline study: preprocessing and exploration of a labelled table."""

from pyspark.sql import functions as F

from flowspark.operators import eda, prep
from flowspark.plans.oracle import LABELLED
from flowspark.plans.registry import query
from flowspark.sources import views

NUMERIC = ["dur", "rate", "sload", "smean", "spkts"]
SKEWED = ["sload", "rate"]
PLAIN = ["dur", "smean", "spkts"]
TOP = {"proto": ["A", "N"], "service": ["O"], "state": ["1-URGENT", "2-HIGH", "5-LOW"]}
PREFIXES = list(TOP)


def coarse(spark, folder):
    """A few low-cardinality columns, so that exact repeats exist; the id is a distinct row key."""
    return views.labelled(spark, folder).select(
        "id", "proto", "service", "state", "dur", "smean", "spkts", "label"
    )


COARSE = f"select id, proto, service, state, dur, smean, spkts, label from ({LABELLED}) l0"
KEPT = """select min(id) id, proto, service, state, dur, smean, spkts, label
  from ({0}) c group by proto, service, state, dur, smean, spkts, label""".format(COARSE)


def _values(values):
    return ", ".join(f"'{v}'" for v in values)


def _bucket(prefix):
    return f"case when {prefix} in ({_values(TOP[prefix])}) then {prefix} else 'other' end"


ONE_HOT = [(p, c) for p in TOP for c in sorted([*TOP[p], "other"])]
ONE_HOT_NAMES = ", ".join(f"{p}_{c} int" for p, c in ONE_HOT)
ONE_HOT_SQL = ", ".join(f"case when {_bucket(p)} = '{c}' then 1 else 0 end \"{p}_{c}\"" for p, c in ONE_HOT)


@query("nulls bigint, rows bigint", f"select cast(0 as bigint) nulls, count(*) as \"rows\" from ({LABELLED}) l")
def null_gate(spark, folder):
    df = prep.require_no_nulls(views.labelled(spark, folder))
    return df.agg(F.count_if(prep.any_null(df)).alias("nulls"), F.count("*").alias("rows"))


@query("nulls bigint, rows bigint, refused boolean", f"""
select count(*) filter (id % 11 = 0 or id % 13 = 0) nulls, count(*) "rows", count(*) filter (id % 11 = 0 or id % 13 = 0) > 0 refused
from ({LABELLED}) l""")
def null_gate_refuses(spark, folder):
    """Missing numbers and missing names are both counted, and the gate does not let the table pass."""
    df = views.labelled(spark, folder)
    holes = df.withColumns({"dur": F.when(F.col("id") % 11 != 0, F.col("dur")),
                            "proto": F.when(F.col("id") % 13 != 0, F.col("proto"))})
    try:
        refused = prep.require_no_nulls(holes) is None
    except ValueError:
        refused = True
    return holes.agg(F.count_if(prep.any_null(holes)).alias("nulls"), F.count("*").alias("rows"),
                     F.lit(refused).alias("refused"))


@query("id bigint, proto string, service string, state string, dur double, smean double, spkts double, label int",
       KEPT)
def exact_dedup(spark, folder):
    return prep.drop_repeats(coarse(spark, folder))


@query("column string, present bigint, total double6", " union all ".join(
    f"""select '{c}' "column", count({c}) present, sum({c}) total from ({LABELLED}) l""" for c in NUMERIC))
def numeric_discovery(spark, folder):
    """The numeric columns found after dropping what the study leaves out, each with its count and sum."""
    df = prep.drop_irrelevant(views.labelled(spark, folder))
    names = prep.numeric_columns(df)
    row = df.agg(*[m for c in names for m in (F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"))])
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("present"), F.col(f"s_{c}").alias("total"))
               for c in names]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


@query("prefix string, category string", " union all ".join(
    f"select distinct '{p}' prefix, {_bucket(p)} category from ({LABELLED}) l" for p in TOP))
def one_hot_fit(spark, folder):
    df = prep.add_buckets(views.labelled(spark, folder), TOP)
    categories = prep.fit_categories(df, PREFIXES)
    pairs = [(p, c) for p, values in categories.items() for c in values]
    return spark.createDataFrame(pairs, "prefix string, category string")


def served(spark, folder):
    """The table as a later one: unknown protocols, other sizes."""
    df = views.labelled(spark, folder)
    return df.withColumns({
        "proto": F.when(F.col("service") == "O", F.col("proto")).otherwise("Z"), "sload": F.col("sload") * 2,
    })


SERVED = f"""select * replace (case when service = 'O' then proto else 'Z' end as proto, sload * 2 as sload)
from ({LABELLED}) l0"""


@query(f"id bigint, {ONE_HOT_NAMES}", f"select id, {ONE_HOT_SQL} from ({SERVED}) l")
def one_hot_apply(spark, folder):
    """Categories fitted on one table, applied to another."""
    fitted = prep.fit_categories(prep.add_buckets(views.labelled(spark, folder), TOP), PREFIXES)
    return prep.apply_one_hot(prep.add_buckets(served(spark, folder), TOP), fitted)


@query("id bigint, sload_log double6, rate_log double6",
       f"select id, ln(1 + sload) sload_log, ln(1 + rate) rate_log from ({LABELLED}) l")
def log_transform(spark, folder):
    return prep.add_logs(views.labelled(spark, folder), SKEWED)


_SCALED_COLUMNS = [f"{c}_log" for c in ["sload", "rate", "spkts"]] + ["dur", "smean"]
_LOGGED = f"select *, ln(1 + sload) sload_log, ln(1 + rate) rate_log, ln(1 + spkts) spkts_log from ({LABELLED}) l"


@query("column string, mean double6, deviation double6", " union all ".join(
    f"""select '{c}' "column", avg({c}) mean, stddev_pop({c}) deviation from ({_LOGGED}) g"""
    for c in _SCALED_COLUMNS))
def scaler_fit(spark, folder):
    df = prep.add_logs(views.labelled(spark, folder), ["sload", "rate", "spkts"])
    fitted = prep.fit_scaler(df, _SCALED_COLUMNS)
    rows = [(c, mean, deviation) for c, (mean, deviation) in fitted.items()]
    return spark.createDataFrame(rows, "column string, mean double, deviation double")


def _z(column, source):
    return f"({column} - m_{column}) / s_{column} {column}_scaled"


def _stats(columns, source):
    return "select " + ", ".join(
        f"avg({c}) m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) s_{c}" for c in columns) + f" from {source}"


_TRAIN = f"""with kept as (
  select min(id) id, proto, service, state, sload, rate, dur, smean, spkts, label from ({LABELLED}) l group by all),
logged as (select *, ln(1 + sload) sload_log, ln(1 + rate) rate_log, ln(1 + spkts) spkts_log from kept),
fitted as ({_stats(_SCALED_COLUMNS, "logged")}),
testing as (
  select min(id) id, proto, service, state, sload, rate, dur, smean, spkts, label from ({SERVED}) l group by all),
test_logged as (select *, ln(1 + sload) sload_log, ln(1 + rate) rate_log, ln(1 + spkts) spkts_log from testing)"""
_MODEL_NAMES = ONE_HOT_NAMES + ", " + ", ".join(f"{c}_scaled double6" for c in _SCALED_COLUMNS) + ", label int"
_MODEL_SQL = f"select {ONE_HOT_SQL}, " + ", ".join(_z(c, "") for c in _SCALED_COLUMNS) + ", label from {0}, fitted"


def _trained(spark, folder):
    return prep.preprocess_train(views.labelled(spark, folder), top=TOP)


@query(_MODEL_NAMES, _TRAIN + " " + _MODEL_SQL.format("logged"))
def preprocess_train_model(spark, folder):
    return _trained(spark, folder)[1]


@query(ONE_HOT_NAMES + ", dur double, rate double, sload double, smean double, spkts double, label int",
       _TRAIN + f" select {ONE_HOT_SQL}, dur, rate, sload, smean, spkts, label from logged")
def preprocess_train_tree(spark, folder):
    return _trained(spark, folder)[2]


@query("sload double, sload_log double6, sload_log_scaled double6, proto_bucket string", _TRAIN + f"""
select sload, sload_log, {_z("sload_log", "")}, {_bucket("proto")} proto_bucket from logged, fitted""")
def preprocess_train_full(spark, folder):
    return _trained(spark, folder)[0]


@query(_MODEL_NAMES, _TRAIN + " " + _MODEL_SQL.format("test_logged"))
def preprocess_test_model(spark, folder):
    artifacts = _trained(spark, folder)[3]
    return prep.preprocess_test(served(spark, folder), artifacts)[1]


@query("width int, label double, n bigint", f"""
select {len(ONE_HOT) + 5} width, cast(label as double) as "label", count(*) n from (
  select min(id), label from ({LABELLED}) l
  group by proto, service, state, sload, rate, dur, smean, spkts, label) k group by 2""")
def features_label_split(spark, folder):
    from pyspark.ml.functions import vector_to_array

    xy = prep.features_and_label(_trained(spark, folder)[2])
    return xy.groupBy(F.size(vector_to_array("features")).alias("width"), "label").agg(F.count("*").alias("n"))


@query("rows bigint, kept bigint, removed bigint", f"""
select sum(n) as "rows", count(*) kept, sum(n) - count(*) removed from (
  select count(*) n from ({COARSE}) c group by proto, service, state, dur, smean, spkts, label) k""")
def repeat_counts(spark, folder):
    return eda.repeat_counts(coarse(spark, folder))


@query("value string, n bigint", f"select cast(label as varchar) as \"value\", count(*) n from ({LABELLED}) l group by 1")
def class_balance(spark, folder):
    return eda.value_counts(views.labelled(spark, folder), "label")


def _corr_rows(columns=NUMERIC, source=LABELLED):
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return " union all ".join(f"select '{a}' a, '{b}' b, corr({a}, {b}) r from ({source}) l" for a, b in pairs)


#: Two columns that follow others, so that strong correlations occur; the first of them with either sign.
RELATED = sorted([*NUMERIC, "dload", "spare"])
RELATED_SQL = f"select *, sload * 2 + spkts dload, 1000 - rate spare from ({LABELLED}) l0"


def related(spark, folder):
    return views.labelled(spark, folder).withColumns(
        {"dload": F.col("sload") * 2 + F.col("spkts"), "spare": 1000 - F.col("rate")})


@query("a string, b string, r double6", _corr_rows())
def correlation_pairs(spark, folder):
    return eda.correlations(views.labelled(spark, folder), NUMERIC)


@query("a string, b string, strength double", f"""
select a, b, round(abs(r), 3) strength from ({_corr_rows(RELATED, RELATED_SQL)}) c where abs(r) > 0.3""")
def high_correlations(spark, folder):
    return eda.high_correlations(related(spark, folder), RELATED, above=0.3)


@query("a string, b string, r double6", f"""
with c as ({_corr_rows(RELATED, RELATED_SQL)}), f as (select distinct unnest([a, b]) f from c where abs(r) > 0.3)
select a, b, r from c where a in (select f from f) and b in (select f from f)
union all select b, a, r from c where a in (select f from f) and b in (select f from f)
union all select f, f, 1.0 from f""")
def correlation_submatrix(spark, folder):
    return eda.correlation_submatrix(related(spark, folder), RELATED, above=0.3)


@query("column string, kind string, distinct_values bigint", " union all ".join(
    f"""select '{c}' "column", '{k}' kind, count(distinct {c}) distinct_values from ({LABELLED}) l"""
    for c, k in [("proto", "categorical"), ("service", "categorical"), ("state", "categorical"), ("id", "numeric"),
                 *[(n, "numeric") for n in NUMERIC]]))
def column_kinds(spark, folder):
    return eda.column_kinds(views.labelled(spark, folder))


@query("column string, value string, n bigint, place int", """
select "column", "value", n, place from (
  select *, row_number() over (partition by "column" order by n desc, "value") place from (
    select 'size' "column", cast(p_size as varchar) "value", count(*) n from part group by 2
    union all select 'brand', p_brand, count(*) from part group by 2
    union all select 'type', p_type, count(*) from part group by 2) c) p where place <= 15""")
def top_categories(spark, folder):
    part = views.read_table(spark, folder, "part")
    renamed = part.select(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return eda.top_categories(renamed, ["size", "brand", "type"])


@query("column string, min double, max double, mean double6, std double6, range double6", " union all ".join(
    f"""select '{c}' "column", min({c}) "min", max({c}) "max", avg({c}) mean, stddev_samp({c}) std,
    max({c}) - min({c}) "range" from ({LABELLED}) l""" for c in NUMERIC))
def summary_table(spark, folder):
    return eda.summary_table(views.labelled(spark, folder), NUMERIC)


def _histogram_sql(column, scale):
    value = column if scale == "raw" else f"ln(1 + {column})"
    return f"""
select '{column}' "column", '{scale}' "scale", least(cast(floor((v - lo) * 60 / (hi - lo)) as bigint), 59) bin, count(*) n
from (select v, min(v) over () lo, max(v) over () hi from (select {value} v from ({LABELLED}) l) x) y group by 3"""


@query("column string, scale string, bin bigint, n bigint",
       " union all ".join(_histogram_sql(c, "raw") for c in ("spkts", "sload", "rate")))
def histograms_raw(spark, folder):
    binned = eda.histograms(views.labelled(spark, folder), ["spkts", "sload", "rate"])
    return binned.filter(F.col("scale") == "raw")


@query("column string, scale string, rows bigint, bins bigint", f"""
select 'spkts' "column", 'log1p' "scale", count(*) as "rows", count(distinct least(floor((v - lo) * 60 / (hi - lo)), 59)) bins
from (select v, min(v) over () lo, max(v) over () hi from (select ln(1 + spkts) v from ({LABELLED}) l) x) y""")
def histograms_log(spark, folder):
    """Summarised: the two engines' logarithms differ in the last digit, which may move a bin edge."""
    binned = eda.histograms(views.labelled(spark, folder), ["spkts"]).filter(F.col("scale") == "log1p")
    return binned.groupBy("column", "scale").agg(F.sum("n").alias("rows"), F.count("*").alias("bins"))
