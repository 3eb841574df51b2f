"""Queries on policies, models, labels and keys, each with SQL written apart from it where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexroute.functions import sessions
from lexroute.operators import labels, models, routing, studies
from lexroute.plans import oracles, variants
from lexroute.sources import caches


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid() -> list[variants.Variant]:
    return variants.feature_variants() + variants.cost_variants()


def variant_routes(spark, sf_dir):
    """How many questions of the conversations each variant of the router sends to each strategy."""
    asked = routing.features(_t(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("text").alias("query")))
    return variants.routes(asked, _grid()).groupBy("study", "variant", "strategy").agg(F.count("*").alias("n"))


def _records(spark, sf_dir):
    """Users as queries: their mean values of views and clicks as features, of purchases as the target."""
    x = _t(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.avg("value"))
    rows = x.select("user_id", "view", "click", "purchase", F.when(F.col("click").isNotNull() & F.col("purchase").isNotNull(), (F.col("purchase") - F.col("click") >= 0.01).cast("int")).alias("needed"))
    return rows.filter("view is not null and click is not null")


def ridge_linear_fit(spark, sf_dir):
    """Purchases by views and clicks, slopes penalised."""
    m = models.ridge_linear(_records(spark, sf_dir), ["view", "click"], "purchase")
    return spark.createDataFrame([(n, round(v, 5)) for n, v in zip(["intercept", *m.features], [m.intercept, *m.slopes])], "term string, slope double")


def ridge_logistic_fit(spark, sf_dir):
    """Whether the dear arm is needed, by views and clicks, both classes weighing the same."""
    m = models.ridge_logistic(sessions.cut(models.imputed(_records(spark, sf_dir), ["view", "click"])), ["view", "click"], "needed")
    return spark.createDataFrame([(n, round(v, 6), m.converged) for n, v in zip(["intercept", *m.features], [m.intercept, *m.slopes])], "term string, slope double, converged boolean")


def feature_screen(spark, sf_dir):
    """Views and clicks, one at a time, against whether the dear arm is needed."""
    return models.screen(_records(spark, sf_dir), ["view", "click"], "needed")


def auc_power(spark, sf_dir):
    """What AUC could be seen with as many documents of either quality as there are."""
    n = _t(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1).alias("ones"), F.count_if(F.col("quality") == 0).alias("zeros")).first()
    return spark.createDataFrame(models.power_grid(n["ones"], n["zeros"]), "true_auc double, error double, power double, enough boolean")


def _sections(spark, sf_dir):
    """Regions as documents, [region, nation] as their section paths."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").alias("document_id"), F.array("r_name", "n_name").alias("section_path"))


def _given_labels(spark, sf_dir):
    """One label a customer: the path of the nation, for each third with prose of the segment run on, or the nation of a shifted region."""
    c, n, r = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    x = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    tail = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("whichwasextendedby"))).otherwise("")
    doc = F.when(F.col("c_custkey") % 3 == 2, (F.col("r_regionkey") + 1) % 5).otherwise(F.col("r_regionkey"))
    return x.select(F.col("c_custkey").alias("label_id"), doc.alias("document_id"), F.array(F.col("r_name"), F.concat("n_name", tail)).alias("section_path"))


def label_audit(spark, sf_dir):
    return labels.audit(_given_labels(spark, sf_dir), _sections(spark, sf_dir))


def label_repair(spark, sf_dir):
    return labels.repair(_given_labels(spark, sf_dir), _sections(spark, sf_dir)).select("label_id", F.array_join("repaired", " > ").alias("repaired"), "n_paths", "verdict")


def embedding_keys(spark, sf_dir):
    """The key under which the vector of each document is kept."""
    return _t(spark, sf_dir, "documents").select("doc_id", caches.embedding_key(F.col("text"), "hash64", "local", None, True, "v1").alias("cache_key"))


def reranker_decomposition(spark, sf_dir):
    """Users' mean values: purchases as the reranked arm, clicks as its base, all further types as the other arms."""
    rows = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return studies.reranker_decomposition(rows, "user_id", "event_type", "v", "purchase", "click")


def run_deltas(spark, sf_dir):
    """Mean and number of values of each event type, users with odd numbers as the second run."""
    x = _t(spark, sf_dir, "events").withColumn("run", F.col("user_id") % 2)
    both = x.groupBy("run", F.col("event_type").alias("metric")).agg(F.avg("value").alias("mean"), F.count("*").cast("double").alias("n"))
    long = both.select("run", "metric", F.explode(F.array(F.struct(F.lit("mean").alias("k"), F.col("mean").alias("value")), F.struct(F.lit("n").alias("k"), F.col("n").alias("value")))).alias("x")).select("run", "metric", "x.k", "x.value", F.lit("events").alias("corpus"))
    return studies.run_deltas(long.filter("run = 0"), long.filter("run = 1"), ["corpus"])


QUERIES = (variant_routes, ridge_linear_fit, ridge_logistic_fit, feature_screen, auc_power, label_audit, label_repair, embedding_keys, reranker_decomposition, run_deltas)

_LABELS = """lab as (select c_custkey as label_id, case when c_custkey % 3 = 2 then (r_regionkey + 1) % 5 else r_regionkey end as doc, r_name as a,
 n_name || case when c_custkey % 3 = 1 then ' ' || lower(c_mktsegment) || 'whichwasextendedby' else '' end as b from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
paths as (select r_regionkey as doc, r_name as a, n_name as b from nation join region on n_regionkey = r_regionkey)"""


def _long(column: str) -> str:
    return f"len(list_filter(string_split({column}, ' '), lambda t: len(t) > 20)) > 0"


def oracle_sql() -> dict[str, str]:
    one = [f"select '{v.study}' as study, '{v.name}' as variant, strategy, count(*) as n from (with {oracles.routes(v.policy.cost_weight, v.policy.groups)} select strategy from w) x group by strategy" for v in _grid()]
    return {
        "variant_routes": f"with {oracles.features(oracles.TURNS)} " + " union all ".join(one),
        # slopes of centred columns, as the intercept bears no penalty: two equations by Cramer's rule
        "ridge_linear_fit": """with p as (select user_id, avg(value) filter (event_type = 'view') as v, avg(value) filter (event_type = 'click') as c, avg(value) filter (event_type = 'purchase') as y from events group by user_id),
x as (select * from p where v is not null and c is not null and y is not null), m as (select avg(v) as mv, avg(c) as mc, avg(y) as my from x),
s as (select sum((v - mv) * (v - mv)) + 1 as vv, sum((c - mc) * (c - mc)) + 1 as cc, sum((v - mv) * (c - mc)) as vc, sum((v - mv) * (y - my)) as vy, sum((c - mc) * (y - my)) as cy, any_value(mv) as mv, any_value(mc) as mc, any_value(my) as my from x cross join m),
b as (select (vy * cc - cy * vc) / (vv * cc - vc * vc) as bv, (cy * vv - vy * vc) / (vv * cc - vc * vc) as bc, mv, mc, my from s)
select 'intercept' as term, round(my - bv * mv - bc * mc, 5) as slope from b union all select 'view', round(bv, 5) from b union all select 'click', round(bc, 5) from b""",
        "label_audit": f"""with {_LABELS} select label_id, case when {_long("a")} or {_long("b")} then 'spliced' when exists (select 1 from paths p where p.doc = lab.doc and p.a = lab.a and p.b = lab.b) then 'sound' else 'unresolved' end as verdict from lab""",
        "label_repair": f"""with {_LABELS}, h as (select distinct doc, unnest([a, b]) as h from paths), g as (select doc, h from h where not ({_long("h")})),
m as (select label_id, any_value(lab.doc) as doc, arg_max(x.h, len(x.h)) filter (starts_with(lab.a, x.h)) as ma, arg_max(x.h, len(x.h)) filter (starts_with(lab.b, x.h)) as mb from lab left join g x on x.doc = lab.doc group by label_id),
k as (select label_id, ma, mb, (select count(*) from paths p where p.doc = m.doc and p.a = ma and p.b = mb) as n, (select count(*) from paths p where p.doc = m.doc and p.a = ma and p.b = mb and (({_long("p.a")}) or ({_long("p.b")}))) as bad from m)
select label_id, case when n > 0 then ma || ' > ' || mb end as repaired, n as n_paths, case when n = 0 then 'unrepairable' when bad > 0 then 'unverifiable' else 'safe' end as verdict from k""",
        "embedding_keys": "select doc_id, sha256('v1|hash64|local|None|True|' || sha256(text)) as cache_key from documents",
        "reranker_decomposition": """with e as (select user_id, event_type, avg(value) as v from events group by all),
p as (select user_id, max(v) filter (event_type = 'purchase') as r, max(v) filter (event_type = 'click') as b, max(v) filter (event_type not in ('purchase', 'click')) as o from e group by user_id),
x as (select * from p where r is not null and b is not null)
select count(*) as n, count(*) filter (r > b + 1e-9) as rises, count(*) filter (r < b - 1e-9) as falls, count(*) filter (abs(r - b) <= 1e-9) as stays, count(*) filter (r > o + 1e-9) as reranked_beats_others,
 count(*) filter (b > o + 1e-9) as base_beats_others, count(*) filter (r > b + 1e-9 and r > o + 1e-9) as rises_above_others from x""",
        "run_deltas": """with g as (select user_id % 2 as run, event_type as metric, avg(value) as m, count(*)::double as n from events group by all),
l as (select run, metric, 'mean' as k, m as v from g union all select run, metric, 'n', n from g)
select metric, k, round(a.v, 6) as before, round(b.v, 6) as after, round(b.v - a.v, 6) as delta, round((b.v - a.v) / nullif(a.v, 0), 6) as relative from l a join l b using (metric, k) where a.run = 0 and b.run = 1""",
    }
