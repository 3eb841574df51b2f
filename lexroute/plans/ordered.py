"""Queries on order statistics and resampling, each with SQL written apart from it.

The SQL ranks with windows and draws with the same counter-based numbers; the plans do neither in one task.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexroute.functions.totals import mean
from lexroute.operators import families, inference, ordering, resampling
from lexroute.plans import oracles


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _means(spark, sf_dir):
    """Users as queries, event types as systems."""
    return _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n"))


def records(spark, sf_dir):
    """Users as queries: the clicks' mean as the cheap arm, the purchases' as the dear one, the views' as a signal."""
    x = _t(spark, sf_dir, "events").groupBy("user_id").agg(*(mean(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in ("view", "click", "purchase")))
    one = x.select("user_id", F.col("view").alias("signal"), F.col("click").alias("cheap"), F.col("purchase").alias("dear"), F.col("click").alias("cheap_ms"), (F.col("purchase") * 10).alias("dear_ms"))
    return one.filter("cheap is not null and dear is not null")


def _graded(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("v"), F.col("quality").alias("y"))


def _deltas(spark, sf_dir):
    """Users' mean of clicks less that of views; a user's number modulo 50 as its cluster."""
    d = records(spark, sf_dir).filter("signal is not null")
    return d.select(F.lit("click - view").alias("pair"), (F.col("user_id") % 50).alias("cluster"), F.round(F.col("cheap") - F.col("signal"), 9).alias("d"))


def _pairs(spark, sf_dir):
    x = _means(spark, sf_dir).select("user_id", "event_type", "v")
    return x.alias("a").join(x.alias("b"), "user_id").filter("a.event_type < b.event_type").select(F.col("a.event_type").alias("sa"), F.col("b.event_type").alias("sb"), F.round(F.col("a.v") - F.col("b.v"), 9).alias("d"))


def _rounded(df, places: int, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- order statistics ---


def spearman(spark, sf_dir):
    """Length of documents against their number."""
    return ordering.spearman(_t(spark, sf_dir, "documents"), "n_chars", "doc_id").select(F.round("rho", 6).alias("rho"))


def average_precision(spark, sf_dir):
    """Quality of documents by their length."""
    return ordering.average_precision(_graded(spark, sf_dir), "v", "y", "doc_id").select(F.round("ap", 6).alias("ap"))


def roc_auc(spark, sf_dir):
    return ordering.auc(_graded(spark, sf_dir), "v", "y").select(F.round("auc", 6).alias("auc"))


def hanley_mcneil(spark, sf_dir):
    x = ordering.auc(_graded(spark, sf_dir), "v", "y")
    a, p, n = F.col("auc"), F.col("ones"), F.col("zeros")
    var = a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)
    return x.select(F.round("auc", 6).alias("auc"), F.round(F.sqrt(F.try_divide(var, p * n)), 6).alias("se"))


def mid_rank(spark, sf_dir):
    """Place of each document by length among those of its language."""
    return ordering.with_ranks(_t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", ["lang"]).select("doc_id", "mid_rank")


def chunk_stats(spark, sf_dir):
    """Number, extremes, median (the upper of two), 95 % and total of lengths."""
    docs = _t(spark, sf_dir, "documents").select("n_chars")
    q = ordering.quantiles(docs, "n_chars", [], {"median_v": lambda n: [(F.floor(n / 2), F.lit(1.0))], "p95_v": lambda n: [(F.floor(n * 95 / F.lit(100.0)), F.lit(1.0))]})
    return docs.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.sum("n_chars").alias("total")).join(F.broadcast(q)).select("n", "lo", "hi", F.col("median_v").cast("long").alias("median_v"), F.col("p95_v").cast("long").alias("p95_v"), "total")  # one row each


def p95_nearest_rank(spark, sf_dir):
    return ordering.quantiles(_t(spark, sf_dir, "events"), "value", ["event_type"], {"p95": ordering.nearest_rank(0.95)}).select("event_type", "p95")


def median_split(spark, sf_dir):
    return _rounded(ordering.quantiles(_t(spark, sf_dir, "events"), "value", ["event_type"], {"median_v": ordering.median}).select("event_type", "median_v"), 6, "median_v")


def wilcoxon_statistic(spark, sf_dir):
    return ordering.signed_ranks(_pairs(spark, sf_dir), "d", ["sa", "sb"]).select("sa", "sb", "n", F.round("w_plus", 3).alias("w_plus"), F.round("w_minus", 3).alias("w_minus"))


def best_fixed(spark, sf_dir):
    """The system of highest mean, the first by name of equals."""
    m = _means(spark, sf_dir).groupBy("event_type").agg(F.avg("v").alias("m"))
    return m.agg(F.min(F.struct((-F.round("m", 9)).alias("low"), F.col("event_type").alias("s"), "m")).alias("x")).filter("x is not null").select("x.s", F.round("x.m", 6).alias("mean_v"))


# --- resampling ---


def bootstrap_ci(spark, sf_dir):
    return _rounded(inference.mean_intervals(_deltas(spark, sf_dir), ["pair"]), 6, "mean_d", "lo", "hi")


def median_bootstrap(spark, sf_dir):
    """Median difference of each pair of event types with its interval."""
    return _rounded(inference.median_intervals(_pairs(spark, sf_dir), ["sa", "sb"], rounds=2000), 6, "median_d", "ci_low", "ci_high")


def sign_flip_permutation(spark, sf_dir):
    return _rounded(inference.sign_flips(_deltas(spark, sf_dir), ["pair"]), 6, "statistic", "p_value")


def cluster_bootstrap(spark, sf_dir):
    return _rounded(inference.cluster_intervals(_deltas(spark, sf_dir), ["pair"], "cluster"), 6, "lo", "hi")


def rank_interval(spark, sf_dir):
    return _rounded(inference.rank_intervals(records(spark, sf_dir).withColumn("pair", F.lit("signal/dear")), ["pair"], "signal", "dear"), 6, "rho", "lo", "hi")


def random_policy(spark, sf_dir):
    """Escalation where the signal is above 50, against as many rows picked at random."""
    chosen = records(spark, sf_dir).withColumn("policy", F.lit("signal > 50")).withColumn("chosen", F.coalesce(F.col("signal") > 50, F.lit(False)))
    return _rounded(inference.policy_ablation(chosen, ["policy"], "cheap", "dear", "chosen"), 6, "quality", "random_quality", "share_reaching")


def mean_permutation(spark, sf_dir):
    """The signal of users whose dear arm helps against that of all others."""
    x = records(spark, sf_dir).filter("signal is not null").withColumn("helps", F.col("dear") - F.col("cheap") >= 0.01)
    return _rounded(inference.mean_permutations(x, [], "signal", "helps", rounds=2000), 6, "difference", "p_value")


def contingency_permutation(spark, sf_dir):
    """Language against quality of documents."""
    x = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return _rounded(inference.contingency_permutation(x, "lang", "quality", rounds=1000), 6, "chi_square", "phi", "p_value")


def comparison_family(spark, sf_dir):
    """Users that have all event types: every pair of types by mean value as latency and by number of events as cost, adjusted within each metric."""
    m = _means(spark, sf_dir).select("user_id", F.col("event_type").alias("system"), F.round("v", 9).alias("total_latency_ms"), F.col("n").alias("context_tokens"))
    arms = sorted(r[0] for r in m.select("system").distinct().collect())  # event types
    whole = m.groupBy("user_id").agg(F.count("*").alias("k")).filter(F.col("k") == len(arms)).select("user_id")
    rows = m.join(whole, "user_id")
    out = families.compare(rows, families.all_pairs(arms), ["total_latency_ms", "context_tokens"], id="user_id", rounds=1000)
    return out.select("metric", "treatment", "baseline", "n_pairs", "wins", "losses", F.round("median_d", 6).alias("median_d"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), "test", F.round("p_value", 6).alias("p_value"), "p_holm", "family_size")


QUERIES = (
    comparison_family, spearman, average_precision, roc_auc, hanley_mcneil, mid_rank, chunk_stats, p95_nearest_rank, median_split, wilcoxon_statistic, best_fixed,
    bootstrap_ci, median_bootstrap, sign_flip_permutation, cluster_bootstrap, rank_interval, random_policy, mean_permutation, contingency_permutation,
)

_GRADED = "x as (select d.doc_id as id, d.n_chars::double as v, l.quality as y from documents d join labels l on d.doc_id = l.doc_id)"
_AUC = f"""{_GRADED}, r as (select y, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2::double as rk from x),
a as (select count(*) filter (y = 1)::double as p, count(*) filter (y = 0)::double as n, sum(rk) filter (y = 1) as s from r), u as (select p, n, (s - p * (p + 1) / 2) / (p * n) as auc from a)"""
_MEANS = "m as (select user_id, event_type, avg(value) as v from events group by all), d as (select a.event_type as sa, b.event_type as sb, round(a.v - b.v, 9) as d from m a join m b on a.user_id = b.user_id and a.event_type < b.event_type)"
_DELTAS = f"{oracles._RECORDS}, d as (select user_id % 50 as cluster, round(cheap - signal, 9) as d from rec where signal is not null)"
_P = resampling.PRIME


def _numbers(stream: int, rounds: int, seed: int = 0) -> str:
    """Rows numbered in x by i."""
    return resampling.sql(seed, stream, f"select unnest(range({rounds})) as r", "select distinct i from x")


SQL = {
    "comparison_family": f"""with m as (select user_id, event_type as s, round(avg(value), 9) as v, count(*)::double as n from events group by all), k as (select user_id from m group by user_id having count(*) = (select count(distinct event_type) from events)),
l as (select user_id, s, unnest(['total_latency_ms', 'context_tokens']) as metric, unnest([v, n]) as v from m join k using (user_id)),
e as (select a.metric, a.s as treatment, b.s as baseline, a.v - b.v as d from l a join l b on a.user_id = b.user_id and a.metric = b.metric and a.s > b.s),
x as (select *, row_number() over (partition by metric, treatment, baseline order by d) - 1 as i, count(*) over (partition by metric, treatment, baseline) as n from e), {_numbers(resampling.DRAW, 1000, 20250101)},
q as (select x.metric, x.treatment, x.baseline, r, median(t.d) as m from u join x on x.i = u.i join x t on t.metric = x.metric and t.treatment = x.treatment and t.baseline = x.baseline and t.i = u.u * x.n // {_P} group by all),
c as (select metric, treatment, baseline, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from q group by all),
w as (select metric, treatment, baseline, count(*) as n_pairs, count(*) filter (d > 0) as wins, count(*) filter (d < 0) as losses, median(d) as median_d from e group by all),
p as (select *, case when wins + losses = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))) end as p_value from w),
h as (select *, count(*) over (partition by metric) as family_size, row_number() over (partition by metric order by p_value) as rn from p),
j as (select *, least(1, max((family_size - rn + 1) * p_value) over (partition by metric order by rn rows between unbounded preceding and current row)) as p_holm from h)
select j.metric, j.treatment, j.baseline, n_pairs, wins, losses, round(median_d, 6) as median_d, round(lo, 6) as ci_low, round(hi, 6) as ci_high, 'signs' as test, round(p_value, 6) as p_value, round(p_holm, 6) as p_holm, family_size from j join c using (metric, treatment, baseline)""",
    "spearman": """with r as (select rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2::double as a, rank() over (order by doc_id) + (count(*) over (partition by doc_id) - 1) / 2::double as b from documents)
select round(corr(a, b), 6) as rho from r""",
    "average_precision": f"""with {_GRADED}, r as (select y, row_number() over (order by v desc, id) as rn, sum(y) over (order by v desc, id rows between unbounded preceding and current row) as pos from x)
select round(sum(pos / rn::double) filter (y = 1) / nullif(sum(y), 0), 6) as ap from r""",
    "roc_auc": f"with {_AUC} select round(auc, 6) as auc from u",
    "hanley_mcneil": f"with {_AUC} select round(auc, 6) as auc, round(sqrt((auc * (1 - auc) + (p - 1) * (auc / (2 - auc) - auc * auc) + (n - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (p * n)), 6) as se from u",
    "mid_rank": "select doc_id, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2::double as mid_rank from documents",
    "chunk_stats": """with r as (select n_chars as v, row_number() over (order by n_chars) - 1 as i, count(*) over () as n from documents)
select count(*) as n, min(v) as lo, max(v) as hi, max(v) filter (i = n // 2) as median_v, max(v) filter (i = floor(n * 95 / 100::double)::bigint) as p95_v, sum(v)::bigint as total from r""",
    "p95_nearest_rank": """with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, value as p95 from r where i = least(greatest(round_even(0.95::double * n, 0)::bigint - 1, 0), n - 1)""",
    "median_split": "select event_type, round(median(value), 6) as median_v from events group by event_type",
    "wilcoxon_statistic": f"""with {_MEANS}, r as (select sa, sb, d, rank() over (partition by sa, sb order by abs(d)) + (count(*) over (partition by sa, sb, abs(d)) - 1) / 2::double as rk from d where d <> 0)
select sa, sb, count(*) as n, round(coalesce(sum(rk) filter (d > 0), 0), 3) as w_plus, round(coalesce(sum(rk) filter (d < 0), 0), 3) as w_minus from r group by sa, sb""",
    "best_fixed": "with m as (select user_id, event_type, avg(value) as v from events group by all), s as (select event_type as s, avg(v) as m from m group by event_type) select s, round(m, 6) as mean_v from s order by round(m, 9) desc, s limit 1",
    "bootstrap_ci": f"""with {_DELTAS}, x as (select d, row_number() over (order by d) - 1 as i, count(*) over () as n from d), {_numbers(resampling.DRAW, 10000)},
s as (select r, avg(t.d) as m from u join x on x.i = u.i join x t on t.i = u.u * x.n // {_P} group by r)
select 'click - view' as pair, (select count(*) from x) as n, (select round(avg(d), 6) from x) as mean_d, round(quantile_cont(m, 0.025), 6) as lo, round(quantile_cont(m, 0.975), 6) as hi from s""",
    "median_bootstrap": f"""with {_MEANS}, x as (select sa, sb, d, row_number() over (partition by sa, sb order by d) - 1 as i, count(*) over (partition by sa, sb) as n from d), {_numbers(resampling.DRAW, 2000)},
s as (select x.sa, x.sb, r, median(t.d) as m from u join x on x.i = u.i join x t on t.sa = x.sa and t.sb = x.sb and t.i = u.u * x.n // {_P} group by all),
q as (select sa, sb, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from s group by all)
select sa, sb, round(m, 6) as median_d, round(lo, 6) as ci_low, round(hi, 6) as ci_high from q join (select sa, sb, median(d) as m from d group by all) using (sa, sb)""",
    "sign_flip_permutation": f"""with {_DELTAS}, x as (select d, row_number() over (order by d) - 1 as i, count(*) over () as n from d), {_numbers(resampling.SIGN, 10000)},
s as (select r, abs(avg(case when u.u % 2 = 1 then d else -d end)) as m from u join x on x.i = u.i group by r), o as (select abs(avg(d)) as m from x)
select round(o.m, 6) as statistic, 'click - view' as pair, round((count(*) filter (s.m >= o.m - 1e-12) + 1) / (count(*) + 1)::double, 6) as p_value from s cross join o group by o.m""",
    "cluster_bootstrap": f"""with {_DELTAS}, x as (select cluster, sum(d) as t, count(*) as k, row_number() over (order by cluster) - 1 as i, count(*) over () as n from d group by cluster), {_numbers(resampling.DRAW, 10000)},
s as (select r, sum(c.t) / sum(c.k) as m from u join x on x.i = u.i join x c on c.i = u.u * x.n // {_P} group by r)
select 'click - view' as pair, (select count(*) from d) as n, (select count(*) from x) as clusters, round(quantile_cont(m, 0.025), 6) as lo, round(quantile_cont(m, 0.975), 6) as hi from s""",
    "rank_interval": f"""with {oracles._RECORDS}, x as (select signal as a, dear as b, row_number() over (order by signal, dear) - 1 as i, count(*) over () as n from rec where signal is not null), {_numbers(resampling.DRAW, 1000)},
s as (select r, t.a, t.b from u join x on x.i = u.i join x t on t.i = u.u * x.n // {_P}),
k as (select r, rank() over (partition by r order by a) + (count(*) over (partition by r, a) - 1) / 2::double as ra, rank() over (partition by r order by b) + (count(*) over (partition by r, b) - 1) / 2::double as rb from s),
c as (select r, case when var_pop(ra) > 0 and var_pop(rb) > 0 then covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)) end as rho from k group by r),
o as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2::double as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2::double as rb from x)
select 'signal/dear' as pair, (select count(*) from x) as n, (select round(corr(ra, rb), 6) from o) as rho, round(quantile_cont(rho, 0.025), 6) as lo, round(quantile_cont(rho, 0.975), 6) as hi, count(*) filter (rho is null) as constant from c""",
    "random_policy": f"""with {oracles._RECORDS}, x as (select cheap, dear - cheap as gain, coalesce(signal > 50, false) as go, row_number() over (order by dear - cheap) - 1 as i from rec), {_numbers(resampling.PICK, 1000, 20250101)},
b as (select count(*) as n, count(*) filter (go) as k, sum(cheap) as base, avg(case when go then cheap + gain else cheap end) as quality from x),
pk as (select r, i, row_number() over (partition by r order by u, i) as place from u), s as (select r, (any_value(base) + coalesce(sum(gain) filter (place <= k), 0)) / any_value(n) as q from pk join x using (i) cross join b group by r)
select 'signal > 50' as policy, n, k as spent, round(quality, 6) as quality, round(avg(q), 6) as random_quality, round(avg((q >= quality - 1e-12)::int), 6) as share_reaching from s cross join b group by n, k, quality""",
    "mean_permutation": f"""with {oracles._RECORDS}, x as (select signal as d, dear - cheap >= 0.01 as h, row_number() over (order by signal) - 1 as i from rec where signal is not null), {_numbers(resampling.PICK, 2000)},
b as (select count(*) as n, count(*) filter (h) as k, avg(d) filter (h) - avg(d) filter (not h) as difference from x),
pk as (select r, i, row_number() over (partition by r order by u, i) <= (select k from b) as first from u), s as (select r, avg(d) filter (first) - avg(d) filter (not first) as g from pk join x using (i) group by r)
select k as n_first, n - k as n_second, round(difference, 6) as difference, round((count(*) filter (abs(g) >= abs(difference) - 1e-12) + 1) / (count(*) + 1)::double, 6) as p_value from s cross join b group by all""",
    # cells of a shuffle: the language of a row is dealt by its number in the order of languages, the quality by its place in the round
    "contingency_permutation": f"""with z as (select d.lang as l, l.quality as q from documents d join labels l on d.doc_id = l.doc_id where d.lang is not null and l.quality is not null),
w as (select l, row_number() over (order by l desc) - 1 as i, count(*) over () as n from z), x as (select * from w), {_numbers(resampling.PICK, 1000)},
kr as (select l, count(*) as k from z group by l), kc as (select q, count(*) as k, coalesce(sum(count(*)) over (order by cast(q as varchar) rows between unbounded preceding and 1 preceding), 0) as before from z group by q),
chi as (select l, q, count(*) as o from z group by all), seen as (select sum(o * o * (select count(*) from z) / (kr.k * kc.k)::double) - (select count(*) from z) as s from chi join kr using (l) join kc using (q)),
p as (select r, i, row_number() over (partition by r order by u, i) as place from u), c as (select r, l, q, count(*) as o from p join x using (i) join kc on place > kc.before and place <= kc.before + kc.k group by all),
s as (select r, sum(o * o * (select count(*) from z) / (kr.k * kc.k)::double) - (select count(*) from z) as s from c join kr using (l) join kc using (q) group by r)
select (select count(*) from z) as n, round(seen.s, 6) as chi_square, round(sqrt(seen.s / (select count(*) from z)), 6) as phi, round((count(*) filter (s.s >= seen.s - 1e-9) + 1) / (count(*) + 1)::double, 6) as p_value from s cross join seen group by seen.s""",
}
