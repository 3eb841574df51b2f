"""Evaluation analytics as SQL plans over parquet tables.

Each text names its tables in braces. The `panel` views read `events` as strategy
rows: user_id is the query, event_type the strategy, value the clock. Undefined
values stay NULL; ties are broken by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexroute.functions.totals import mean_sql, total_sql

PANEL = "panel as (select user_id as q, event_type as s, avg(value) as v, count(*) as n from {events} group by user_id, event_type)"
LABELLED = "x as (select d.doc_id as id, cast(d.n_chars as double) as v, l.quality as y from {documents} d join {labels} l on d.doc_id = l.doc_id)"

SQL: dict[str, str] = {
    "system_summary": """
        select event_type, count(*) as n, round(avg(value), 6) as mean_v, round(min(value), 6) as min_v, round(max(value), 6) as max_v,
               round(stddev_samp(value), 6) as sd_v from {events} group by event_type""",
    "status_counts": "select o_orderstatus as status, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share from {orders} group by o_orderstatus",
    "error_breakdown": "select l_returnflag as stage, l_linestatus as kind, count(*) as n from {lineitem} group by l_returnflag, l_linestatus",
    "category_breakdown": """
        select d.lang as category, count(*) as n, count(l.doc_id) as n_labelled, round(avg(cast(l.quality as double)), 6) as mean_quality
        from {documents} d left join {labels} l on d.doc_id = l.doc_id group by d.lang""",
    "cost_table": """
        with m as (select event_type, avg(value) as v from {events} group by event_type)
        select event_type, round(v, 2) as cost, round(v / nullif(max(v) over (), 0), 6) as relative from m""",
    "dispersion": f"with {PANEL} select q, count(*) as systems, round(max(v) - min(v), 6) as spread from panel group by q",
    "complete_cases": f"with {PANEL} select q from panel group by q having count(distinct s) = (select count(distinct event_type) from {{events}})",
    "oracle_pick": f"""
        with {PANEL}, r as (select q, s, v, row_number() over (partition by q order by round(v, 9) desc, n, s) as rn from panel)
        select q, s, round(v, 6) as best from r where rn = 1""",
    "frontier_pick": f"""
        with {PANEL}, b as (select q, s, v, n, max(v) over (partition by q) as top from panel),
        r as (select q, s, v, n, row_number() over (partition by q order by n, s) as rn from b where v >= top - 5)
        select q, s, n, round(v, 6) as v from r where rn = 1""",
    "needed_split": f"""
        with {PANEL}, w as (select q, max(case when s = 'purchase' then v end) as ref, max(case when s <> 'purchase' then v end) as other from panel group by q)
        select case when ref is null or other is null then 'undefined' when other >= ref - 0.01 then 'sufficient' else 'needed' end as verdict, count(*) as n from w group by 1""",
    "gain_concentration": f"""
        with {PANEL}, w as (select q, s, v, max(v) over (partition by q) as top, count(case when v is not null then 1 end) over (partition by q) as k from panel)
        select s, count(case when v = top then 1 end) as wins, round(sum(top - v), 6) as regret from w group by s""",
    "threshold_sweep": f"""
        with {LABELLED}, t as (select cast(500 as double) as cut union all select cast(1000 as double) union all select cast(2000 as double) union all select cast(4000 as double))
        select cut, round(avg(case when v >= cut then cast(1 as double) else cast(0 as double) end), 6) as rate, count(case when v >= cut and y = 1 then 1 end) as tp, count(case when v >= cut and y = 0 then 1 end) as fp,
               count(case when v < cut and y = 1 then 1 end) as fn, count(case when v < cut and y = 0 then 1 end) as tn from x cross join t group by cut""",
    "one_se_selection": f"""
        with {LABELLED}, t as (select cast(500 as double) as cut union all select cast(1000 as double) union all select cast(2000 as double) union all select cast(4000 as double)),
        s as (select cut, avg(case when v >= cut then cast(1 as double) else cast(0 as double) end) as rate, avg(case when (v >= cut) = (y = 1) then cast(1 as double) else cast(0 as double) end) as m,
              stddev_samp(case when (v >= cut) = (y = 1) then cast(1 as double) else cast(0 as double) end) / sqrt(count(*)) as se from x cross join t group by cut),
        b as (select cut, rate, m, se, max(m) over () as top from s where rate >= 0.05 and rate <= 0.95),
        r as (select cut, rate, m, row_number() over (order by round(rate, 9), cut) as rn from b where m + se >= top)
        select cut, round(rate, 6) as rate, round(m, 6) as quality from r where rn = 1""",
    "confusion": f"with {LABELLED} select count(case when v >= 1000 and y = 1 then 1 end) as tp, count(case when v >= 1000 and y = 0 then 1 end) as fp, count(case when v < 1000 and y = 1 then 1 end) as fn, count(case when v < 1000 and y = 0 then 1 end) as tn from x",
    "paired_effect": f"""
        with {PANEL}, d as (select a.s as sa, b.s as sb, a.v - b.v as d from panel a join panel b on a.q = b.q and a.s < b.s)
        select sa, sb, count(*) as n, count(case when d > 0 then 1 end) as wins, count(case when d = 0 then 1 end) as ties, count(case when d < 0 then 1 end) as losses, round(avg(d), 6) as mean_d from d group by sa, sb""",
    "holm": """
        with p as (select p_partkey as id, p_brand as family, (p_size * 7 + p_partkey) % 100 / cast(1000 as double) as p from {part}),
        r as (select id, family, p, row_number() over (partition by family order by p, id) as rn, count(*) over (partition by family) as m from p)
        select id, family, round(least(cast(1 as double), max((m - rn + 1) * p) over (partition by family order by rn rows between unbounded preceding and current row)), 6) as adjusted from r""",
    "moments": """
        with m as (select event_type, avg(value) as mu from {events} group by event_type),
        c as (select e.event_type, avg(power(value - mu, 2)) as m2, avg(power(value - mu, 3)) as m3, avg(power(value - mu, 4)) as m4 from {events} e join m on e.event_type = m.event_type group by e.event_type)
        select event_type, round(m3 / nullif(power(m2, 1.5), 0), 5) as skew, round(m4 / nullif(m2 * m2, 0) - 3, 5) as excess_kurtosis from c""",
    "transitions": """
        with o as (select user_id, event_type, lead(event_type) over (partition by user_id order by event_id) as next_type from {events})
        select event_type as from_s, next_type as to_s, count(*) as n from o where next_type is not null group by event_type, next_type""",
    "crosstab": "select d.lang, count(case when l.quality = 1 then 1 end) as good, count(case when l.quality = 0 then 1 end) as bad from {documents} d join {labels} l on d.doc_id = l.doc_id group by d.lang",
    "dq_duplicates": "select text, count(*) as n from {documents} group by text having count(*) > 1",
    "dq_referential": "select l.doc_id from {labels} l left join {documents} d on l.doc_id = d.doc_id where d.doc_id is null",
    "dq_blank_queries": "select conv_id, turn from {conversations} where text is null or trim(text) = ''",
    "dq_split_overlap": "select o_custkey from {orders} group by o_custkey having count(distinct o_orderstatus) > 2",
    "latest_upsert": """
        with u as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from {events})
        select user_id, event_type, value from u where rn = 1""",
    "cache_misses": "select b.item_id from {benchmark} b left join (select distinct text from {documents}) d on b.text = d.text where d.text is null",
    "run_delta": f"""
        with {PANEL}, m as (select s, avg(case when q % 2 = 0 then v end) as a, avg(case when q % 2 = 1 then v end) as b from panel group by s)
        select s, round(a, 6) as before_v, round(b, 6) as after_v, round(b - a, 6) as delta from m""",
    "depth_pivot": f"with {PANEL} select q % 10 as depth, round(avg(case when s = 'click' then v end), 6) as click, round(avg(case when s = 'view' then v end), 6) as view_v from panel group by q % 10",
    "most_selected": "with c as (select event_type, count(*) as n from {events} group by event_type), r as (select event_type, n, row_number() over (order by n desc, event_type desc) as rn from c) select event_type, n from r where rn = 1",
    "escalation_rate": "select event_type, count(case when value > 50 then 1 end) as escalated, round(avg(case when value > 50 then cast(1 as double) else cast(0 as double) end), 6) as rate, round(avg(case when value > 50 then value end), 6) as escalated_mean, round(avg(case when value <= 50 then value end), 6) as settled_mean from {events} group by event_type",
    "quota_check": """
        with c as (select source, lang, count(*) as n from {documents} group by source, lang)
        select source, lang, n, n >= 5 as met from c""",
}


def plans() -> dict[str, str]:
    from lexroute.plans import statistics

    return SQL | statistics.SQL


#: What Spark adds up without regard to the order of rows, by query; DuckDB keeps the text above.
ORDERLESS = {
    "gain_concentration": {"avg(value)": mean_sql("value"), "sum(top - v)": total_sql("top - v")},
    "paired_effect": {"avg(value)": mean_sql("value"), "avg(d)": mean_sql("d")},
}


def spark_text(name: str) -> str:
    text = plans()[name]
    for plain, orderless in ORDERLESS.get(name, {}).items():
        text = text.replace(plain, orderless)
    return text.replace("{half_even}", "bround").replace("div_int", "div").replace("{sha}(coalesce(text, ''))", "sha2(coalesce(text, ''), 256)")


def duck_text(name: str) -> str:
    text = plans()[name].replace("{half_even}", "round_even_0").replace("div_int", "//").replace("{sha}", "sha256")
    text = text.replace("round_even_0(0.95 * n)", "round_even(0.95 * n, 0)")
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = spark_text(name)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
