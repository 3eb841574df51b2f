"""Effect statistics and report tables as SQL plans, in the same form as analytics."""

from __future__ import annotations

from lexroute.plans.analytics import LABELLED, PANEL

DIGITS = "d10 as (select 0 as i " + " ".join(f"union all select {i}" for i in range(1, 10)) + ")"
DELTAS = f"{PANEL}, d as (select a.q, round(a.v - b.v, 9) as d from panel a join panel b on a.q = b.q and a.s = 'click' and b.s = 'view')"

SQL: dict[str, str] = {
    "contingency_chi_square": """
        with c as (select d.lang, l.quality, count(*) as n from {documents} d join {labels} l on d.doc_id = l.doc_id group by d.lang, l.quality),
        r as (select lang, cast(sum(n) as double) as r from c group by lang), k as (select quality, cast(sum(n) as double) as k from c group by quality), t as (select cast(sum(n) as double) as t from c),
        e as (select coalesce(c.n, 0) as o, r.r * k.k / t.t as e, t.t as t from r cross join k cross join t left join c on c.lang = r.lang and c.quality = k.quality)
        select round(sum((o - e) * (o - e) / e), 5) as chi_square, round(sqrt(sum((o - e) * (o - e) / e) / max(t)), 6) as phi from e""",
    "symmetry": f"""
        with {DELTAS}, m as (select avg(d) as mu, count(*) as n from d), c as (select max(n) as n, avg(power(d - mu, 2)) as m2, avg(power(d - mu, 3)) as m3, avg(power(d - mu, 4)) as m4 from d cross join m)
        select n, round(m3 / nullif(power(m2, 1.5), 0), 5) as skew, round(m4 / nullif(m2 * m2, 0) - 3, 5) as excess_kurtosis,
               case when n < 10 then 'too few' when abs(m3 / nullif(power(m2, 1.5), 0)) <= 0.5 and abs(m4 / nullif(m2 * m2, 0) - 3) <= 2 then 'symmetric' else 'asymmetric' end as verdict from c""",
    "rank_aware_frontier": f"""
        with {PANEL}, b as (select q, s, v, n, max(v) over (partition by q) as top, max(n) over (partition by q) as most from panel),
        r as (select q, s, n, row_number() over (partition by q order by case when v >= top - 5 and n >= most - 1 then 0 else 1 end, case when v >= top - 5 and n >= most - 1 then n else 0 end, round(v, 9) desc, s) as rn,
                     case when v >= top - 5 and n >= most - 1 then 0 else 1 end as fell_back from b)
        select q, s, n, fell_back from r where rn = 1""",
    "overhead_shares": """
        select l_returnflag, count(*) as n, round(avg(cast(l_tax as double)), 6) as mean_share, round(sum(cast(l_tax as double) * cast(l_extendedprice as double)) / nullif(sum(cast(l_extendedprice as double)), 0), 6) as aggregate_share
        from {lineitem} where l_extendedprice > 0 group by l_returnflag""",
    "efficiency_report": """
        with t as (select role, case when length(coalesce(text, '')) = 0 then 0 else greatest(1, length(text) div_int 4) end as k from {conversations}),
        r as (select role, k, row_number() over (partition by role order by k) as rn, count(*) over (partition by role) as n from t)
        select role, max(n) as n, cast(sum(k) as bigint) as tokens, round(avg(k), 6) as mean_tokens, max(case when rn - 1 = least(greatest(cast({half_even}(0.95 * n) as bigint) - 1, 0), n - 1) then k end) as p95_tokens,
               round(sum(k) * cast(0.0000005 as double), 7) as cost_usd, round(sum(k) * cast(0.0000005 as double) / max(n) * 1000, 7) as cost_per_1000 from r group by role""",
    "rotation_schedule": f"with {DIGITS}, a as (select i from d10 where i < 4), r as (select i as rep from d10 where i < 5) select rep, i as slot, (i + rep) % 4 as arm from a cross join r",
    "document_checksums": "select doc_id, {sha}(coalesce(text, '')) as checksum from {documents}",
    "symmetric_difference": """
        select q, max(side) as side from (select distinct user_id as q, 'click only' as side from {events} where event_type = 'click' and value > 80 union all select distinct user_id, 'view only' from {events} where event_type = 'view' and value > 80) u
        group by q having count(*) = 1""",
    "wide_to_long": """
        select p_partkey as id, name, value from (select p_partkey, 'size' as name, cast(p_size as double) as value from {part} union all select p_partkey, 'price', cast(p_retailprice as double) from {part}) u where value is not null""",
    "residual_variants": "select o_orderpriority, count(*) as n from {orders} where o_orderstatus not in ('F', 'O') group by o_orderpriority",
    "category_coverage": "select n.n_name as category, count(c.c_custkey) as n from {nation} n left join {customer} c on c.c_nationkey = n.n_nationkey group by n.n_name",
    "integrity_summary": """
        select count(*) as n, count(distinct doc_id) as n_ids, count(case when text is null or trim(text) = '' then 1 end) as blank, count(case when n_chars <> length(text) then 1 end) as wrong_length from {documents}""",
}
