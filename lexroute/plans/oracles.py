"""SQL for DuckDB, written apart from the plans that it is compared with."""

from __future__ import annotations

from lexroute.operators import routing as R


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def features(source: str) -> str:
    """CTEs that end in f: one row for each query of source (columns k1, k2, query) with its features."""
    plain = [c for c in R.COMPARISON if c not in R.WHOLE_WORD]
    bounded = " + ".join(f"regexp_matches(norm, '\\b{c.replace('.', chr(92) + '.')}\\b')::int" for c in R.WHOLE_WORD)
    held = lambda words, hay="norm": f"len(list_filter({_list(words)}, lambda c: contains({hay}, c)))"
    prefix = R.PREFIX.removeprefix("(?i)").replace("'", "''")
    define = R.DEFINE.removeprefix("(?i)").replace("'", "''")
    return f"""src as ({source}),
n0 as (select *, regexp_replace(trim(lower(nfc_normalize(query))), '\\s+', ' ', 'g') as norm from src where trim(coalesce(query, '')) <> ''),
n1 as (select *, regexp_extract_all(norm, '{R.WORD}') as words, regexp_extract_all(query, '{R.WORD}') as own from n0),
n2 as (select *, list_filter(words, lambda w: not list_contains({_list(R.STOPWORDS)}, w) and len(w) > 1) as c0 from n1 where len(words) > 0),
n3 as (select *, case when len(c0) > 0 then c0 else words[1:1] end as content_terms from n2),
n4 as (select *, len(words)::int as query_length_words, len(query)::int as query_length_chars, len(content_terms)::int as content_term_count,
 (len(regexp_extract_all(query, '{R.QUOTED.replace("'", "''")}')) + len(list_filter(own, lambda w: regexp_matches(w, '^[A-Z][A-Z0-9\\-]+$') or regexp_matches(w, '^[a-z][A-Z]')
 or (regexp_matches(w, '^[A-Za-z0-9_]') and regexp_matches(w, '[0-9]')) or regexp_matches(w, '^[A-Za-z0-9_]*[_.\\-][A-Za-z0-9_\\-]*$'))))::int as entity_indicator_count,
 {held(R.TECHNICAL)}::int as technical_term_count, {held(R.SEMANTIC)}::int as semantic_indicator_count, ({held(plain)} + {bounded})::int as comparison_indicator_count,
 (1 + {held(R.CONJUNCTIONS, "(' ' || norm || ' ')")})::int as concept_count,
 case when regexp_matches(norm, '{R.COMPARE}') then 'compare' when regexp_matches(trim(query), '{define}', 'i') then 'define'
 when regexp_matches(trim(query), '{prefix}', 'i') then lower(regexp_extract(trim(query), '^\\w+', 0)) when list_contains({_list(R.QUESTION_WORDS)}, words[1]) then words[1] else 'other' end as question_type from n3),
f as (select *, round(content_term_count / query_length_words, 6) as lexical_density, round(entity_indicator_count / query_length_words, 6) as entity_ratio, round(technical_term_count / content_term_count, 6) as technical_ratio,
 round(semantic_indicator_count / content_term_count, 6) as semantic_ratio, concept_count > 1 as multi_concept,
 round(least(1, 0.3::double * least(1, content_term_count / 12) + 0.2::double * least(1, (concept_count - 1) / 2) + 0.2::double * least(1, comparison_indicator_count / content_term_count)
 + 0.15::double * least(1, entity_indicator_count / query_length_words) + 0.15::double * least(1, semantic_indicator_count / content_term_count)), 6) as complexity_score from n4)"""


def routes(cost: float = 0.25, groups=tuple(R.GROUPS)) -> str:
    """CTEs after f that end in w: the winner of each query."""
    rows = []
    for i, s in enumerate(R.STRATEGIES):
        w = {g: R.WEIGHTS[s][g] if g in groups else 0.0 for g in R.GROUPS}
        kind = "case question_type " + " ".join(f"when '{k}' then {v}::double" for k, v in R.SUPPORT[s].items()) + " end"
        signals = {"lexical": "least(1, lexical_density)", "semantic": "least(1, semantic_ratio * 4)", "entity": "least(1, entity_ratio * 2)", "complexity": "complexity_score", "multi_concept": "least(1, (concept_count - 1) / 2)", "question_type": kind}
        terms = " + ".join(f"round({w[g]}::double * ({x}) * 100000000)::bigint" for g, x in signals.items())
        rows.append(f"select k1, k2, {i} as place, '{s}' as strategy, floor(({terms} - {round(cost * R.COST_MS[s] / max(R.COST_MS.values()) * 1e8)} + 50) / 100::double) / 1000000::double as score from f")
    return f"""s as ({' union all '.join(rows)}),
r as (select *, row_number() over (partition by k1, k2 order by score desc, place) as rn, lead(score) over (partition by k1, k2 order by score desc, place) as next from s),
v as (select k1, k2, strategy, score, round(score * 1000000)::bigint as b, round(next * 1000000)::bigint as c from r where rn = 1),
w as (select k1, k2, strategy, score, coalesce(greatest(0, (2000000 * (b - c) + abs(b) + abs(c)) // nullif(2 * (abs(b) + abs(c)), 0)) / 1000000::double, 0) as confidence from v)"""


TURNS = "select conv_id as k1, turn as k2, text as query from conversations where role = 'user'"
_EMBED = "select {id} as i, ('0x' || substr(md5(t), 1, 4))::int % 64 as b, count(*)::double as n from (select {id}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as t from {table}) x group by all"
_DENSE = f"""qv as ({_EMBED.format(id='item_id', table='benchmark')}), dv as ({_EMBED.format(id='doc_id', table='documents')}),
ql as (select i, sqrt(sum(n * n)) as l from qv group by i), dl2 as (select i, sqrt(sum(n * n)) as l from dv group by i),
dt as (select q.i as query_id, d.i as doc_id, sum(q.n * d.n) as dot from qv q join dv d on q.b = d.b group by all),
alld as (select ql.i as query_id, dl2.i as doc_id, round(coalesce(dot, 0) / (ql.l * dl2.l), 6) as score from ql cross join dl2 left join dt on dt.query_id = ql.i and dt.doc_id = dl2.i),
dn as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from alld)"""
_RECORDS = """p as (select user_id, avg(value) filter (event_type = 'view') as signal, avg(value) filter (event_type = 'click') as cheap, avg(value) filter (event_type = 'purchase') as dear from events group by user_id),
rec as (select user_id, signal, cheap, dear, cheap as cheap_ms, dear * 10 as dear_ms from p where cheap is not null and dear is not null)"""
_CUTS = f"""{_RECORDS}, o as (select signal as v, row_number() over (order by signal) - 1 as i, count(*) over () as n from rec where signal is not null and isfinite(signal)),
pt as (select d, greatest(0, least(max(n) - 1, floor(d * max(n) / 10)))::bigint as lo, greatest(0, least(max(n) - 1, ceil(d * max(n) / 10)))::bigint as hi from o cross join range(1, 10) g(d) group by d),
cuts as (select distinct (a.v + b.v) / 2 as cut from pt join o a on a.i = pt.lo join o b on b.i = pt.hi)"""
_SWEEP = f"""{_CUTS}, g as (select dir as direction, cut, coalesce(case dir when 'high' then signal >= cut else signal <= cut end, false) as go, dear - cheap >= 0.01 as y, rec.* from rec cross join cuts cross join (values ('high'), ('low')) z(dir)),
sw as (select 'signal' as signal, direction, cut, count(*) as n, avg(go::int) as rate, avg(case when go then dear else cheap end) as quality, stddev_samp(case when go then dear else cheap end) / sqrt(count(*)) as error,
 avg(cheap_ms + case when go then dear_ms else 0 end) as clock, count(*) filter (go and y) as tp, count(*) filter (go and not y) as fp, count(*) filter (not go and y) as fn, count(*) filter (not go and not y) as tn from g group by direction, cut)"""
_QTEXT = "q as (select conv_id * 1000 + turn as id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as t from conversations where role = 'user')"
_DUPS = f"""{_QTEXT}, cl as (select id, list_sort(list_distinct(t)) as t, min(id) over (partition by list_sort(list_distinct(t))) as rep from q), dp as (select rep as a, id as b, 1::double as jaccard from cl where id > rep
union all select a.id, b.id, least(0.9999, round(len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)), 4)) from cl a join cl b on a.id < b.id where a.id = a.rep and b.id = b.rep and len(a.t) > 0 and len(b.t) > 0 and len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) >= 0.8)"""


def sql(bm: str, rank: str, tok: str, qrel: str) -> dict[str, str]:
    every = rank.replace("HAVING_", "")
    b10 = f"b10 as (select * from {every} where rank <= 10)"
    bench = features("select item_id as k1, 0 as k2, text as query from benchmark")
    cov = lambda hay: f"case when len(content_terms) = 0 then 1 else len(list_filter(content_terms, lambda c: contains({hay}, c))) / len(content_terms) end"
    hybrid = f"{bm}, {_DENSE}, lists as (select query_id, doc_id, rank from {every} where rank <= 20 union all select query_id, doc_id, rank from dn where rank <= 20), fu as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score, min(rank) as best from lists group by all), hy as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, best, doc_id)::int as rank from fu)"
    names = "entity_indicator_count, technical_term_count, semantic_indicator_count, comparison_indicator_count, query_length_words, query_length_chars, content_term_count, concept_count, question_type, lexical_density, entity_ratio, technical_ratio, semantic_ratio, multi_concept, complexity_score, content_terms"
    packs = f"{bm}, {b10}, {_DENSE}, a as (select query_id, list(doc_id order by rank) as x, list(score order by rank) as s from b10 group by query_id), b as (select query_id, list(doc_id order by rank) as y, list(score order by rank) as z from dn where rank <= 10 group by query_id)"
    gap = lambda s: f"round((({s})[1] - ({s})[2]) / nullif(abs(({s})[1]), 0), 5)"
    shared = "sh as (select query_id, corr(rx, ry) as rho from (select b10.query_id, rank() over (partition by b10.query_id order by b10.rank) as rx, rank() over (partition by b10.query_id order by dn.rank) as ry from b10 join dn on dn.query_id = b10.query_id and dn.doc_id = b10.doc_id and dn.rank <= 10) group by query_id having count(*) >= 2)"
    slope = "sl as (select query_id, regr_slope(score, rank) as slope from b10 group by query_id)"
    words = lambda text: f"list_distinct({tok.format(text)})"
    # every strategy's results of every question, then those of the strategy it is routed to or sent on to
    adaptive = f"""{hybrid}, {bench}, {routes()},
ro as (select hy.query_id, hy.doc_id, hy.rank as first, round(len(list_intersect({words('i.text')}, {words('d.text')})) / greatest(len({words('i.text')}), 1)::double, 6) as score from hy join documents d on d.doc_id = hy.doc_id join benchmark i on i.item_id = hy.query_id where hy.rank <= 20),
rk as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, first, doc_id) as rank from ro),
ev as (select query_id, doc_id, rank::int as rank, 'bm25' as strategy, 1 as rung from {every} where rank <= 10 union all select query_id, doc_id, rank::int, 'dense', 2 from dn where rank <= 10 union all select query_id, doc_id, rank::int, 'hybrid', 3 from hy where rank <= 10
 union all select query_id, doc_id, rank::int, 'hybrid_rerank', 4 from rk where rank <= 10),
fi as (select ev.* from ev join w on w.k1 = ev.query_id and w.strategy = ev.strategy), rung as (select k1 as query_id, case strategy when 'bm25' then 1 when 'dense' then 2 when 'hybrid' then 3 else 4 end as lvl from w),
ha as (select query_id, count(*) as n, string_agg(lower(coalesce(text, '')), ' ' order by rank) as hay, max(lower(coalesce(text, ''))) filter (rank = 1) as one from fi join documents using (doc_id) group by query_id),
su as (select k1 as query_id, (least(1, coalesce(n, 0) / 3) + {cov("coalesce(hay, '')")} + 0.5::double * case when n is null then 0 else {cov("coalesce(one, '')")} end) / 2.5::double >= 0.5 as enough from f left join ha on ha.query_id = f.k1),
onto as (select query_id, case when enough or lvl = 4 then lvl else lvl + 1 end as lvl, not enough and lvl < 4 as escalated, case when enough then 'sufficient' when lvl = 4 then 'strongest available' else 'escalated' end as reason from su join rung using (query_id))"""
    return {
        "adaptive_results": f"{adaptive} select ev.query_id, doc_id, rank, strategy, escalated, reason from ev join onto on onto.query_id = ev.query_id and onto.lvl = ev.rung",
        "hybrid_rrf_top10": f"{hybrid} select * from hy where rank <= 10",
        "query_features": f"with {features(TURNS)} select k1 as conv_id, k2 as turn, {names} from f",
        "route_decisions": f"with {features(TURNS)}, {routes()} select k1 as conv_id, k2 as turn, strategy, score, confidence from w",
        "rejected_queries": "select conv_id, turn, case when trim(coalesce(text, '')) = '' then 'query is empty' else 'no term to analyse' end as reason from conversations where role = 'user' and not regexp_matches(coalesce(text, ''), '[A-Za-z0-9]')",
        "sufficiency": f"""{bm}, {b10}, {bench}, h as (select query_id, count(*) as n, string_agg(lower(text), ' ' order by rank) as hay, max(lower(text)) filter (rank = 1) as one from b10 join documents using (doc_id) group by query_id),
 v as (select k1 as query_id, coalesce(n, 0)::int as n_results, {cov("coalesce(hay, '')")} as c, case when n is null then 0 else {cov("coalesce(one, '')")} end as t from f left join h on h.query_id = f.k1),
 z as (select *, (least(1, n_results / 3) + c + 0.5::double * t) / 2.5::double as sc from v) select query_id, n_results, round(c, 6) as coverage, round(t, 6) as top1_coverage, round(sc, 6) as score, sc >= 0.5 as sufficient from z""",
        "pair_signals": f"""{packs}, {shared}, {slope} select query_id, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 5) as jaccard, round(len(list_intersect(x, y)) / len(x), 5) as overlap, round(len(list_distinct(x || y)) / (len(x) + len(y)), 5) as union_concentration,
 round(rho, 5) as rank_correlation, round(len(x) / 10, 5) as distinct_ratio_a, round(len(y) / 10, 5) as distinct_ratio_b, {gap('s')} as gap_a, {gap('z')} as gap_b, round(slope, 5) as slope_a, x[1] = y[1] as top1 from a join b using (query_id) left join sh using (query_id) left join sl using (query_id)""",
        "hybrid_change": f"""{hybrid}, {qrel}, x as (select query_id, list(doc_id order by rank) as d from dn where rank <= 10 group by query_id), y as (select query_id, list(doc_id order by rank) as h from hy where rank <= 10 group by query_id),
 b as (select query_id, list(doc_id order by rank) as b from {every} where rank <= 10 group by query_id), l as (select query_id, list(doc_id) as rel from rel group by query_id),
 e as (select query_id, d, h, b, coalesce(rel, []) as rel, list_sort(list_filter(h[1:5], lambda i: not list_contains(d[1:5], i))) as entered, list_sort(list_filter(d[1:5], lambda i: not list_contains(h[1:5], i))) as gone from x join y using (query_id) join b using (query_id) left join l using (query_id))
 select query_id, entered, gone, list_filter(entered, lambda i: list_contains(rel, i)) as relevant_entered, list_filter(gone, lambda i: list_contains(rel, i)) as relevant_left,
 list_transform(entered, lambda i: case when list_contains(d, i) and list_contains(b, i) then 'both' when list_contains(d, i) then 'dense_only' when list_contains(b, i) then 'bm25_only' else 'neither' end) as entered_source from e""",
        "decile_cuts": f"with {_CUTS} select distinct round(cut, 6) as cut from cuts",
        "rule_sweep": f"with {_SWEEP} select signal, direction, n, tp, fp, fn, tn, round(cut, 6) as cut, round(rate, 6) as rate, round(quality, 6) as quality, round(error, 6) as error, round(clock, 6) as clock, round((tp + tn) / n, 6) as agreement from sw",
        "selected_rule": f"""with {_SWEEP}, fair as (select * from sw where rate between 0.05 and 0.95), near as (select * from fair where quality >= (select max(quality) from fair) - error)
 select signal, direction, cut, round(rate, 6) as rate, round(quality, 6) as quality, false as degenerate from near order by rate, signal, cut limit 1""",
        "separation_check": f"""with {_RECORDS}, l as (select case when dear - cheap >= 0.01 then 'helps' when dear - cheap <= -0.01 then 'harms' end as g, unnest(['signal', 'cheap', 'dear']) as feature, unnest([signal, cheap, dear]) as v from rec),
 m as (select feature, min(v) filter (g = 'helps') as a, max(v) filter (g = 'helps') as b, min(v) filter (g = 'harms') as c, max(v) filter (g = 'harms') as d from l group by feature)
 select feature, coalesce(b < c or d < a, false) as separates, case when b < c then 'helps_below_harms' when d < a then 'helps_above_harms' end as direction from m""",
        "dup_pairs": f"with {_DUPS} select * from dp",
        "dq_structure": "select 'repeated_id' as gate, doc_id::varchar as id from documents group by doc_id having count(*) > 1 union all select 'blank_query', doc_id::varchar from documents where trim(coalesce(text, '')) = '' union all select 'unknown_category', doc_id::varchar from documents where lang is null or lang not in ('en', 'de')",
        "dq_grounding": r"""with x as (select doc_id as e, doc_id + 1 as c, i.text as quote from documents join benchmark i on i.item_id = doc_id % 40), d as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents)
 select case when d.doc_id is null then 'no_chunk' else 'not_verbatim' end as gate, e::varchar as id from x left join d on d.doc_id = c where d.doc_id is null or not coalesce(contains(t, trim(regexp_replace(quote, '\s+', ' ', 'g'))), false)""",
        "dq_same_ids": "select 'left_only' as gate, doc_id::varchar as id from documents where doc_id not in (select doc_id from labels) union all select 'right_only', doc_id::varchar from labels where doc_id not in (select doc_id from documents) union all select 'repeated_left', doc_id::varchar from documents group by doc_id having count(*) > 1 union all select 'repeated_right', doc_id::varchar from labels group by doc_id having count(*) > 1",
        "dq_quotas": "with w as (select * from (values ('en', 100::bigint), ('de', 100::bigint), ('xx', 1::bigint)) v(lang, expected)), g as (select lang, count(*) as got from documents group by lang) select coalesce(w.lang, g.lang) as lang, coalesce(expected, 0) as expected, coalesce(got, 0) as got from w full join g on w.lang = g.lang where coalesce(expected, 0) <> coalesce(got, 0)",
    }
