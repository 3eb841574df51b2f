"""Queries on the structure of texts: typed elements of lines, section trees, relevance by labelled sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexroute.functions import sessions
from lexroute.operators import labels, lines, sections
from lexroute.plans import experiments


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_elements(spark, sf_dir):
    """Typed elements of all documents, texts as digests."""
    out = lines.elements(_t(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("element").cast("long").alias("element"), "kind", "level", "number", "n_lines", F.md5(lines.dehyphenated(F.col("text"))).alias("digest"), F.array_join("section_path", " > ").alias("path"))


def _chunks(spark, sf_dir):
    """Customers as chunks of their region, under nation and segment."""
    c, n, r = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    x = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select(F.col("c_custkey").alias("chunk_id"), F.col("r_regionkey").alias("document_id"), F.array("r_name", "n_name", "c_mktsegment").alias("section_path"))


def section_tree(spark, sf_dir):
    return sections.tree(_chunks(spark, sf_dir)).select("document_id", F.array_join("prefix", " > ").alias("prefix"), "low", "high", "n_chunks")


def _labelled(spark, sf_dir):
    """Labels (some damaged) as queries: the documents that are relevant to each, and its refs; even ones name the whole region too."""
    given = experiments._given_labels(spark, sf_dir)
    refs = given.select("label_id", F.col("label_id").alias("query_id"), "document_id", F.col("section_path").alias("prefix"))
    more = refs.filter("query_id % 2 = 0").withColumn("prefix", F.slice("prefix", 1, 1)).withColumn("label_id", F.lit(None).cast("long"))
    docs = given.select(F.col("label_id").alias("query_id"), F.explode(F.array(F.col("document_id"), (F.col("document_id") + 1) % 5)).alias("document_id"))
    return docs, refs.unionByName(more)


def _retrieved(spark, sf_dir):
    """The next ten customers by number, as results of each query."""
    q = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank"))
    known = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"))
    return q.withColumn("chunk_id", F.col("query_id") + F.col("rank")).join(known, "chunk_id")


def _scored(spark, sf_dir, refs, docs, pooled=True):
    chunks = _chunks(spark, sf_dir)
    nodes = sessions.cut(sections.tree(chunks))
    found = sections.spans(docs, refs, nodes, pooled)
    judged = sections.judged(_retrieved(spark, sf_dir), sections.numbered(chunks, nodes), found)
    return sections.scores(judged, sections.gold_sizes(docs, found))


def section_scores(spark, sf_dir):
    """Recall and nDCG of each query against its labelled sections."""
    docs, refs = _labelled(spark, sf_dir)
    return _scored(spark, sf_dir, refs, docs).select("query_id", "n_gold", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


def section_repair_effect(spark, sf_dir):
    """Mean nDCG by the labels as given and by those whose safe repairs are made, each label in its own document."""
    docs, refs = _labelled(spark, sf_dir)
    graded = labels.repair(experiments._given_labels(spark, sf_dir), experiments._sections(spark, sf_dir))
    arms = [("as given", refs), ("repaired", sections.repaired_refs(refs, graded))]
    parts = [_scored(spark, sf_dir, r, docs, pooled=False).select(F.lit(name).alias("labels"), "n_gold", "ndcg") for name, r in arms]
    return parts[0].union(parts[1]).groupBy("labels").agg(F.count("*").alias("n"), F.count_if(F.col("n_gold") > 0).alias("n_with_gold"), F.round(F.avg("ndcg"), 6).alias("mean_ndcg"))


QUERIES = (line_elements, section_tree, section_scores, section_repair_effect)

_CHUNKS = "chunks as (select c_custkey as chunk_id, r_regionkey as doc, [r_name, n_name, c_mktsegment] as path from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
_REFS = f"""{experiments._LABELS}, given as (select label_id as q, doc, [a, b] as prefix from lab), rel as (select distinct q, unnest([doc, (doc + 1) % 5]) as doc from given),
got as (select c.c_custkey as q, k.c_custkey as chunk_id, k.c_custkey - c.c_custkey as rank from customer c join customer k on k.c_custkey between c.c_custkey + 1 and c.c_custkey + 10)"""


def _scores(refs: str, name: str, same: str) -> str:
    """CTEs that end in <name>: a chunk is relevant if a prefix of its path is one of its query's refs; without refs all of a relevant document is."""
    return f"""{name}_ok as (select rel.q, c.chunk_id from rel join chunks c using (doc) where exists (select 1 from {refs} r where r.q = rel.q {same} and list_slice(c.path, 1, len(r.prefix)) = r.prefix)
 or not exists (select 1 from {refs} r where r.q = rel.q {same})),
{name}_n as (select rel.q, count(distinct o.chunk_id) as n_gold from (select distinct q from rel) rel left join {name}_ok o on o.q = rel.q group by rel.q),
{name}_j as (select got.q, rank, o.chunk_id is not null as hit from got left join {name}_ok o on o.q = got.q and o.chunk_id = got.chunk_id),
{name}_s as (select q, count(*) filter (hit and rank <= 5) as hits, count(*) filter (hit) as found, sum(1 / log2(rank + 1)) filter (hit and rank <= 5) as dcg from {name}_j group by q),
{name} as (select q as query_id, n_gold, coalesce(hits, 0) / nullif(n_gold, 0)::double as recall, case when coalesce(dcg, 0) > 0 then dcg / list_sum(list_transform(range(1, least(found, 5) + 1), lambda i: 1 / log2(i + 1))) else 0 end as ndcg from {name}_n left join {name}_s using (q))"""


_SPACE = lines.SPACE.replace(r"\x85", r"\x{85}").replace("'", "''")


def _clean(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _element_sql() -> str:
    q = lambda s: s.replace("'", "''")
    arabic, roman, appendix, caption, url = q(lines.ARABIC), q(lines.ROMAN), q(lines.APPENDIX), q(lines.CAPTION.removeprefix("(?i)")), q(lines.URLISH.removeprefix("(?i)"))
    dense = f"regexp_replace(line, '{_SPACE}', '', 'g')"
    math = lambda x: f"(length(regexp_replace({x}, '[^{lines.MATH}]', '', 'g')) >= 2 or (contains({x}, '=') and ({' or '.join(f'contains({x}, {chr(39)}{f}{chr(39)})' for f in lines.FUNCTIONS)})))"
    words = f"list_filter(regexp_split_to_array(line, '{_SPACE}+'), lambda w: w <> '')"
    last = ", ".join(f"last_value(case when level = {k} then line_no end ignore nulls) over w as a{k}, last_value(case when level = {k} then line end ignore nulls) over w as t{k}" for k in range(1, lines.LEVELS + 1))
    path = ", ".join(f"case when a{k} is not null and a{k} > greatest(-1, {', '.join(f'coalesce(a{j}, -1)' for j in range(1, k)) or '-1'}) then t{k} end" for k in range(1, lines.LEVELS + 1))
    return f"""with s as (select doc_id, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') as l from documents), r as (select doc_id, unnest(l) as raw, unnest(range(len(l))) as line_no from s),
c as (select doc_id, line_no, {_clean('raw')} as line from r),
f as (select *, line = '' or length(line) > {lines.HEADING_CHARS} or regexp_matches(line, '{url}', 'i') or regexp_matches(line, '{q(lines.REFERENCE)}')
 or length({dense}) = 0 or length(regexp_replace({dense}, '[\\p{{L}}.,''\\-]', '', 'g')) / length({dense})::double > {lines.NUMERIC_SHARE} or {math('line')}
 or (len({words}) >= {lines.FEWEST_WORDS} and len(list_filter({words}, lambda w: length(trim(w, '.,:;()')) <= 1)) / len({words})::double > {lines.SINGLE_SHARE}) as refused from c),
h as (select *, case when refused then null when regexp_matches(line, '{arabic}') and regexp_matches(regexp_extract(line, '{arabic}', 2), '^\\p{{Lu}}') then regexp_extract(line, '{arabic}', 1)
 when length(line) <= {lines.SHORT_CHARS} and regexp_matches(line, '{roman}') then regexp_extract(line, '{roman}', 1) when length(line) <= {lines.SHORT_CHARS} and regexp_matches(line, '{appendix}') then regexp_extract(line, '{appendix}', 1) end as number from f),
k as (select doc_id, line_no, line, number, case when number is not null then least({lines.LEVELS}, 1 + length(number) - length(replace(number, '.', ''))) end as level,
 case when line = '' then 'blank' when number is not null then 'heading' when regexp_matches(line, '{caption}', 'i') then 'caption' else 'body' end as kind from h),
g as (select *, kind <> 'body' or coalesce(lag(kind) over (partition by doc_id order by line_no) <> 'body', true) as start from k),
e as (select *, sum(start::int) over w as element, {last} from g window w as (partition by doc_id order by line_no rows between unbounded preceding and current row)),
o as (select doc_id, element, any_value(kind) as kind, any_value(level) as level, any_value(number) as number, count(*) as n_lines, string_agg(line, ' ' order by line_no) as text, arg_max(array_to_string(list_filter([{path}], lambda x: x is not null), ' > '), line_no) as path
 from e where kind <> 'blank' group by doc_id, element)
select doc_id, element::bigint as element, case when kind <> 'body' then kind when {math('text')} and n_lines <= {lines.EQUATION_LINES} then 'equation'
 when starts_with(text, '- ') or starts_with(text, '• ') or starts_with(text, '* ') or regexp_matches(text, '^\\p{{Nd}}[.)] ') then 'list' else 'paragraph' end as kind, level::int as level, number, n_lines::int as n_lines,
 md5(regexp_replace({_clean(f"regexp_replace(text, '{_SPACE}+', ' ', 'g')")}, '- +', '', 'g')) as digest, path from o"""


def oracle_sql() -> dict[str, str]:
    as_given = "refs as (select q, doc, prefix from given union all select q, doc, prefix[1:1] from given where q % 2 = 0)"
    mended = f"fixed as (select query_id as q, repaired from ({experiments.oracle_sql()['label_repair'].replace('select label_id, case', 'select label_id as query_id, case')}) z where verdict = 'safe')"
    repaired = "mrefs as (select q, doc, coalesce(string_split(repaired, ' > '), prefix) as prefix from given left join fixed using (q) union all select q, doc, prefix[1:1] from given where q % 2 = 0)"
    mean = lambda name, cte: f"select '{name}' as labels, count(*) as n, count(*) filter (n_gold > 0) as n_with_gold, round(avg(ndcg), 6) as mean_ndcg from {cte}"
    return {
        "line_elements": _element_sql(),
        "section_tree": f"""with {_CHUNKS}, p as (select doc, path, count(*) as m from chunks group by all), o as (select *, row_number() over (partition by doc order by path) - 1 as no from p),
n as (select doc, list_slice(path, 1, k) as prefix, no, m from (select *, unnest(range(len(path) + 1)) as k from o) x)
select doc as document_id, array_to_string(prefix, ' > ') as prefix, min(no) as low, max(no) as high, sum(m)::bigint as n_chunks from n group by doc, prefix""",
        "section_scores": f"with {_CHUNKS}, {_REFS}, {as_given}, {_scores('refs', 'sc', '')} select query_id, n_gold, round(recall, 6) as recall, round(ndcg, 6) as ndcg from sc",
        "section_repair_effect": f"with {_CHUNKS}, {_REFS}, {as_given}, {mended}, {repaired}, {_scores('refs', 'sa', 'and r.doc = rel.doc')}, {_scores('mrefs', 'sb', 'and r.doc = rel.doc')} {mean('as given', 'sa')} union all {mean('repaired', 'sb')}",
    }
