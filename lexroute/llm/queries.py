"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexroute.llm import bpe, embdup, exactdup, fim, langid, lm, neardup, packing, quality, rules, runindex, substring, whiten
from lexroute.llm.sparkops import fold, table


def op1_substring_dedup(spark, sf_dir):
    return substring.digest(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold("doc_id", 5) != 0)
    out = langid.identify(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op4_embedding_near_dedup(spark, sf_dir):
    out = embdup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_lm_scores(spark, sf_dir):
    out = lm.score(table(spark, sf_dir, "documents"), F.coalesce(fold("doc_id", 5) != 1, F.lit(True)))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_run_index_dedup(spark, sf_dir):
    return runindex.digest(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark, sf_dir):
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, threshold=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_quality_classifier(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    out = quality.score(table(spark, sf_dir, "documents"), labels, fold("doc_id", 3) != 1)
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_rules(spark, sf_dir):
    out = rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *rules.COUNTS, "base_failed", "kept", "quality_probability")


def op11_exact_dedup(spark, sf_dir):
    return exactdup.groups(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    out = fim.transform(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_embedding_whitening(spark, sf_dir):
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_bpe_round_trip, op3_language_id, op4_embedding_near_dedup, op5_lm_scores, op6_run_index_dedup, op7_best_fit_packing, op8_minhash_near_dedup, op9_quality_classifier, op10_quality_rules, op11_exact_dedup, op12_fill_in_middle, op13_embedding_whitening)}


SQL = {
    "op11_exact_dedup": r"""
        with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents)
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, h as text_sha256
        from t window w as (partition by h)""",
    # units as a list; the draws; the cut; the parts put together
    "op12_fill_in_middle": """
        with t as (select doc_id, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        d as (select doc_id, x, u, len(u) as n, cast('0x' || substr(h, 1, 8) as ubigint) % (len(u) + 1) as r1, cast('0x' || substr(h, 9, 8) as ubigint) % (len(u) + 1) as r2,
                     cast('0x' || substr(h, 17, 8) as ubigint) % 100 as r3, cast('0x' || substr(h, 25, 8) as ubigint) % 100 as r4 from t),
        c as (select doc_id, x, n, case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or r3 >= 90 then 'plain' when r4 < 20 then 'spm' else 'psm' end as form,
                     array_to_string(list_slice(u, 1, least(r1, r2)), '') as a, array_to_string(list_slice(u, least(r1, r2) + 1, greatest(r1, r2)), '') as b, array_to_string(list_slice(u, greatest(r1, r2) + 1, n), '') as c from d)
        select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(a) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(b) as bigint) end as middle_chars,
               sha256(case form when 'plain' then x when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b else '<S>' || c || '<P>' || a || '<M>' || b end) as output_sha256, sha256(x) as restored_sha256 from c""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
