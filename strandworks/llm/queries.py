"""Queries of the llm operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, langid, lm, mixing, packing, periodic, quality, repair, rules, simhash, topk
from . import substring_dedup as substrings
from . import suffix_array_dedup as suffixes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    return substrings.digest(substrings.substring_dedup(table(spark, sf_dir, "documents")))


def op2_suffix_array_dedup(spark, sf_dir):
    return suffixes.digest(suffixes.suffix_array_dedup(table(spark, sf_dir, "documents")))


def op3_chat_formatting(spark, sf_dir):
    return chat.maximal_chats(table(spark, sf_dir, "conversations"))


def op4_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % topk.EVERY == 0)


def op6_source_mixing(spark, sf_dir):
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op7_lm_scoring(spark, sf_dir):
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op9_quality_rules(spark, sf_dir):
    return rules.digest(rules.quality_rules(table(spark, sf_dir, "documents")))


def op10_simhash_near_dedup(spark, sf_dir):
    return simhash.digest(simhash.simhash_groups(table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark, sf_dir):
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark, sf_dir):
    return periodic.digest(periodic.periodic_runs(periodic.damaged(table(spark, sf_dir, "documents"))))


def op13_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_suffix_array_dedup, op3_chat_formatting, op4_quality_classifier,
        op5_exact_topk, op6_source_mixing, op7_lm_scoring, op8_packing, op9_quality_rules, op10_simhash_near_dedup,
        op11_conversation_repair, op12_periodic_runs, op13_language_id,
    )
}

SQL = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS s FROM w)),
firsts AS (SELECT k, min({'d': doc_id, 's': s}) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (
  SELECT doc_id, unnest(range(s, s + 20)) AS p FROM win JOIN firsts USING (k) WHERE (m.d, m.s) <> (doc_id, s))),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op2_suffix_array_dedup": r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 400)) AS k FROM (SELECT *, unnest(range(0, len(x) // 2 - 199)) AS s FROM h)),
dup AS (SELECT doc_id, s FROM win SEMI JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
isle AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM (
  SELECT doc_id, s, CAST(coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 200, TRUE) AS INT) AS fresh FROM dup)),
span AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM isle GROUP BY doc_id, g),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM span GROUP BY doc_id),
part AS (SELECT doc_id, a AS o, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM span
  UNION ALL SELECT doc_id, 1 + len(x) // 2, coalesce(b, 0), len(x) // 2 FROM h LEFT JOIN (SELECT doc_id, max(b) AS b FROM span GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY o) AS y FROM part JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(y)) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id) JOIN kept USING (doc_id)""",
    "op3_chat_formatting": chat.SQL,
    "op5_exact_topk": topk.SQL,
    "op6_source_mixing": mixing.SQL,
    "op9_quality_rules": rules.SQL,
    "op11_conversation_repair": repair.SQL,
    "op12_periodic_runs": periodic.SQL,
}
