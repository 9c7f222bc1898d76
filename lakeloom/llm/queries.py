"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, htmltext, langid, media, packing, pii, quality, simhash, substrings
from .common import table


#: Where the surrogates' key comes from; the registered queries run on public test data with this one if it is unset.
KEY_SETTING, TEST_KEY = "spark.lakeloom.surrogateKey", "a key for test data only"


def surrogate_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract_main_text(pages, "html", "html").select("page_id", "url", F.col("html").alias("text"), F.length("html").cast("long").alias("n_chars"))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.stale_answers(chat.conversations(table(spark, sf_dir, "conversations")))
    runs = lambda c: F.concat_ws(",", F.transform(c, lambda r: F.concat(r.length.cast("string"), F.lit(":"), r.bit.cast("string")))).alias(c)
    return chat.format_preferences(pairs).select(F.col("pair_id").alias("conv_id"), F.col("prefix_turns").cast("long").alias("prefix_turns"), "prompt", "chosen_completion", runs("chosen_mask"), "rejected_completion", runs("rejected_mask"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, most=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify_language(docs, langid.train(docs))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark), keep_count="n_replaced")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_html_main_text, op3_token_packing, op4_preference_format, op5_simhash_near_dedup, op6_language_id, op7_pii_surrogates, op8_quality_classifier, op9_benchmark_leaks, op10_substring_dedup)}

ORACLE_SQL = {
    "op4_preference_format": """
WITH e AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations),
l AS (SELECT conv_id, max(i) AS last FROM e WHERE role = 'assistant' GROUP BY conv_id),
s AS (SELECT e.conv_id, max_by(e.text, e.i) AS stale FROM e JOIN l USING (conv_id) WHERE e.role = 'assistant' AND e.i < l.last GROUP BY e.conv_id),
p AS (
  SELECT l.conv_id, l.last, e.text AS good, coalesce(s.stale, '') AS bad,
         CASE WHEN e.text = coalesce(s.stale, '') THEN l.last ELSE l.last - 1 END AS n
  FROM l JOIN e ON e.conv_id = l.conv_id AND e.i = l.last LEFT JOIN s ON s.conv_id = l.conv_id),
q AS (
  SELECT p.conv_id, string_agg('<|' || e.role || '|>' || chr(10) || e.text || chr(10) || '<|end|>' || chr(10), '' ORDER BY e.i) AS prompt
  FROM p JOIN e ON e.conv_id = p.conv_id AND e.i <= p.n GROUP BY p.conv_id)
SELECT p.conv_id, p.n AS prefix_turns, coalesce(q.prompt, '') AS prompt,
  CASE WHEN p.n = p.last THEN '' ELSE '<|assistant|>' || chr(10) || p.good || chr(10) || '<|end|>' || chr(10) END AS chosen_completion,
  CASE WHEN p.n = p.last THEN '' ELSE '14:0,' || length(p.good) || ':1,9:0' END AS chosen_mask,
  CASE WHEN p.n = p.last THEN '' ELSE '<|assistant|>' || chr(10) || p.bad || chr(10) || '<|end|>' || chr(10) END AS rejected_completion,
  CASE WHEN p.n = p.last THEN '' ELSE '14:0,' || length(p.bad) || ':1,9:0' END AS rejected_mask
FROM p LEFT JOIN q ON q.conv_id = p.conv_id
""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) AS n FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r WHERE n > 1),
f AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.p) AS kept, count(*) AS n FROM f LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.p = f.p WHERE g.p IS NULL GROUP BY f.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
""",
}
