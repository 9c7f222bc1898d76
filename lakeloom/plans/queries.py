"""The registered queries over the driver's tables, each beside its SQL.

conversations stand for sessions (conv_id, turn), documents for messages of projects (source), events for
sequences with boundaries (errors), pages for paths, embeddings for chunk vectors (label for session).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import mining, tables
from ..operators import search as s
from ..operators import sessions as ss
from ..operators import vectors as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# SQL that several oracles share.
_FOLD = "translate(lower(text), 'éèêçóíñäöüáàâîôûúëïãõåýìòùÿ', 'eeecoinaouaaaiouueiaoayiouy')"  # the accents that the tables have
_TOKENS = rf"regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+')"
_COLLAPSED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bm25_sql(table: str, columns: str, phrases: list[list[str]], where: str = "true") -> str:
    """CTEs up to `scored`: rows of the table that hold every phrase, with the negated score, 9 digits."""
    count = lambda p: f"len(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p) - 1}] = [{', '.join(repr(t) for t in p)}]))"
    n = range(len(phrases))
    score = " + ".join(
        f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END) * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * l / avgdl))" for i in n
    )
    return f"""
words AS (SELECT {columns}, {_TOKENS} AS w FROM {table} WHERE text <> '' AND {where}),
counted AS (SELECT * EXCLUDE w, len(w) AS l, {', '.join(f'{count(phrases[i])} AS f{i}' for i in n)} FROM words),
stats AS (SELECT count(*) AS n, avg(l) AS avgdl, {', '.join(f'count(*) FILTER (WHERE f{i} > 0) AS df{i}' for i in n)} FROM counted),
scored AS (SELECT counted.*, round(-({score}), 9) + 0.0 AS rank FROM counted, stats WHERE {' AND '.join(f'f{i} > 0' for i in n)})"""


def _bodies(c: DataFrame) -> DataFrame:
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"), "role", "text")


_TOP = """
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank, turn) AS k FROM (SELECT * FROM hits ORDER BY rank, conv_id, turn LIMIT 400)) WHERE k = 1)
SELECT row_number() OVER (ORDER BY rank, conv_id, turn) AS pos, 1 AS tier, conv_id AS session_id, turn AS line_no, rank FROM best ORDER BY rank, conv_id, turn LIMIT 20"""


# ---- search


@query(f"WITH {_bm25_sql('conversations', 'conv_id, turn, role', [['thing'], ['thble']])}, hits AS (SELECT * FROM scored), {_TOP}")
def keyword_search_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.search(_bodies(_table(spark, sf_dir, "conversations")), "thing thble")


@query(f"WITH {_bm25_sql('documents', 'doc_id', [['of', 'the']])} SELECT doc_id, rank FROM scored")
def keyword_search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return s.scored(docs, "of-the").select("doc_id", F.round("rank", 9).alias("rank"))


@query(f"WITH {_bm25_sql('conversations', 'conv_id, turn, role', [['thing']])}, hits AS (SELECT * FROM scored WHERE role = 'user'), {_TOP}")
def keyword_search_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.search(_bodies(_table(spark, sf_dir, "conversations")), "thing", role="user")


@query(f"""
WITH b AS (SELECT * FROM (WITH {_bm25_sql('conversations', 'conv_id, turn, role', [['thing']], 'turn > 0')} SELECT * FROM scored) ORDER BY rank, conv_id, turn LIMIT 400),
t AS (SELECT * FROM (WITH {_bm25_sql('conversations', 'conv_id, turn, role', [['thing']], 'turn = 0')} SELECT * FROM scored) ORDER BY rank, conv_id LIMIT 20),
hits AS (SELECT 0 AS tier, conv_id, 0 AS line_no, rank FROM t UNION ALL SELECT 1, conv_id, turn, rank FROM b),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY tier, rank, line_no) AS k FROM hits) WHERE k = 1)
SELECT row_number() OVER (ORDER BY tier, rank, conv_id, line_no) AS pos, tier, conv_id AS session_id, line_no::BIGINT AS line_no, rank FROM best ORDER BY tier, rank, conv_id, line_no LIMIT 20""")
def title_tier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    titles = c.filter("turn = 0").select(F.col("conv_id").alias("session_id"), "text")
    return s.search(_bodies(c.filter("turn > 0")), "thing", titles=titles)


@query(f"""
WITH w AS (SELECT {_TOKENS} AS w FROM documents WHERE text <> ''), t AS (SELECT unnest(['thing', 'thble', 'thtion', 'of', 'absent']) AS term)
SELECT term, count(*) AS n_docs, round(avg(len(w)), 6) AS avg_len, count(*) FILTER (WHERE list_contains(w, term)) AS df, sum(len(list_filter(w, lambda x: x = term)))::BIGINT AS occurrences FROM w, t GROUP BY term""")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.corpus_stats(_table(spark, sf_dir, "documents"), ["thing", "thble", "thtion", "of", "absent"])
    return out.withColumn("avg_len", F.round("avg_len", 6))


@query(f"WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text <> ''), p AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM w) SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS df, min(pos)::BIGINT AS first_pos FROM p GROUP BY term")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = s.postings(_table(spark, sf_dir, "documents"), "doc_id")
    by_doc = index.groupBy("term", "doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    return by_doc.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("df"), F.min("p").cast("long").alias("first_pos"))


# ---- prompts, prose, lookup


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND text <> '' AND NOT starts_with(text, '<') AND NOT starts_with(text, '/')")
def own_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").withColumns({"text_for_fts": F.col("text"), "rec_type": F.col("role"), "first_kind": F.lit("text")})
    return c.filter(ss.typed_prompts(c)).select("conv_id", "turn", "text")


@query("""
WITH m AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE starts_with(lower(c_name), 'customer#00000001'))
SELECT row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_name) AS pos, * FROM m ORDER BY c_acctbal DESC NULLS LAST, c_name LIMIT 25""")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return ss.find_sessions(c, "cUSTOMER#00000001", 25, "c_name", "c_acctbal")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unlabeled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.pending(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), _table(spark, sf_dir, "labels"), ["doc_id"])


@query("""
SELECT 'lineitem' AS child, count(*) AS rows FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'orders', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'labels', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: _table(spark, sf_dir, n)
    parts = [("lineitem", "orders", "l_orderkey", "o_orderkey"), ("orders", "customer", "o_custkey", "c_custkey"), ("labels", "documents", "doc_id", "doc_id")]
    found = [tables.violations(t(a).select(x), t(b), x, y).agg(F.count("*").alias("rows")).select(F.lit(a).alias("child"), "rows") for a, b, x, y in parts]
    return found[0].union(found[1]).union(found[2])


# ---- sequences


def _sequence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return e.filter("event_type <> 'error'"), e.filter("event_type = 'error'")


@query("""
WITH s AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS item_rank,
  max(ts) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id) AS last_b FROM events)
SELECT user_id, event_id, item_rank, (item_rank = 1 AND coalesce(ts < last_b, false)) AS pre_compaction,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, item_rank, event_id) AS pos FROM s""")
def recover_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b = _sequence(spark, sf_dir)
    order = Window.partitionBy("user_id").orderBy("ts", "item_rank", "event_id")
    return ss.recover(m, b, "user_id", "ts").select("user_id", "event_id", "item_rank", "pre_compaction", F.row_number().over(order).cast("long").alias("pos"))


@query("""
WITH b AS (SELECT user_id, max(ts) AS last_b, count(*) AS boundary_count FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT b.user_id, boundary_count, count(e.event_id) AS recovered_count FROM b LEFT JOIN events e ON e.user_id = b.user_id AND e.event_type <> 'error' AND e.ts < b.last_b GROUP BY b.user_id, boundary_count""")
def recover_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.recovery_counts(*_sequence(spark, sf_dir), "user_id", "ts")


@query("""
WITH b AS (SELECT event_id, user_id, event_id - 1 AS parent FROM events WHERE event_type = 'error')
SELECT user_id, count(*) AS cross_file FROM b WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type <> 'error' AND e.user_id = b.user_id AND e.event_id = b.parent) GROUP BY user_id""")
def cross_ref_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b = _sequence(spark, sf_dir)
    missing = ss.cross_file(b.withColumn("parent", F.col("event_id") - 1), m, "user_id", "parent", "event_id")
    return missing.groupBy("user_id").agg(F.count("*").alias("cross_file"))


@query("SELECT conv_id, turn, role, (lag(conv_id) OVER (ORDER BY conv_id, turn) IS DISTINCT FROM conv_id) AS is_first FROM conversations")
def session_change_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.first_of_session(_table(spark, sf_dir, "conversations"), "conv_id", F.col("turn")).select("conv_id", "turn", "role", "is_first")


@query("""
WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT 'range' AS kind, conv_id, turn, role, i, total FROM n WHERE i BETWEEN 2 AND 4
UNION ALL SELECT 'tail', conv_id, turn, role, i, total FROM n WHERE i > total - 2
UNION ALL SELECT 'head', conv_id, turn, role, i, total FROM n WHERE i <= 1""")
def transcript_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    parts = [ss.window(c, "conv_id", F.col("turn"), **{f"{k}_" if k == "range" else k: x}).withColumn("kind", F.lit(k)) for k, x in (("range", "2:4"), ("tail", 2), ("head", 1))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- trees


@query(r"""
WITH s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/w/' || (page_id % 7) || '/.claude/worktrees/t' || (page_id % 5) || '/x' WHEN page_id % 11 = 0 THEN NULL ELSE '/w/' || (page_id % 7) END AS cwd,
  CASE WHEN page_id % 4 = 0 THEN '/r/' || (page_id % 2) END AS orig FROM pages),
c AS (SELECT page_id, coalesce(orig, CASE WHEN instr(cwd, '/.claude/worktrees/') > 0 THEN split_part(cwd, '/.claude/worktrees/', 1) ELSE coalesce(cwd, '(unknown)') END) AS repo,
  CASE WHEN orig IS NOT NULL THEN 'wt' WHEN instr(cwd, '/.claude/worktrees/') > 0 THEN split_part(split_part(cwd, '/.claude/worktrees/', 2), '/', 1) END AS worktree,
  CASE WHEN orig IS NOT NULL THEN 'explicit' WHEN instr(cwd, '/.claude/worktrees/') > 0 THEN 'inferred' END AS confidence FROM s)
SELECT repo, worktree, min(confidence) AS confidence, count(*) AS session_count FROM c GROUP BY repo, worktree""")
def worktree_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    text = lambda c: c.cast("string")
    plain = F.concat(F.lit("/w/"), text(i % 7))
    sessions = _table(spark, sf_dir, "pages").select(
        text(i).alias("session_key"), text(i).alias("session_id"), F.when(i % 3 == 0, F.concat(plain, F.lit("/.claude/worktrees/t"), text(i % 5), F.lit("/x"))).when(i % 11 == 0, F.lit(None)).otherwise(plain).alias("project_path"),
        F.lit("").alias("title"), F.lit("p").alias("project_name"), i.alias("last_ts"), F.lit(1).alias("message_count"), i.alias("page_id"),
    )
    records = sessions.filter(i % 4 == 0).select("session_key", F.lit(1).alias("line_no"), F.concat(F.lit("/r/"), text(i % 2)).alias("original_cwd"), F.lit("wt").alias("worktree_name"), F.lit("b").alias("branch"))
    return ss.topology(sessions, records).select("repo", "worktree", "confidence", "session_count")


@query("""
WITH l AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS last_date FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, o_orderkey AS last_order, last_date FROM customer LEFT JOIN l ON c_custkey = o_custkey""")
def latest_record_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = tables.latest(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"))
    c = _table(spark, sf_dir, "customer")
    return c.join(last, c.c_custkey == last.o_custkey, "left").select("c_custkey", "c_name", F.col("o_orderkey").alias("last_order"), F.col("o_orderdate").alias("last_date"))


# ---- vectors and fusion


def _query_vector(e: DataFrame) -> DataFrame:
    """The embedding of row 0, as one row to be broadcast."""
    return F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))


_DOT = "SELECT e.vec_id, e.label, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0 LIMIT 1) q"


@query(f"WITH d AS ({_DOT}) SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS pos, vec_id, score FROM d ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return v.similar(e.crossJoin(_query_vector(e)), F.col("q"), 20, "vec_id", "embedding")


@query("""WITH d AS (SELECT q.vec_id AS query, e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q),
r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS pos, vec_id, score FROM d) SELECT * FROM r WHERE pos <= 20""")
def cosine_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are all rows whose id is divisible by 50."""
    e = _table(spark, sf_dir, "embeddings")
    return v.similar_many(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")), 20, "vec_id", "embedding")


@query(f"WITH d AS ({_DOT}) SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM d) WHERE k = 1")
def best_chunk_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return v.best_chunk(e.crossJoin(_query_vector(e)), F.col("q"), "label", "vec_id", "embedding")


@query(f"""
WITH {_bm25_sql('documents', 'doc_id', [['thing'], ['thble']])},
a AS (SELECT doc_id, row_number() OVER (ORDER BY rank, doc_id) AS left_pos FROM scored ORDER BY rank, doc_id LIMIT 60),
b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS right_pos FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60),
f AS (SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + left_pos), 0) + coalesce(1.0::DOUBLE / (60 + right_pos), 0), 12) AS score, left_pos, right_pos FROM a FULL JOIN b USING (doc_id))
SELECT row_number() OVER (ORDER BY score DESC, left_pos NULLS LAST, doc_id) AS pos, doc_id, score, left_pos, right_pos FROM f ORDER BY score DESC, left_pos NULLS LAST, doc_id LIMIT 20""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    hits = s.scored(docs.select("doc_id", "text"), "thing thble").withColumn("rank", F.round("rank", 9))
    left = s.with_position(hits.select("doc_id", "rank"), 60, F.col("rank"), F.col("doc_id"))
    right = s.with_position(docs.select("doc_id", "n_chars"), 60, F.col("n_chars").desc(), F.col("doc_id"))
    return s.fuse(left, right, 20, "doc_id")


@query(f"""
WITH {_bm25_sql('conversations', 'conv_id, turn, role', [['thing']])},
k1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank, turn) AS k FROM (SELECT * FROM scored ORDER BY rank, conv_id, turn LIMIT 1200)),
a AS (SELECT conv_id AS session_id, turn, rank, row_number() OVER (ORDER BY rank, conv_id, turn) AS left_pos FROM k1 WHERE k = 1 ORDER BY rank, conv_id, turn LIMIT 60),
d AS ({_DOT}),
b AS (SELECT vec_id AS session_id, row_number() OVER (ORDER BY score DESC, vec_id) AS right_pos FROM d ORDER BY score DESC, vec_id LIMIT 60),
f AS (SELECT session_id, turn, rank, round(coalesce(1.0::DOUBLE / (60 + left_pos), 0) + coalesce(1.0::DOUBLE / (60 + right_pos), 0), 12) AS score, left_pos, right_pos FROM a FULL JOIN b USING (session_id))
SELECT row_number() OVER (ORDER BY score DESC, left_pos NULLS LAST, session_id) AS pos, session_id, score, coalesce(rank, 0.0) AS rank, coalesce(turn, 0)::BIGINT AS line_no, left_pos, right_pos
FROM f ORDER BY score DESC, left_pos NULLS LAST, session_id LIMIT 20""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    vectors = e.crossJoin(_query_vector(e)).select(F.col("vec_id").alias("session_id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vec"), "q")
    return v.hybrid_search(_bodies(_table(spark, sf_dir, "conversations")), vectors, "thing", F.col("q"), 20)


@query(r"""
WITH RECURSIVE m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, trim(text, E' \t\n\r\x0b\f') AS t FROM conversations WHERE role = 'user' AND trim(text, E' \t\n\r\x0b\f') <> ''),
r AS (
  SELECT conv_id, 0::BIGINT AS i, ''::VARCHAR AS open, []::VARCHAR[] AS done FROM (SELECT DISTINCT conv_id FROM m)
  UNION ALL
  SELECT r.conv_id, m.i,
    CASE WHEN strlen(m.t) > 1200 THEN '' WHEN r.open = '' OR strlen(r.open) + 1 + strlen(m.t) > 1200 THEN m.t ELSE r.open || chr(10) || m.t END,
    CASE WHEN strlen(m.t) > 1200 THEN list_concat(CASE WHEN r.open = '' THEN r.done ELSE list_append(r.done, r.open) END, list_transform(range(0, (length(m.t) - 1) // 1200 + 1), lambda k: substr(m.t, k * 1200 + 1, 1200)))
         WHEN r.open <> '' AND strlen(r.open) + 1 + strlen(m.t) > 1200 THEN list_append(r.done, r.open) ELSE r.done END
  FROM r JOIN m ON m.conv_id = r.conv_id AND m.i = r.i + 1),
l AS (SELECT conv_id, arg_max(CASE WHEN open = '' THEN done ELSE list_append(done, open) END, i) AS c FROM r GROUP BY conv_id)
SELECT conv_id, unnest(range(len(c))) AS ordinal, unnest(c) AS text FROM l""")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _table(spark, sf_dir, "conversations").filter("role = 'user'")
    return v.chunk_sessions(users, "conv_id", "turn", "text").withColumn("ordinal", F.col("ordinal").cast("long"))


# ---- mining


@query("""
WITH RECURSIVE d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (
  SELECT doc_id, source, i, 0::BIGINT AS shard, n_chars AS filled FROM d WHERE i = 1
  UNION ALL
  SELECT d.doc_id, d.source, d.i, CASE WHEN r.filled >= 20000 THEN r.shard + 1 ELSE r.shard END, CASE WHEN r.filled >= 20000 THEN d.n_chars ELSE r.filled + d.n_chars END
  FROM r JOIN d ON d.source = r.source AND d.i = r.i + 1)
SELECT source, doc_id, shard FROM r""")
def shard_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return mining.shards(docs, "n_chars", ["doc_id"], ["source"], 20_000).select("source", "doc_id", "shard")


@query(f"""
SELECT doc_id, CASE WHEN length({_COLLAPSED}) <= 2000 THEN {_COLLAPSED}
  ELSE left({_COLLAPSED}, 1000) || ' …[' || (length({_COLLAPSED}) - 1500) || ' chars cut]… ' || right({_COLLAPSED}, 500) END AS cropped FROM documents""")
def crop_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", tx.crop(F.col("text")).alias("cropped"))


@query(rf"SELECT doc_id, regexp_matches(trim(text, E' \t\n\r\x0b\f'), '{mining.NOISE}') OR trim(text, E' \t\n\r\x0b\f') = '' AS noise, regexp_matches(text, '(?i)^(the|and|is)\b') AS stop_start FROM documents")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", mining.is_noise(t).alias("noise"), t.rlike(r"(?i)^(the|and|is)\b").alias("stop_start"))


RULES = {"shouting": r"(?i)[a-z]!!", "token": r"token = ", "mail": r"@mail\d", "licence": r"Licensed under", "number": r"\d{16}"}
_RULES_SQL = " UNION ALL ".join(f"SELECT '{k}' AS rule, count(DISTINCT doc_id) FILTER (WHERE regexp_matches(text, '{p}')) AS session_hits, count(DISTINCT source) FILTER (WHERE regexp_matches(text, '{p}')) AS projects_seen, count(DISTINCT doc_id) AS sessions, count(DISTINCT source) AS projects FROM documents" for k, p in RULES.items())


@query(_RULES_SQL)
def rule_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.prevalence(_table(spark, sf_dir, "documents"), RULES, "doc_id", "source")


@query(f"""
WITH p AS ({_RULES_SQL}), t AS (SELECT *, CASE WHEN session_hits * 20 >= sessions THEN 0 WHEN projects_seen >= 6 OR session_hits >= 25 THEN 1 END AS tier FROM p)
SELECT row_number() OVER (ORDER BY tier, CASE WHEN tier = 0 THEN session_hits ELSE projects_seen END DESC, rule) AS pos, rule, session_hits, projects_seen, tier FROM t WHERE tier IS NOT NULL""")
def keep_and_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rule_prevalence(spark, sf_dir).withColumn("keep", F.col("session_hits") * 20 >= F.col("sessions"))
    return mining.keep_or_rescue(p).select("pos", "rule", "session_hits", "projects_seen", "tier")


@query(r"""
WITH f AS (SELECT trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}]+', ' ', 'g')) AS n, split_part(text, chr(10), 1) AS rule FROM documents),
g AS (SELECT min(rule) AS rule, count(*) AS votes FROM f GROUP BY n)
SELECT row_number() OVER (ORDER BY votes DESC, rule) AS pos, rule, votes FROM g ORDER BY votes DESC, rule LIMIT 16""")
def consolidate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.consolidate(_table(spark, sf_dir, "documents").select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("rule")))


@query(f"SELECT doc_id, CASE WHEN length({_COLLAPSED}) <= 140 THEN {_COLLAPSED} ELSE '…' || left({_COLLAPSED}, 140) || '…' END AS snippet FROM documents")
def snippet_140(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", tx.excerpt(F.col("text")).alias("snippet"))


@query("""SELECT c_custkey, 'cd ' || CASE WHEN c_custkey % 3 = 0 THEN '''/home/it''\\''''s ' || c_custkey || '''' ELSE '/home/' || c_custkey END || ' && claude --resume ' || c_name AS command FROM customer""")
def resume_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("session_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("/home/it's "), k)).otherwise(F.concat(F.lit("/home/"), k)).alias("project_path"))
    return ss.resume_command(c).join(c, "session_id").select("c_custkey", "command")


# ---- upkeep of tables


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 6 <> 0)
SELECT o_orderkey, CASE WHEN o.o_totalprice IS NULL THEN 'added' WHEN n.o_totalprice IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (o_orderkey)
WHERE o.o_totalprice IS NULL OR n.o_totalprice IS NULL OR o.o_totalprice <> n.o_totalprice""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.filter("o_orderkey % 6 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return tables.snapshot_diff(o.filter("o_orderkey % 5 <> 0"), new, "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1 AND o_custkey % 2 = 0
UNION ALL
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_custkey % 2 = 1) WHERE k = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    old = o.groupBy("o_custkey").agg(F.min_by(F.struct(*o.columns), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("r.*")
    new = tables.latest(o.filter("o_custkey % 2 = 0"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"))
    return tables.upsert(old, new, ["o_custkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_search_body(spark, sf_dir)
