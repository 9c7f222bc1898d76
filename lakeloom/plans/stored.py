"""Registered queries over a session store: the conversations as transcripts, indexed, then asked through the engine.

Each conversation becomes a session file: a generated title, a line for each turn (users as plain text, assistants as a
text and a tool call, system turns as compaction boundaries), and for some a title of their own, a worktree record and
a broken line. The files go through the reader, the store and the engine like any others. A store is made once for
each session and data folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mining, search, vectors
from ..operators import sessions as ss
from ..sources.store import Store
from .engine import Engine
from .queries import _bm25_sql, _table, query

_STORES: dict[tuple[str, str], Store] = {}


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_key, mtime_us, size, content) of a file for each conversation."""
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    cid = F.col("conv_id")
    name = cid.cast("string")
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")

    def line(t: Column, i: Column) -> Column:
        own = text(name, "-", i.cast("string"))
        parent = F.when(i > 0, text(name, "-", (i - 1).cast("string")))
        at = text("2026-01-01T", two((i / 60).cast("int")), ":", two(i % 60), ":00.000Z")
        known = [own.alias("uuid"), at.alias("timestamp")]
        user = F.to_json(F.struct(F.lit("user").alias("type"), *known, parent.alias("parentUuid"), text("/w/p", (cid % 5).cast("string")).alias("cwd"), F.struct(F.lit("user").alias("role"), t.text.alias("content")).alias("message")))
        call = text('{"id":"t","input":{"q":"needle ', name, '","o":{"b":"y","a":["x",3]}},"name":"Search","type":"tool_use"}')
        said = F.to_json(F.struct(F.lit("text").alias("type"), t.text.alias("text")))
        assistant = text('{"type":"assistant","uuid":"', own, '","parentUuid":"', F.coalesce(parent, F.lit("")), '","timestamp":"', at, '","message":{"role":"assistant","content":[', said, ",", call, "]}}")
        meta = F.struct(F.lit("auto").alias("trigger"), (i + 1000).alias("preTokens"), i.alias("postTokens")).alias("compactMetadata")
        system = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), *known, parent.alias("logicalParentUuid"), meta))
        return F.when(t.role == "user", user).when(t.role == "assistant", assistant).otherwise(system)

    only = lambda n, x: F.when(cid % n == 0, F.array(x)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(text('{"type":"ai-title","aiTitle":"Talk ', name, '"}')),
        F.transform("turns", line),
        only(4, text('{"type":"custom-title","customTitle":"Named ', name, '"}')),
        only(3, text('{"type":"worktree-state","worktreeSession":{"originalCwd":"/r/', (cid % 2).cast("string"), '","worktreeName":"wt","worktreeBranch":"b', (cid % 6).cast("string"), '"}}')),
        only(5, F.lit('{"broken')),
    )
    made = c.select(text("/projects/p", (cid % 3).cast("string"), "/", name, ".jsonl").alias("session_key"), F.lit(1000).cast("long").alias("mtime_us"), F.encode(F.array_join(lines, "\n"), "UTF-8").alias("content"))
    return made.select("session_key", "mtime_us", F.octet_length("content").cast("long").alias("size"), "content")


def new_store(spark: SparkSession) -> Store:
    """An empty store in the shared folder; in local mode without one, in a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lakeloom-store-")
    return Store(spark, f"{at.rstrip('/')}/store-{uuid.uuid4().hex}", buckets=8)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = new_store(spark)
        store.refresh_files(transcripts(spark, sf_dir))
        _STORES[key] = store
    return Engine(_STORES[key], vectors.hashing_embedder())


def drop_stores(spark: SparkSession) -> None:
    """Delete the stores that these queries made, once their results have been taken."""
    for key in [k for k in _STORES if k[0] == spark.sparkContext.applicationId]:
        store = _STORES.pop(key)
        store._delete(store.root)


# What the transcripts say, in SQL.
_T = """t AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
m AS (SELECT c, c::VARCHAR AS session_id, i + 2 AS line_no, i, role, text AS said, c || '-' || i AS uuid,
  CASE WHEN i > 0 THEN c || '-' || (i - 1) WHEN role = 'assistant' THEN '' END AS parent_uuid, 1767225600000 + i * 60000 AS ts,
  CASE WHEN role = 'user' THEN text WHEN text = '' THEN 'Search x y needle ' || c ELSE text || chr(10) || 'Search x y needle ' || c END AS text
  FROM t WHERE role IN ('user', 'assistant')),
b AS (SELECT c, i + 2 AS line_no, i, c || '-' || i AS uuid, CASE WHEN i > 0 THEN c || '-' || (i - 1) END AS parent FROM t WHERE role NOT IN ('user', 'assistant')),
s AS (SELECT c, c::VARCHAR AS session_id, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS message_count, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) > 0 AS has_compaction,
  1767225600000 + min(i) * 60000 AS first_ts, 1767225600000 + max(i) * 60000 AS last_ts, CASE WHEN count(*) FILTER (WHERE role = 'user') > 0 THEN '/w/p' || (c % 5) END AS project_path,
  CASE WHEN count(*) FILTER (WHERE role = 'user') > 0 THEN 'p' || (c % 5) ELSE 'p' || (c % 3) END AS project, CASE WHEN c % 4 = 0 THEN 'Named ' || c ELSE 'Talk ' || c END AS title, count(*) AS n FROM t GROUP BY c)"""


def _ids(e: Engine) -> DataFrame:
    return e.store.sessions().select("session_key", "session_id")


@query(f"WITH {_T} SELECT session_id, line_no, uuid, parent_uuid, role AS rec_type, role, ts, CASE WHEN role = 'user' AND said = '' THEN NULL ELSE 'text' END AS first_kind, text FROM m")
def store_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    rows = e.store.messages().join(_ids(e), "session_key")
    return rows.select("session_id", F.col("line_no").cast("long").alias("line_no"), "uuid", "parent_uuid", "rec_type", "role", "ts", "first_kind", F.col("text_for_fts").alias("text"))


@query(f"WITH {_T} SELECT c::VARCHAR AS session_id, line_no, uuid, parent AS logical_parent_uuid, 'auto' AS trigger, 1000 + i AS pre_tokens, i AS post_tokens, 1767225600000 + i * 60000 AS ts FROM b")
def store_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    rows = e.store.table("boundaries").join(_ids(e), "session_key")
    return rows.select("session_id", F.col("line_no").cast("long").alias("line_no"), "uuid", "logical_parent_uuid", "trigger", "pre_tokens", "post_tokens", "ts")


@query(f"WITH {_T} SELECT session_id, project_path, project AS project_name, first_ts, last_ts, title, message_count, has_compaction FROM s")
def store_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).store.all_sessions().select("session_id", "project_path", "project_name", "first_ts", "last_ts", "title", "message_count", "has_compaction")


@query(f"WITH {_T} SELECT session_id, n + 2 + (c % 4 = 0)::INT + (c % 3 = 0)::INT AS line_no FROM s WHERE c % 5 = 0")
def store_skipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return e.store.table("skipped_lines").join(_ids(e), "session_key").select("session_id", F.col("line_no").cast("long").alias("line_no"))


@query(f"""WITH {_T}, o AS (SELECT m.*, s.project, s.title, s.first_ts FROM m JOIN s USING (c) WHERE m.role = 'user' AND m.text <> '' AND NOT starts_with(m.text, '<') AND NOT starts_with(m.text, '/') AND NOT starts_with(m.text, '['))
SELECT session_id, project, title, ts, text FROM o""")
def store_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).messages("user").select("session_id", "project", "title", "ts", "text")


_CLASSIFIED = """k AS (SELECT *, CASE WHEN c % 3 = 0 THEN '/r/' || (c % 2) ELSE coalesce(project_path, '(unknown)') END AS repo, CASE WHEN c % 3 = 0 THEN 'wt' END AS worktree, CASE WHEN c % 3 = 0 THEN 'b' || (c % 6) END AS branch FROM s)"""
_TREE = """SELECT repo, worktree, arg_min(branch, (-last_ts, session_id)) AS branch, CASE WHEN worktree IS NOT NULL THEN 'explicit' END AS confidence, count(*) AS session_count, sum(message_count)::BIGINT AS message_count,
  string_agg(session_id, ',' ORDER BY last_ts DESC, session_id) AS session_ids FROM k {} GROUP BY repo, worktree"""


def _joined(tree: DataFrame) -> DataFrame:
    return tree.withColumn("session_ids", F.array_join("session_ids", ","))


@query(f"WITH {_T}, {_CLASSIFIED} {_TREE.format('')}")
def store_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(engine(spark, sf_dir).tree())


@query(f"WITH {_T}, {_CLASSIFIED} {_TREE.format("WHERE contains(lower(concat_ws(' ', repo, project, title)), 'named 1')")}")
def store_tree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(engine(spark, sf_dir).tree("NAMED 1"))


@query(f"""WITH {_T}, l AS (SELECT c, max(line_no) AS last FROM b GROUP BY c),
q AS (SELECT m.c, m.line_no, 1 AS k, CASE WHEN trim(regexp_replace(m.said, '\\s+', ' ', 'g')) = '' AND m.role = 'user' THEN NULL ELSE '## ' || m.role || CASE WHEN m.line_no < l.last THEN '  ⟨pre-compaction · hidden by UI⟩' ELSE '' END || chr(10) ||
  CASE WHEN m.role = 'user' THEN regexp_replace(m.said, '\\s+$', '') ELSE regexp_replace(m.said, '\\s+$', '') || chr(10) || '  → Search({{"o":{{"a":["x",3],"b":"y"}},"q":"needle ' || m.c || '"}})' END END AS chunk FROM m LEFT JOIN l ON l.c = m.c
  UNION ALL SELECT c, line_no, 0, '─── ⟪ compaction boundary · auto · ' || (1000 + i) || '→' || i || ' tokens ⟫ ───' FROM b),
n AS (SELECT c, chunk, row_number() OVER (PARTITION BY c ORDER BY line_no, k) AS i, count(*) OVER (PARTITION BY c) AS total FROM q WHERE chunk IS NOT NULL)
SELECT c::VARCHAR AS session_id, i, total, chunk FROM n WHERE total <= 6 OR i > total - 6""")
def store_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    sequence = ss.recover(e.store.messages(), e.store.table("boundaries").drop("bucket"))
    shown = ss.window(ss.rendered(sequence), "session_key", F.col("line_no"), F.col("item_rank"), cap=6)
    return shown.join(_ids(e), "session_key").select("session_id", "i", "total", "chunk")


@query(f"""WITH {_T}, l AS (SELECT c, max(line_no) AS last, count(*) AS boundary_count FROM b GROUP BY c),
x AS (SELECT b.c, count(*) AS cross_file FROM b WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.c = b.c AND m.uuid = b.parent) GROUP BY b.c)
SELECT l.c::VARCHAR AS session_id, boundary_count, count(m.c) AS recovered_count, coalesce(any_value(cross_file), 0) AS cross_file FROM l LEFT JOIN m ON m.c = l.c AND m.line_no < l.last LEFT JOIN x ON x.c = l.c GROUP BY l.c, boundary_count""")
def store_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    m, b = e.store.messages(), e.store.table("boundaries").drop("bucket")
    missing = ss.cross_file(b, m).groupBy("session_key").agg(F.count("*").alias("cross_file"))
    counts = ss.recovery_counts(m, b).join(missing, "session_key", "left").join(_ids(e), "session_key")
    return counts.select("session_id", "boundary_count", "recovered_count", F.coalesce("cross_file", F.lit(0)).cast("long").alias("cross_file"))


@query(f"""WITH {_T}, z AS (WITH {_bm25_sql('m', 'session_id, line_no', [['from'], ['ther']])} SELECT * FROM scored),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank, line_no) AS k FROM (SELECT * FROM z ORDER BY rank, session_id, line_no LIMIT 400)) WHERE k = 1),
top AS (SELECT row_number() OVER (ORDER BY rank, session_id, line_no) AS pos, session_id, line_no, rank FROM best ORDER BY rank, session_id, line_no LIMIT 20)
SELECT pos, 1 AS tier, top.session_id, line_no, rank, project, title FROM top JOIN s ON s.session_id = top.session_id""")
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words are such that no other word of the tables shares their stems, which SQL can't make."""
    return engine(spark, sf_dir).search("from ther").drop("snippet")


@query(f"""WITH {_T}, h AS (SELECT s.session_id, project, title FROM s WHERE c % 4 = 0)
SELECT row_number() OVER (ORDER BY session_id) AS pos, 0 AS tier, session_id, 0::BIGINT AS line_no, project, title, replace(title, 'Named', '[Named]') AS snippet FROM h ORDER BY session_id LIMIT 20""")
def store_title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).search("naming").drop("rank")


@query(f"""WITH {_T}, base AS (SELECT count(*) AS files, count(*) FILTER (WHERE c % 5 = 0) AS bad, count(*) FILTER (WHERE c % 7 = 0) AS changed, count(*) FILTER (WHERE c % 35 = 0) AS bad_changed FROM s)
SELECT 'cold' AS run, files AS files_seen, files AS indexed, 0::BIGINT AS skipped_unchanged, bad AS parse_skipped_lines, (SELECT count(*) FROM m) AS messages FROM base
UNION ALL SELECT 'again', files, 0, files, 0, (SELECT count(*) FROM m) FROM base
UNION ALL SELECT 'changed', files, changed, files - changed, 0, (SELECT count(*) FROM m WHERE c % 7 <> 0) + (SELECT count(*) FROM s WHERE c % 7 = 0) FROM base""")
def store_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's counts after a first refresh, after one of the same files, and after one with some files replaced."""
    store, files = new_store(spark), transcripts(spark, sf_dir)
    short = F.encode(F.lit('{"type":"user","uuid":"u","message":{"role":"user","content":"all new"}}'), "UTF-8")
    changed = F.regexp_extract("session_key", r"(\d+)\.jsonl$", 1).cast("long") % 7 == 0
    other = files.withColumns({"content": F.when(changed, short).otherwise(F.col("content")), "mtime_us": F.when(changed, 2000).otherwise(F.col("mtime_us"))})
    rows = []
    for run, given in (("cold", files), ("again", files), ("changed", other)):
        r = store.refresh_files(given)
        rows.append((run, r.files_seen, r.indexed, r.skipped_unchanged, r.parse_skipped_lines, store.messages().count()))
    store._delete(store.root)
    return spark.createDataFrame(rows, "run string, files_seen long, indexed long, skipped_unchanged long, parse_skipped_lines long, messages long")


@query(f"""WITH {_T}, f AS (SELECT session_id, line_no FROM m WHERE text <> '' AND len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) > 0)
SELECT session_id, line_no, CASE WHEN line_no % 5 = 0 THEN 'missing' ELSE 'differs' END AS problem FROM f WHERE line_no % 5 = 0 OR line_no % 7 = 0 UNION ALL SELECT session_id, 100000, 'orphan' FROM s WHERE c % 10 = 0 AND message_count > 0""")
def store_index_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term index with lines dropped, changed and made up, checked against the messages."""
    e = engine(spark, sf_dir)
    terms = e.store.table("terms").drop("bucket")
    postings = F.filter("postings", lambda p: p.line_no % 5 != 0)
    moved = F.transform(postings, lambda p: F.struct(p.line_no.alias("line_no"), p.role.alias("role"), F.when(p.line_no % 7 == 0, p.length + 1).otherwise(p.length).alias("length"), p.positions.alias("positions")))
    damaged = terms.withColumn("postings", moved)
    cid = F.regexp_extract("session_key", r"(\d+)\.jsonl$", 1).cast("long")
    made_up = e.store.messages().select("session_key").distinct().filter(cid % 10 == 0).select("session_key", F.lit("ghost").alias("term"), F.array(F.struct(F.lit(100000).alias("line_no"), F.lit("user").alias("role"), F.lit(1).alias("length"), F.array(F.lit(0)).alias("positions"))).alias("postings"))
    found = search.term_index_problems(damaged.unionByName(made_up), e.store.messages())
    return found.join(_ids(e), "session_key").select("session_id", F.col("line_no").cast("long").alias("line_no"), "problem")


@query(f"""WITH {_T}, c AS (SELECT 'sessions' AS item, (SELECT count(*) FROM s) AS value UNION ALL SELECT 'messages', (SELECT count(*) FROM m) UNION ALL SELECT 'skipped_lines', (SELECT count(*) FROM s WHERE c % 5 = 0))
SELECT item, value::VARCHAR AS value FROM c""")
def store_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).doctor().filter(F.col("item").isin("sessions", "messages", "skipped_lines"))


@query(f"""WITH {_T} SELECT table_name, rows FROM (SELECT 'messages' AS table_name, (SELECT count(*) FROM m WHERE c % 9 = 0) AS rows UNION ALL SELECT 'boundaries', (SELECT count(*) FROM b WHERE c % 9 = 0) UNION ALL SELECT 'worktrees', (SELECT count(*) FROM s WHERE c % 9 = 0)) WHERE rows > 0""")
def store_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose session is gone, in a store from which some sessions were taken."""
    e = engine(spark, sf_dir)

    class Damaged(Store):
        def table(self, name: str) -> DataFrame:
            rows = super().table(name)
            return rows.filter(F.regexp_extract("session_key", r"(\d+)\.jsonl$", 1).cast("long") % 9 != 0) if name == "sessions" else rows

    return Damaged(spark, e.store.root, e.store.buckets).orphans()


@query(f"WITH {_T} SELECT session_id, CASE WHEN project_path IS NULL THEN '' ELSE 'cd ' || project_path || ' && ' END || 'claude --resume ' || session_id AS command FROM s")
def store_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.resume_command(engine(spark, sf_dir).store.sessions())


@query(f"""WITH RECURSIVE {_T}, o AS (SELECT m.*, s.project, s.title, s.first_ts FROM m JOIN s USING (c) WHERE m.role = 'user' AND m.text <> '' AND NOT starts_with(m.text, '<') AND NOT starts_with(m.text, '/') AND NOT starts_with(m.text, '[')),
x AS (SELECT c, line_no, project, first_ts, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS w FROM o WHERE NOT regexp_matches(trim(text, E' \\t\\n\\r\\x0b\\f'), '{mining.NOISE}') AND trim(text, E' \\t\\n\\r\\x0b\\f') <> ''),
y AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY line_no) AS k FROM x),
l AS (SELECT c, line_no, row_number() OVER (ORDER BY first_ts, '/projects/p' || (c % 3) || '/' || c || '.jsonl', line_no) AS i, CASE WHEN k = 1 THEN chr(10) || '--- session [' || project || '] ---' || chr(10) ELSE '' END || '• ' ||
  CASE WHEN length(w) <= 2000 THEN w ELSE left(w, 1000) || ' …[' || (length(w) - 1500) || ' chars cut]… ' || right(w, 500) END || chr(10) AS line FROM y),
r AS (SELECT i, c, line_no, line, 0::BIGINT AS shard, length(line) AS filled FROM l WHERE i = 1
  UNION ALL SELECT l.i, l.c, l.line_no, l.line, CASE WHEN r.filled >= 5000 THEN r.shard + 1 ELSE r.shard END, CASE WHEN r.filled >= 5000 THEN length(l.line) ELSE r.filled + length(l.line) END FROM r JOIN l ON l.i = r.i + 1)
SELECT c::VARCHAR AS session_id, line_no, shard, line FROM r""")
def mining_prose_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    lines = mining.prose_lines(ss.prose(e.store.messages(), e.store.sessions(), keys=True), ["first_ts", "session_key", "line_no"], budget=5000)
    return lines.select("session_id", F.col("line_no").cast("long").alias("line_no"), "shard", "line")


@query(f"""WITH RECURSIVE {_T}, o AS (SELECT m.*, s.project, s.title FROM m JOIN s USING (c) WHERE m.role = 'user' AND m.text <> '' AND NOT starts_with(m.text, '<') AND NOT starts_with(m.text, '/') AND NOT starts_with(m.text, '[') AND m.c % 2 = 0),
x AS (SELECT c, line_no, project, title, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS w, row_number() OVER (PARTITION BY c ORDER BY line_no) AS k FROM o),
l AS (SELECT c, line_no, CASE WHEN k = 1 THEN chr(10) || '===== session [' || project || '] ' || left(title, 60) || ' =====' || chr(10) ELSE '' END || '• ' ||
  CASE WHEN length(w) <= 2000 THEN w ELSE left(w, 1000) || ' …[' || (length(w) - 1500) || ' chars cut]… ' || right(w, 500) END || chr(10) AS line FROM x),
g AS (SELECT c, sum(length(line))::BIGINT AS size, row_number() OVER (ORDER BY c::VARCHAR) AS i FROM l GROUP BY c),
r AS (SELECT i, c, 0::BIGINT AS shard, size AS filled FROM g WHERE i = 1
  UNION ALL SELECT g.i, g.c, CASE WHEN r.filled >= 5000 THEN r.shard + 1 ELSE r.shard END, CASE WHEN r.filled >= 5000 THEN g.size ELSE r.filled + g.size END FROM r JOIN g ON g.i = r.i + 1)
SELECT l.c::VARCHAR AS session_id, line_no, shard, line FROM l JOIN r USING (c)""")
def mining_topic_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    ids = e.store.sessions().filter(F.col("session_id").cast("long") % 2 == 0).select(F.concat(F.lit(" "), "session_id").alias("id"))
    topic = mining.id_list(ids.union(ids).union(spark.createDataFrame([("  ",)], "id string")), "id")
    lines = mining.topic_lines(ss.prose(e.store.messages(), e.store.sessions(), keys=True), topic, ["first_ts", "session_key", "line_no"], budget=5000)
    return lines.select("session_id", F.col("line_no").cast("long").alias("line_no"), "shard", "line")


@query(r"""
WITH d AS (SELECT c_custkey AS id, '{"t":' || c_custkey || ',"k":"' || c_mktsegment || '","a":["' || c_name || '",5,{"z":"last","b":null}]}' AS j FROM customer)
SELECT c_custkey, c_name || ' last ' || c_mktsegment AS leaves FROM customer""")
def json_scalar_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings of a JSON value by sorted keys, as a tool call's input is made searchable."""
    from ..functions.blocks import leaves_of

    c = _table(spark, sf_dir, "customer")
    j = F.concat(F.lit('{"t":'), F.col("c_custkey").cast("string"), F.lit(',"k":"'), "c_mktsegment", F.lit('","a":["'), "c_name", F.lit('",5,{"z":"last","b":null}]}'))
    return c.select("c_custkey", leaves_of(j).alias("leaves"))
