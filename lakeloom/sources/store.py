"""The session store: typed Parquet tables in hash buckets, refreshed file by file.

A refresh reads only files whose (modification time, size) are new, and rewrites only the buckets that hold
them: what other files have there, and the new rows. The manifest is written last, so a refresh that breaks
off is done again by the next one; repeating one changes nothing. Aliases are appended and resolved on read.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.stem import stem, stem_all
from ..functions.text import tokens, words
from ..operators.search import TERM_INDEX, term_index, term_index_problems
from .transcripts import BOUNDARY, MESSAGE, RECORD, WORKTREE, discover, read_records, sessions_of

SCHEMA_VERSION = 2
SCHEMAS = {
    "file_manifest": "session_key string, source_kind string, mtime_us long, size long, parser_version int, scan_started_at long, scan_finished_at long",
    "sessions": "session_key string, session_id string, source_kind string, project_path string, project_name string, first_ts long, last_ts long, ai_title string, custom_title string, message_count long, has_compaction boolean, indexed_messages long, indexed_tokens long, ai_terms array<string>, custom_terms array<string>, indexed_at long",
    "messages": "session_key string, line_no int, uuid string, parent_uuid string, rec_type string, subtype string, role string, ts long, cwd string, is_sidechain boolean, is_compact_summary boolean, blocks_json string, first_kind string, text_for_fts string",
    "boundaries": "session_key string, line_no int, uuid string, parent_uuid string, logical_parent_uuid string, trigger string, pre_tokens long, post_tokens long, ts long",
    "worktrees": "session_key string, line_no int, original_cwd string, worktree_path string, worktree_name string, branch string, original_branch string, original_head string, continues_session_id string",
    "relations": "session_key string, line_no int, relation_type string, evidence string, confidence string",
    "skipped_lines": "session_key string, line_no int, reason string",
    "aliases": "session_key string, alias string, terms array<string>, set_at long",
    "terms": TERM_INDEX,
    "chunks": "session_key string, ordinal int, text string",
    "chunk_vectors": "session_key string, ordinal int, dim int, model string, vec array<float>, built_at long",
}
#: Tables written at the same time.
WRITERS = 6
BUCKETED = [t for t in SCHEMAS if t != "aliases"]


@dataclass
class RefreshStats:
    files_seen: int
    indexed: int
    skipped_unchanged: int
    parse_skipped_lines: int


class Store:
    """root: a folder that Spark reaches. buckets: fixed at the first refresh; more for more files."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def migrate(self) -> list[int]:
        """Take over what an older version's tables hold and a refresh can't make again: the aliases. The versions found.

        Everything else is read from the files anew by the next refresh. Safe to call on every open.
        """
        found = []
        for version in range(1, SCHEMA_VERSION):
            old, done = f"{self.root}/v{version}/aliases", f"{self.root}/v{version}/taken-over"
            if not self._there(f"{self.root}/v{version}"):
                continue
            found.append(version)
            if self._there(done):
                continue
            if self._there(old):
                rows = self.spark.read.schema("session_key string, alias string, set_at long").parquet(old)
                rows.select("session_key", "alias", stem_all(tokens(F.col("alias"))).alias("terms"), "set_at").coalesce(1).write.mode("append").parquet(self._path("aliases"))
            p = self.spark._jvm.org.apache.hadoop.fs.Path(done)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(p)
        return found

    # ---- tables

    def _path(self, name: str) -> str:
        return f"{self.root}/v{SCHEMA_VERSION}/{name}"

    def table(self, name: str) -> DataFrame:
        """A table's rows; without any yet, none."""
        schema = SCHEMAS[name] + (", bucket int" if name in BUCKETED else "")
        try:
            found = self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = self.spark.createDataFrame([], schema)
        return found

    def _bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col("session_key") if key is None else key), F.lit(self.buckets)).cast("int")

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def _exists(self, name: str) -> bool:
        return self._there(self._path(name))

    def _replace(self, name: str, fresh: DataFrame | None, changed: DataFrame, touched: list[int]) -> None:
        """In the touched buckets: drop the rows of changed files, add the fresh ones, empty what has none left."""
        columns = StructType.fromDDL(SCHEMAS[name]).names
        order = ["term"] if name == "terms" else []
        laid = lambda d: d.repartition("bucket").sortWithinPartitions("bucket", *order) if order else d.repartition("bucket")
        new = None if fresh is None else fresh.select(*columns).withColumn("bucket", self._bucket())
        if not self._exists(name):
            if new is not None:
                laid(new).write.partitionBy("bucket").parquet(self._path(name))
            return
        rows = self.table(name).filter(F.col("bucket").isin(touched)).join(changed.select("session_key"), "session_key", "left_anti").select(*columns, "bucket")
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"
        laid(rows if new is None else rows.unionByName(new)).write.partitionBy("bucket").parquet(staged)
        again = self.spark.read.schema(SCHEMAS[name] + ", bucket int").parquet(staged)
        # a bucket without rows writes no partition and would keep its old files
        left = {r[0] for r in again.select("bucket").distinct().collect()}
        laid(again).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._path(name))
        for b in set(touched) - left:
            self._delete(f"{self._path(name)}/bucket={b}")
        self._delete(staged)

    def drop_vectors(self, keep: str) -> None:
        """Delete the vectors of all models but one, bucket by bucket as they are."""
        name, staged = "chunk_vectors", f"{self.root}/staged-{uuid.uuid4().hex}"
        self.table(name).filter(F.col("model") == keep).repartition("bucket").write.partitionBy("bucket").parquet(staged)
        again = self.spark.read.schema(SCHEMAS[name] + ", bucket int").parquet(staged)
        again.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path(name))
        self._delete(staged)

    # ---- refresh

    def refresh(self, projects_root: str, incremental: bool = True, now_ms: int | None = None, prune_missing: bool = False) -> RefreshStats:
        """Read new and changed files. Files that are gone keep their rows unless prune_missing."""
        return self.refresh_files(discover(self.spark, projects_root), incremental, now_ms, prune_missing)

    def refresh_files(self, files: DataFrame, incremental: bool = True, now_ms: int | None = None, prune_missing: bool = False) -> RefreshStats:
        """refresh() of files (session_key, mtime_us, size, content), wherever they come from.

        The records are staged by kind, so each table reads its own only; the tables are written side by side, the
        manifest last.
        """
        now = int(time.time() * 1000) if now_ms is None else now_ms
        listing = files.select("session_key", "mtime_us", "size")
        known = self.table("file_manifest")
        todo = listing.join(known, ["session_key", "mtime_us", "size"], "left_anti") if incremental else listing
        gone = known.select("session_key").join(listing, "session_key", "left_anti") if prune_missing else None
        seen = listing.count()
        staged = f"{self.root}/records-{uuid.uuid4().hex}"
        wanted = files.join(todo.select("session_key"), "session_key", "left_semi") if incremental else files
        read_records(wanted).write.partitionBy("kind").parquet(staged)
        records = self.spark.read.schema(RECORD).parquet(staged)
        fresh = sessions_of(records)
        changed = fresh.select("session_key") if gone is None else fresh.select("session_key").union(gone)
        held = fresh.persist()
        try:
            counted = held.agg(F.count("*"), F.coalesce(F.sum("skipped_lines"), F.lit(0))).first()
            touched = sorted(r[0] for r in changed.select(self._bucket().alias("b")).distinct().collect())
            if touched:
                self._write_all(records, fresh, changed, touched, known, now)
        finally:
            held.unpersist()
        self._delete(staged)
        return RefreshStats(seen, counted[0], seen - counted[0], counted[1])

    def _write_all(self, records: DataFrame, fresh: DataFrame, changed: DataFrame, touched: list[int], known: DataFrame, now: int) -> None:
        stored = self.titles().select("session_key", F.col("custom_title").alias("stored_title"))
        sessions = fresh.join(stored, "session_key", "left").withColumns({"custom_title": F.coalesce("file_title", "stored_title"), "source_kind": F.lit("main"), "indexed_at": F.lit(now)})
        sessions = sessions.withColumns({f"{k}_terms": stem_all(tokens(F.coalesce(f"{k}_title", F.lit("")))) for k in ("ai", "custom")})
        of = lambda kind: records.filter(F.col("kind") == kind)
        tables = {
            "terms": term_index(of("message").select("session_key", "line_no", "role", "text_for_fts")),
            "messages": of("message").select("session_key", "line_no", *MESSAGE),
            "sessions": sessions,
            "boundaries": of("boundary").select("session_key", "line_no", *BOUNDARY),
            "worktrees": of("worktree").select("session_key", "line_no", *WORKTREE),
            "relations": of("bridge").select("session_key", "line_no", F.lit("bridge").alias("relation_type"), "evidence", F.lit("explicit").alias("confidence")),
            "skipped_lines": of("skipped").select("session_key", "line_no", "reason"),
            "chunks": None,
            "chunk_vectors": None,
        }
        with ThreadPoolExecutor(WRITERS) as pool:
            for done in [pool.submit(self._replace, name, rows, changed, touched) for name, rows in tables.items()]:
                done.result()
        first = known.select("session_key", F.col("scan_started_at").alias("first_scan"))
        manifest = fresh.join(first, "session_key", "left").select("session_key", F.lit("main").alias("source_kind"), "mtime_us", "size", F.lit(SCHEMA_VERSION).alias("parser_version"), F.coalesce("first_scan", F.lit(now)).alias("scan_started_at"), F.lit(now).alias("scan_finished_at"))
        self._replace("file_manifest", manifest, changed, touched)

    # ---- titles and sessions

    def set_alias(self, session_key: str, alias: str, now_ms: int | None = None) -> None:
        """Name a session. It holds at once, and over a title in the file until that file is read again."""
        if not alias.strip():
            raise ValueError("an alias can't be blank")
        now = int(time.time() * 1000) if now_ms is None else now_ms
        self.spark.createDataFrame([(session_key, alias.strip(), [stem(w) for w in words(alias)], now)], SCHEMAS["aliases"]).coalesce(1).write.mode("append").parquet(self._path("aliases"))

    def titles(self) -> DataFrame:
        """(session_key, custom_title, title_terms): the later of the stored title and the last alias, and its stems."""
        last = self.table("aliases").groupBy("session_key").agg(F.max_by(F.struct("alias", "terms"), "set_at").alias("a"), F.max("set_at").alias("set_at"))
        newer = F.col("set_at").isNotNull() & ((F.col("set_at") >= F.col("indexed_at")) | F.col("custom_title").isNull())
        return self.table("sessions").join(last, "session_key", "left").select("session_key", F.when(newer, F.col("a.alias")).otherwise(F.col("custom_title")).alias("custom_title"), F.when(newer, F.col("a.terms")).otherwise(F.col("custom_terms")).alias("title_terms"))

    def sessions(self) -> DataFrame:
        """Sessions with their titles resolved: the custom one, even empty, else the generated one, else empty."""
        s = self.table("sessions").drop("custom_title", "custom_terms", "bucket").join(self.titles(), "session_key")
        return s.withColumns({"title": F.coalesce("custom_title", "ai_title", F.lit("")), "title_terms": F.when(F.col("custom_title").isNull(), F.col("ai_terms")).otherwise(F.col("title_terms"))}).drop("ai_terms")

    def all_sessions(self) -> DataFrame:
        """Sessions, the latest first, those without a time last."""
        return self.sessions().orderBy(F.col("last_ts").desc_nulls_last(), "session_key")

    def messages(self) -> DataFrame:
        return self.table("messages").drop("bucket")

    # ---- checks

    def orphans(self) -> DataFrame:
        """(table_name, rows) of child rows whose session is missing."""
        s = self.table("sessions").select("session_key")
        parts = [self.table(t).join(s, "session_key", "left_anti").agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows") for t in ("messages", "boundaries", "worktrees", "relations", "chunks")]
        vectors = self.table("chunk_vectors").join(self.table("chunks").select("session_key", "ordinal"), ["session_key", "ordinal"], "left_anti")
        parts.append(vectors.agg(F.count("*").alias("rows")).select(F.lit("chunk_vectors").alias("table_name"), "rows"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.filter("rows > 0")

    def index_problems(self) -> DataFrame:
        """(session_key, line_no, problem) of the stored term index against the stored messages."""
        return term_index_problems(self.table("terms"), self.messages())

    def doctor(self) -> DataFrame:
        """(item, value): the store's paths and counts."""
        counts = [self.table(t).agg(F.count("*").cast("string").alias("value")).select(F.lit(t).alias("item"), "value") for t in ("sessions", "messages", "chunk_vectors", "skipped_lines")]
        out = self.spark.createDataFrame([("root", self.root), ("schema_version", str(SCHEMA_VERSION))], "item string, value string")
        for c in counts:
            out = out.union(c)
        return out
