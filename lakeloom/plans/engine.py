"""The engine over a store: index, search, messages, show, recover, tree, name, resume, doctor, export."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as s
from ..operators import sessions as ss
from ..operators import vectors as v
from ..sources.store import RefreshStats, Store


def session(app: str = "lakeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC; everything else is left to the cluster's settings unless given."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    b = b.master(master) if master else b
    for k, x in conf.items():
        b = b.config(k, x)
    return b.getOrCreate()


HIT = "pos long, tier int, session_id string, line_no long, rank double, project string, title string, snippet string"
FUSED = "pos long, session_id string, score double, rank double, line_no long, left_pos long, right_pos long, project string, title string, snippet string"


def snippet_of(text: str, size: int = 140) -> str:
    """The start of a text in one line."""
    t = " ".join(text.split())
    return t if len(t) <= size else f"…{t[:size]}…"


class Engine:
    """model: the name of what embed computes; vectors of another model are made anew and aren't searched."""

    def __init__(self, store: Store, embed: v.Embedder | None = None, model: str = "own"):
        self.store, self.embed, self.model = store, embed, model

    def index(self, projects_root: str, incremental: bool = False, embed: bool = False) -> RefreshStats:
        stats = self.store.refresh(projects_root, incremental)
        if embed:
            self.build_vectors()
        return stats

    # ---- search

    def _hits(self, query: str) -> DataFrame:
        """(session_key, line_no, role, rank) by the term index; its counts are kept while they are read twice."""
        size = self.store.table("sessions").agg(F.coalesce(F.sum("indexed_messages"), F.lit(0)), F.coalesce(F.sum("indexed_tokens"), F.lit(0))).first()
        return s.index_hits(s.index_counts(self.store.table("terms"), query), query, size[0], size[1])

    def _found(self, query: str, limit: int, role: str | None = None) -> list:
        """The rows (pos, tier, session_id, line_no, rank, session_key) of a keyword search, at most limit."""
        if not s.phrases(query):
            return []
        sessions = self.store.sessions()
        hits = self._hits(query).join(sessions.select("session_key", "session_id"), "session_key")
        return s.search(None, query, limit, role, sessions.select("session_id", "session_key", "title_terms"), True, hits=hits, title_tokens="title_terms", more=("session_key",)).collect()

    def search(self, query: str, limit: int = 20, role: str | None = None) -> DataFrame:
        """(pos, tier, session_id, line_no, rank, project, title, snippet); no more than `limit` rows are collected."""
        found = self._found(query, limit, role)
        details = self._details([(r.session_key, r.line_no) for r in found], query)
        rows = [(r.pos, r.tier, r.session_id, r.line_no, r["rank"], *details[r.session_key, r.line_no]) for r in found]
        return self.store.spark.createDataFrame(rows, HIT)

    def _details(self, places: list[tuple[str, int]], query: str) -> dict[tuple[str, int], tuple[str, str, str]]:
        """(project, title, snippet) of each place (session_key, line_no), line 0 for the title; only these buckets, sessions and lines are read."""
        keys = sorted({k for k, _ in places})
        if not keys:
            return {}
        buckets = [r[0] for r in self.store.spark.createDataFrame([(k,) for k in keys], "session_key string").select(self.store._bucket()).distinct().collect()]
        known = {r.session_key: r for r in self.store.sessions().filter(F.col("session_key").isin(keys)).select("session_key", "project_name", "title").collect()}
        m = self.store.table("messages").filter(F.col("bucket").isin(buckets) & F.col("session_key").isin(keys) & F.col("line_no").isin(sorted({n for _, n in places})))
        wanted = set(places)
        body = {(r.session_key, r.line_no): r.text_for_fts for r in m.select("session_key", "line_no", "text_for_fts").collect() if (r.session_key, r.line_no) in wanted}
        out = {}
        for key, line in places:
            title = known[key].title
            out[key, line] = (known[key].project_name, title, s.snippet((title if line == 0 else body.get((key, line))) or "", query, stemmed=True))
        return out

    def build_vectors(self) -> tuple[int, int]:
        """Chunk the sessions that have no chunks yet, and embed the chunks without vectors; (chunks, vectors) made."""
        if self.embed is None:
            raise ValueError("no embedder")
        st = self.store
        chunks = st.table("chunks").select("session_key", "ordinal", "text")
        mine = st.messages().filter(ss.typed_prompts(st.messages())).join(chunks.select("session_key").distinct(), "session_key", "left_anti")
        fresh = v.chunk_sessions(mine, "session_key", "line_no", "text_for_fts").withColumn("ordinal", F.col("ordinal").cast("int"))
        new = self._append("chunks", fresh)
        todo = v.pending(st.table("chunks").select("session_key", "ordinal", "text"), st.table("chunk_vectors").filter(F.col("model") == self.model), ["session_key", "ordinal"])
        vectors = v.embed_chunks(todo, self.embed).select("session_key", "ordinal", F.size("vec").alias("dim"), F.lit(self.model).alias("model"), "vec", F.unix_millis(F.current_timestamp()).alias("built_at"))
        made = self._append("chunk_vectors", vectors)
        stale = st.table("chunk_vectors").filter(F.col("model") != self.model).select("session_key").distinct()
        if made and not stale.isEmpty():
            st.drop_vectors(self.model)
        return new, made

    def _append(self, name: str, rows: DataFrame) -> int:
        """Write rows of keys that the table doesn't have; counted by what was there before and after."""
        before = self.store.table(name).count()
        rows.withColumn("bucket", self.store._bucket()).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.store._path(name))
        return self.store.table(name).count() - before

    def hybrid(self, query: str, limit: int = 20) -> DataFrame:
        """(pos, session_id, score, rank, line_no, left_pos, right_pos, project, title, snippet): keyword and vector hits, fused.

        Without vectors the keyword hits alone, scored by their place. A session that only vectors found shows its best chunk.
        """
        st = self.store
        found = self._found(query, 3 * limit)
        words = st.spark.createDataFrame([(r.pos, r.tier, r.session_id, r.line_no, r["rank"]) for r in found], "pos long, tier int, session_id string, line_no long, rank double")
        ids = st.sessions().select("session_key", "session_id")
        vectors = st.table("chunk_vectors").filter(F.col("model") == self.model).join(ids, "session_key")
        q = F.array(*(F.lit(float(x)) for x in self.embed(["query: " + query])[0])) if self.embed else F.array().cast("array<double>")
        rows = v.hybrid_search(None, vectors if self.embed else vectors.limit(0), query, q, limit, words=words).collect()
        key = {r.session_id: r.session_key for r in found}
        left = [r.session_id for r in rows if r.session_id not in key]
        near = {}
        if left:
            best = v.best_chunk(vectors.filter(F.col("session_id").isin(left)).withColumn("at", F.struct("session_key", "ordinal")), q, "session_id", "at")
            near = {r.session_id: (r.session_key, r.text) for r in best.select("session_id", "at.*").join(st.table("chunks").select("session_key", "ordinal", "text"), ["session_key", "ordinal"]).collect()}
        places = [(key[r.session_id], r.line_no) if r.session_id in key else (near[r.session_id][0], 0) for r in rows]
        details = self._details(places, query)
        out = []
        for r, place in zip(rows, places, strict=True):
            project, title, snippet = details[place]
            out.append((*r, project, title, snippet if r.session_id in key else snippet_of(near[r.session_id][1])))
        return st.spark.createDataFrame(out, FUSED)

    # ---- sequences

    def messages(self, role: str = "user", limit: int | None = None) -> DataFrame:
        return ss.prose(self.store.messages(), self.store.sessions(), role, limit)

    def show(self, prefix: str, recovered: bool = False, **window) -> DataFrame:
        """(i, total, chunk) of one session's transcript, windowed."""
        key = ss.resolve(self.store.sessions(), prefix)
        m = self.store.messages().filter(F.col("session_key") == key)
        b = self.store.table("boundaries").drop("bucket").filter(F.col("session_key") == key)
        seq = ss.recover(m, b if recovered else b.limit(0))
        return ss.window(ss.rendered(seq), "session_key", F.col("line_no"), F.col("item_rank"), from_start=recovered, **window).select("i", "total", "chunk").orderBy("i")

    def recovery(self, prefix: str) -> dict[str, int]:
        key = ss.resolve(self.store.sessions(), prefix)
        m = self.store.messages().filter(F.col("session_key") == key)
        b = self.store.table("boundaries").filter(F.col("session_key") == key)
        counts = ss.recovery_counts(m, b).first()
        return {"boundaries": counts.boundary_count if counts else 0, "recovered": counts.recovered_count if counts else 0, "cross_file": ss.cross_file(b, m).count()}

    def tree(self, contains: str | None = None) -> DataFrame:
        return ss.topology(self.store.sessions(), self.store.table("worktrees"), contains)

    def tree_text(self, contains: str | None = None) -> Iterator[str]:
        """The tree as lines of text."""
        return ss.tree_text(ss.tree_lines(self.store.sessions(), self.store.table("worktrees"), contains))

    def name(self, prefix: str, alias: str, now_ms: int | None = None) -> None:
        self.store.set_alias(ss.resolve(self.store.sessions(), prefix), alias, now_ms)

    def resume(self, prefix: str) -> str:
        key = ss.resolve(self.store.sessions(), prefix)
        return ss.resume_command(self.store.sessions().filter(F.col("session_key") == key)).first().command

    def doctor(self) -> DataFrame:
        return self.store.doctor()

    def export(self, prefix: str, path: str) -> None:
        """One session's whole transcript as text."""
        self.show(prefix, recovered=True, range_="1:2147483647").coalesce(1).sortWithinPartitions("i").select("chunk").write.mode("overwrite").text(path)


def to_json(rows: DataFrame) -> str:
    """A bounded result as one JSON array, fields in the order of the columns; rows without a bound go to write_json()."""
    return "[" + ",".join(rows.toJSON().collect()) + "]"


def write_json(rows: DataFrame, path: str) -> None:
    """Any number of rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def hits_text(hits: DataFrame) -> str:
    """Search results as numbered lines; a bounded result is collected."""
    return "\n".join(f"{r.pos}. [{r.project}] {r.title or '(untitled)'} · {r.session_id}\n    {r.snippet}" for r in hits.orderBy("pos").collect())
