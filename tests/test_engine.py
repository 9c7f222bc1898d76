"""The engine end to end on session files generated here: a bakery's notes, with every kind of line."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import mining
from lakeloom.operators import sessions as ss
from lakeloom.operators.vectors import hashing_embedder
from lakeloom.plans.engine import Engine, to_json, write_json
from lakeloom.sources import config
from lakeloom.sources.store import Store
from lakeloom.streaming.refresh import refresh_stream

DOUGH = "sourdough starter rye hydration crumb oven proofing lamination butter croissant batch timer".split()


class Session:
    """Builds a session file line by line; ids and times follow from the line number."""

    def __init__(self, name, cwd="/srv/bakery"):
        self.name, self.cwd, self.lines, self.last = name, cwd, [], None

    def at(self):
        n = len(self.lines)
        return f"2025-03-{1 + n // 600:02d}T{n // 60 % 10 + 6:02d}:{n % 60:02d}:30.250Z"

    def node(self, kind, **more):
        line = {"type": kind, "uuid": f"{self.name}/{len(self.lines)}", "parentUuid": self.last, "timestamp": self.at(), **more}
        self.last = line["uuid"]
        self.lines.append(line)
        return self

    def user(self, content, **more):
        return self.node("user", cwd=self.cwd, message={"role": "user", "content": content}, **more)

    def assistant(self, *blocks, **more):
        return self.node("assistant", message={"role": "assistant", "content": list(blocks)}, **more)

    def compact(self, parent=None):
        n = len(self.lines)
        return self.node("system", subtype="compact_boundary", logicalParentUuid=parent or self.last, compactMetadata={"trigger": "manual", "preTokens": 900 + n, "postTokens": n})

    def raw(self, line):
        self.lines.append(line)
        return self


def text(t):
    return {"type": "text", "text": t}


def put(root, project, session):
    os.makedirs(root / project, exist_ok=True)
    p = root / project / f"{session.name}.jsonl"
    p.write_bytes(b"\n".join(x if isinstance(x, bytes) else json.dumps(x).encode() for x in session.lines) + b"\n")
    return p


def kitchen():
    s = Session("kitchen-log-07")
    s.user("how long should the rye proof at nine degrees?")
    s.assistant({"type": "thinking", "thinking": "unspoken arithmetic"}, text("Overnight, about fourteen hours."), {"type": "tool_use", "id": "k1", "name": "Thermometer", "input": {"probe": "core-left", "limits": {"low": "chilled", "high": ["warm", 31]}}})
    s.user([{"type": "tool_result", "tool_use_id": "k1", "is_error": True, "content": [text("probe-7 offline"), {"type": "tool_reference", "tool_name": "Hygrometer"}]}])
    s.raw({"type": "ai-title", "aiTitle": "Cold rye proofing"})
    s.node("attachment", attachment={"snippet": "levain ratios 1:5:5"})
    s.compact()
    s.user("Earlier part: the rye proofs overnight.", isCompactSummary=True)
    s.assistant(text("Then shape it at dawn."))
    s.compact(parent="another-file/3")
    s.user("/clear")
    s.user("what about the croissants?")
    s.raw({"type": "worktree-state", "worktreeSession": {"originalCwd": "/srv/bakery", "worktreeName": "pastry", "worktreeBranch": "feature/butter"}})
    return s


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("projects")
    put(root, "srv-bakery", kitchen())
    engine = Engine(Store(spark, str(tmp_path_factory.mktemp("store")), buckets=4), hashing_embedder())
    return engine, root, engine.index(str(root))


@pytest.fixture
def fresh(spark, tmp_path):
    root = tmp_path / "projects"
    put(root, "srv-bakery", kitchen())
    engine = Engine(Store(spark, str(tmp_path / "store"), buckets=2), hashing_embedder())
    engine.index(str(root))
    return engine, root


def found(engine, query, **more):
    return [r.session_id for r in engine.search(query, **more).collect()]


def test_index_and_search(made):
    engine, _, stats = made
    assert (stats.files_seen, stats.indexed, stats.skipped_unchanged, stats.parse_skipped_lines) == (1, 1, 0, 0)
    assert engine.store.messages().count() == 8
    assert found(engine, "proofs") == found(engine, "thermometer warm") == found(engine, "levain", limit=10**6) == ["kitchen-log-07"]
    assert found(engine, "unspoken arithmetic") == found(engine, "\t") == found(engine, "?!") == []
    row = engine.search("probe-7").first()
    assert "[probe-7]" in row.snippet and (row.project, row.title, row.line_no) == ("bakery", "Cold rye proofing", 3)
    assert json.loads(to_json(engine.search("fourteen")))[0]["line_no"] == 2
    s = engine.store.all_sessions().first()
    assert (s.title, s.has_compaction, s.message_count, s.project_path) == ("Cold rye proofing", True, 8, "/srv/bakery")
    assert (s.last_ts - s.first_ts) == 10 * 60_000 and s.first_ts % 1000 == 250


def test_roles_and_titles(made):
    engine = made[0]
    assert found(engine, "croissants", role="user") and not found(engine, "croissants", role="assistant")
    first = engine.search("rye").first()
    assert (first.tier, first.line_no, first.snippet) == (0, 0, "Cold [rye] proofing")


def test_prose(made, tmp_path, spark):
    rows = made[0].messages()
    assert [r.text for r in rows.collect()] == ["how long should the rye proof at nine degrees?", "Earlier part: the rye proofs overnight.", "what about the croissants?"]
    assert made[0].messages(limit=1).count() == 1
    write_json(rows.select("session_id", "project", "title", "ts", "text"), str(tmp_path / "dump"))
    assert sorted(r.text for r in mining.read_dump(spark, str(tmp_path / "dump")).collect()) == sorted(r.text for r in rows.collect())


def test_recovery_and_show(made):
    engine = made[0]
    assert engine.recovery("kitchen") == {"boundaries": 2, "recovered": 6, "cross_file": 1}
    chunks = [r.chunk for r in engine.show("kitchen", recovered=True).collect()]
    assert chunks[0] == "## user  ⟨pre-compaction · hidden by UI⟩\nhow long should the rye proof at nine degrees?"
    assert '  → Thermometer({"limits":{"high":["warm",31],"low":"chilled"},"probe":"core-left"})' in chunks[1] and "  💭 unspoken arithmetic" in chunks[1]
    assert chunks[2].endswith("  ← [error]\n    probe-7 offline\n      [tool: Hygrometer]")
    assert [c for c in chunks if c.startswith("───")] == ["─── ⟪ compaction boundary · manual · 905→5 tokens ⟫ ───", "─── ⟪ compaction boundary · manual · 908→8 tokens ⟫ ───"]
    assert [r.i for r in engine.show("kitchen", tail=3).collect()] == [6, 7, 8]
    assert engine.resume("kitchen") == "cd /srv/bakery && claude --resume kitchen-log-07"


def test_topology(made):
    g = made[0].tree().collect()
    assert [(r.repo, r.worktree, r.branch, r.confidence, r.session_count) for r in g] == [("/srv/bakery", "pastry", "feature/butter", "explicit", 1)]
    assert made[0].tree("no such place").isEmpty() and not made[0].tree("COLD RYE").isEmpty()
    assert list(made[0].tree_text()) == ["\n/srv/bakery  (1 session(s))", "  ├─ ⌥ worktree: pastry (branch feature/butter) [explicit]", "  │    └─ kitchen-  Cold rye proofing  · 8 msgs"]


def test_resolve_is_literal(made):
    engine = made[0]
    for bad in ("kitchen%", "_itchen", "nobody"):
        with pytest.raises(LookupError):
            engine.recovery(bad)
    assert engine.recovery("KITCHEN-")["boundaries"] == 2


def test_alias_survives_until_the_file_names_itself(fresh):
    engine, root = fresh
    engine.name("kitchen", "Zwieback Ärger", now_ms=4_000_000_000_000)
    assert found(engine, "zwiebäck arger") == ["kitchen-log-07"]
    engine.index(str(root))
    assert found(engine, "zwieback") == ["kitchen-log-07"] and engine.store.sessions().first().title == "Zwieback Ärger"
    with pytest.raises(ValueError):
        engine.name("kitchen", " \n")


def test_changed_files_replace_their_rows_only(fresh):
    engine, root = fresh
    put(root, "other", Session("walk-in").user("freezer inventory"))
    assert engine.index(str(root), incremental=True).indexed == 1
    for _ in range(2):
        engine.index(str(root))
    assert engine.store.messages().count() == 9 and engine.store.table("sessions").count() == 2
    put(root, "srv-bakery", Session("kitchen-log-07").user("only olives now"))
    stats = engine.index(str(root), incremental=True)
    assert (stats.indexed, stats.skipped_unchanged) == (1, 1) and engine.store.messages().count() == 2
    assert engine.store.table("boundaries").isEmpty() and engine.store.table("worktrees").isEmpty()
    assert not found(engine, "rye") and found(engine, "olive") and found(engine, "freezer")
    assert engine.store.orphans().isEmpty() and engine.store.index_problems().isEmpty()
    os.remove(root / "other" / "walk-in.jsonl")
    engine.store.refresh(str(root), prune_missing=True)
    assert not found(engine, "freezer") and engine.store.messages().count() == 1


def test_generated_sessions_against_plain_python(spark, tmp_path):
    """Many sessions of random words: counts, titles, search and order as plain Python has them."""
    rng, root, want = random.Random(17), tmp_path / "p", {}
    for k in range(30):
        s = Session(f"s{k:02d}", f"/w/{k % 4}")
        said = []
        for _ in range(rng.randrange(1, 40)):
            t = " ".join(rng.choices(DOUGH, k=rng.randrange(1, 8)))
            said.append(t)
            s.user(t) if rng.random() < 0.5 else s.assistant(text(t))
        put(root, f"d{k % 3}", s)
        want[s.name] = said
    e = Engine(Store(spark, str(tmp_path / "st"), buckets=3))
    assert e.index(str(root)).indexed == 30
    got = {r.session_id: r.message_count for r in e.store.sessions().collect()}
    assert got == {n: len(x) for n, x in want.items()}
    for q in ("butter", "rye oven", "croissant batch timer"):
        hits = {n for n, x in want.items() if any(all(w in t.split() for w in q.split()) for t in x)}
        assert set(found(e, q, limit=100)) == hits
    assert found(e, "butter") == found(e, "butter", limit=100)[:20]


def test_bad_lines_and_types(spark, tmp_path):
    root = tmp_path / "p"
    s = Session("mess").user("fine", isSidechain="yes")
    for line in (b"", b"{ half", b'{"type":"user"} tail', b'{"type":"user","uuid":[1]}', b"7", b"\xc3\x28", b'{"type":"last-prompt"}', b'{"type":"new-kind"}', b'{"type":"user","uuid":"\\ud83d"}', b'{"\\udc00":1}', b'{"type":"user","message":{"content":"\\ud83d\\ude00 smile"}}', b'{"a":NaN}'):
        s.raw(line)
    put(root, "d", s)
    put(root, "d", Session("good").user("untouched by the other"))
    put(root / "d", "deeper", Session("hidden").user("x"))
    (root / "d" / "note.txt").write_text("x")
    e = Engine(Store(spark, str(tmp_path / "st"), buckets=2))
    stats = e.index(str(root))
    assert (stats.files_seen, stats.parse_skipped_lines) == (2, 6)
    assert sorted(r.line_no for r in e.store.table("skipped_lines").collect()) == [3, 4, 7, 10, 11, 13]
    rows = {r.line_no: r for r in e.store.messages().filter("session_key like '%mess.jsonl'").collect()}
    assert sorted(rows) == [1, 5, 6, 9, 12] and rows[1].is_sidechain is False and rows[12].text_for_fts == "😀 smile"
    assert rows[5].uuid is None and rows[6].rec_type == "" and rows[9].rec_type == "new-kind"
    assert found(e, "untouched") == ["good"]


def test_missing_root_is_empty(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path / "st")))
    assert e.index(str(tmp_path / "none")).files_seen == 0 and e.store.sessions().isEmpty()
    assert e.search("anything").isEmpty() and e.hybrid("anything").isEmpty()


def test_hybrid_and_models(fresh):
    engine, root = fresh
    put(root, "other", Session("flour").user("rye flour delivery").user("y" * 3000))
    engine.index(str(root), incremental=True, embed=True)
    assert engine.store.table("chunk_vectors").filter("session_key like '%flour.jsonl'").count() == 4
    assert engine.build_vectors() == (0, 0)
    rows = engine.hybrid("overnight proof", 5).collect()
    assert rows[0].session_id == "kitchen-log-07" and {r.session_id for r in rows} == {"kitchen-log-07", "flour"}
    assert all(r.project in ("bakery",) and r.snippet for r in rows)
    other = Engine(engine.store, hashing_embedder(32), "small")
    n = engine.store.table("chunks").count()
    assert other.build_vectors() == (0, n)
    assert {(r.model, r.dim) for r in engine.store.table("chunk_vectors").collect()} == {("small", 32)} and engine.store.table("chunk_vectors").count() == n
    assert Engine(engine.store).hybrid("overnight proof", 5).columns == engine.hybrid("overnight proof", 5).columns


def test_damaged_index_is_found(fresh):
    store = fresh[0].store
    assert store.index_problems().isEmpty()
    store.table("messages").filter("line_no <> 2").withColumn("text_for_fts", F.when(F.col("line_no") == 1, "changed").otherwise(F.col("text_for_fts"))).repartition("bucket").write.partitionBy("bucket").parquet(store.root + "/m")
    store._delete(store._path("messages"))
    store.spark.read.parquet(store.root + "/m").write.partitionBy("bucket").parquet(store._path("messages"))
    assert sorted((r.line_no, r.problem) for r in store.index_problems().collect()) == [(1, "differs"), (2, "orphan")]


def test_stream_refresh(spark, tmp_path):
    root = tmp_path / "p"
    put(root, "d", Session("s").user("streamed words"))
    store = Store(spark, str(tmp_path / "st"), buckets=2)
    refresh_stream(store, str(root), str(tmp_path / "ck")).awaitTermination(120)
    assert store.messages().count() == 1


def test_migration_takes_over_aliases_once(spark, tmp_path):
    root = tmp_path / "p"
    path = put(root, "d", Session("s").user("words"))
    store = Store(spark, str(tmp_path / "st"), buckets=2)
    assert store.migrate() == []
    spark.createDataFrame([(f"file:{path}", "Old name", 4_000_000_000_000)], "session_key string, alias string, set_at long").write.parquet(f"{store.root}/v1/aliases")
    assert store.migrate() == [1] and store.migrate() == [1] and store.table("aliases").count() == 1
    store.refresh(str(root))
    assert found(Engine(store), "old names") == ["s"]


def test_places():
    assert config.projects_root({"HOME": "/home/x"}) == "/home/x/.claude/projects"
    assert config.projects_root({"LAKELOOM_PROJECTS": "/in"}) == "/in" and config.store_root({"LAKELOOM_STORE": "/out"}) == "/out"
    assert config.store_root({"HOME": "/home/x", "XDG_DATA_HOME": "/d"}) == "/d/lakeloom/store"
    with pytest.raises(ValueError):
        config.projects_root({})


def test_ranges():
    assert [ss.parse_range(x) for x in ("7:7", "2 - 31", "1:400")] == [(7, 7), (2, 31), (1, 400)]
    for bad in ("0-4", "9:8", "x:2", "12", "", "1:"):
        with pytest.raises(ValueError):
            ss.parse_range(bad)


def test_rules_are_not_capped(spark):
    n = 10_001
    rules = spark.range(n).select(F.format_string("rule %05d", "id").alias("rule"), F.col("id").alias("session_hits"), F.lit(9).cast("long").alias("projects_seen"), (F.col("id") % 2 == 0).alias("keep"))
    got = mining.keep_or_rescue(rules).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, n + 1)) and [r.tier for r in got] == [0] * 5001 + [1] * 5000
    assert got[0].session_hits == 10_000 and got[5001].rule == "rule 00001"


def test_shards_of_a_topic(spark):
    ids = spark.createDataFrame([(" a ",), ("b",), ("a",), ("  ",), (None,)], "id string")
    assert sorted(r.session_id for r in mining.id_list(ids, "id").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        mining.id_list(ids.filter("id = '  '"), "id")
    prose = spark.createDataFrame([(s, "p", "T", f"{s} says {'x' * 30} {i}", i) for s in "abc" for i in range(4)], "session_id string, project string, title string, text string, line_no int")
    lines = mining.topic_lines(prose, mining.id_list(ids, "id"), ["session_id", "line_no"], budget=100)
    said = mining.per_shard(lines, ["session_id", "line_no"], lambda shard, t: [{"shard": shard, "n": t.count("•")}], "shard long, n long")
    assert sorted((r.shard, r.n) for r in said.collect()) == [(0, 4), (1, 4)]
