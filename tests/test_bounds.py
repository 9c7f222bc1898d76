"""What a Python task holds follows from fixed bounds, not from the rows of a batch or table."""

import json
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from lakeloom.functions import blocks
from lakeloom.operators import search, vectors
from lakeloom.sources import transcripts


class Rows:
    """Stands for a table: keeps the functions given to mapInArrow()."""

    def __init__(self, spark):
        self.sparkSession, self.runs = spark, []

    def select(self, *_):
        return self

    filter = select

    def mapInArrow(self, run, schema):
        self.runs.append(run)
        return self.sparkSession.createDataFrame([], schema)


def peak(f):
    """MB that f() has at most, without Arrow's own, and its result."""
    tracemalloc.start()
    try:
        out = f()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_vector_search_holds_few_scores(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(-3, 4, (6000, 8)) / 4.0  # many equal scores
    m[4000] = np.nan
    keys = rng.permutation(len(m))
    queries = spark.createDataFrame([(i, m[i].tolist()) for i in range(1500)], "query long, vec array<double>")
    rows = Rows(spark)
    vectors.similar_many(rows, queries, 5, "k")
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 3000]), pa.array(list(m[a : a + 3000]), pa.list_(pa.float64()))], ["k", "v"]) for a in (0, 3000)]
    mb, out = peak(lambda: list(rows.runs[0](iter(batches))))
    assert len(rows.runs) == 1 and mb < 60  # a whole batch's scores alone are 36
    got = [tuple(c[i].as_py() for c in b.columns) for b in out for i in range(b.num_rows)]
    assert Counter(r[0] for r in got) == {i: 5 for i in range(1500)}
    scores = np.round(m[:1500] @ m.T, 6)
    for q in range(0, 1500, 50):
        order = sorted(range(len(m)), key=lambda i: (0 if np.isnan(scores[q, i]) else 1, -scores[q, i] if scores[q, i] == scores[q, i] else 0, keys[i]))[:5]
        assert {r[1] for r in got if r[0] == q} == {int(keys[i]) for i in order}


WORDS = "rye crumb oven proofing lamination butter croissant batch".split()


def test_term_index_holds_a_piece(spark):
    def batch(n):
        said = [" ".join(f"{WORDS[(i + k) % 8]}{(i * k) % 97}" for k in range(60)) for i in range(n)]
        return pa.RecordBatch.from_arrays([pa.array([f"s{i // 10}" for i in range(n)]), pa.array(range(n), pa.int32()), pa.array(["user"] * n), pa.array(said)], ["session_key", "line_no", "role", "text"])

    rows = Rows(spark)
    search.term_index(rows)
    run = rows.runs[0]
    few, many = batch(4000), batch(16000)
    small, _ = peak(lambda: list(x.num_rows for x in run(iter([few]))))
    large, _ = peak(lambda: list(x.num_rows for x in run(iter([many]))))
    assert large < 1.5 * small  # four times the rows
    found = Counter()
    for b in run(iter([few])):
        for term, postings in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            found[term] += sum(len(p["positions"]) for p in postings)
    assert found == Counter(search.stem(w) for t in few.column(3).to_pylist() for w in search.words(t))


def test_vocabulary_is_bounded_by_its_bytes(spark, monkeypatch):
    made = []

    class Counted(search._Vocabulary):
        def __init__(self):
            super().__init__()
            made.append(self)

    monkeypatch.setattr(search, "_Vocabulary", Counted)
    rows = Rows(spark)
    search.term_index(rows)
    one = lambda i: pa.RecordBatch.from_arrays([pa.array(["s"]), pa.array([i], pa.int32()), pa.array(["user"]), pa.array([f"{i}x" + "y" * 900_000])], ["session_key", "line_no", "role", "text"])
    out = [b.column(1)[0].as_py() for b in rows.runs[0](one(i) for i in range(60))]
    assert [x[:3] for x in out] == [f"{i}xy"[:3] for i in range(60)]
    assert len(made) > 1 and all(sum(map(len, v)) < 40_000_000 for v in made)


def test_reader_holds_a_piece_of_the_files(spark):
    def batch(n):
        said = json.dumps({"type": "user", "uuid": "u", "message": {"role": "user", "content": "a" * 20_000}})
        content = "\n".join([said, "", "{broken", said]).encode()
        return pa.RecordBatch.from_arrays([pa.array([f"/p/{i}.jsonl" for i in range(n)]), pa.array([1] * n), pa.array([len(content)] * n), pa.array([content] * n)], ["session_key", "mtime_us", "size", "content"])

    rows = Rows(spark)
    transcripts.read_records(rows)
    run = rows.runs[0]
    few, many = batch(100), batch(800)
    small, _ = peak(lambda: sum(x.num_rows for x in run(iter([few]))))
    large, n = peak(lambda: sum(x.num_rows for x in run(iter([many]))))
    assert n == 800 * 4 and large < 1.5 * small
    got = [r for b in run(iter([batch(2)])) for r in b.to_pylist()]
    assert [(r["session_key"], r["line_no"], r["kind"]) for r in got] == [(f"/p/{i}.jsonl", n, k) for i in range(2) for n, k in ((1, "message"), (3, "skipped"), (4, "message"), (0, "empty"))]


def test_rendering_holds_a_piece():
    texts = lambda n: pa.array([json.dumps([{"kind": "text", "text": "b" * 5000}]), None, "no json"] * n)
    few, many = texts(300), texts(2400)
    small, _ = peak(lambda: len(blocks._each(few, lambda x: blocks.render(json.loads(x)) if x and x[0] == "[" else "")))
    large, out = peak(lambda: blocks._each(many, lambda x: blocks.render(json.loads(x)) if x and x[0] == "[" else ""))
    assert large < 1.5 * small and out.to_pylist() == ["b" * 5000 + "\n", "", ""] * 2400
    assert len(blocks._each(pa.array([], pa.string()), len)) == 0


def test_lines_as_split():
    for x in (b"", b"\n", b"a", b"a\n", b"\n\na\nb", b"a\r\nb\n\n"):
        assert list(transcripts._split(x)) == x.split(b"\n")
