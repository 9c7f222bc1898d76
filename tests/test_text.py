"""Tokens, stems, scores and snippets against SQLite's full-text index, which is built from public rules."""

import sqlite3
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.blocks import attachment, flatten, render, string_leaves
from lakeloom.functions.stem import stem
from lakeloom.functions.text import fold_text, tokens, words
from lakeloom.operators import search as s
from lakeloom.operators.vectors import chunked, dot

TEXTS = ["proofing baskets were floured generously", "Bakers baked; baking relates to relational ovens", "pain-au-chocolat crème brûlée", "chocolat au pain", "au chocolat pain-au-chocolat", "an empty tray", "Łódź, Čapek, şeker; ΟΔΟΣ İstanbul cafés", ""]


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(x, tokenize='porter unicode61 remove_diacritics 1')")
    c.executemany("insert into t(rowid, x) values (?, ?)", [(i, x) for i, x in enumerate(TEXTS) if x])
    c.execute("create virtual table v using fts5vocab(t, row)")
    return c


@pytest.mark.parametrize("query", ["pain-au-chocolat", "baker", "proof", "relate oven", "creme", "nothing", "generous", "lodz", "capek SEKER", "οδος", "istanbul", "cafes"])
def test_bm25_like_a_full_text_index(spark, fts, query):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r.id: r["rank"] for r in s.scored(docs, query, stemmed=True).collect()}
    match = " ".join('"' + w + '"' for w in query.split())
    want = dict(fts.execute("select rowid, bm25(t) from t where t match ?", (match,)).fetchall())
    assert got == pytest.approx(want, abs=1e-9)
    own = {r.id: r["rank"] for r in s.scored(docs.withColumn("w", s.stem_all(tokens(F.col("text")))), query, stemmed=True, tokens_="w").collect()}
    assert own == got


def test_tokens_over_all_of_unicode(spark):
    """Each character of the basic plane inside a word, as SQLite folds it; on both paths.

    SQLite's tables are older than today's letters: of what they don't know as letters or pairs of case, nothing is asked.
    """
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(x, tokenize='unicode61 remove_diacritics 1')")
    c.execute("create virtual table v using fts5vocab(t, instance)")
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    c.executemany("insert into t(rowid, x) values (?, ?)", [(ord(x), f"q{x}z") for x in chars])
    theirs = {}
    for term, doc in c.execute("select term, doc from v order by doc, offset"):
        theirs.setdefault(chr(doc), []).append(term)
    ours = {x: words(f"q{x}z") for x in chars}
    differ = {x for x in chars if ours[x] != theirs[x]}
    newer = {x for x in differ if theirs[x] == [f"q{x}z"] and x.casefold() != x}
    letters = {x for x in differ if len(theirs[x]) != len(ours[x])}
    assert len(differ - newer - letters) == 0
    assert all(x.isascii() is False for x in differ) and len(newer) < 400
    # of code points that are letters and numbers today, SQLite takes a few for none
    assert len({x for x in letters if unicodedata.category(x)[0] in "LN"}) < 60
    df = spark.createDataFrame([(x, f"q{x}z") for x in chars if x not in "\x00"], "c string, t string").repartition(4)
    jvm = {r.c: r.w for r in df.select("c", tokens(F.col("t")).alias("w")).collect()}
    # the JVM's tables are a little older than Python's too: letters that are new to it separate words
    apart = [x for x in chars if x not in differ and jvm[x] != ours[x] and unicodedata.category(x) != "Cn"]
    assert len(apart) < 150 and all(len(jvm[x]) > 1 for x in apart), apart
    assert fold_text("CAFÉ é") == "cafe e"


def test_stems_like_a_full_text_index(fts):
    words_ = "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll".split()
    fts.executemany("insert into t(rowid, x) values (?, ?)", [(1000 + i, w) for i, w in enumerate(words_)])
    terms = {t for (t,) in fts.execute("select term from v").fetchall()}
    assert {stem(w) for w in words_} <= terms


def test_query_words():
    assert s.phrases('Pain-au AND "so" ..') == [["pain", "au"], ["and"], ["so"]]
    assert s.phrases("\n") == []


def test_snippets():
    text = " ".join(f"t{i}" for i in range(90))
    cut = s.snippet(text, "t55")
    assert "[t55]" in cut and cut.startswith("…") and cut.endswith("…")
    assert s.snippet("le pain au lait, Crème", "pain-au") == "le [pain au] lait, Crème" and s.snippet("le pain au lait, Crème", "creme") == "le pain au lait, [Crème]"
    assert s.snippet("", "x") == "" and len(sys.intern(s.snippet(text, "absent"))) < len(text)


def test_blocks():
    said, blocks = flatten([{"type": "tool_result", "is_error": True, "content": [{"type": "tool_reference", "tool_name": "Scale"}, {"type": "text", "text": "grams"}, {"type": "image", "source": {"media_type": "image/gif", "data": "R" * 44}}]}, {"type": "unknown"}, {"type": "thinking", "thinking": "hm"}])
    assert said == "Scale\ngrams" and [b["kind"] for b in blocks] == ["tool_result", "thinking"]
    assert blocks[0]["content"][2] == {"kind": "image", "media_type": "image/gif", "byte_len": 33}
    assert render(blocks) == "  ← [error]\n      [tool: Scale]\n    grams\n      [image image/gif ~33B]\n  💭 hm\n"
    assert string_leaves({"z": ["last", None], "k": {"b": 2.5, "a": "first"}, "m": "mid"}) == ["first", "mid", "last"]
    assert attachment({"content": {"file": {"content": ""}}, "snippet": "s"}) == ("", [{"kind": "text", "text": ""}]) and attachment({"snippet": "s"})[0] == "s" and attachment(5) == ("", [])


def test_chunks_and_dot(spark):
    rows = spark.createDataFrame([(["rye"] * 3,), (["é" * 1300],), (["　", "\n"],), (["k" * 800, "l" * 399, "m"],)], "t array<string>")
    assert [list(map(len, r[0])) for r in rows.select(chunked(F.col("t"))).collect()] == [[11], [1200, 100], [], [1200, 1]]
    v = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 1.0]), ([0.5], [-3.0, 9.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(dot(F.col("a"), F.col("b"))).collect()] == [4.0, -1.5]
