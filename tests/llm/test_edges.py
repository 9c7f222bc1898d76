"""Nulls, ties, repeated rows, empty tables, long texts and clashing columns; brute force for what SQL can't express."""

import math
import os
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import chat, common, decontaminate, htmltext, langid, media, packing, quality, simhash, substrings

from .test_operators import DOCS, docs_of, words


def clashing(df):
    """Columns that inner ones might be named like."""
    return df.withColumns({n: F.lit(f"{n}!") for n in ("_id", "K0", "node", "component", "bucket", "fp0", "size", "stats", "feature_", "low", "n")})


# ---- intermediate tables


def test_tables_go_when_told(spark, tmp_path):
    before = common.written(spark)
    at = common.shared_dir(spark)
    a, b = (common.materialize(spark.range(3), n) for n in "ab")
    with common.only_result(spark) as keep:
        c = common.materialize(spark.range(5), "c")
        common.materialize(spark.range(5), "d")
        keep.append(c)
    new = [p for p in common.written(spark) if p not in before]
    assert len(new) == 3 and all(p.startswith(at) for p in new)
    common.drop_table(a)
    assert b.count() == 3 and c.count() == 5 and len(common.written(spark)) == len(before) + 2
    simhash.keep_one(docs_of(spark, ["a b c d e f"] * 3)).count()
    quality.score_quality(docs_of(spark, ["a"]), spark.createDataFrame([(0, 1)], "doc_id long, quality int")).count()
    common.drop_written(spark)
    assert common.written(spark) == [] and not [p for p in new if os.path.exists(p.removeprefix("file:"))]


def test_the_folder_must_be_shared(tmp_path):
    class Conf:
        def __init__(self, at):
            self.at = at

        def get(self, *_):
            return self.at

    class Session:
        def __init__(self, at, master, checkpoint=None):
            self.conf, self.sparkContext = Conf(at), self
            self.master, self.applicationId, self.getCheckpointDir = master, f"{tmp_path}", lambda: checkpoint

    assert common.shared_dir(Session("s3://x/y/", "yarn")) == "s3://x/y" and common.shared_dir(Session(None, "yarn", "hdfs:/c")) == "hdfs:/c"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(None, "spark://host"))
    own = common.shared_dir(Session(None, "local[2]"))
    assert os.path.isdir(own) and own == common.shared_dir(Session(None, "local[2]"))


# ---- 1 media


def test_headers_that_say_nothing():
    for body in (b"", b"\0" * 12, media.struct.pack(">IIBBBBB", 9, 0, 8, 0, 0, 0, 0), media.struct.pack(">IIBBBBB", 0, 3, 8, 0, 0, 0, 0)):
        with pytest.raises(media.MediaError):
            media.decode_png(media.SIGNATURE + media._chunk(b"IHDR", body) + media._chunk(b"IDAT", zlib.compress(b"")) + media._chunk(b"IEND", b""))


def test_filters_by_the_published_rules():
    """Every filter undone sample by sample, as the format's text says."""
    rng = np.random.default_rng(5)
    for h, w in ((1, 1), (1, 40), (17, 9), (30, 3)):
        raw = np.c_[rng.integers(0, 5, h), rng.integers(0, 256, (h, w))].astype(np.uint8)
        out = [[0] * (w + 1) for _ in range(h + 1)]
        for y in range(1, h + 1):
            for x in range(1, w + 1):
                a, b, c = out[y][x - 1], out[y - 1][x], out[y - 1][x - 1]
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                out[y][x] = (int(raw[y - 1, x]) + (0, a, b, (a + b) // 2, near)[raw[y - 1, 0]]) % 256
        assert (media._unfilter(raw) == np.array(out)[1:, 1:]).all()


def test_feature_against_sums():
    rng = np.random.default_rng(6)
    for shape in ((1, 576), (5, 576), (70, 40)):
        p = rng.integers(0, 256, shape, dtype=np.uint8)
        m = media.area_means(p)
        low = [sum(float(m[y, x]) * round(4096 * math.cos(math.pi * (2 * y + 1) * u / 64)) * round(4096 * math.cos(math.pi * (2 * x + 1) * v / 64)) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
        median = sorted(low[1:])[31]
        bits = "".join("1" if c > median else "0" for c in low)
        assert media.cosine_hash(p) == f"{int(bits, 2):016x}"


def test_media_of_nothing(spark):
    assert media.media_digest(docs_of(spark, [])).count() == 0
    assert media.media_features(media.to_media(docs_of(spark, []))).count() == 0
    rows = media.media_features(media.to_media(clashing(docs_of(spark, [None, "", "é" * 99_999])))).collect()
    assert all(r.media_error is None and r["K0"] == "K0!" for r in rows)


# ---- 2 pages


def paragraphs(rng, n, size):
    return [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(size, 2 * size))) for _ in range(n)]


def test_density_alone_decides():
    """Pages without semantic tags or names: the article among link lists, a footer and an advert."""
    rng = random.Random(13)
    for _ in range(60):
        body = paragraphs(rng, rng.randrange(3, 12), 30)
        links = "<div>" + "".join(f"<span><a href=/{i}>Page {i}</a></span> " for i in range(rng.randrange(4, 30))) + "</div>"
        said = [body[0], f"{body[1]} <a href=/x>a link</a> <b>bold</b>", *body[2:]]
        wrap = rng.choice(("<div>{}</div>", "<div><div>{}</div></div>", "<div><div><div>{}</div></div></div>"))
        page = f"<html><body>{links}<div>Buy this now</div>" + wrap.format("<h1>A heading</h1>" + "".join(f"<p>{x}</p>" for x in said)) + f"{links}<div>All rights</div></body></html>"
        assert htmltext.main_text(page) == " ".join(["A heading", body[0], f"{body[1]} a link bold", *body[2:]])


@pytest.mark.parametrize("open_", ['<div class="post share-price-analysis">', '<div id="alert-systems">', '<div class="promo">', "<section role=search>", '<article class="comment header">'])
def test_names_never_delete_the_article(open_):
    rng = random.Random(14)
    p = paragraphs(rng, 4, 60)
    close = f"</{open_[1:].split()[0].rstrip('>')}>"
    page = f"<body><nav><a href=/>Home</a></nav>{open_}<header><h1>T</h1></header>" + "".join(f"<p>{x}</p>" for x in p) + f"{close}<div>Unlabelled advert, buy now</div><footer>foot</footer></body>"
    got = htmltext.main_text(page)
    assert got.endswith(" ".join(p)) and "advert" not in got and "foot" not in got and "Home" not in got


def test_hinted_blocks_inside_go():
    rng = random.Random(15)
    a, b = paragraphs(rng, 2, 60)
    for junk in ("<div class='ad-slot'>Buy</div>", "<aside>See also</aside>", "<div id=comments><p>Reader says much</p></div>", "<form><input><p>Sign up</p></form>", "<ul class=share-links><li>Mail</li></ul>"):
        assert htmltext.main_text(f"<body><article><header><h1>Kept</h1></header><p>{a}</p>{junk}<p>{b}</p></article></body>") == f"Kept {a} {b}"
    assert htmltext.main_text("<body><div class=ad>Only an advert here</div><article></article><footer>&copy;</footer></body>") == ""


def test_pages_of_every_kind(spark):
    data = "/root/testdata/sf0.01/pages.parquet"
    long = "<body><article>" + "<p>word word word.</p>" * 30_000 + "</article></body>"
    rows = [(1, long), (2, None), (3, ""), (4, long), (4, long), (None, "<p>a</p><p>a</p>")]
    got = htmltext.extract_main_text(clashing(spark.createDataFrame(rows, "page_id long, html string"))).collect()
    assert len(got) == 6 and sum(len(r.main_text) == 30_000 * 16 - 1 for r in got) == 3 and [r.main_text for r in got if r.page_id is None] == ["a a"]
    assert htmltext.extract_main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
    if os.path.exists(data):
        import html
        import re

        for r in spark.read.parquet(data).collect():
            inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
            want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner))).split())
            assert htmltext.main_text(r.html) == want


# ---- 3 tokens


def test_ids_of_all_letters_and_marks():
    import public_tokenizers

    t = packing.WordTokenizer(public_tokenizers.path(packing.VOCABULARY))
    chars = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c))[0] != "C"]
    rng = random.Random(16)
    texts = [f"a{c}. {c}, b{c}b! {c}" for c in chars] + [f"TÜRKİYE CUMHURİYETİ{m} İ{m}" for m in packing.MARKS]
    pools = ["İIıiğĞŞ .,;:!?#$%&*|", "ΣσςΑ .,", "éÉ .,'s\n", "क़ख़ .,", "".join(rng.sample(chars, 300)) + " ." * 40]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 25))) for _ in range(20_000)]
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        for x, mine, theirs in zip(part, t.encode_batch(part), t.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
            assert mine.tolist() == theirs.ids, x


def test_the_cache_is_bounded(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "CACHE_BYTES", 50_000)
    t = packing.WordTokenizer(public_tokenizers.path(packing.VOCABULARY))
    for k in range(20):
        t.encode_batch([" ".join(f"x{k}y{i}" for i in range(100))])
        assert len(t.known) < 500


# ---- 4 conversations


def test_conversations_of_every_kind(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (None, 0, "assistant", "n"), *((2, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(3000)), (3, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.format_preferences(chat.stale_answers(chat.conversations(turns))).collect()}
    assert set(got) == {None, 1, 2, 3} and got[1].prompt == "<|user|>\na\n<|end|>\n<|user|>\nb\n<|end|>\n" and got[2].prefix_turns == 2998
    assert got[3].prefix_turns == 3 and got[3].chosen_completion == "" and got[None].rejected_completion == "<|assistant|>\n\n<|end|>\n"
    assert chat.format_preferences(chat.stale_answers(chat.conversations(turns.limit(0)))).count() == 0


# ---- 5 fingerprints and similar texts


def test_fingerprints_bit_by_bit():
    """Counted in plain Python from the contract's words."""
    rng = random.Random(17)
    for t in ["", " \t", "ONE", "Zwei wörter", *(words(rng, rng.randrange(1, 90), 20) for _ in range(60))]:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).replace("\t", " ").split(" ") if x]
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(t, 3) == sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def test_null_and_repeated_ids(spark):
    a, b = "p q r s t u v w", "1 2 3 4 5 6 7 8 9"
    rows = [(5, a), (5, a), (None, a), (None, b), (7, a), (7, b), (9, None), (None, None)]
    for made in (simhash.near_duplicates, simhash.similar_documents):
        got = Counter((r.doc_id, r.component_id) for r in made(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
        # a null id is of a component of real ids; each row of an id is of its own text's
        assert got == Counter([(5, 5), (5, 5), (None, 5), (None, 7), (7, 5), (7, 7), (9, 9), (None, 9)])
        assert made(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = simhash.similar_documents(spark.createDataFrame([(None, a), (None, a)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in only] == [(None, None)] * 2


def test_one_of_each_group_stays(spark):
    long = [" ".join(f"z{k}x{i}" for i in range(300)) for k in range(4)]
    rows = [(1, long[0]), (1, long[0]), (2, long[0] + " more"), (None, long[1]), (None, long[1]), (4, long[2]), (4, long[3]), (6, None), (7, ""), (8, long[3])]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(1, long[0]), (None, long[1]), (4, long[2]), (4, long[3]), (6, None)])
    assert simhash.keep_one(docs.limit(0)).count() == 0


# ---- 6 and 8


def test_learners_of_nothing(spark):
    none, labels = docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int")
    assert langid.train(none) is None and langid.identify_language(none, None).count() == 0
    assert quality.score_quality(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0
    docs = clashing(docs_of(spark, ["good words here.", None] * 30))
    twice = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    got = quality.score_quality(docs, twice).collect()
    assert len(got) == 60 and all(0 <= r.score <= 1 for r in got)


def test_normal_equations_against_lstsq(spark):
    """Partition sums give the ridge weights of the whole matrix."""
    rng = random.Random(18)
    texts = [words(rng, rng.randrange(5, 60)) + ("!!" if k % 3 else ".") for k in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int")
    model = quality.train(quality.text_statistics(docs_of(spark, texts)), labels)
    fold = [zlib.crc32(str(i).encode()) % 5 for i in range(300)]
    x = np.stack([quality.statistics(t) for t in texts]).astype(float)
    learned, fit = [i for i in range(300) if fold[i] != 0], [i for i in range(300) if fold[i] > 1]
    assert np.allclose(model.mean, x[learned].mean(axis=0)) and np.allclose(model.scale, x[learned].std(axis=0) + 1e-6, atol=1e-5)
    z, y = model.transform(x[fit]), np.array([float(i % 3 == 0) for i in fit])
    d = z.shape[1]
    root = np.sqrt(quality.RIDGE * len(fit) / d)
    want = np.linalg.lstsq(np.r_[z, root * np.eye(d)], np.r_[y, np.zeros(d)], rcond=None)[0]
    assert np.allclose(z @ model.beta, z @ want, atol=1e-6)


def test_convolutions_against_loops():
    net = langid.ByteNet(["a", "b", "c"])
    rng = np.random.default_rng(19)
    x = rng.integers(0, 256, (2, langid.LENGTH), dtype=np.uint8)
    p = net.p
    for row, got in zip(x, net.compiled().log_probabilities(x), strict=True):
        h = []
        for k in langid.WIDTHS:
            v = [np.concatenate([p["e"][b] for b in row[i : i + k]]) @ p[f"w{k}"] + p[f"b{k}"] for i in range(langid.LENGTH - k + 1)]
            h.append(np.maximum(np.max(v, axis=0), 0))
        z = np.concatenate(h) @ p["o"] + p["c"]
        assert np.allclose(got, z - np.log(np.exp(z).sum()), atol=1e-4)


# ---- 9 benchmark


def edits_anywhere(item, text):
    """The least edits of an item against any piece of a text, row by row."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("entries, text_bytes", [(1 << 21, 1 << 20), (50, 64)])
def test_leaks_against_brute_force(spark, monkeypatch, entries, text_bytes):
    """The whole query; also with items looked at in ranges and texts in pieces."""
    monkeypatch.setattr(decontaminate, "ENTRIES", entries)
    monkeypatch.setattr(decontaminate, "TEXT_BYTES", text_bytes)
    rng = random.Random(20)
    items = [(i, words(rng, rng.randrange(4, 14), 30)) for i in range(12)] + [(12, "tiny"), (13, ""), (14, None)]
    texts = [None, "", "a tiny one"]
    for _ in range(25):
        x = list(items[rng.randrange(12)][1])
        for _ in range(rng.randrange(7)):
            x[rng.randrange(len(x))] = rng.choice(["#", "", "ab"])
        texts.append(words(rng, rng.randrange(1, 20), 30) + " " + "".join(x) + " " + words(rng, 10, 30))
    docs = clashing(docs_of(spark, texts))
    index = decontaminate.QGramIndex(items)
    for i, t in enumerate(texts):
        n = decontaminate.normal(t)
        want = {k: e for k, x in enumerate(index.items) if len(x) and n and (e := edits_anywhere(x.tobytes(), n)) <= index.budget[k]}
        assert {m[0]: m[1] for m in index.matches(n)} == want, (i, t)
        assert index.holds(n) == bool(want)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(len(texts))) - {i for i, _ in got}


def test_items_with_one_stem_and_a_long_text():
    rng = random.Random(21)
    stem = "what is the answer to the following question about the history of letters in the old world "
    index = decontaminate.QGramIndex([(i, stem + words(rng, 25)) for i in range(3000)])
    assert not index.holds(decontaminate.normal(" ".join([stem] * 40)))
    text = decontaminate.normal(words(rng, 400_000) + " ") + b" " + index.items[77].tobytes() + decontaminate.normal(" " + words(rng, 1000))
    assert [m[:2] for m in index.matches(text)] == [(77, 0)] and index.holds(text)


def test_rows_of_null_and_equal_ids(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "the quick brown fox jumps over")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "say the quick brown fox jumps over"), (3, "THE  quick brown fox jumps over"), (3, "nothing"), (3, None)], "doc_id long, text string")
    assert Counter((r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(docs, bench).collect()) == Counter([(None, 1, 0), (None, 2, 0), (3, 1, 0), (3, 2, 0)])
    assert sorted(str(r.text) for r in decontaminate.drop_leaks(docs, bench, block_bytes=1).collect()) == ["None", "nothing"]


# ---- 10 repeats


def test_one_very_long_text_and_clashing_columns(spark):
    rng = random.Random(22)
    part = words(rng, 30)
    long = " ".join([words(rng, 30_000), part, words(rng, 30_000), part])
    got = {r.doc_id: r for r in substrings.repeated_words(clashing(docs_of(spark, [long, part, None])).withColumn("key", F.lit("x")).withColumn("to", F.lit("y")), bucket_bytes=10_000).collect()}
    assert (got[0].n_removed, got[1].n_removed, got[2].n_words) == (30, 30, 0)


# ---- pipeline


def test_stages_of_nothing_and_of_odd_rows(spark, tmp_path):
    rng = random.Random(23)
    good = [words(rng, 150) + "." for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)] + [(3, good[3], "en", "s", 1), (None, good[4], None, None, None), (None, words(rng, 90), "en", "s", 1), (70, None, "en", "s", 0)]
    for name, kept in (("full", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(kept, DOCS).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, 1) for i in range(30)] if kept else [], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "some benchmark text of no document")] if kept else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out = corpus_pipeline.run(spark, at).collect()
        starts = Counter(r.doc_id for r in out if r.start == 0)
        if kept:
            assert starts[3] == 1 and starts[None] == 1 and all(starts[i] == 1 for i in range(30))
        else:
            assert out == []
    common.drop_written(spark)
