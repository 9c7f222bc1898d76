"""The training-data operators against brute force, exact round trips and planted cases."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import chat, common, decontaminate, graph, htmltext, langid, media, packing, quality, simhash, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


# ---- 1 media


@pytest.mark.parametrize("row_filter", [*media.FILTERS, "mixed"])
def test_png_round_trip(row_filter):
    rng = np.random.default_rng(1)
    for h in (1, 2, 7, 40):
        p = rng.integers(0, 256, (h, 30), dtype=np.uint8)
        assert (media.decode_png(media.encode_png(p, row_filter)) == p).all()


def test_png_damage_is_seen():
    data = bytearray(media.encode_png(np.zeros((3, 9), np.uint8)))
    for at in (0, 20, 45, len(data) - 3):
        bad = bytes(data[:at]) + bytes([data[at] ^ 1]) + bytes(data[at + 1 :])
        with pytest.raises(media.MediaError):
            media.decode_png(bad)
    with pytest.raises(media.MediaError):
        media.decode_png(bytes(data[:-5]))


def test_media_digest(spark):
    texts = [None, "", "é" * 288, "x" * 577, "y" * 50_000, "x" * 577]
    got = {r.doc_id: r for r in media.media_digest(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pay = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
    assert got[3][1:] == got[5][1:] and len(got[4].feature) == 16
    kept = media.media_features(media.to_media(docs_of(spark, texts).withColumn("feature", F.lit("clash")))).collect()
    assert all(r.media_error is None and r.samples is not None for r in kept)
    assert media.media_features(spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "id int, media binary")).filter("media_error is null").count() == 0


# ---- 2 html

PAGE = """<!doctype html><html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>
<div class="cookie-notice">We use cookies, accept them all please.</div><div class="sidebar"><p>Sidebar words here</p></div>
{}<div id="comments"><p>First reader comment that goes on for quite a while, as they do.</p></div><form><p>Sign up</p></form><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize(
    "body",
    [
        "<article><h1>Head &amp; shoulders</h1><p>One <b>bold</b>\n  step.<br>And&nbsp;on.<p>Two caf&eacute; <i>x</i>y.<p>Three.</article>",
        "<div class='post has-sidebar'><h1>Head &amp; shoulders</h1><p>One <b>bold</b> step.<br/>And on.</p><p>Two café <i>x</i>y.</p><p>Three.</p></div>",
        "<main><h1>Head &amp; shoulders</h1><div><p>One <b>bold</b> step. And on.</p><div class=ad>Buy now</div><p>Two café <i>x</i>y.</p><p>Three.</p></div></main>",
    ],
)
def test_main_text(body):
    assert htmltext.main_text(PAGE.format(body)) == "Head & shoulders One bold step. And on. Two café xy. Three."


def test_main_text_keeps_sections_side_by_side():
    p = ["".join(f"{k} word{i} " for i in range(30)).strip() for k in "abcde"]
    links = "<ul>" + "".join(f"<li><a href=/{i}>Other page {i}</a></li>" for i in range(9)) + "</ul>"
    first, second = ("<div>" + "".join(f"<p>{x}</p>" for x in part) + "</div>" for part in (p[:3], p[3:]))
    for tail in ("", links):
        assert htmltext.main_text(f"<body><div id=content><h1>Head</h1>{first}{second}{tail}</div></body>") == " ".join(["Head", *p])
        assert htmltext.main_text(f"<body><div id=content><h1>Head</h1>{tail}<div>{first}</div><p>Short.</p>{second}</div></body>") == " ".join(["Head", *p[:3], "Short.", *p[3:]])


def test_main_text_edges(spark):
    assert [htmltext.main_text(x) for x in (None, "", "<p>", "<script>x", "<!-- a")] == [""] * 5
    assert htmltext.main_text("1 < 2") == "1 < 2"
    assert htmltext.main_text("just words") == "just words"
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert htmltext.main_text(deep) == "core"
    df = spark.createDataFrame([(1, PAGE.format("<article><p>abc</p></article>"), "z"), (2, None, "z")], "page_id long, html string, main_text string")
    assert [tuple(r) for r in htmltext.extract_main_text(df).select("page_id", "main_text").orderBy("page_id").collect()] == [(1, "abc"), (2, "")]


# ---- 3 packing


def test_tokenizer_is_exact():
    import public_tokenizers

    path = public_tokenizers.path(packing.VOCABULARY)
    t = packing.WordTokenizer(path)
    for x in ["", " ", "Don't, <|endoftext|>x <|", "|> a|> É.É é́, ÀÀ! \tfoo\r\nΣΑΣ", "1,234.5e 'LL x²!", "İstanbul ǅ. x̸< ≮.", "THE the The!! ###$$$", "🙂 日本語 한국"]:
        assert list(t.encode_batch([x])[0]) == t.tokenizer.encode(x, add_special_tokens=False).ids


def test_differencing_packs_everything():
    rng = random.Random(1)
    for n in (1, 2, 5, 300):
        sizes = [rng.randrange(1, 513) for _ in range(n)]
        windows = packing.pack(sizes)
        assert sorted(i for w in windows for i in w) == list(range(n))
        assert all(sum(sizes[i] for i in w) <= packing.CAPACITY for w in windows)
    assert len(windows) <= 1.02 * sum(sizes) / packing.CAPACITY + 1
    assert packing.pack([]) == []
    assert sorted(s for s, _ in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_pack_documents(spark):
    rng = random.Random(2)
    texts = [None, "", *(words(rng, rng.randrange(1, 900)) for _ in range(40)), words(rng, 6000)]
    out = packing.pack_documents(docs_of(spark, texts).withColumn("start", F.lit("clash")), with_ids=True).collect()
    t = packing.tokenizer_at(__import__("public_tokenizers").path(packing.VOCABULARY))
    for i, x in enumerate(texts):
        parts = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        ids = [*t.encode_batch([x or ""])[0].tolist(), 1]
        assert [v for r in parts for v in r.ids] == ids and all(r.doc_tokens == len(ids) for r in parts)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in parts)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


# ---- 4 chat


def test_preferences(spark):
    turns = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame(
        [
            (1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")]),
            (2, [("user", "q")], [("user", "q"), ("assistant", "b")]),
            (3, [("user", "x")], [("user", "y")]),
            (4, None, []),
            (5, [("user", "same")], [("user", "same")]),
        ],
        f"pair_id int, chosen {turns}, rejected {turns}",
    )
    got = {r.pair_id: r for r in chat.format_preferences(pairs).collect()}
    assert [got[i].prefix_turns for i in range(1, 6)] == [1, 1, 0, 0, 1]
    assert got[1].prompt == "<|user|>\nq\n<|end|>\n" and got[1].chosen_completion == "<|assistant|>\na\n<|end|>\n"
    assert [tuple(m) for m in got[1].rejected_mask] == [(14, 0), (1, 1), (9, 0)]
    for r in got.values():
        assert sum(m.length for m in r.chosen_mask) == len(r.chosen_completion)
    assert got[2].chosen_completion == "" and got[3].prompt == got[4].prompt == ""
    clash = chat.format_preferences(pairs.withColumns({n: F.lit("x") for n in ("_a", "_B", "_turns", "prompt")}))
    assert clash.columns == ["pair_id", "_a", "_B", "_turns", *chat.RESULT]
    assert {r.pair_id: (r["_a"], r["_B"], r["_turns"], r.prompt) for r in clash.collect()} == {i: ("x", "x", "x", r.prompt) for i, r in got.items()}
    rows = spark.createDataFrame([(1, 1, "assistant", "a1"), (1, 0, "user", None), (1, 2, None, "u"), (1, 3, "assistant", "a2"), (2, 0, "user", "no answer")], "conv_id long, turn long, role string, text string")
    pair = chat.stale_answers(chat.conversations(rows)).collect()
    assert len(pair) == 1 and pair[0].chosen[-1].text == "a2" and pair[0].rejected[-1].text == "a1" and len(pair[0].chosen) == 4


# ---- 5 simhash


def brute_components(texts, n, most):
    prints = [simhash.fingerprint(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def near_texts(rng):
    base = [words(rng, 120) for _ in range(12)]
    texts = [None, "", " \n", "one", "one", "two words", *base, *base[:3]]
    for b in base:
        for _ in range(6):
            w = b.split()
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(999)}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("most, blocks", [(3, 2), (7, 4)])
def test_near_duplicates(spark, most, blocks):
    texts = near_texts(random.Random(4))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(spark, texts), words=3, most=most, blocks=blocks).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 3, most)


def jaccard_links(texts, words):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    return {(i, j): len(a & b) / len(a | b) for j, b in enumerate(sets) for i, a in enumerate(sets[:j])}


@pytest.mark.parametrize("long_run, group", [(64, None), (2, 300)])
def test_similar_documents(spark, monkeypatch, long_run, group):
    """Of pairs of similarity over 0.8 at most one in twenty is missed, and none below is linked; also with long runs, hot anchors and large groups split."""
    monkeypatch.setattr(simhash, "LONG_RUN", long_run)
    if group:
        for name in ("GROUP_ROWS", "GROUP_SETS", "GROUP_SHINGLES"):
            monkeypatch.setattr(simhash, name, group)
        monkeypatch.setattr(simhash, "SAMPLE", 1)
    rng = random.Random(8)
    texts = [None, "", "one", "one", "a b c d e f"]
    for _ in range(40):
        base = words(rng, 200).split()
        texts.append(" ".join(base))
        for n in (1, 3, 8, 16):
            w = [*base]
            for k in rng.sample(range(200), n):
                w[k] = f"v{rng.randrange(9999)}"
            texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(spark, texts)).collect()}
    alike = jaccard_links(texts, 5)
    assert len(got) == len(texts) and got[0] == got[1] == 0 and got[2] == got[3] == 2
    near = [got[i] == got[j] for (i, j), x in alike.items() if x >= 0.8]
    assert len(near) > 100 and sum(near) >= 0.95 * len(near)
    root = {}
    find = lambda i: i if root.get(i, i) == i else find(root[i])
    for (i, j), x in alike.items():
        if x >= 0.8:
            root[find(j)] = find(i)
    assert all(find(i) == find(j) for i, j in got.items())
    assert simhash.similar_documents(docs_of(spark, [])).count() == 0


def test_similar_short_texts_are_decided_exactly(spark):
    """Sets of n in m shingles (n / m in similarity), copies with the last words changed, and texts with a common line."""
    rng = random.Random(21)
    texts = []
    for n, m in [(4, 5), (5, 6), (6, 7), (8, 10), (11, 14), (12, 15), (14, 17), (20, 25), (48, 60), (64, 80), (3, 4), (7, 9), (60, 76)]:
        for _ in range(12):
            w = [f"u{rng.randrange(10**6)}" for _ in range(m + 4)]
            texts += [" ".join(w[: n + 4]), " ".join(w)]
    for n in (10, 13, 14, 20, 40):
        for _ in range(12):
            w = [f"u{rng.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(w), " ".join([*w[:-1], "changed"])]
    texts += [f"this line is common to very many texts {words(rng, 2)}" for _ in range(90)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), x in jaccard_links(texts, 5).items():
        if x >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_forests_keep_the_components():
    rng = np.random.default_rng(1)
    for n, width, homes in ((200, 24, 1.0), (300, 30, 0.3), (90, 12, 1.0)):
        fp = rng.integers(0, 1 << width, n, dtype=np.uint64)[:, None]
        home = rng.random(n) < homes
        a, b = simhash._links(fp, home, 4)
        near = (np.bitwise_count(fp ^ fp.T) <= 4) & (home[:, None] | home[None])
        assert near[a, b].all() and len(a) < n

        def components(pairs):
            root = list(range(n))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for x, y in pairs:
                root[find(x)] = find(y)
            return [find(x) for x in range(n)]

        mine, full = components(zip(a.tolist(), b.tolist(), strict=True)), components(np.argwhere(near).tolist())
        assert len({*zip(mine, full)}) == len(set(mine)) == len(set(full))


def test_shingles_and_hash():
    import xxhash

    assert simhash.fingerprint(" A b\tC ", 3) == xxhash.xxh64_intdigest(b"a b c", 42)
    assert simhash.fingerprint("A b", 3) == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint("É", 3) == xxhash.xxh64_intdigest("É".encode(), 42)
    h = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b c", b"b c d")]
    assert simhash.fingerprint("a b c d", 3) == h[0] & h[1]


@pytest.mark.parametrize("bits, radius", [(32, 2), (16, 2), (16, 3), (21, 3)])
def test_cover_finds_every_anchor(bits, radius):
    code = simhash.HammingCover(0, bits)
    v = np.random.default_rng(2).integers(0, 1 << bits, 20, dtype=np.uint64)
    rows, anchors = code.within(v, radius)
    near = np.bitwise_count(v[rows] ^ anchors)
    assert (near <= radius).all() and (code.syndrome(anchors) == 0).all() and len({*zip(rows.tolist(), anchors.tolist())}) == len(rows)
    # any point within radius - 1 of v has its nearest anchor among them
    for k in range(20):
        mine = set(anchors[rows == k].tolist())
        for i in range(bits):
            other = v[k] ^ (np.uint64(1) << np.uint64(i))
            assert int(code.nearest(np.array([other]))[0]) in mine


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (50, 60), (None, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 50: 50, 60: 50}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_random_forest(spark):
    """Against one pass of union-find, with more files of edges than rounds write."""
    rng = random.Random(5)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1800)]
    root = list(range(3000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(24)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("rows, files", [(0, 8), (5, 8), (12 * common.FILE_ROWS, 12), (None, 40)])
def test_few_rows_in_few_files(spark, rows, files):
    """As many files as the bound of rows needs; every row is there."""
    got = common.materialize(spark.range(0, 400, 1, 40), "few", rows)
    assert len(got.inputFiles()) == files and sorted(r.id for r in got.collect()) == list(range(400))
    common.drop_table(got)


# ---- 6 language, 8 quality

TONGUES = {"en": "the of and to in that is was it for on with as be at by this from".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split()}


def test_language(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(TONGUES[k]) for _ in range(rng.randrange(5, 200))), k, "s", 0) for i, k in enumerate(rng.choice(list(TONGUES)) for _ in range(400))]
    rows += [(900, None, "en", "s", 0), (901, "123 !!", "en", "s", 0), (902, "", None, "s", 0), (903, "der und " * 20_000, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    net = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify_language(docs, net).collect()}
    held = [(k, got[i].lang_pred) for i, _, k, _, _ in rows[:400] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) >= 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in langid.identify_language(docs.limit(3), None).collect()} == {"und"}


def test_byte_net_gradients_and_tables():
    net = langid.ByteNet(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (3, langid.LENGTH), dtype=np.uint8), np.array([0, 1, 1])
    loss = lambda: -net.compiled().log_probabilities(x)[np.arange(3), y].mean()
    g = net.gradients(x, y)
    for name, at in (("o", (3, 1)), ("w3", (5, 2)), ("c", (0,)), ("b4", (1,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 5e-3


def test_quality(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        t = words(rng, rng.randrange(20, 200)) + "."
        rows.append((i, t if good else " ".join(w.upper() + "!!" for w in t.split()), "en", "s", 0))
        labels.append((i, int(good)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "long " * 50_000, "en", "s", 0)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(docs, marks).collect()}
    assert len(got) == 503 and all(0 <= r.score <= 1 for r in got.values())
    held = [(q, got[i].score >= quality.THRESHOLD) for i, q in labels if got[i].held_out]
    assert sum(bool(a) == b for a, b in held) / len(held) >= 0.95
    assert {r.score for r in quality.score_quality(docs.limit(4), marks.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and 300 < kept.count() < 420


def test_isotonic():
    at, v = quality.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 1, 1]), np.array([0.0, 1, 2, 3]))
    assert np.allclose(v, [0, 2 / 3, 1]) and np.allclose(at, [0, 5 / 3, 3])


# ---- 9 decontamination


def test_edits_within_the_budget_are_found():
    rng = random.Random(8)
    items = [(i, words(rng, 40)) for i in range(20)] + [(90, ""), (91, None), (92, "tiny")]
    index = decontaminate.QGramIndex(items)
    for _ in range(60):
        k = rng.randrange(20)
        x, budget = decontaminate.normal(items[k][1]), int(index.budget[k])
        for _ in range(rng.randrange(budget + 1)):
            p, o = rng.randrange(len(x)), rng.random()
            x = x[:p] + (b"" if o < 0.3 else b"#" + x[p:][:1] if o < 0.6 else b"#") + x[p + 1 :]
        text = decontaminate.normal(words(rng, 200)) + b" " + x + b" " + decontaminate.normal(words(rng, 50))
        assert any(m[0] == k and m[1] <= budget for m in index.matches(text))
    assert not [m for m in index.matches(decontaminate.normal(words(rng, 3000))) if m[0] < 20]
    assert [m[0] for m in index.matches(b"a tiny bit")] == [22]


def test_banded_distance_against_the_full_table():
    rng = random.Random(9)
    for _ in range(40):
        item = np.array([rng.randrange(3) for _ in range(12)], np.uint8)
        text = np.array([rng.randrange(3) for _ in range(20)], np.uint8)
        table = np.zeros((13, 21), int)
        table[:, 0] = np.arange(13)
        for i in range(1, 13):
            for j in range(1, 21):
                table[i, j] = min(table[i - 1, j - 1] + (item[i - 1] != text[j - 1]), table[i - 1, j] + 1, table[i, j - 1] + 1)
        assert decontaminate.banded_distance(item, text, -12, 20)[0] == table[12].min()


def test_leaks(spark):
    rng = random.Random(10)
    items = [(i, words(rng, 30)) for i in range(5)]
    texts = [None, "", words(rng, 500), words(rng, 100) + " " + items[2][1].upper().replace(" ", "\n ") + " " + words(rng, 100), items[4][1] + items[0][1]]
    docs, bench = docs_of(spark, texts), spark.createDataFrame([*items, (7, None), (2, items[2][1])], "item_id long, text string")
    for block in (50, 1 << 20):
        got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, block_bytes=block).collect())
        assert got == [(3, 2), (4, 0), (4, 4)]
        assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench, block_bytes=block).collect()) == [0, 1, 2]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


# ---- 10 substrings


def brute_repeats(rows, window):
    first, gone = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in first:
                gone.setdefault(i, set()).update(range(k, k + window))
            first.setdefault(key, (i, k))
    return {i: " ".join(w for k, w in enumerate((t or "").split()) if k not in gone.get(i, ())) for i, t in rows}


@pytest.mark.parametrize("window, period", [(20, 13), (8, 7), (5, 1)])
def test_repeats(spark, window, period):
    rng = random.Random(11)
    shared = [words(rng, 45) for _ in range(4)]
    texts = [None, "", "a b", "x " * 100, *(words(rng, rng.randrange(5, 60)) + " " + rng.choice(shared) + " " + words(rng, 20) for _ in range(30)), shared[0], shared[0], words(rng, 4000, 3)]
    got = {r.doc_id: r for r in substrings.repeated_words(docs_of(spark, texts), window=window, period=period, bucket_bytes=4000, with_text=True).collect()}
    want = brute_repeats(list(enumerate(texts)), window)
    assert {i: r.kept_text for i, r in got.items()} == want
    assert all(r.n_words - r.n_removed == len(r.kept_text.split()) and r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got.values())


def test_repeats_edges(spark):
    t = " ".join(f"q{i}" for i in range(25))
    rows = [(1, t), (1, t), (None, t), (2, t)]
    out = substrings.repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (1, 25), (1, 25), (2, 25)]
    assert substrings.repeated_words(docs_of(spark, [])).count() == 0
    for p, d in substrings.COVERS.items():
        assert {(a - b) % p for a in d for b in d} == set(range(p))


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    good = [words(rng, 150) + "." for _ in range(60)]
    texts = good + [good[0], " ".join([*good[1].split()[:-1], "edited"]), good[2] + " " + "leak " + words(random.Random(99), 30), good[3][:300] + " 34@mail7.example.com"]
    junk = [" ".join(w.upper() + "!!" for w in words(rng, 80).split()) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, *junk])]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(texts))) for i in range(len(rows))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(random.Random(99), 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert left & set(range(64, 104)) == set() and not {60, 61, 62} & left and set(range(60)) <= left
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert all("34@mail7" not in r.text for r in docs.collect())


def test_registry_and_sql(spark):
    from lakeloom.llm.queries import ORACLE_SQL, QUERIES

    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(QUERIES) and len(QUERIES) == 10
    assert set(ORACLE_SQL) <= set(QUERIES) and Counter(json.dumps(n) for n in QUERIES)


@pytest.mark.parametrize("name", ["op4_preference_format", "op10_substring_dedup"])
def test_against_sql(spark, name):
    import os

    import duckdb

    from lakeloom.llm.queries import ORACLE_SQL, QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    df, rel = QUERIES[name](spark, data), c.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    assert sorted(tuple(r[x] for x in cols) for r in df.collect()) == sorted(tuple(r[rel.columns.index(x)] for x in cols) for r in rel.fetchall())
