"""Keyword search: phrases, BM25, tiers, one hit for each session, and rank fusion.

A query's words become phrases of tokens that must all occur. Documents are scored where they are: one pass
counts each phrase and the length, a second row of corpus statistics (one row, so it is broadcast) gives the
weights. Nothing is exploded and no text is shuffled; only hits are. For many queries over one corpus,
postings() gives an inverted index instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import freeing, pieces
from ..functions.stem import stem, stem_all
from ..functions.text import spans, tokens, words

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: More rows than hits, as several rows may be of one session.
OVERFETCH, MOST_ROWS, RRF_K = 20, 50_000, 60


def phrases(query: str, stemmed: bool = False) -> list[list[str]]:
    """The query's words as token lists, in order, each list once; words without a token say nothing."""
    found = [words(word) for word in query.split()]
    return [[stem(t) for t in f] if stemmed else f for f in found if f]


def occurrences(tokens_: Column, phrase: list[str]) -> Column:
    """How often these tokens follow one another in a token array."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens_, lambda w: w == phrase[0]))

    def count(ws: Column) -> Column:
        def same(w: Column, i: Column) -> Column:
            out = w == phrase[0]
            for k, token in enumerate(phrase[1:], 1):
                out = out & F.coalesce(F.get(ws, i + k) == token, F.lit(False))
            return out

        return F.size(F.filter(ws, same))

    # bound as a lambda's variable, the array is made once a row, not once a token
    return F.get(F.transform(F.array(tokens_), count), F.lit(0))


def scored(docs: DataFrame, query: str, text: str = "text", stemmed: bool = False, tokens_: str | None = None) -> DataFrame:
    """Rows that hold every phrase, with `rank`: the negated BM25 score, so the best is the lowest.

    Rows without text aren't part of the corpus. The statistics are those of all rows of docs, so filter after.
    tokens_: a column of (stemmed) tokens, if
    docs have one, in place of the text's.
    """
    wanted = phrases(query, stemmed)
    if not wanted:
        return docs.limit(0).withColumn("rank", F.lit(0.0))
    own = F.col(tokens_) if tokens_ else stem_all(tokens(F.col(text))) if stemmed else tokens(F.col(text))
    counted = docs.filter(F.size(tokens_) > 0 if tokens_ else F.col(text) != "").withColumn("_words", own)
    counted = counted.withColumns({"_len": F.size("_words")} | {f"_f{i}": occurrences(F.col("_words"), p) for i, p in enumerate(wanted)}).drop("_words")
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *_document_counts(len(wanted)))
    return _ranked(counted, stats, len(wanted), docs.columns)


def _document_counts(n: int) -> list[Column]:
    return [F.count_if(F.col(f"_f{i}") > 0).alias(f"_df{i}") for i in range(n)]


def _ranked(counted: DataFrame, stats: DataFrame, n: int, kept: list[str]) -> DataFrame:
    """BM25 of rows with `_len` and each phrase's count `_f0`, …; stats is one row."""
    hits = counted
    for i in range(n):
        hits = hits.filter(F.col(f"_f{i}") > 0)
    score = F.lit(0.0)
    for i in range(n):
        idf = F.ln((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        f = F.col(f"_f{i}")
        score = score + F.when(idf <= 0, LEAST_IDF).otherwise(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return hits.crossJoin(F.broadcast(stats)).select(*kept, (-score).alias("rank"))


TERM_INDEX = "session_key string, term string, postings array<struct<line_no:int,role:string,length:int,positions:array<int>>>"


#: Bytes, about, of the tokens whose stems a task keeps.
VOCABULARY = 1 << 25


class _Vocabulary(dict):
    """A token's number, that of its stem; terms are the stems by number."""

    def __init__(self):
        super().__init__()
        self.held = 0
        self.terms: list[str] = []
        self.of: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        term = stem(token)
        if term not in self.of:
            self.of[term] = len(self.terms)
            self.terms.append(term)
        self[token] = self.of[term]
        self.held += 300 + 2 * len(token)
        return self[token]


def term_index(messages: DataFrame, text: str = "text_for_fts") -> DataFrame:
    """Stemmed postings of messages (session_key, line_no, role, text): a row for each session and term of a piece.

    One pass without a shuffle, in pieces of bounded bytes; the vocabulary is bounded too. A posting holds its
    message's length and the term's places. Written sorted by term, a query reads the row groups of its terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary()
        offsets = lambda starts, n: pa.array(np.r_[starts, n].astype(np.int32))
        for b in (p for whole in batches for p in pieces(whole, 3)):
            if vocabulary.held > VOCABULARY:
                vocabulary = _Vocabulary()
            own = [words(t) for t in b.column(3).to_pylist()]
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            term = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(own)), np.int64, int(lengths.sum()))
            keys = b.column(0).to_pylist()
            session = np.cumsum([0, *(x != y for x, y in zip(keys, keys[1:], strict=False))]) if keys else np.zeros(0, np.int64)
            message = np.repeat(np.arange(len(own)), lengths)
            place = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            # in the order of session, term, message and place, as one number each
            key = (session[message] * (len(vocabulary.terms) + 1) + term) * (len(own) + 1) + message
            order = np.argsort(key, kind="stable")
            key = key[order]
            posting = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
            row = np.flatnonzero(np.r_[True, np.diff(key[posting] // (len(own) + 1)) != 0]) if len(key) else key
            at = order[posting]
            positions = pa.ListArray.from_arrays(offsets(posting, len(key)), pa.array(place[order].astype(np.int32)))
            take = pa.array(message[at])
            postings = pa.StructArray.from_arrays([b.column(1).cast(pa.int32()).take(take), b.column(2).take(take), pa.array(lengths.astype(np.int32)).take(take), positions], ["line_no", "role", "length", "positions"])
            first = at[row]
            rows = [b.column(0).take(pa.array(message[first])), pa.array([vocabulary.terms[i] for i in term[first].tolist()], pa.string()), pa.ListArray.from_arrays(offsets(row, len(posting)), postings)]
            yield pa.RecordBatch.from_arrays(rows, ["session_key", "term", "postings"])

    return messages.filter(F.col(text) != "").select("session_key", "line_no", "role", text).mapInArrow(freeing(run), TERM_INDEX)


def index_counts(index: DataFrame, query: str) -> DataFrame:
    """(session_key, line_no, role, _len, _f0, ...) of the messages that hold a term of the query, by a term index."""
    wanted = phrases(query, stemmed=True)
    terms = sorted({t for p in wanted for t in p})
    each = index.filter(F.col("term").isin(terms)).select("session_key", "term", F.explode("postings").alias("p")).select("session_key", "term", "p.*")
    places = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"_p{i}") for i, t in enumerate(terms)]
    rows = each.groupBy("session_key", "line_no").agg(F.max("role").alias("role"), F.max("length").alias("_len"), *places)

    def count(phrase: list[str]) -> Column:
        cols = [F.coalesce(F.col(f"_p{terms.index(t)}"), F.array().cast("array<int>")) for t in phrase]

        def follows(i: Column) -> Column:
            out = F.lit(True)
            for k, c in enumerate(cols[1:], 1):
                out = out & F.array_contains(c, i + k)
            return out

        return F.size(F.filter(cols[0], follows)) if len(phrase) > 1 else F.size(cols[0])

    return rows.select("session_key", "line_no", "role", "_len", *(count(p).alias(f"_f{i}") for i, p in enumerate(wanted)))


def index_hits(counted: DataFrame, query: str, messages: int, tokens_: int) -> DataFrame:
    """(session_key, line_no, role, rank) of the messages that hold every phrase; counted by index_counts(), in a corpus of so many messages and tokens."""
    n = len(phrases(query))
    stats = counted.agg(F.lit(messages).alias("_n"), F.lit(tokens_ / max(messages, 1)).alias("_avg"), *_document_counts(n))
    return _ranked(counted, stats, n, ["session_key", "line_no", "role"])


def best_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key. The window keeps one row a key in each task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def with_position(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first `limit` rows in this order, numbered from 1 in `pos`; the limit bounds what is numbered."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long"))


def search(bodies: DataFrame | None, query: str, limit: int = 20, role: str | None = None, titles: DataFrame | None = None, stemmed: bool = False, digits: int | None = 9, hits: DataFrame | None = None, title_tokens: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(pos, tier, session_id, line_no, rank) of up to `limit` sessions.

    bodies: (session_id, line_no, role, text); titles: (session_id, text), hits of which come first unless a
    role is asked for. hits: (session_id, line_no, role, rank) from an index, in place of a scan of bodies. more: columns
    of hits and titles to keep. Ties go by session and line. As in a row-limited index scan, so many rows are looked at
    as OVERFETCH says. digits: scores are rounded to so many, so that ties are ties everywhere.
    """
    rank = lambda d: d.withColumn("rank", F.round("rank", digits)) if digits else d
    hits = rank(scored(bodies.select("session_id", "line_no", "role", "text"), query, stemmed=stemmed) if hits is None else hits)
    if role is not None:
        hits = hits.filter(F.col("role") == role)
    raw = min(max(OVERFETCH * limit, limit), MOST_ROWS)
    order = [F.col("tier"), F.col("rank"), F.col("session_id"), F.col("line_no")]
    rows = hits.select("session_id", F.col("line_no").cast("long"), "rank", *more).orderBy("rank", "session_id", "line_no").limit(raw).withColumn("tier", F.lit(1))
    if titles is not None and role is None:
        named = rank(scored(titles, query, stemmed=stemmed, tokens_=title_tokens)).select("session_id", F.lit(0).cast("long").alias("line_no"), "rank", *more)
        rows = named.orderBy("rank", "session_id").limit(limit).withColumn("tier", F.lit(0)).unionByName(rows)
    return with_position(best_per_key(rows, "session_id", *order), limit, *order).select("pos", "tier", "session_id", "line_no", "rank", *more)


def snippet(text: str, query: str, size: int = 12, left: str = "[", right: str = "]", more: str = "…", stemmed: bool = False) -> str:
    """Up to `size` tokens around the first match, matches in brackets; for the few rows of a result."""
    wanted = phrases(query, stemmed)
    places = spans(text)
    own = [stem(t) if stemmed else t for _, _, t in places]
    at = [(i, i + len(p)) for p in wanted for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p]
    if not places:
        return text
    first = min(at, default=(0, 0))[0]
    start = max(0, min(first - size // 3 if first + size > len(own) or first > size // 2 else 0, len(own) - size))
    end = min(start + size, len(own))
    out, here = [], 0 if start == 0 else places[start][0]
    inside = sorted({(max(a, start), min(b, end)) for a, b in at if a < end and b > start})
    for a, b in inside:
        if places[a][0] < here:
            continue
        out += [text[here : places[a][0]], left, text[places[a][0] : places[b - 1][1]], right]
        here = places[b - 1][1]
    stop = len(text) if end == len(own) else places[end - 1][1]
    return ("" if start == 0 else more) + "".join(out) + text[here:stop] + ("" if end == len(own) else more)


def postings(docs: DataFrame, doc_id: str, text: str = "text", stemmed: bool = False) -> DataFrame:
    """(doc_id, term, pos) of every token of every non-empty text: an inverted index, to be written sorted by term."""
    words = stem_all(tokens(F.col(text))) if stemmed else tokens(F.col(text))
    return docs.filter(F.col(text) != "").select(F.col(doc_id).alias("doc_id"), F.posexplode(words).alias("pos", "term")).select("doc_id", "term", "pos")


def index_problems(index: DataFrame, docs: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """(doc_id, problem): indexed documents that are gone or empty, and those with tokens that aren't indexed."""
    have = docs.filter(F.size(tokens(F.coalesce(F.col(text), F.lit("")))) > 0).select(F.col(doc_id).alias("doc_id")).distinct()
    indexed = index.select("doc_id").distinct()
    return indexed.join(have, "doc_id", "left_anti").withColumn("problem", F.lit("orphan")).union(have.join(indexed, "doc_id", "left_anti").withColumn("problem", F.lit("missing")))


def term_index_problems(index: DataFrame, messages: DataFrame, text: str = "text_for_fts") -> DataFrame:
    """(session_key, line_no, problem) of a stored term index against the messages: lines that are gone, not indexed, or whose tokens differ.

    The messages are indexed anew, and a digest of each line's terms and places is compared.
    """

    def lines(rows: DataFrame) -> DataFrame:
        each = rows.select("session_key", "term", F.explode("postings").alias("p")).select("session_key", "p.line_no", F.xxhash64("term", "p.positions", "p.role", "p.length").cast("decimal(20,0)").alias("h"))
        return each.groupBy("session_key", "line_no").agg(F.sum("h").alias("digest"))

    a, b = lines(index).withColumnRenamed("digest", "stored"), lines(term_index(messages, text)).withColumnRenamed("digest", "made")
    problem = F.when(F.col("made").isNull(), "orphan").when(F.col("stored").isNull(), "missing").when(F.col("stored") != F.col("made"), "differs")
    return a.join(b, ["session_key", "line_no"], "full_outer").select("session_key", "line_no", problem.alias("problem")).filter("problem is not null")


def corpus_stats(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """(term, n_docs, avg_len, df, occurrences) of each term over the non-empty texts, in one pass."""
    counted = docs.filter(F.col(text) != "").select(tokens(F.col(text)).alias("w"))
    counted = counted.select(F.size("w").alias("len"), *(occurrences(F.col("w"), [t]).alias(f"f{i}") for i, t in enumerate(terms)))
    row = counted.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *(x for i in range(len(terms)) for x in (F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}"), F.sum(f"f{i}").alias(f"n{i}"))))
    each = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"df{i}").alias("df"), F.col(f"n{i}").alias("occurrences")) for i, t in enumerate(terms)))
    return row.select("n_docs", "avg_len", F.explode(each).alias("t")).select("t.term", "n_docs", "avg_len", "t.df", F.coalesce("t.occurrences", F.lit(0)).alias("occurrences"))


def fuse(left: DataFrame, right: DataFrame, limit: int, key: str = "session_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists of (key, pos): (pos, key, score, left_pos, right_pos).

    Ties go to the better place in the left list, then to the smaller key.
    """
    a, b = left.select(key, F.col("pos").alias("left_pos")), right.select(key, F.col("pos").alias("right_pos"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = a.join(b, key, "full_outer").withColumn("score", F.round(part("left_pos") + part("right_pos"), 12))
    order = [F.col("score").desc(), F.col("left_pos").asc_nulls_last(), F.col(key)]
    return with_position(both, limit, *order).select("pos", key, "score", "left_pos", "right_pos")


def empty_hits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "pos long, tier int, session_id string, line_no long, rank double")
