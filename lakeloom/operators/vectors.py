"""Chunks and vectors: greedy packing of messages, cosine scores, best chunk, hybrid search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import freeing
from ..functions.text import trim
from .search import best_per_key, fuse, search, with_position

CHUNK = 1200
#: Scores that similar_many() holds at once in a task.
CELLS = 1 << 20
Embedder = Callable[[list[str]], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    """The inner product; the longer of two arrays is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def chunked(texts: Column, size: int = CHUNK) -> Column:
    """Messages, in order, packed greedily into chunks of at most `size` bytes, joined by newlines.

    A message of more bytes is cut by itself into pieces of `size` characters. Blank messages are left out.
    """
    kept = F.filter(F.transform(texts, trim), lambda t: t != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    pieces = lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.length(m) - 1) / size).cast("int")), lambda i: F.substring(m, i * size + 1, F.lit(size)))
    flushed = lambda s: F.when(s.open != "", F.array_append(s.done, s.open)).otherwise(s.done)

    def step(s: Column, m: Column) -> Column:
        large = F.octet_length(m) > size
        over = (s.open != "") & (F.octet_length(s.open) + 1 + F.octet_length(m) > size)
        done = F.when(large, F.concat(flushed(s), pieces(m))).when(over, flushed(s)).otherwise(s.done)
        open_ = F.when(large, F.lit("")).when(over | (s.open == ""), m).otherwise(F.concat(s.open, F.lit("\n"), m))
        return F.struct(done.alias("done"), open_.alias("open"))

    return F.aggregate(kept, state, step, flushed)


def chunk_sessions(messages: DataFrame, key: str = "session_id", line: str = "line_no", text: str = "text", size: int = CHUNK) -> DataFrame:
    """(key, ordinal, text) of each session's chunks; a session is one row while it is packed."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(line).alias("l"), F.col(text).alias("t")))), lambda x: x.t)
    return messages.filter(F.col(text).isNotNull()).groupBy(key).agg(chunked(ordered, size).alias("c")).select(key, F.posexplode("c").alias("ordinal", "text"))


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed word hashes, normalized: a deterministic embedder for where no model is at hand."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed_chunks(chunks: DataFrame, embed: Embedder, text: str = "text", prefix: str = "passage: ", batch: int = 256) -> DataFrame:
    """Append `vec`; batches of Arrow rows, the embedder built once in each task."""
    kept = chunks.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), batch):
                part = p.iloc[at : at + batch].copy()
                part["vec"] = list(embed([prefix + (t or "") for t in part[text]]))
                yield part

    schema = chunks.withColumn("vec", F.lit(None).cast("array<float>")).schema
    return chunks.select(*kept).mapInPandas(run, schema)


def pending(parents: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    """Parents that have no child yet."""
    return parents.join(children.select(*on).distinct(), on, "left_anti")


def similar(vectors: DataFrame, query: Column, limit: int, key: str, vec: str = "vec", digits: int = 6) -> DataFrame:
    """(pos, key, score) of the rows nearest to a query vector; the query is a literal or one-row column."""
    rows = vectors.select(F.col(key), F.round(dot(F.col(vec), query), digits).alias("score"))
    return with_position(rows, limit, F.col("score").desc(), F.col(key)).select("pos", key, "score")


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    sizes = pc.unique(pc.list_value_length(vectors))
    if len(sizes) != 1 or sizes.null_count:
        raise ValueError("vectors must be there, and of one length")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _best(query: np.ndarray, keys: np.ndarray, scores: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's `limit` first rows by falling score, what isn't a number before all, then by key; in that order."""
    order = np.lexsort((keys, -scores, ~np.isnan(scores), query))
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    kept = order[rank < limit]
    return query[kept], keys[kept], scores[kept]


def similar_many(vectors: DataFrame, queries: DataFrame, limit: int, key: str, vec: str = "vec", digits: int = 6, block: int = 4096) -> DataFrame:
    """(query, pos, key, score) of the rows nearest to each of many query vectors (query, vec), in blocks of queries against all rows.

    A block is a bounded broadcast; a task keeps its `limit` best rows of each query, so only those are exchanged. Rows
    are scored in pieces, so that a task holds at most some CELLS scores at once.
    """
    out, held = None, []
    block = max(1, min(block, CELLS // max(limit, 1)))

    def one(ids: list, matrix: np.ndarray) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            query, keys, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # the best rows so far, by query
            least = np.full(len(ids), -np.inf)  # of queries that have `limit` rows
            step = max(1, CELLS // max(len(ids), 1))
            for p in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step) if len(ids)):
                names, found = np.array(p.column(0).to_pylist(), np.int64), np.round(q @ _matrix(p.column(1)).T, digits)
                near = ~(found < least[:, None])  # a comparison that keeps what isn't a number
                if limit < found.shape[1]:
                    near &= ~(found < np.partition(found, -limit, axis=1)[:, [-limit]])
                at, row = np.nonzero(near)
                if len(at):
                    query, keys, scores = _best(np.r_[query, at], np.r_[keys, names[row]], np.r_[scores, found[at, row]], limit)
                    last = np.flatnonzero(np.r_[query[1:] != query[:-1], True])
                    full = last[np.diff(last, prepend=-1) == limit]
                    least[query[full]] = scores[full]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[query]), pa.array(keys), pa.array(scores)], ["query", key, "score"])

        return vectors.select(F.col(key).cast("long"), F.col(vec).cast("array<double>")).mapInArrow(freeing(run), f"query long, {key} long, score double")

    for r in queries.select(F.col("query").cast("long"), F.col("vec").cast("array<double>")).orderBy("query").toLocalIterator():
        held.append(r)
        if len(held) == block:
            part = one([x[0] for x in held], np.array([x[1] for x in held]))
            out, held = part if out is None else out.union(part), []
    if held or out is None:
        part = one([x[0] for x in held], np.array([x[1] for x in held]).reshape(len(held), -1))
        out = part if out is None else out.union(part)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col(key))
    return out.withColumn("pos", F.row_number().over(order).cast("long")).filter(F.col("pos") <= limit).select("query", "pos", key, "score")


def best_chunk(vectors: DataFrame, query: Column, session: str, chunk: str, vec: str = "vec", digits: int = 6) -> DataFrame:
    """(session, chunk, score): each session's nearest chunk, the first of equals."""
    rows = vectors.select(session, chunk, F.round(dot(F.col(vec), query), digits).alias("score"))
    return best_per_key(rows, session, F.col("score").desc(), F.col(chunk))


def hybrid_search(bodies: DataFrame | None, vectors: DataFrame, query: str, query_vec: Column, limit: int, session: str = "session_id", titles: DataFrame | None = None, chunk: str = "ordinal", words: DataFrame | None = None) -> DataFrame:
    """(pos, session_id, score, rank, line_no, left_pos, right_pos): keyword and vector hits, fused.

    Both lists are three times as long; words: the keyword list, if it is at hand. rank is the keyword score, 0 for sessions that only vectors found.
    """
    over = 3 * limit
    words = search(bodies, query, over, titles=titles) if words is None else words
    near = best_chunk(vectors, query_vec, session, chunk)
    near = with_position(near, over, F.col("score").desc(), F.col(session)).select(F.col(session).alias("session_id"), "pos")
    fused = fuse(words, near, limit)
    return fused.join(F.broadcast(words.select("session_id", "rank", "line_no")), "session_id", "left").select("pos", "session_id", "score", F.coalesce("rank", F.lit(0.0)).alias("rank"), F.coalesce("line_no", F.lit(0)).cast("long").alias("line_no"), "left_pos", "right_pos")

