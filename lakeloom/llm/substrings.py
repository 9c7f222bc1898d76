"""Removal of repeated word sequences by difference-cover anchors.

A window is `window` words in a row. With a difference cover D of a period p, two equal windows share an
offset below p at which both lie at cover positions, so the anchor hashes of window - p + 1 words, taken at
cover positions only, find every pair. Three steps:

1. Anchors go to buckets by their hash; those that occur twice mark their position.
2. Windows around marked anchors are extended: their whole word sequence is hashed (96 bits) and goes to
   buckets, where all but the first occurrence by (doc_id, start) are repeats.
3. Each document drops the words that repeats cover.

Rows between the steps are packed arrays for a batch and bucket. A batch sends each hash once, whatever its
frequency, so a hot passage costs one entry for each batch; what repeats within a batch is marked there. The
number of buckets, and of tasks, follows the total text size. All steps recompute from the documents; nothing is collected.

Null text has no words. Rows of the same id are in the order of their text's hash; equal rows don't count as
earlier than one another. Null ids come before all others. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Perfect difference covers: every difference modulo the period occurs between two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
WINDOW, PERIOD = 20, 13
#: Text bytes for each bucket of hashes and of documents, and for each batch within a task.
BUCKET_BYTES, BATCH_BYTES = 12 << 20, 8 << 20
NO_ID = -(1 << 63)

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def window_hashes(words: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """A hash of words[i : i + size] for each i in at, from 64-bit word hashes; positions don't matter."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * ODD + words[at + k]
    return _mix(out)


class Batch:
    """Documents of a task's batch, their word hashes end to end."""

    def __init__(self, ids: list, keys: list, texts: list):
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.keys = np.array(keys, np.int64)
        digest, hashed = xxhash.xxh64_intdigest, [np.zeros(0, np.uint64)]
        for t in texts:
            words = (t or "").encode().split()
            hashed.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        self.sizes = np.array([len(w) for w in hashed[1:]], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]].astype(np.int64)
        self.words = np.concatenate(hashed)

    def positions(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, start) of every window of this size."""
        n = np.maximum(self.sizes - size + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        return doc, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _batches(batches: Iterator[pa.RecordBatch], bytes_: int) -> Iterator[tuple[list, list, list]]:
    ids, keys, texts, held = [], [], [], 0
    for b in batches:
        for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            ids.append(i), keys.append(k), texts.append(t)
            held += len(t or "")
            if held >= bytes_:
                yield ids, keys, texts
                ids, keys, texts, held = [], [], [], 0
    if ids:
        yield ids, keys, texts


def _cut(order_by: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """A stable order by these values, and the slice of each value in it."""
    order = np.argsort(order_by, kind="stable")
    values, first = np.unique(order_by[order], return_index=True)
    ends = np.r_[first, len(order)][1:]
    return order, [(int(v), slice(a, b)) for v, a, b in zip(values, first, ends, strict=True)]


#: doc: the documents' (id, key) pairs; ref: each entry's document by number; at: its position; hash: 4 or 12 bytes each.
PACKED = "to string, bucket long, doc binary, ref binary, at binary, hash binary"
NAMES = ["to", "bucket", "doc", "ref", "at", "hash"]


def _planes(x: np.ndarray) -> bytes:
    """The low bytes of 32-bit numbers, then the next, to the high ones, which are mostly equal and shrink."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _packed(to: str, buckets: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: np.ndarray, hashes: np.ndarray | None) -> list[tuple]:
    rows = []
    order, parts = _cut(buckets)
    for bucket, s in parts:
        i = order[s]
        pair = np.stack([ids[i], keys[i]], axis=1)
        new = np.r_[True, (pair[1:] != pair[:-1]).any(axis=1)]
        rows.append((to, bucket, pair[new].tobytes(), _planes(np.cumsum(new) - 1), _planes(at[i]), hashes[i].tobytes() if hashes is not None else None))
    return rows


def _record(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), *[pa.binary()] * 4], strict=True)], NAMES)


def _unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, key, position, hash as rows of words) of all entries of these packed rows."""
    ids, keys, at, hashes = [], [], [], []
    for doc, ref, pos, h in zip(pdf["doc"], pdf["ref"], pdf["at"], pdf["hash"], strict=True):
        r = _numbers(ref)
        d = np.frombuffer(doc, np.int64).reshape(-1, 2)[r]
        ids.append(d[:, 0]), keys.append(d[:, 1]), at.append(_numbers(pos).astype(np.int64))
        if h is not None:
            hashes.append(np.frombuffer(h, np.uint8).reshape(len(r), -1))
    return np.concatenate(ids), np.concatenate(keys), np.concatenate(at), np.concatenate(hashes) if hashes else np.zeros((0, 0), np.uint8)


def _doc_bucket(ids: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    return (_mix(ids.view(np.uint64) * ODD ^ keys.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, period: int = PERIOD, bucket_bytes: int = BUCKET_BYTES, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; with_text: also kept_text, its kept words."""
    if period not in COVERS or not period <= window:
        raise ValueError(f"the period must be one of {sorted(COVERS)} and at most the window")
    anchor, cover = window - period + 1, np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(8, -(-total // bucket_bytes))
    first_of = lambda h: np.unique(h, return_index=True, return_inverse=True, return_counts=True)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches, BATCH_BYTES):
            b = Batch(*part)
            doc, start = b.positions(anchor)
            keep = cover[start % period]
            doc, start = doc[keep], start[keep]
            h = window_hashes(b.words, anchor, b.starts[doc] + start)
            _, first, inverse, count = first_of(h)
            again = count[inverse] > 1
            out = _packed("mark", _doc_bucket(b.ids[doc[again]], b.keys[doc[again]], n), b.ids[doc[again]], b.keys[doc[again]], start[again], None) if again.any() else []
            first.sort()
            d = doc[first]
            # 32 bits beside the bucket: what they take for equal is compared in full with the windows
            out += _packed("hash", ((h[first] >> np.uint64(32)) % np.uint64(n)).astype(np.int64), b.ids[d], b.keys[d], start[first], h[first].astype(np.uint32))
            yield _record(out)

    def twice(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] != "hash":
            return pdf
        ids, keys, at, h = _unpacked(pdf)
        _, inverse, count = np.unique(h.view(np.uint32).ravel(), return_inverse=True, return_counts=True)
        i = count[inverse] > 1
        return pd.DataFrame(_packed("mark", _doc_bucket(ids[i], keys[i], n), ids[i], keys[i], at[i], None), columns=NAMES)

    def marked(pdf: pd.DataFrame) -> dict[tuple[int, int], np.ndarray]:
        if not len(pdf):
            return {}
        ids, keys, at, _ = _unpacked(pdf)
        order = np.lexsort((at, keys, ids))
        ids, keys, at = ids[order], keys[order], at[order]
        cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(keys) != 0)) + 1
        return {(int(ids[s[0]]), int(keys[s[0]])): at[s] for s in np.split(np.arange(len(ids)), cuts)}

    def extend(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found, out = marked(right), []
        if found and len(left):
            b = Batch(left["doc_id"].tolist() if left["doc_id"].notna().all() else [None if pd.isna(x) else int(x) for x in left["doc_id"]], left["key"].tolist(), left["text"].tolist())
            near = []
            for d, pair in enumerate(zip(b.ids.tolist(), b.keys.tolist(), strict=True)):
                at, m = found.get(pair), int(b.sizes[d]) - window + 1
                if at is not None and m > 0:  # windows that hold a marked anchor
                    step = np.zeros(m + 1, np.int32)
                    np.add.at(step, np.maximum(at - (period - 1), 0), 1)
                    np.add.at(step, np.minimum(at + 1, m), -1)
                    near.append((d, np.flatnonzero(np.cumsum(step)[:m] > 0)))
            if near:
                doc = np.concatenate([np.full(len(s), d) for d, s in near])
                start = np.concatenate([s for _, s in near])
                at = b.starts[doc] + start
                h = np.stack([window_hashes(b.words, window, at), window_hashes(_mix(b.words + ODD), window, at)], axis=1)
                order = np.lexsort((start, b.ids[doc], h[:, 1], h[:, 0]))
                doc, start, h = doc[order], start[order], h[order]
                new = np.r_[True, (h[1:] != h[:-1]).any(axis=1)]
                group = np.cumsum(new) - 1
                low = np.flatnonzero(new)[group]
                later = (b.ids[doc] != b.ids[doc[low]]) | (start != start[low])
                d = doc[later]
                out += _packed("mark", _doc_bucket(b.ids[d], b.keys[d], n), b.ids[d], b.keys[d], start[later], None) if later.any() else []
                # all rows at a hash's first place go on: equal places of rows of one id stay or fall together
                first = np.flatnonzero(~later)
                first = first[np.lexsort((start[first], doc[first]))]
                d, s, g = doc[first], start[first], h[first]
                out += _packed("hash", (g[:, 0] % np.uint64(n)).astype(np.int64), b.ids[d], b.keys[d], s, g.view(np.uint32).reshape(-1, 4)[:, :3])
        return pd.DataFrame(out, columns=NAMES)

    def repeats(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] != "hash":
            return pdf
        ids, keys, at, raw = _unpacked(pdf)
        h = np.ascontiguousarray(raw).view(np.uint32).reshape(-1, 3)
        order = np.lexsort((at, ids, h[:, 2], h[:, 1], h[:, 0]))
        ids, keys, at, h = ids[order], keys[order], at[order], h[order]
        new = np.r_[True, (h[1:] != h[:-1]).any(axis=1)]
        low = np.flatnonzero(new)[np.cumsum(new) - 1]
        i = (ids != ids[low]) | (at != at[low])
        return pd.DataFrame(_packed("mark", _doc_bucket(ids[i], keys[i], n), ids[i], keys[i], at[i], None), columns=NAMES)

    def drop(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found, out = marked(right), []
        for i, k, t in zip(left["doc_id"], left["key"], left["text"], strict=True):
            words, i = (t or "").encode().split(), None if pd.isna(i) else int(i)
            at = found.get((NO_ID if i is None else i, int(k)))
            gone = 0
            if at is not None:
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                keep = np.cumsum(step)[:-1] == 0
                gone = len(words) - int(keep.sum())
                kept = b" ".join([w for w, x in zip(words, keep.tolist(), strict=True) if x])
            else:
                kept = b" ".join(words)
            out.append((i, len(words), gone, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
        result = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])
        return result.astype({"doc_id": "Int64"})


    def with_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array([NO_ID if x is None else x for x in b.column(0).to_pylist()], np.int64)
            keys = np.array(b.column(1).to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_doc_bucket(ids, keys, n))], ["doc_id", "key", "text", "bucket"])

    by_doc = rows.mapInArrow(with_bucket, "doc_id long, key long, text string, bucket long").repartition(n, "bucket")
    by_target = lambda d: d.repartition(n, "to", "bucket").groupBy("to", "bucket")
    by_bucket = lambda d: d.repartition(n, "bucket").groupBy("bucket")
    marks = by_target(rows.mapInArrow(anchors, PACKED)).applyInPandas(twice, PACKED)
    windows = by_doc.groupBy("bucket").cogroup(by_bucket(marks)).applyInPandas(extend, PACKED)
    marks = by_target(windows).applyInPandas(repeats, PACKED)
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return by_doc.groupBy("bucket").cogroup(by_bucket(marks)).applyInPandas(drop, result)
