"""Language identification by a byte convolutional network, trained in numpy.

Texts are cut into fixed-length windows of UTF-8 bytes. Byte vectors, filters of several widths, ReLU, the
maximum over a window and a softmax give a window's log-probabilities; a text's are the mean over all its
windows, weighted by their bytes. For prediction the filters are folded into tables over bytes and byte pairs.

Null texts and texts without a letter are `und` with score 0. Without labelled rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import HELD_OUT, fold

LENGTH, EMBED, FILTERS, WIDTHS, UNKNOWN = 192, 8, 12, (2, 3, 4), "und"
#: The bound of the training sample: documents of each language, chosen by their id's hash, and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS, BATCH, RATE, SEED = 1200, 2, 6, 64, 0.01, 3
LETTER = regex.compile(r"\p{L}")


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text, the last filled with zero bytes."""
    return np.frombuffer(raw + b"\0" * (-len(raw) % LENGTH), np.uint8).reshape(-1, LENGTH)


class ByteNet:
    def __init__(self, classes: list[str]):
        rng = np.random.default_rng(SEED)
        self.classes = classes
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED)), "o": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))), "c": np.zeros(len(classes))}
        for k in WIDTHS:
            self.p[f"w{k}"], self.p[f"b{k}"] = rng.normal(0, (2 / (k * EMBED)) ** 0.5, (k * EMBED, FILTERS)), np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on the cross-entropy of windows x with classes y."""
        rng, p = np.random.default_rng(SEED), self.p
        m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                i = order[at : at + BATCH]
                step += 1
                for k, g in self.gradients(x[i], y[i]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= RATE * 0.5**epoch * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, kept = [], []
        for k in WIDTHS:
            slides = np.lib.stride_tricks.sliding_window_view(e, k, axis=1).transpose(0, 1, 3, 2).reshape(n, LENGTH - k + 1, k * EMBED)
            r = slides @ p[f"w{k}"] + p[f"b{k}"]
            top = r.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(r, top[:, None], 1)[:, 0], 0))
            kept.append(top)
        h = np.concatenate(pooled, axis=1)
        z = h @ p["o"] + p["c"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"o": h.T @ q, "c": q.sum(axis=0), "e": np.zeros_like(p["e"])}
        back = (q @ p["o"].T) * (h > 0)
        for j, (k, top) in enumerate(zip(WIDTHS, kept, strict=True)):
            d = back[:, j * FILTERS : (j + 1) * FILTERS]
            byte = x[np.arange(n)[:, None, None], top[:, :, None] + np.arange(k)]  # example, filter, place
            seen = p["e"][byte].reshape(n, FILTERS, k * EMBED)
            g[f"w{k}"] = np.einsum("nf,nfe->ef", d, seen)
            g[f"b{k}"] = d.sum(axis=0)
            de = (d[:, :, None] * p[f"w{k}"].T[None]).reshape(-1, EMBED)
            np.add.at(g["e"], byte.reshape(-1), de)
        return g

    def compiled(self) -> ByteNet:
        """Fold byte vectors and filters into tables: of a pair and what follows it."""
        p = self.p
        one = {k: [p["e"] @ p[f"w{k}"][i * EMBED : (i + 1) * EMBED] for i in range(k)] for k in WIDTHS}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1).astype(np.float32)
        self.first = np.concatenate([pair(one[k][0], one[k][1]) + p[f"b{k}"] for k in WIDTHS], axis=1)
        self.third, self.last = one[3][2].astype(np.float32), pair(one[4][2], one[4][3])
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window; the same values whatever windows are beside it."""
        out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        for at in range(0, len(x), 16):
            part = x[at : at + 16].astype(np.int32)
            code = part[:, :-1] << 8 | part[:, 1:]
            r = self.first[code]
            a, b = FILTERS, 2 * FILTERS
            n = len(part)
            out[at : at + n, :a] = r[:, :, :a].max(axis=1)
            out[at : at + n, a:b] = (r[:, :-1, a:b] + self.third[part[:, 2:]]).max(axis=1)
            out[at : at + n, b:] = (r[:, :-2, b:] + self.last[code[:, 2:]]).max(axis=1)
        h = np.maximum(out, 0).astype(np.float64)
        z = (h[:, :, None] * self.p["o"].astype(np.float64)[None]).sum(axis=1) + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        raw = [t.encode() if t and LETTER.search(t) else b"" for t in texts]
        sizes = np.array([-(-len(r) // LENGTH) for r in raw])
        total = np.zeros((len(raw), len(self.classes)))
        owner = np.repeat(np.arange(len(raw)), sizes)
        if len(owner):
            x = np.concatenate([windows(r) for r in raw if r])
            weight = np.full(len(x), LENGTH)
            ends = np.cumsum(sizes)[sizes > 0] - 1
            weight[ends] = [len(r) - (len(r) - 1) // LENGTH * LENGTH for r in raw if r]
            np.add.at(total, owner, self.log_probabilities(x) * weight[:, None])
        out = []
        for r, t in zip(raw, total, strict=True):
            if not r:
                out.append((UNKNOWN, 0.0))
                continue
            q = np.exp((t - t.max()) / len(r))
            k = int(t.argmax())
            out.append((self.classes[k], float(q[k] / q.sum())))
        return out


def train(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text") -> ByteNet | None:
    """Fit on a bounded sample of labelled rows outside the held-out fold; None without any."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null").withColumn("fold", fold()).filter(F.col("fold") != HELD_OUT)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    # ids whose hash lies in a share of its range that holds about SAMPLE_DOCS of the language
    share = F.lit(0)
    for k, n in counts.items():
        share = F.when(F.col("lang") == k, F.lit(min(1 << 20, -(-SAMPLE_DOCS * (1 << 20) // n)))).otherwise(share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, k in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                w = windows(t.encode())
                rng = np.random.default_rng(i & (1 << 62) - 1)
                out += [(i, k, w[j].tobytes()) for j in sorted(rng.permutation(len(w))[:SAMPLE_WINDOWS])] if LETTER.search(t) else []
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int64(), pa.string(), pa.binary()))], ["doc_id", "lang", "bytes"])

    few = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("doc_id", "text", "lang").mapInArrow(cut, "doc_id long, lang string, bytes binary")
    got = sorted(tuple(r) for r in few.collect())
    if not got:
        return None
    classes = sorted({r[1] for r in got})
    net = ByteNet(classes)
    net.fit(np.stack([np.frombuffer(bytes(r[2]), np.uint8) for r in got]), np.array([classes.index(r[1]) for r in got]))
    return net.compiled()


def identify_language(docs: DataFrame, net: ByteNet | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by whole texts; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found, at = b.column(1).to_pylist(), [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < 1 << 20:
                    size += len(texts[end] or "")
                    end += 1
                found += net.predict(texts[at:end]) if net else [(UNKNOWN, 0.0)] * (end - at)
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", (fold() == HELD_OUT).alias("held_out"), "lang_pred", "score")
