"""Quality scores: random Fourier features, ridge from partition-summed normal equations, isotonic calibration.

Every document gets a fixed vector of statistics of its whole text. Cosines of random projections of the
standardized vector approximate a Gaussian kernel. Each partition sums its own normal equations; the sums are
added level by level, so the driver gets a few small matrices whatever the number of partitions. Ridge scores
of a fold that the weights have not seen are counted in fixed bins and made monotone by pooling adjacent
violators; between the pools' centres the calibration is linear.

Null and empty texts count as the empty text. A row without a label doesn't train; without any labelled rows
every score is 0.5. Each label row of an id counts; rows of one id are scored each by its own text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, materialize, only_result

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
FEATURES, RIDGE, SEED, BINS, THRESHOLD = 384, 1e-3, 7, 2000, 0.3

_CLASS = np.zeros((8, 256))
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"()-", b"!", b"#$%&*@^~<>=+_\\/{}[]`", b"|", b" \t\n\r\x0b\x0c")):
    _CLASS[_k, list(_bytes)] = 1
STATISTICS = 26


def statistics(text: str | None) -> np.ndarray:
    """Fixed statistics of a whole text, all finite."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, mark, bang, symbol, bar, space = (_CLASS @ count).tolist()
    high = float(count[128:].sum())
    words = raw.split()
    m = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sentences = [x for x in raw.replace(b"!", b".").replace(b"\n", b".").split(b".") if x.strip()]
    caps = sum(map(bytes.isupper, words))
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / max(m - 2, 1) if len(words) > 2 else 1.0
    return np.array(
        [
            np.log1p(len(raw)), np.log1p(len(words)), sizes.mean(), sizes.std(), sizes.max(), upper / max(upper + lower, 1), digit / n, mark / n, bang / n, symbol / n, bar / n, space / n, high / n,
            symbol / m, bang / m, bar / m, caps / m, len(kinds) / m, max(kinds.values(), default=0) / m, triples, len(set(lines)) / max(len(lines), 1), len(set(sentences)) / max(len(sentences), 1),
            np.log1p(len(sentences)), len(sentences) / m, len(zlib.compress(raw, 1)) / n if raw else 1.0, np.log1p(max(map(len, lines), default=0)),
        ],
        np.float32,
    )


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats binary: float32 values) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(x).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "stats"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(freeing(run), "doc_id long, stats binary")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT)).cast("int")


def _summed(df: DataFrame, size: int) -> np.ndarray:
    """The sum of a one-column table of float64 arrays of this size, added in levels of 32 rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = df.rdd.getNumPartitions()
    while parts > 32:
        parts = -(-parts // 32)
        df = df.repartition(parts).mapInArrow(add, "part binary")
    return np.sum([np.frombuffer(r[0]) for r in df.collect()] or [np.zeros(size)], axis=0)


class QualityModel:
    """mean, scale: of the statistics; w, b: the random projection; beta: ridge weights; knots, values: calibration."""

    def __init__(self, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(size=(STATISTICS, features)) / np.sqrt(STATISTICS / 4)
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.mean, self.scale, self.beta = np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(features + 1)
        self.knots, self.values = np.array([0.0]), np.array([0.5])

    def transform(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.transform(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(count: np.ndarray, total: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators of bins in rising order: the pools' mean places and mean values."""
    pools: list[list[float]] = []
    for c, t, x in zip(count, total, at, strict=True):
        pools.append([c, t, c * x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 2] / p[:, 0], p[:, 1] / p[:, 0]


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", features: int = FEATURES, ridge: float = RIDGE) -> QualityModel:
    """Fit on the labelled rows outside the held-out fold; one fold of these calibrates."""
    with only_result(stats.sparkSession):
        return _train(stats, labels, label, doc_id, features, ridge)


def _train(stats: DataFrame, labels: DataFrame, label: str, doc_id: str, features: int, ridge: float) -> QualityModel:
    model, d = QualityModel(features), features + 1
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("y is not null and doc_id is not null")
    rows = materialize(stats.join(known, "doc_id").withColumn("fold", fold()).filter(F.col("fold") != HELD_OUT).select("stats", "y", "fold"), "labelled")

    def values(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(-1, STATISTICS).astype(float), b.column(1).to_numpy()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * STATISTICS)
        for b in batches:
            x, _ = values(b)
            total += np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    m = _summed(rows.select("stats", "y").mapInArrow(moments, "part binary"), 1 + 2 * STATISTICS)
    if not m[0]:
        return model
    model.mean = m[1 : 1 + STATISTICS] / m[0]
    model.scale = np.sqrt(np.maximum(m[1 + STATISTICS :] / m[0] - model.mean**2, 0)) + 1e-6

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right, n = np.zeros((d, d)), np.zeros(d), 0.0
        for b in batches:
            x, y = values(b)
            z = model.transform(x)
            gram, right, n = gram + z.T @ z, right + z.T @ y, n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[gram.ravel(), right, n].tobytes()], pa.binary())], ["part"])

    fit = rows.filter(F.col("fold") != CALIBRATION)
    s = _summed(fit.select("stats", "y").mapInArrow(normal, "part binary"), d * d + d + 1)
    if not s[-1]:
        return model
    model.beta = np.linalg.solve(s[: d * d].reshape(d, d) + ridge * s[-1] / d * np.eye(d), s[d * d : -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS))
        for b in batches:
            x, y = values(b)
            at = np.clip((model.raw(x) + 0.5) * BINS / 2, 0, BINS - 1).astype(int)
            total += [np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    c, t = _summed(rows.filter(F.col("fold") == CALIBRATION).select("stats", "y").mapInArrow(binned, "part binary"), 2 * BINS).reshape(2, BINS)
    if c.any():
        at = (np.arange(BINS) + 0.5) * 2 / BINS - 0.5
        model.knots, model.values = isotonic(c[c > 0], t[c > 0], at[c > 0])
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score) of every row; learns from the labels, then scores all rows."""
    stats = materialize(text_statistics(docs, doc_id, text), "stats")
    return scored(stats, train(stats, labels, label, doc_id))


def scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, STATISTICS).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(freeing(run), "doc_id long, score double").select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents whose score reaches the threshold, with the columns they had.

    Statistics are computed twice, once to learn and once to filter, so that no text is shuffled.
    """
    model = train(text_statistics(docs), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([statistics(t) for t in b.column("text").to_pylist()]).astype(float)
                yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(freeing(run), docs.schema)
