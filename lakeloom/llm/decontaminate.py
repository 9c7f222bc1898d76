"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as UTF-8 bytes in lower case with single spaces. An item of m bytes has an edit budget
k = rate * m. Where a region of a text lies within k edits of the item, both share at least m - q + 1 - k * q
q-grams, all on diagonals (place in the text minus place in the item) that differ by at most k. So shared
q-grams are counted in overlapping bands of diagonals, and only bands that reach the bound are aligned, in
the band's diagonals widened by k. Nothing within the budget is missed.

Texts are looked at in overlapping pieces, and where a piece's q-grams occur in very many items, in ranges of items:
the pairs of places held at once are bounded, whatever items share. Bands that reach the bound are aligned together,
a row of all of them at a time; only those within the budget are followed back.

The benchmark is the query set: it goes to the workers in blocks of a bounded size, each block against all documents
in one pass without a shuffle. A benchmark of more than one block takes a pass for each, whose result is written
before the next block is sent, and the block is then released. Null and empty texts and items match nothing. Items
shorter than q bytes are found as they are, and items below 32 bytes have at most (size - q) // q edits, which can be
one less than the rate. Equal items are reported each by its own id, rows of one document id together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, freeing, materialize

Q, RATE = 8, 0.1
#: Bytes of benchmark text in each block, of document text in each piece, and of text compared in one batch of alignments.
BLOCK_BYTES, TEXT_BYTES, CELLS = 8 << 20, 1 << 20, 1 << 21
#: Pairs of equal q-grams held at once.
ENTRIES = 1 << 21
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def edit_budget(size: int, q: int = Q, rate: float = RATE) -> int:
    """The most edits for which the lemma's bound stays positive, up to the rate."""
    return max(0, min(int(rate * size), (size - q) // q))


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int | None = None) -> tuple[int, int, int]:
    """The least edits between item and a piece of text that begins on diagonals low to high; its start and end.

    Cells lie on the diagonals low to high only; places outside the text cost an edit like any other byte.
    most: give up, with most + 1 edits, once no cell is within it.
    """
    width = high - low + 1
    columns = np.arange(width, dtype=np.int32)
    padded = np.full(len(item) + width, 256, np.int16)
    a, b = max(low, 0), min(high + len(item), len(text))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    differs = (np.lib.stride_tricks.sliding_window_view(padded, width)[: len(item)] != item[:, None]).astype(np.int32)
    rows = np.zeros((len(item) + 1, width), np.int32)
    for i, d in enumerate(differs):
        cost, step = rows[i], rows[i + 1]
        np.add(cost, d, out=step)
        np.minimum(step[:-1], cost[1:] + 1, out=step[:-1])
        # the least over cells to the left, each further place in the text one edit
        step -= columns
        np.minimum.accumulate(step, out=step)
        step += columns
        if most is not None and i & 15 == 15 and step.min() > most:
            return most + 1, 0, 0
    j = end = int(rows[-1].argmin())
    for i in range(len(item), 0, -1):  # back along one best path
        while j and rows[i, j] == rows[i, j - 1] + 1 and rows[i, j] != rows[i - 1, j] + differs[i - 1, j]:
            j -= 1
        if rows[i, j] != rows[i - 1, j] + differs[i - 1, j]:
            j += 1
    return int(rows[-1, end]), low + j, low + end + len(item)


def least_edits(items: list[np.ndarray], text: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray) -> np.ndarray:
    """banded_distance() of many items at once, without places: each one's least edits on its diagonals, or more than most."""
    out = np.empty(len(items), np.int64)
    sizes, widths = np.array([len(x) for x in items]), high - low + 1
    order = np.lexsort((widths, sizes))
    at = 0
    while at < len(order):
        end, width = at, 0
        while end < len(order) and (end == at or max(width, widths[order[end]]) * (end + 1 - at) <= CELLS // 8):
            width = max(width, int(widths[order[end]]))
            end += 1
        part = order[at:end]
        at = end
        n, longest = len(part), int(sizes[part].max())
        item = np.full((n, longest), 257, np.int16)
        for k, i in enumerate(part):
            item[k, : sizes[i]] = items[i]
        columns = np.arange(width, dtype=np.int32)
        # beyond a band's own width nothing can be reached
        outside = np.where(columns[None] >= widths[part][:, None], np.int32(1 << 20), np.int32(0))
        cost, left = outside.copy(), np.arange(n)
        for i in range(longest):
            places = low[part][left][:, None] + i + columns[None]
            inside = (places >= 0) & (places < len(text))
            there = np.where(inside, text[np.clip(places, 0, max(len(text) - 1, 0))] if len(text) else 0, 256)
            step = cost + (there != item[left, i][:, None])
            np.minimum(step[:, :-1], cost[:, 1:] + 1, out=step[:, :-1])
            step -= columns
            np.minimum.accumulate(step, axis=1, out=step)
            step += columns
            cost = np.maximum(step, outside[left])
            ended = sizes[part[left]] == i + 1
            if ended.any() or i & 7 == 7:
                best = cost.min(axis=1)
                out[part[left[ended]]] = best[ended]
                lost = ~ended & (best > most[part[left]])
                out[part[left[lost]]] = most[part[left[lost]]] + 1
                stay = ~ended & ~lost
                if not stay.all():
                    left, cost = left[stay], cost[stay]
                if not len(left):
                    break
    return out


class QGramIndex:
    """Items of one block, their q-grams sorted, and a bit table that rules most q-grams out."""

    def __init__(self, items: list[tuple[int, str | None]], q: int = Q, rate: float = RATE):
        self.q = q
        self.ids = [i for i, _ in items]
        self.items = [np.frombuffer(normal(t), np.uint8) for _, t in items]
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.budget = np.array([edit_budget(n, q, rate) for n in self.sizes.tolist()], np.int64)
        self.reach = int((self.sizes + 2 * self.budget).max(initial=0)) + 2
        self.least = self.sizes - q + 1 - self.budget * q
        self.short = [(k, x.tobytes()) for k, x in enumerate(self.items) if 0 < len(x) < q]
        codes = [self.codes(x) for x in self.items]
        code = np.concatenate([*codes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)])
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.values, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.ranked = np.repeat(np.arange(len(self.values)), self.count) * len(self.ids) + self.item
        self.bits = max(16, int(4 * len(self.values)).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.slot(self.values)] = True

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Each q-gram as a number: its bytes where q is 8, else a polynomial over them."""
        n = len(x) - self.q + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if self.q == 8:
            return np.ndarray((n,), "<u8", x.tobytes(), 0, (1,)).astype(np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(self.q):
            out = out * np.uint64(1_000_003) + x[k : k + n]
        return out

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * MULTIPLY) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _shared(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, number of the q-gram) of each place whose q-gram is in some item."""
        code = self.codes(text)
        at = np.flatnonzero(self.table[self.slot(code)]) if len(code) and len(self.values) else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.values, code[at]), len(self.values) - 1)
        same = self.values[k] == code[at]
        return at[same], k[same]

    def candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, lowest diagonal, highest diagonal) of every band that reaches its item's bound."""
        at, k = self._shared(text)
        total = np.cumsum(self.count[k])
        if not len(at) or total[-1] <= ENTRIES:
            return self._bands(at, k, len(text), 0, len(self.ids))
        reach, found = self.reach, []
        start = 0
        while start < len(at):
            # a piece: places up to a bound of pairs, but never less than twice an item's reach, the last reach of it again in the next
            end = int(np.searchsorted(total, (total[start - 1] if start else 0) + ENTRIES, side="right"))
            end = max(end, int(np.searchsorted(at, at[start] + 2 * reach, side="right")), start + 1)
            pairs = int(total[end - 1] - (total[start - 1] if start else 0))
            ranges = max(1, -(-pairs // ENTRIES))
            cuts = np.unique(np.linspace(0, len(self.ids), min(ranges, max(len(self.ids), 1)) + 1).astype(np.int64))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found.append(self._bands(at[start:end], k[start:end], len(text), a, b))
            if end >= len(at):
                break
            start = max(start + 1, int(np.searchsorted(at, at[end - 1] - reach)))
        item, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        bands = np.unique(np.stack([item, low, high], axis=1), axis=0)
        return bands[:, 0], bands[:, 1], bands[:, 2]

    def _bands(self, at: np.ndarray, k: np.ndarray, size: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """candidates() among the items from first to last, by these places of a text of that size."""
        if last - first < len(self.ids):  # an item's entries of a q-gram are together, in the order of items
            begin = np.searchsorted(self.ranked, k * len(self.ids) + first)
            n = np.searchsorted(self.ranked, k * len(self.ids) + last) - begin
            at, begin, n = at[n > 0], begin[n > 0], n[n > 0]
        else:
            begin, n = self.first[k], self.count[k]
        if not len(at):
            return (np.zeros(0, np.int64),) * 3
        entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, place = self.item[entry], self.place[entry]
        at = np.repeat(at, n)
        shift = int(self.sizes.max())
        span = size + 2 * shift + 2
        keys = item * span + (at - place + shift) // (self.budget[item] + 1)
        key, hits = np.unique(keys, return_counts=True)
        item = key // span
        # a band is two neighbouring steps; its count that of both
        beside = np.r_[(key[1:] == key[:-1] + 1) & (item[1:] == item[:-1]), False]
        both = hits + np.where(beside, np.r_[hits[1:], 0], 0)
        keep = np.flatnonzero(both >= self.least[item])
        if 0 < len(keep) <= 1000:
            # what the lemma counts are distinct places in the text and in the item
            order = np.argsort(keys, kind="stable")
            sorted_, at, place = keys[order], at[order], place[order]
            a, b = np.searchsorted(sorted_, key[keep]), np.searchsorted(sorted_, key[keep] + 1 + beside[keep])
            keep = keep[[min(len(np.unique(at[x:y])), len(np.unique(place[x:y]))) >= self.least[i] for x, y, i in zip(a, b, item[keep], strict=True)]]
        item, band = item[keep], key[keep] % span
        low = band * (self.budget[item] + 1) - shift
        return item, low, low + 2 * (self.budget[item] + 1) - 1

    def _pieces(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, piece): pieces of TEXT_BYTES that overlap by what an item can reach."""
        step = max(TEXT_BYTES, 2 * self.reach)
        for at in range(0, max(len(text) - self.reach, 1), step):
            yield at, text[at : at + step + self.reach]

    def matches(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item number, edits, start, end) in the normal text: of each item that occurs, its best place."""
        best: dict[int, tuple[int, int, int]] = {}
        for k, x in self.short:
            if (at := text.find(x)) >= 0:
                best[k] = (0, at, at + len(x))
        for base, piece in self._pieces(text):
            raw = np.frombuffer(piece, np.uint8)
            items, low, high = self.candidates(raw)
            budget = self.budget[items]
            if len(items) > 8:
                edits = least_edits([self.items[k] for k in items.tolist()], raw, low - budget, high + budget, budget)
                fewest = np.full(len(self.ids), 1 << 40)
                np.minimum.at(fewest, items, edits)
                near = (edits <= budget) & (edits == fewest[items])  # only an item's best bands are followed back
                items, low, high, budget = items[near], low[near], high[near], budget[near]
            for k, a, b, most in zip(items.tolist(), low.tolist(), high.tolist(), budget.tolist(), strict=True):
                if k in best and best[k][0] == 0:
                    continue
                item, start = self.items[k], max(0, a - most)
                at = piece.find(item.tobytes(), start, max(0, b + most + len(item)))
                found = (0, at, at + len(item)) if at >= 0 else banded_distance(item, raw, a - most, b + most, most)
                found = (found[0], base + max(found[1], 0), base + min(found[2], len(raw)))
                if found[0] <= most and (k not in best or found < best[k]):
                    best[k] = found
        return [(k, *v) for k, v in sorted(best.items())]


    def holds(self, text: bytes) -> bool:
        """Whether any item occurs."""
        if any(x in text for _, x in self.short):
            return True
        for _, piece in self._pieces(text):
            raw = np.frombuffer(piece, np.uint8)
            items, low, high = self.candidates(raw)
            budget = self.budget[items]
            if len(items) <= 8:
                for k, a, b, most in zip(items.tolist(), low.tolist(), high.tolist(), budget.tolist(), strict=True):
                    item = self.items[k]
                    if piece.find(item.tobytes(), max(0, a - most), max(0, b + most + len(item))) >= 0 or banded_distance(item, raw, a - most, b + most, most)[0] <= most:
                        return True
                continue
            for at in range(0, len(items), 512):
                part = slice(at, at + 512)
                if (least_edits([self.items[x] for x in items[part].tolist()], raw, (low - budget)[part], (high + budget)[part], budget[part]) <= budget[part]).any():
                    return True
        return False


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The benchmark's items by id, in blocks, each with whether it is the only one; the driver holds one block at a time."""
    part, size, sent = [], 0, False
    for i, t in benchmark.select(F.col(item_id).cast("long"), F.col(text)).filter(F.col(text).isNotNull()).distinct().orderBy(F.col(item_id), F.col(text)).toLocalIterator():
        if size >= block_bytes:
            yield part, False
            part, size, sent = [], 0, True
        part.append((i, t))
        size += len(t)
    yield part, not sent


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, start, end) of every item within its budget of a region of a document.

    start and end are bytes of the document's normal form; an item that occurs in several places is given at
    the place of the fewest edits, the first of equals.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = []
    for items, only in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = QGramIndex(shared.value, q, rate)
            for b in batches:
                found = [(i, index.ids[k], e, s, z) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, e, s, z in index.matches(normal(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in range(5)], ["doc_id", "item_id", "edits", "start", "end"])

        part = rows.mapInArrow(freeing(run), "doc_id long, item_id long, edits long, start long, end long")
        if only:
            return part
        found.append(materialize(part, "leaks"))
        shared.destroy()
    return reduce(DataFrame.union, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents that hold no item, with all their columns; decided where the text is, without a join."""
    left = docs
    for items, only in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = QGramIndex(shared.value, q, rate)
            for b in batches:
                yield b.filter(pa.array([not index.holds(normal(t)) for t in b.column(text).to_pylist()], pa.bool_()))

        part = left.mapInArrow(freeing(run), docs.schema)
        if only:
            return part
        new = materialize(part, "clean")
        shared.destroy()
        if left is not docs:
            drop_table(left)
        left = new
    return left
