"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenized whole. A document of more than one window gives full windows at once; what is left
of it is shorter than a window. These rests are packed in blocks: each rest starts as a partial partition of
k windows (itself and k - 1 empty ones); the two partial partitions of the largest spread are merged, the
fullest window of one with the emptiest of the other, until one partition is left. Its windows are nearly
equal. k starts at the smallest count that could hold the block and rises until no window is over capacity.
Rests are cut at `grain` tokens, so that near-equal windows are also near-full ones.

A block is a bounded number of rests of one input partition: no shuffle, memory of one block, and a lost task
gives the same windows when it runs again. Sequence ids hold the partition and a counter within it.

Null or empty text: a document of one token, the end token. Equal rows and equal ids are packed each for itself.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

CAPACITY, END_ID, VOCABULARY = 2048, 1, "word_bpe_49k.json"
BLOCK_TOKENS, GRAIN = 1 << 19, 512
#: Bounds of the cache, in memory and by string, from a text's space-separated strings to their ids.
CACHE_BYTES, CACHE_CHARS = 64 << 20, 64
#: What an entry of the cache takes besides its characters and ids.
ENTRY_BYTES = 190


#: Fixed values of the vocabulary's file: the suffix of a word's last token, and marks that are parted from letters.
WORD_END, MARKS = "</w>", ".,;:!?#$%&*|"


def _all_letters(word: str) -> bool:
    """Whether a string is letters only, also in the form in which the vocabulary's rules look at it.

    Lower case or composition can give a letter a mark of its own (a dotted capital I, some Indic letters); such
    a mark joins with the marks after the word, so the word can't be encoded apart from them.
    """
    return word.isascii() and word.isalpha() or word.isalpha() and unicodedata.normalize("NFC", unicodedata.normalize("NFC", word).lower()).isalpha()


class WordTokenizer:
    """A tokenizer file applied to whole texts; the ids of each string between spaces or newlines are kept for reuse.

    The vocabulary's pre-tokenizer never joins characters across white space, drops it, and parts letters from
    the marks after them, so a text's ids are those of these strings in order. Words of letters that are new
    are encoded together and cut after each token that ends a word. Longer strings than CACHE_CHARS aren't
    kept; a full cache starts anew.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.held = Tokenizer.from_file(path), {}, 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: set[str]) -> None:
        known = self.known
        other = [w for w in words if not _all_letters(w)]
        stems = [w.rstrip(MARKS) for w in other]
        whole = [_all_letters(x) for x in stems]
        new = list(words.difference(other).union(x for x, ok in zip(stems, whole, strict=True) if ok).difference(known))
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            ids = self._ids(" ".join(part))
            ends = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            else:
                known.update((x, self._ids(x).tobytes()) for x in part)
        for w, x, ok in zip(other, stems, whole, strict=True):
            if not ok:
                known[w] = self._ids(w).tobytes()
                continue
            marks = w[len(x) :]
            if marks not in known:
                known[marks] = self._ids(marks).tobytes()
            known[w] = known[x] + known[marks]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        known = self.known
        if self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        # lower case comes first here as it does in the vocabulary's rules, but for letters whose case has context
        split = [(t if "Σ" in t or "İ" in t else t.lower()).replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(known)
        if new:
            self._learn(new)
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint32) for words in split]
        for w in new:
            if len(w) > CACHE_CHARS:
                known.pop(w, None)
            else:
                self.held += ENTRY_BYTES + len(w) + len(known[w])
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer and cache for each file and Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


SUM = itemgetter(0)


def _merge(a: list, b: list, k: int) -> list:
    """Two partial partitions, each a list of (sum, items) from the fullest window down, without their empty windows."""
    both = max(0, len(a) + len(b) - k)  # so many windows of a meet a non-empty one of b, the fullest the emptiest
    joined = []
    if both:
        # a's windows in falling order meet b's in rising order; all but `both` of them meet empty ones
        low_a, low_b = a[k - len(b) :], b[k - len(a) :]
        joined = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(low_a, reversed(low_b), strict=True)]
        a, b = a[: k - len(b)], b[: len(b) - both]
    return sorted([*a, *b, *joined], key=SUM, reverse=True)


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp: the items in k windows of nearly equal sums, as (sum, item numbers)."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = _merge(a, b, k)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, count, merged))
        count += 1
    windows = []
    for total, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += [x[1], x[0]]
            else:
                items.append(x)
        windows.append((total, items))
    return windows


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items in the fewest near-equal windows that differencing finds under the capacity."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("an item is larger than a window")
    k, total = -(-sum(sizes) // capacity), sum(sizes)
    while True:
        windows = differencing(sizes, k)
        most = max(s for s, _ in windows)
        if most <= capacity:
            return [items for _, items in windows]
        # at the spread just seen, so many windows would do
        k = max(k + 1, min(-(-total // max(capacity - (most - total // k), 1)), k + max(1, k // 50)))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, grain: int = GRAIN, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: where it starts in its document and where it lies in its sequence.

    vocabulary: the path of a tokenizer file. with_ids: also the ids, as array<int>. Columns other than doc_id
    and text aren't read.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path)
        base = TaskContext.get().partitionId() << 36
        sequence = 0
        rows: list[tuple] = []
        rests: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal sequence, held
            for items in pack([r[2] for r in rests], capacity):
                at = 0
                for i in items:
                    doc, start, n, ids, total = rests[i]
                    rows.append((doc, start, n, zlib.crc32(ids), total, base + sequence, at, ids))
                    at += n
                sequence += 1
            rests.clear()
            held = 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, np.int32) for x in cols[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            doc_ids, texts = b.column("doc_id").to_pylist(), [x or "" for x in b.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and chars < 1 << 20:
                    chars += len(texts[end])
                    end += 1
                for doc, ids in zip(doc_ids[at:end], tokenizer.encode_batch(texts[at:end]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    full = len(ids) // capacity * capacity
                    for start in range(0, full, capacity):
                        part = ids[start : start + capacity].tobytes()
                        rows.append((doc, start, capacity, zlib.crc32(part), len(ids), base + sequence, 0, part))
                        sequence += 1
                    for start in range(full, len(ids), grain):
                        part = ids[start : start + grain]
                        rests.append((doc, start, len(part), part.tobytes(), len(ids)))
                        held += len(part)
                    if held >= block_tokens:
                        close()
                at = end
                if len(rows) > 5000:
                    yield out()
        close()
        if rows:
            yield out()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freeing(run), PIECES + ", ids array<int>" * with_ids)
