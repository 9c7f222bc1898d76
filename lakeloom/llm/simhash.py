"""SimHash near-duplicates by anchor-point covering.

A fingerprint has one bit for each majority among the 64-bit hashes of a text's word shingles. Two
fingerprints that differ in at most t bits differ in at most t // m bits in one of m blocks. For each block a
covering code gives the anchors: the words of a Hamming code of length 2**r - 1 with the block's other bits
free, so that every block value lies within one bit of an anchor. A fingerprint is replicated to every anchor
within the covering radius plus t // m; of two linked fingerprints, each then lies at the other's nearest
anchor. Within an anchor, fingerprints at home there are compared with all others.

Only distinct fingerprints are replicated, so groups of copies cost one row. An anchor's rows are streamed in
sorted runs; of a long run only a spanning forest of its links leaves the task, never all pairs, and an anchor that a
large share of all rows goes to is split into pairs of blocks, each a group of its own.

For a given similarity, fingerprints only propose: their anchors are wider, so that texts that don't resemble one
another rarely meet, and what they bring together is grouped and compared by the exact sets of shingles. Texts of few
shingles are brought together by those sets instead, as majorities among few hashes say little.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeing, materialize, only_result, unused
from .graph import connected_components

SEED = 42
#: Runs longer than this leave a spanning forest.
LONG_RUN = 8
#: Up to so many distinct shingles a text is brought together with others by the set itself.
FEW = 64
#: Rows of an anchor in one group; of more, blocks of rows meet in pairs. Anchors are counted on one node in SAMPLE.
GROUP_ROWS, GROUP_SETS, SAMPLE = 500_000, 50_000, 100
#: Shingles compared in one group; larger groups are split likewise.
GROUP_SHINGLES = 1_000_000
#: Words of a set's fingerprint, bits of each anchor's block, blocks, and words that decide whether two meet.
SET_WORDS, SET_BITS, SET_BLOCKS, SEEN = 16, 22, 93, 2
BEYOND = 1 << 62


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text in lower case (A-Z only), words between ASCII white space, repeats counted."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - words + 1)
    shingles = [b" ".join(w)] if n == 1 else w if words == 1 else map(b" ".join, zip(*(w[i : i + n] for i in range(words)), strict=True))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)


def majorities(h: np.ndarray, count: int = 1) -> np.ndarray:
    """A fingerprint of `count` 64-bit words: the majorities among the hashes, then among the hashes mixed anew for each further word."""
    total = np.zeros((count, 64), np.int64)
    odd = np.array([0x9E3779B97F4A7C15 + 2 * k for k in range(count)], np.uint64)[:, None]
    step = max(64, 16384 // count)
    for at in range(0, len(h), step):
        part = h[at : at + step]
        x = part[None] * odd
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x[0] = part
        bits = np.unpackbits(x.view(np.uint8).reshape(count, len(part), 8), axis=2, bitorder="little")
        total += bits.sum(axis=1, dtype=np.int32)
    return np.packbits(total * 2 > len(h), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit fingerprint of a text; 0 without words."""
    return int(majorities(shingle_hashes(text, words))[0])


def fingerprints(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp0) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, words) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp0"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(freeing(run), "doc_id long, fp0 long")


def set_prints(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, k0, k1, size, wide, shingles) of rows (doc_id, text): of each text's set of shingles a 128-bit digest and its size.

    Sets of more than FEW have a fingerprint of SET_WORDS words in wide; those that can be as similar as asked to one of
    at most FEW carry their sorted hashes in shingles; what a row hasn't is null.
    """
    carried = math.floor(FEW / similarity + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(x, words))
                raw = h.tobytes()
                key = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64)
                out.append((int(key[0]), int(key[1]), len(h), majorities(h, SET_WORDS).tobytes() if len(h) > FEW else None, raw if len(h) <= carried else None))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True))], ["doc_id", "k0", "k1", "size", "wide", "shingles"])

    return rows.mapInArrow(freeing(run), "doc_id long, k0 long, k1 long, size long, wide binary, shingles binary")


class HammingCover:
    """The covering code of one block of `bits` bits: a Hamming code of length 2**r - 1, the other bits free."""

    def __init__(self, shift: int, bits: int):
        self.shift, self.bits = np.uint64(shift), bits
        self.r = (bits + 1).bit_length() - 1
        self.length = (1 << self.r) - 1

    def value(self, fp: np.ndarray) -> np.ndarray:
        return (fp >> self.shift) & np.uint64((1 << self.bits) - 1)

    def syndrome(self, value: np.ndarray) -> np.ndarray:
        s = np.zeros(value.shape, np.int64)
        for i in range(self.length):
            s ^= ((value >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * (i + 1)
        return s

    def _flip(self, position: np.ndarray) -> np.ndarray:
        """The mask of a position of the Hamming code from 1; of 0 no bit."""
        return np.where(position > 0, np.uint64(1) << np.maximum(position - 1, 0).astype(np.uint64), np.uint64(0))

    def nearest(self, fp: np.ndarray) -> np.ndarray:
        v = self.value(fp)
        return v ^ self._flip(self.syndrome(v))

    def within(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) of every anchor within the radius, one to three."""
        v = self.value(fp)
        s, rows = self.syndrome(v), np.arange(len(v))
        found_rows, found = [], []
        free = [np.uint64(0), *(np.uint64(1) << np.uint64(i) for i in range(self.length, self.bits))]
        pairs_free = [np.uint64(1) << np.uint64(i) | np.uint64(1) << np.uint64(j) for i in range(self.length, self.bits) for j in range(i)if j >= self.length]
        flips = [(f, 0 if f == 0 else 1) for f in free] + [(f, 2) for f in pairs_free]
        i = np.arange(1, self.length + 1)
        for f, used in flips:
            left = radius - used
            if left < 0:
                continue
            base = v ^ f
            # sets of at most `left` positions whose sum is the syndrome
            at = s == 0
            found_rows.append(rows[at]), found.append(base[at])
            if left >= 1:
                at = s > 0
                found_rows.append(rows[at]), found.append(base[at] ^ self._flip(s[at]))
            if left >= 2:
                a = np.broadcast_to(i, (len(v), self.length))
                b = a ^ s[:, None]
                at = a < b
                r, c = np.nonzero(at)
                found_rows.append(r), found.append(base[r] ^ self._flip(a[r, c]) ^ self._flip(b[r, c]))
            if left >= 3:
                p, q = np.triu_indices(self.length, 1)
                p, q = p + 1, q + 1
                c = p[None, :] ^ q[None, :] ^ s[:, None]
                r, k = np.nonzero(c > q[None, :])
                found_rows.append(r), found.append(base[r] ^ self._flip(p[k]) ^ self._flip(q[k]) ^ self._flip(c[r, k]))
            if left >= 4:
                raise ValueError("at most three bits around an anchor are supported")
        return np.concatenate(found_rows), np.concatenate(found)


def covers(blocks: int) -> list[HammingCover]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [HammingCover(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints; the last axis holds the words."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for k in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def _forest(n: int, near: Callable[[np.ndarray], np.ndarray], step: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among n rows; near(rows): a matrix of which rows link to which of all.

    Rows start one after another, and see all others. Two rows of the largest group so far are joined already, so of
    it no more rows start: among near copies few do.
    """
    parent, label, done, from_, to = np.arange(n), np.arange(n), np.zeros(n, bool), [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    size = 1
    while True:
        main = np.bincount(label, minlength=n).argmax() if done.any() else -1
        part = np.flatnonzero(~done & (label != main))[:size]
        if not len(part):
            return from_, to
        for x, row in zip(part.tolist(), near(part), strict=True):
            ys = np.flatnonzero(row)
            groups, at = np.unique(label[ys], return_index=True)
            for g, y in zip(groups.tolist(), ys[at].tolist(), strict=True):
                a, b = root(g), root(int(label[x]))
                if a != b:
                    parent[a] = b
                    from_.append(x), to.append(y)
        done[part] = True
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
        size = min(step, size * 4)


def _links(fp: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one anchor's rows as row pairs, fp: (rows, words); of a long run only a spanning forest."""
    n = len(fp)
    if n <= LONG_RUN:
        homes = np.flatnonzero(home)
        a, b = np.nonzero(_distance(fp[homes, None], fp[None, :]) <= most)
        a = homes[a]
        keep = a != b
        return a[keep], b[keep]
    near = lambda part: (_distance(fp[part, None], fp[None, :]) <= most) & (home[part, None] | home[None, :])
    from_, to = _forest(n, near, max(1, (1 << 20) // n))
    return np.array(from_, np.int64), np.array(to, np.int64)


def split_hot(replicate: Callable[[DataFrame], DataFrame], nodes: DataFrame, limit: int) -> DataFrame:
    """replicate(nodes), whose rows (anchor, node, home, ...) come together by group and in order; the anchor is the group.

    An anchor of more than about `limit` rows, as counted on one node in SAMPLE, is a group for each pair of its blocks
    of rows. Any two rows of an anchor still meet, and no group grows with the data.
    """
    out = replicate(nodes)
    few = replicate(nodes.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SAMPLE)) == 0))
    hot = materialize(few.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") * SAMPLE * 2 > limit).select("anchor", F.ceil(F.col("n") * SAMPLE * 2 / limit).cast("int").alias("_blocks")), "hot")
    if not hot.isEmpty():
        more = [c for c in out.columns if c != "anchor"]
        block, other = F.pmod(F.xxhash64("node", F.lit(2)), F.col("_blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_blocks") - 1, F.lit(0)))).alias("_other")
        met = out.join(hot, "anchor", "left").select("anchor", *more, "_blocks", block.alias("_block"), other)
        group = F.when(F.col("_blocks").isNull(), F.col("anchor")).otherwise(F.xxhash64("anchor", F.least("_block", "_other"), F.greatest("_block", "_other")))
        out = met.select(group.alias("anchor"), *more)
    # the smallest node of a run starts first, so forests of different anchors have links in common
    return out.repartition("anchor").sortWithinPartitions("anchor", "node")


def spread(prints: DataFrame, count: int, blocks: int, near: int) -> DataFrame:
    """(anchor, node, home, fp0, ...): each row of prints (node, fp0, ... of `count` words) at every anchor of each word's blocks.

    A fingerprint goes to all anchors within the covering radius plus `near` bits; home marks its nearest one.
    """
    words = [f"fp{k}" for k in range(count)]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = covers(blocks)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                node = part.column(0).to_numpy()
                fps = [part.column(1 + k).to_numpy().view(np.uint64) for k in range(count)]
                for k, (fp, code) in enumerate((fp, code) for fp in fps for code in codes):
                    rows, anchor = code.within(fp, 1 + near)
                    home = code.nearest(fp)[rows] == anchor
                    key = (anchor << np.uint64(8) | np.uint64(k)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[rows]), pa.array(home), *(pa.array(x[rows].view(np.int64)) for x in fps)], ["anchor", "node", "home", *words])

    return prints.select("node", *words).mapInArrow(freeing(replicate), ", ".join(["anchor long", "node long", "home boolean", *(f"{w} long" for w in words)]))


def spread_wide(prints: DataFrame) -> DataFrame:
    """(anchor, node, home, fp0, fp1): each row of prints (node, wide) at the anchor within the covering radius of each of its blocks.

    The blocks' bits are those of the fingerprint, twice in different orders, and the code is perfect but for the
    block's free bits: so there is one anchor for each block, and no bit more than the radius is allowed for.
    """
    order = np.concatenate([np.random.default_rng(k).permutation(64 * SET_WORDS) for k in range(-(-SET_BITS * SET_BLOCKS // (64 * SET_WORDS)))])[: SET_BITS * SET_BLOCKS]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, weight = HammingCover(0, SET_BITS), 1 << np.arange(SET_BITS, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                node = part.column(0).to_numpy()
                wide = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(node), -1)
                bits = np.unpackbits(wide, axis=1, bitorder="little")[:, order].reshape(len(node), SET_BLOCKS, SET_BITS)
                anchor = code.nearest((bits @ weight).astype(np.uint64)) << np.uint64(8) | np.arange(SET_BLOCKS, dtype=np.uint64)
                words = [np.repeat(x, SET_BLOCKS) for x in wide.view(np.int64)[:, :SEEN].T]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.ravel().view(np.int64)), pa.array(np.repeat(node, SET_BLOCKS)), pa.array(np.ones(anchor.size, bool)), *map(pa.array, words)], ["anchor", "node", "home", *(f"fp{k}" for k in range(SEEN))])

    return prints.select("node", "wide").mapInArrow(freeing(replicate), "anchor long, node long, home boolean" + "".join(f", fp{k} long" for k in range(SEEN)))


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, node, home, fingerprints) of sorted rows, never a part of an anchor's rows only. With a column named shingles the last is an array of sets."""

    def arrays(batch: pa.RecordBatch) -> tuple:
        anchor, node, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if batch.schema.field(3).name == "shingles":
            fp = np.empty(len(anchor), object)
            fp[:] = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
        else:
            fp = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(3, batch.num_columns)], axis=1)
        return anchor, node, home, fp

    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = arrays(batch)
        if held and held[0][0][0] != new[0][-1]:
            last = np.searchsorted(new[0], new[0][-1])  # the last run may go on in the next batch
            held.append(tuple(x[:last] for x in new))
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = [tuple(x[last:] for x in new)]
        else:
            held.append(new)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
    return starts, ends, ends - starts


def _short_pairs(key: np.ndarray, home: np.ndarray, fp: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in runs of up to LONG_RUN rows, all runs together: row against the rows 1, 2, ... further."""
    short = np.repeat(size <= LONG_RUN, size)
    for step in range(1, int(size[size <= LONG_RUN].max(initial=1))):
        i = np.flatnonzero((key[:-step] == key[step:]) & short[:-step] & (home[:-step] | home[step:]))
        i = i[_distance(fp[i], fp[i + step]) <= most]
        yield i, i + step


def anchor_links(rows: DataFrame, most: int) -> DataFrame:
    """(a, b): nodes that differ in at most `most` bits and share an anchor, one of them at home there."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, home, fp in _whole_runs(batches):
            starts, ends, size = _runs(key)
            pairs = [*_short_pairs(key, home, fp, size, most)]
            for s, e in zip(starts[size > LONG_RUN], ends[size > LONG_RUN], strict=True):
                a, b = _links(fp[s:e], home[s:e], most)
                pairs.append((a + s, b + s))
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return rows.mapInArrow(freeing(compare), "a long, b long")


def prefix(size: int, similarity: float) -> int:
    """Of two sets as similar as asked, the smallest so many members of each (in one order for all) have one in common."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def spread_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """(anchor, node, home, shingles): each set of (node, shingles) at an anchor for each hash of its prefix and its class of size.

    Two sets as similar as asked are of one class or of neighbouring ones; so each also visits the class above, where it isn't at home.
    """

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                held = [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
                n = np.array([prefix(len(h), similarity) if len(h) else 0 for h in held], np.int64)
                rows = np.repeat(np.arange(len(held)), n)
                if not len(rows):
                    continue
                heads = np.concatenate([h[:k] for h, k in zip(held, n, strict=True)])
                level = np.array([math.floor(math.log(max(len(h), 1)) / -math.log(similarity) + 1e-9) for h in held], np.uint64)[rows]
                for up in (0, 1):
                    key = (heads ^ (level + np.uint64(up)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(key), taken.column(0), pa.array(np.full(len(rows), up == 0)), taken.column(1)], ["anchor", "node", "home", "shingles"])

    return sets.select("node", "shingles").mapInArrow(freeing(replicate), "anchor long, node long, home boolean, shingles binary")


def _set_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the sets that have at least that Jaccard similarity, by exact counts."""
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    stock, flat = np.unique(np.concatenate(sets), return_inverse=True) if ends[-1] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def near(part: np.ndarray) -> np.ndarray:
        out = np.empty((len(part), len(sets)), bool)
        for k, x in enumerate(part):
            mark = np.zeros(len(stock), bool)
            mark[flat[ends[x] - size[x] : ends[x]]] = True
            shared = np.diff(np.r_[0, np.r_[0, np.cumsum(mark[flat])][ends]])
            out[k] = shared >= similarity * (size[x] + size - shared) - 1e-9
        return out

    return _forest(len(sets), near, 64)


def set_links(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a spanning forest of each anchor's nodes whose sets are as similar as asked."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, home, sets in _whole_runs(batches):
            a, b = [], []
            for s, e, size in zip(*_runs(key), strict=True):
                if size > 1 and home[s:e].any():
                    from_, to = _set_forest(list(sets[s:e]), similarity)
                    a += [s + x for x in from_]
                    b += [s + y for y in to]
            yield pa.RecordBatch.from_arrays([pa.array(node[np.array(x, np.int64)]) for x in (a, b)], ["a", "b"])

    return rows.mapInArrow(freeing(compare), "a long, b long")


def verified_links(rows: DataFrame, first: DataFrame, proposed: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): of the groups that proposed links make, the exact links, as spanning forests.

    rows: (doc_id, text); first: (node, size). Each text goes once to its group, so nothing is sent for each pair. A group
    of more than GROUP_SHINGLES is compared by pairs of its blocks.
    """
    members = materialize(connected_components(proposed), "members", first.count())
    weight = members.join(first.groupBy("node").agg(F.sum("size").alias("size")), "node").groupBy("component").agg(F.sum("size").alias("size"))
    large = weight.filter(F.col("size") > GROUP_SHINGLES).select("component", F.ceil(F.col("size") * 2 / GROUP_SHINGLES).cast("int").alias("blocks"))
    texts = rows.join(members.join(large, "component", "left").withColumnRenamed("node", "doc_id"), "doc_id")
    block = F.pmod(F.xxhash64("doc_id", "text"), F.coalesce("blocks", F.lit(1))).cast("int")
    met = texts.select("doc_id", "text", "component", block.alias("block"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))).alias("other"))
    groups = met.select(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("anchor"), "doc_id", "text").repartition("anchor").sortWithinPartitions("anchor", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, [], {})
        out: list[tuple[int, int]] = []

        def close() -> None:
            _, ids, sets = held
            if len(ids) > 1:
                a, b = _set_forest(list(sets), similarity)
                out.extend((ids[x], ids[y]) for x, y in zip(a, b, strict=True))

        def taken() -> pa.RecordBatch:
            record = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
            out.clear()
            return record

        for batch in batches:
            for anchor, i, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if anchor != held[0]:
                    close()
                    held = (anchor, [], [])
                held[1].append(i)
                held[2].append(np.unique(shingle_hashes(t, words)))
            yield taken()
        close()
        yield taken()

    return groups.mapInArrow(freeing(compare), "a long, b long").filter("a != b")


def row_id(doc_id: str, text: str) -> Column:
    """A row's id; a row of null id has one beyond all ids, from its text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(BEYOND) + F.pmod(F.xxhash64(F.lit(0), F.col(text)), F.lit(BEYOND)))


def _with_components(prints: DataFrame, first: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """(doc_id, by, component_id) of every row of prints, itself materialized; component_id is its component's smallest id."""
    with only_result(prints.sparkSession) as keep:
        known = materialize(first.join(connected_components(links), "node", "left").select(*by, F.coalesce("component", "node").alias("component_id")), "known", first.count())
        keep.append(known)
    return prints.select("doc_id", *by).join(known, by)


def near_duplicates(docs: DataFrame, words: int = 5, most: int = 3, blocks: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id reachable over links of 64-bit fingerprints.

    Null text counts as empty; texts without words share the fingerprint zero and link like any others. Rows
    of one id are rows of their own with that id. A null id is kept and never becomes a component's id unless
    all of the component's are null. No rows give no rows.
    """
    rows = docs.select(row_id(doc_id, text).alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(fingerprints(rows, words), "prints")
    first = materialize(prints.groupBy("fp0").agg(F.min("doc_id").alias("node")), "first", prints.count())
    links = anchor_links(split_hot(lambda d: spread(d, 1, blocks, most // blocks), first, GROUP_ROWS), most)
    null = lambda c: F.when(F.col(c) < BEYOND, F.col(c))
    return _with_components(prints, first, links, ["fp0"]).select(null("doc_id").alias("doc_id"), F.col("fp0").alias("fp"), null("component_id").alias("component_id"))


def bits_at(similarity: float, width: int) -> tuple[float, float]:
    """Mean and deviation of the distance of two `width`-bit fingerprints whose equally large shingle sets have that Jaccard similarity."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return width * share, math.sqrt(width * share * (1 - share))


def similar_rows(rows: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row of rows (doc_id, text), whose ids row_id() gives: the smallest id reachable over links of texts as similar as asked.

    Every link is exact: the sets of 64-bit shingle hashes have that Jaccard similarity. Links of texts of at most FEW
    distinct shingles are all found: sets that share a hash among the smallest ones of each, as similar ones must, are
    compared. Others are found if their fingerprints share an anchor: each of SET_BLOCKS blocks of SET_BITS bits has a chance of
    0.047 at a similarity of 0.8 and 0.08 at 0.85, so 99 % and nearly all of them meet; they are compared if the
    first SEEN words differ by at most the mean at that similarity and four deviations.
    """
    by = ["k0", "k1"]
    mean, deviation = bits_at(similarity, 64 * SEEN)
    prints = materialize(set_prints(rows, words, similarity), "prints")
    first = materialize(prints.groupBy(*by).agg(F.min("doc_id").alias("node"), F.min("size").alias("size"), F.first("wide").alias("wide"), F.first("shingles").alias("shingles")), "first", prints.count())
    short = set_links(split_hot(lambda d: spread_sets(d, similarity), first.filter("shingles is not null").select("node", "shingles"), GROUP_SETS), similarity)
    proposed = anchor_links(split_hot(spread_wide, first.filter("wide is not null").select("node", "wide"), GROUP_ROWS), math.floor(mean + 4 * deviation))
    links = short.union(verified_links(rows, first, proposed, words, similarity))
    return _with_components(prints, first, links, by).select("doc_id", "component_id")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row, as similar_rows(); rows with nulls count as in near_duplicates()."""
    found = similar_rows(docs.select(row_id(doc_id, text).alias("doc_id"), F.col(text).alias("text")), words, similarity)
    return found.select(*(F.when(F.col(c) < BEYOND, F.col(c)).alias(c) for c in ("doc_id", "component_id")))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with one of each group of similar texts: the one of the smallest id; null ids come last.

    Of rows of equal id and text one stays. Rows of one id with texts that differ are of one group, and stay or go
    together. All columns stay as they are.
    """
    (key,) = unused(docs.columns, "_id")
    spark, rows = docs.sparkSession, docs.select(row_id(doc_id, text).alias("doc_id"), F.col(text).alias("text"))
    found = similar_rows(rows, words, similarity)
    with only_result(spark) as keep:
        seen = materialize(found.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.count("*").alias("n")).filter("low != doc_id or n > 1"), "seen")
        keep.append(seen)
    marked = docs.withColumn(key, row_id(doc_id, text))
    gone = seen.filter("low != doc_id").select(F.col("doc_id").alias(key))
    twice = seen.filter("low = doc_id").select(F.col("doc_id").alias(key))
    left = marked.join(gone, key, "left_anti")
    if twice.isEmpty():
        return left.select(*docs.columns)
    again = left.join(twice, key, "left_semi").dropDuplicates([key, text])
    return left.join(twice, key, "left_anti").unionByName(again).select(*docs.columns)
