"""Benchmark decontamination by SimHash of item-sized windows.

Every document is read as 5-word shingles. For each distinct size of a benchmark
item (in shingles), the windows of that size that hold enough benchmark shingles
to reach the threshold at all are fingerprinted: a 128-bit SimHash, from running
sums so that a window costs one difference.

The fingerprints are compared by multi-index Hamming blocks: four blocks of 32 bits
with thresholds t whose t + 1 sum up to ``radius`` + 1, so by the pigeonhole principle
every pair within the radius agrees to the threshold in some block. Of unrelated
pairs about one in a hundred does. Those within the radius are then verified by
exact weighted Jaccard similarity, each shingle weighing as often as it occurs.

What is exact and what isn't: all pairs within the radius are found; a pair may be
similar enough and yet farther apart than the radius. At a similarity of just 0.75
fingerprints differ by 22 bits on average with a standard deviation of 4.3, so the
radius of 34 loses about one such pair in 500, and practically none above 0.8 (the
tests measure it).

The benchmark goes to the tasks in blocks of at most ``MAX_ITEMS`` items and
``MAX_ITEM_BYTES`` bytes, read one after another: a larger benchmark means more
passes over the documents, never a larger broadcast.

Defined cases: null and empty texts and items match nothing; a document with
fewer shingles than an item is one window; items and documents under five words
have their whole sequence as one shingle, so match only each other when equal;
a very long text is read whole, and running sums are kept only near benchmark
shingles, ``STARTS`` windows at a time; repeated rows each count; empty tables give
an empty result; extra columns are ignored (or pass through, in
``drop_contaminated``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, arrow_map, mix, pieces, text_bytes

MAX_ITEMS, MAX_ITEM_BYTES = 4096, 16 << 20
BITS, BLOCKS = 128, 4
RADIUS = 34
BITMAP_BITS = 20
STARTS = 4096  # starts of windows at a time


def signs(hashes: np.ndarray) -> np.ndarray:
    """(n, BITS) int8 of +1 and -1."""
    wide = np.empty((len(hashes), 2), U64)
    wide[:, 0] = mix(hashes ^ U64(0xA0761D6478BD642F))
    wide[:, 1] = mix(hashes ^ U64(0xE7037ED1A0B428DB))
    return np.unpackbits(wide.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """(n, BITS // 8) uint8 of sums of signs."""
    return np.packbits(sums > 0, axis=1)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def thresholds(radius: int) -> np.ndarray:
    """Each block's threshold: t + 1 sum up to radius + 1, so of two fingerprints within the radius some block is within its threshold."""
    base, more = divmod(radius + 1, BLOCKS)
    return np.array([base + (k < more) - 1 for k in range(BLOCKS)])


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (of a, of b) of fingerprints within the radius, and how many candidates the blocks gave."""
    x, y = a.view("<u4"), b.view("<u4")
    open_ = np.zeros((len(a), len(b)), bool)
    for k, t in enumerate(thresholds(radius)):
        open_ |= np.bitwise_count(x[:, None, k] ^ y[None, :, k]) <= t
    i, j = np.nonzero(open_)
    far = np.bitwise_count(a[i] ^ b[j]).sum(axis=1)
    ok = far <= radius
    return i[ok], j[ok], len(i)


class Index:
    """Items' shingles and multi-index Hamming blocks, by size."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float, radius: int):
        self.threshold, self.radius = threshold, radius
        w = Words(*text_bytes(pa.array(texts, pa.string())))
        s, d, _ = w.shingles()
        self.all = np.unique(s)
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[(self.all & U64((1 << BITMAP_BITS) - 1)).astype(np.int64)] = True
        by_size: dict[int, list] = {}
        first = np.searchsorted(d, np.arange(len(ids) + 1))
        for k, item in enumerate(ids):
            own = s[first[k] : first[k + 1]]
            if len(own):
                by_size.setdefault(len(own), []).append((item, own))
        self.sizes = {}
        for n, items in sorted(by_size.items()):
            prints = fingerprint(np.stack([signs(own).sum(axis=0, dtype=np.int32) for _, own in items]))
            self.sizes[n] = ([i for i, _ in items], [np.unique(own, return_counts=True) for _, own in items], prints)
        self.least = min((max(1, int(np.ceil(threshold * n))) for n in self.sizes), default=1)

    def hits(self, s: np.ndarray) -> np.ndarray:
        out = self.bitmap[(s & U64((1 << BITMAP_BITS) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.all, s[at]), len(self.all) - 1)
            out[at] = self.all[place] == s[at]
        return out

    def match(self, s: np.ndarray, hit: np.ndarray) -> dict:
        """item -> (similarity, first shingle, shingles, Hamming distance) of a document's best window for each matching item."""
        found: dict = {}
        where = np.flatnonzero(hit)
        if len(where) < self.least:
            return found
        most = min(max(self.sizes), len(s))
        # stretches of starts from which a window reaches a benchmark shingle
        lo = np.maximum(where - most + 1, 0)
        new = np.flatnonzero(np.append(True, lo[1:] > where[:-1] + 1))
        for a, b in zip(lo[new].tolist(), (where[np.append(new[1:], len(where)) - 1] + 1).tolist()):
            for x in range(a, b, STARTS):
                self._match(s, hit, x, min(b, x + STARTS), found)
        return found

    def _match(self, s: np.ndarray, hit: np.ndarray, lo: int, hi: int, found: dict) -> None:
        """Windows that start at lo up to hi."""
        end = min(len(s), hi + max(self.sizes))
        count = np.concatenate([[0], np.cumsum(hit[lo:end])])
        sums = None
        for n, (items, bags, prints) in self.sizes.items():
            m = min(n, len(s))
            need = int(np.ceil(self.threshold * n))
            if m < need:
                continue
            a = np.arange(0, min(hi, len(s) - m + 1) - lo)
            a = a[count[a + m] - count[a] >= need]
            if not len(a):
                continue
            if sums is None:
                sums = np.zeros((end - lo + 1, BITS), np.int32)
                np.cumsum(signs(s[lo:end]), axis=0, out=sums[1:])
            own = fingerprint(sums[a + m] - sums[a])
            wi, ki, _ = near_pairs(own, prints, self.radius)
            for w, k in zip(wi.tolist(), ki.tolist()):
                start = lo + int(a[w])
                sim = weighted_jaccard(np.unique(s[start : start + m], return_counts=True), bags[k])
                if sim >= self.threshold and sim > found.get(items[k], (0,))[0]:
                    found[items[k]] = (sim, start, m, int(np.bitwise_count(own[w] ^ prints[k]).sum()))

    def scan(self, column: pa.Array) -> Iterator[tuple[int, dict]]:
        """(row, matches) of the rows that match."""
        if not self.sizes:
            return
        s, d, _ = Words(*text_bytes(column)).shingles()
        hit = self.hits(s)
        n = np.bincount(d[hit], minlength=len(column))
        first = np.searchsorted(d, np.arange(len(column) + 1))
        for row in np.flatnonzero(n >= self.least):
            if got := self.match(s[first[row] : first[row + 1]], hit[first[row] : first[row + 1]]):
                yield int(row), got


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for r in items.select(F.col(item_id), F.col(text)).where(F.col(text).isNotNull()).orderBy(item_id, text).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1].encode())
        if len(ids) == MAX_ITEMS or size >= MAX_ITEM_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


LINKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("hamming", T.IntegerType())])


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.75, radius: int = RADIUS, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row for each document and item it holds: the most similar window (first word, shingles), its similarity and Hamming distance."""
    sc, out = docs.sparkSession.sparkContext, None
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    for ids, texts in item_blocks(items, item_id, text):
        index = sc.broadcast(Index(ids, texts, threshold, radius))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "_text"):
                doc = b.column(0)
                got = [(doc[row].as_py(), item, *best) for row, found in index.value.scan(b.column(1)) for item, best in sorted(found.items())]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*got), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()))], LINKS.fieldNames())

        part = arrow_map(rows, run, LINKS)
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75, radius: int = RADIUS, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; no shuffle."""
    sc = docs.sparkSession.sparkContext
    for ids, texts in item_blocks(items, item_id, text):
        index = sc.broadcast(Index(ids, texts, threshold, radius))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, text):
                keep = np.ones(b.num_rows, bool)
                keep[[row for row, _ in index.value.scan(b.column(b.schema.get_field_index(text)))]] = False
                yield b.filter(pa.array(keep))

        docs = arrow_map(docs, run, docs.schema)
    return docs
