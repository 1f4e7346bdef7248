"""N-gram language model in an Elias-Fano trie, and scores of whole texts.

Level 1 has every word (by 64-bit hash, sorted, its place is its id) with its exact
count. After that all texts are kept as word ids, so they are split into words and
looked up once more only; the levels above and the scores are made from the ids.
Level n has the n-grams seen at least ``least`` times (1: all of them), as children of
their first n-1 words. A level's file holds, for its shard of contexts: monotone
pointers from contexts to children (Elias-Fano), the children's word ids made monotone
as context * V + word, relative to the shard's first context (Elias-Fano), 8-bit
quantised log10 probabilities of the children and back-off weights of the contexts. A
lookup searches the successor of its word within the context's stretch of V values;
the pointers give each child's context back when a level is read to build the next. Tasks
map the files of the shared folder into memory; nothing of the model goes through the
driver but a row a shard (and its frequent nodes, see below).

Probabilities: unseen words have the mass (n1 + 1) / (N + 2) (n1: words seen once)
as one class; seen ones share the rest by count. Order n interpolates absolute
discounting with order n - 1 (discount n1 / (n1 + 2 n2) of the order's n-grams seen
once and twice where all are kept, else 0.75), with all mass that its kept n-grams
don't take as weight, so that each context's distribution sums to one before quantisation, which
rounds down. A text's first word has the end token as context.

Counts are made in each task and dealt by shard once. A frequent context (more tokens
than a shard should have) is split into shards of its own by ranges of the words that
follow; the children it has in all of them come back as a row a shard, for its weight.
So no shard grows with a word's share of the text. A task looks up the words of its
texts in all shards they lead to: the lookups grow with the texts, the files that a
task opens with the model.

Defined cases: a null or empty text is the end token alone; a very long text is read
whole, some numbers a word; without training documents every word is unseen (N = 0, the
base score is then that of V = 0); repeated rows each count; a null doc_id is no
training document and not held out; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, arrow_map, discard, fs_of, mix, n_parts, pieces, scratch_path, stage, text_bytes
from .eliasfano import Sequence, build, maybe, named, pair_filter, part, read_arrays, write_arrays

END = mix(np.array([0x5EED], U64))[0]
DISCOUNT = 0.75
LEAST = 2  # count from which n-grams of two words and more are kept, unless asked otherwise
SHARD_BYTES = 32 << 20  # of text a shard
SHARD_BYTES_ALL = 16 << 20  # where n-grams seen once are kept: a shard's n-grams are in memory when it is made
PIECE = 3 << 20  # of text at a time
HELD = 4_000_000  # n-grams that a task counts before it sends them on, however large its part of the input is
HOT_TOKENS = 100_000  # a context of fewer tokens is in one shard, whatever the shards' size

# ----------------------------------------------------------------- sequences


class Tokens:
    """Word hashes of a batch with the end token after each document."""

    def __init__(self, column: pa.Array):
        w = Words(*text_bytes(column))
        self.n = w.counts() + 1  # tokens of each document
        end = np.cumsum(self.n) - 1
        self.hashes = np.full(int(self.n.sum()), END, U64)
        inner = np.ones(len(self.hashes), bool)
        inner[end] = False
        self.hashes[inner] = w.hashes


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values and each value's place among them (by a hash table, which is faster than sorting all)."""
    code, u = pd.factorize(a)
    order = np.argsort(u)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return u[order], rank[code]


def training(doc_id: str):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(10)) != 0, F.lit(False))


def held_out(doc_id: str):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(10)) == 0, F.lit(False))


class Counter:
    """Sorted distinct rows of uint64 keys and their counts, merged as they come."""

    def __init__(self, width: int, limit: int = 3_000_000):
        self.width, self.limit, self.raw, self.held, self.size = width, limit, [], [], 0

    def add(self, keys: tuple[np.ndarray, ...], counts: np.ndarray | None = None) -> None:
        """Rows with counts, or (None) rows that each count once."""
        if counts is None:
            self.raw.append(keys)
        else:
            self.held.append((*keys, counts))
        self.size += len(keys[0])
        if self.size > self.limit:
            self.merge()
            self.limit = max(self.limit, 2 * self.size)

    def full(self, most: int) -> bool:
        """Whether there are so many distinct rows that they should be sent; asked after each add, it merges seldom."""
        if self.size <= most:
            return False
        self.merge()
        return self.size > most // 2

    def _one(self, cols: list[np.ndarray]) -> tuple[np.ndarray | None, int]:
        """Rows as one number each, if 64 bits are enough."""
        if self.width == 1:
            return cols[0], 0
        shift = int(cols[1].max(initial=0)).bit_length()
        return ((cols[0] << U64(shift)) | cols[1] if int(cols[0].max(initial=0)).bit_length() + shift <= 64 else None), shift

    def merge(self) -> tuple[np.ndarray, ...]:
        if self.raw:
            cols = [np.concatenate([r[k] for r in self.raw]) for k in range(self.width)]
            self.raw = []
            key, shift = self._one(cols)
            if key is None:
                self.held.append((*cols, np.ones(len(cols[0]), np.int64)))
            else:  # sorted by itself, without an order
                del cols
                key.sort()
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                u = key[at]
                self.held.append((*((u,) if self.width == 1 else (u >> U64(shift), u & U64((1 << shift) - 1))), np.diff(np.append(at, len(key)))))
        if not self.held:
            return (*[np.zeros(0, U64)] * self.width, np.zeros(0, np.int64))
        if len(self.held) > 1:
            cols = [np.concatenate([h[k] for h in self.held]) for k in range(self.width + 1)]
            key, _ = self._one(cols)
            order = np.lexsort(cols[: self.width][::-1]) if key is None else np.argsort(key, kind="stable")  # runs that are sorted
            cols = [c[order] for c in cols]
            new = np.ones(len(order), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[: self.width]], axis=0)
            at = np.flatnonzero(new)
            self.held = [(*[c[at] for c in cols[: self.width]], np.add.reduceat(cols[-1], at) if len(at) else np.zeros(0, np.int64))]
        elif self.size and self.width and len(self.held[0][0]) > 1:
            cols = self.held[0]
            rising = cols[0][1:] > cols[0][:-1] if self.width == 1 else (cols[0][1:] > cols[0][:-1]) | ((cols[0][1:] == cols[0][:-1]) & (cols[1][1:] > cols[1][:-1]))
            if not rising.all():
                self.held.append(tuple(c[:0] for c in cols))
                return self.merge()
        self.size = len(self.held[0][0])
        return self.held[0]


_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(a: np.ndarray, delta: bool = False) -> bytes:
    """An unsigned array as byte planes of its values (or of their differences), compressed."""
    a = a.astype("<u8")
    if delta:
        a = np.diff(a, prepend=U64(0))
    planes = a.view(np.uint8).reshape(-1, 8)
    used = max((k + 1 for k in range(8) if planes[:, k].any()), default=0)
    return bytes([used, delta]) + _zip.compress(np.ascontiguousarray(planes[:, :used].T).tobytes())


def unsqueeze(b: bytes) -> np.ndarray:
    used, delta = b[0], b[1]
    raw = np.frombuffer(_unzip.decompress(b[2:]), np.uint8)
    if used == 0:
        raise ValueError("an array of zeros has no length here")
    out = np.zeros((len(raw) // used, 8), np.uint8)
    out[:, :used] = raw.reshape(used, -1).T
    a = out.view("<u8").ravel()
    return np.cumsum(a, dtype=U64) if delta else a


PAYLOAD = "to bigint, a binary, b binary, n binary"
KEPT = PAYLOAD + ", once bigint, twice bigint, kinds bigint, tokens bigint"


def payload(to: int, cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    a, b, n = cols if len(cols) == 3 else (cols[0], None, cols[1])
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([squeeze(a + U64(1), True)], pa.binary()), pa.array([squeeze(b + U64(1)) if b is not None else None], pa.binary()), pa.array([squeeze(n.astype(U64))], pa.binary())], ["to", "a", "b", "n"])


def payload_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    for to, a, b, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
        yield to, ((unsqueeze(a) - U64(1)), *([] if b is None else [unsqueeze(b) - U64(1)]), unsqueeze(n).astype(np.int64))


def by_target(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Merged counts of each target of a partition sorted by it."""
    now, counter = None, None
    for b in batches:
        for to, cols in payload_rows(b):
            if to != now:
                if counter is not None:
                    yield now, counter.merge()
                now, counter = to, Counter(width)
            counter.add(cols[:width], cols[width])
    if counter is not None:
        yield now, counter.merge()


# --------------------------------------------------------------------- trie


def quantise(log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their values: each value is the least of its bin, so nothing is rounded up."""
    if not len(log_p):
        return np.zeros(0, np.uint8), np.zeros(1, "<f4")
    # half of the bins hold equally many values, half are equally wide
    bins = np.unique(np.concatenate([np.quantile(log_p, np.linspace(0, 1, 129)[:-1], method="lower"), np.linspace(log_p.min(), log_p.max(), 128)]))
    return (np.searchsorted(bins, log_p, side="right") - 1).clip(0).astype(np.uint8), bins.astype("<f8")


def open_arrays(path: str) -> dict[str, np.ndarray]:
    fs, local = fs_of(path)
    if fs.type_name == "local":
        return read_arrays(np.memmap(local, np.uint8, "r"))
    with fs.open_input_file(local) as f:
        return read_arrays(np.frombuffer(f.read(), np.uint8))


class Level:
    """A level's shard. first: the id of its first node; contexts: the ids of its contexts."""

    def __init__(self, path: str):
        a = open_arrays(path)
        self.first, self.n, self.context_first, self.n_contexts, self.types = (int(x) for x in a["meta"])
        self.values, self.counts = Sequence(part(a, "values")), a.get("counts")
        self.code, self.book = a["code"], a["book"]
        self.least = int(a["least"][0]) if "least" in a else 0
        if "pointers.meta" in a:
            self.pointers = Sequence(part(a, "pointers"))
            self.weight_code, self.weight_book = a["weight_code"], a["weight_book"]
            self.filter = a["filter"]

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Node ids of (context, word), or -1; contexts are ids of this shard."""
        out = np.full(len(word), -1, np.int64)
        own = np.flatnonzero(maybe(self.filter, context, word))
        if len(own):
            at = self.values.find((context[own] - self.context_first).astype(U64) * U64(self.types) + word[own].astype(U64))
            out[own] = np.where(at >= 0, at + self.first, -1)
        return out

    def words(self) -> np.ndarray:
        """The word ids of all nodes."""
        fan = np.diff(self.pointers.all().astype(np.int64))
        return (self.values.all() - np.repeat(np.arange(self.n_contexts).astype(U64) * U64(self.types), fan)).astype(np.int64)

    def log_p(self, node: np.ndarray) -> np.ndarray:
        return self.book[self.code[node - self.first]]

    def log_weight(self, context: np.ndarray) -> np.ndarray:
        return self.weight_book[self.weight_code[context - self.context_first]]


_open: dict[str, Level] = {}


def level_of(path: str, first: int) -> Level:
    """A shard's level; first: the id of its first node, which is known only when all shards are."""
    if path not in _open:
        if len(_open) > 20_000:
            _open.clear()
        _open[path] = Level(path)
    _open[path].first = int(first)
    return _open[path]


@dataclass
class Shards:
    """A level's files in the order of their nodes' ids. The first ``cold`` have contexts from ``context`` on; the others are parts, by ranges of words, of the contexts in ``hot``."""

    paths: list[str]
    first: np.ndarray
    context: np.ndarray
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    part_path: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # -1: no such words follow
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # nodes that are hot as contexts, and their counts
    frequent_count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def cold(self) -> int:
        return len(self.context)

    def open(self, k: int) -> Level:
        return level_of(self.paths[k], self.first[k])


def part_of(word: np.ndarray, parts: int, types: int) -> np.ndarray:
    """Which of a hot context's parts a word is in."""
    return word.astype(np.int64) * parts // max(types, 1)


@dataclass
class Trie:
    """Counts, and the levels' shards."""

    total: int
    types: int
    once: int
    levels: list[Shards]
    least: int = LEAST
    hot_count: int = 1 << 62

    @property
    def unseen(self) -> float:
        return (self.once + 1) / (self.total + 2)

    def each(self, n: int, keys: np.ndarray, of: str) -> Iterator[tuple[Level, slice]]:
        """(shard, slice) of sorted ids of nodes (of='node') or contexts (not the hot ones) at level n (1 is the first)."""
        s = self.levels[n - 1]
        edge = s.first if of == "node" else s.context
        cut = np.append(np.searchsorted(keys, edge), len(keys))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            level = s.open(k)
            a, b = int(cut[k]), int(cut[k + 1])
            b = a + int(np.searchsorted(keys[a:b], edge[k] + (level.n if of == "node" else level.n_contexts)))  # contexts of a shard without children lie between
            yield level, slice(a, b)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if self.levels:
            s = self.levels[0]
            cut = np.append(np.searchsorted(hashes, s.context), len(hashes))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                level, own = s.open(k), slice(cut[k], cut[k + 1])
                at = level.values.find(hashes[own] - U64(level.least))
                out[own] = np.where(at >= 0, at + level.first, -1)
        return out

    def value(self, n: int, ids: np.ndarray, what: str, out) -> np.ndarray:
        """Counts, log_p or log_weight of ascending ids (-1: out; it may stand anywhere)."""
        got = np.full(len(ids), out, np.int64 if what == "counts" else np.float64)
        if len(self.levels) < n:
            return got
        at = np.flatnonzero(ids >= 0)
        if what == "log_weight":
            s = self.levels[n - 1]
            where, is_hot = among(s.hot, ids[at])
            for h in np.unique(where[is_hot]).tolist():
                files = s.part_path[s.parts[:h].sum() :][: s.parts[h]]
                files = files[files >= 0]
                if len(files):
                    got[at[is_hot & (where == h)]] = s.open(int(files[0])).log_weight(s.hot[h : h + 1])[0]
            at = at[~is_hot]
        keys = ids[at]
        for level, own in self.each(n, keys, "context" if what == "log_weight" else "node"):
            k = keys[own]
            got[at[own]] = level.counts[k - level.first] if what == "counts" else level.log_p(k) if what == "log_p" else level.log_weight(k)
        return got

    def any_order(self, n: int, ids: np.ndarray, what: str, out) -> np.ndarray:
        u, inverse = np.unique(ids, return_inverse=True)
        return self.value(n, u, what, out)[inverse]

    def children(self, n: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Level-n nodes of (context, word) pairs in ascending order; -1 where there is none."""
        node = np.full(len(word), -1, np.int64)
        if len(self.levels) < n:
            return node
        s = self.levels[n - 1]
        where, is_hot = among(s.hot, context)
        for h in np.unique(where[is_hot]).tolist():
            own = np.flatnonzero(is_hot & (where == h))  # one context, its words ascending
            part = part_of(word[own], int(s.parts[h]), self.types)
            files = s.part_path[s.parts[:h].sum() :][: s.parts[h]]
            for p in np.unique(part).tolist():
                if files[p] >= 0:
                    at = own[part == p]
                    node[at] = s.open(int(files[p])).find(context[at], word[at])
        cold = np.flatnonzero(~is_hot)
        c, w = context[cold], word[cold]
        for level, own in self.each(n, c, "context"):
            node[cold[own]] = level.find(c[own], w[own])
        return node

    def children_any_order(self, n: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(word), -1, np.int64)
        ok = np.flatnonzero((context >= 0) & (word >= 0))
        p = Pairs(context[ok], word[ok])
        out[ok] = self.children(n, p.a, p.b)[p.inverse]
        return out


def among(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each x's place in an ascending array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


class Pairs:
    """Distinct pairs of numbers in ascending order, and each pair's place."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        shift = int(b.max(initial=0)).bit_length()
        if int(a.max(initial=0)).bit_length() + shift < 63:
            u, self.inverse = distinct((a << shift) | b)
            self.a, self.b = u >> shift, u & ((1 << shift) - 1)
        else:
            order = np.lexsort((b, a))
            x, y = a[order], b[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            at = np.flatnonzero(new)
            self.a, self.b = x[at], y[at]
            self.inverse = np.empty(len(x), np.int64)
            self.inverse[order] = np.cumsum(new) - 1


WORDS = "batch bigint, ids binary, nulls binary, held binary, train binary, n binary, base binary, known binary, words binary"


def word_table(rows: DataFrame, trie: Trie) -> DataFrame:
    """A row a batch of texts (_id, _held, _train, _text): numbers of tokens, base scores, numbers of known tokens, and the tokens' word ids plus one (0: unknown)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        for b in pieces(batches, "_text", PIECE):
            t = Tokens(b.column(3))
            u, at = distinct(t.hashes)
            ids = trie.words(u)
            count = trie.value(1, ids, "counts", 0)
            doc = np.repeat(np.arange(len(t.n)), t.n)
            score = np.bincount(doc, np.log10((count + 0.1) / (trie.total + 0.1 * (trie.types + 1)))[at], len(t.n))
            known = np.bincount(doc, (count > 0)[at], len(t.n)).astype("<i8")
            own = [np.asarray(b.column(0).fill_null(0)).astype("<i8"), np.asarray(b.column(0).is_null()).astype(np.uint8), *(np.asarray(b.column(k)).astype(np.uint8) for k in (1, 2)), t.n.astype("<i8"), score, known]
            words = (ids + 1)[at]
            cells = [*(x.tobytes() for x in own), squeeze(words) if words.any() else b""]
            yield pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), *[pa.array([x], pa.binary()) for x in cells]], [f.split()[0] for f in WORDS.split(", ")])
            seq += 1

    return stage(arrow_map(rows, run, WORDS), "lm-words")


class Read:
    """A batch's tokens as word ids (-1: unknown), with the end token before and after each document; train: of the training documents only."""

    def __init__(self, trie: Trie, row: dict, train: bool = False):
        self.trie = trie
        n = np.frombuffer(row["n"], "<i8")
        words = unsqueeze(row["words"]).astype(np.int64) - 1 if row["words"] else np.full(int(n.sum()), -1, np.int64)
        if train:
            use = np.frombuffer(row["train"], np.uint8) > 0
            words, n = words[np.repeat(use, n)], n[use]
        self.n = n
        start = np.cumsum(n + 1) - (n + 1)
        self.start = np.zeros(len(words) + len(n), bool)
        self.start[start] = True
        tokens = np.empty(len(self.start), np.int64)
        tokens[~self.start] = words
        tokens[self.start] = words[np.cumsum(n) - 1] if len(n) else -1  # each document's last token is the end
        self.ids, self.at = distinct(tokens)
        self.counts = trie.value(1, self.ids, "counts", 0)

    def before(self, node: np.ndarray) -> np.ndarray:
        """The value at the token before; -1 at a document's start."""
        out = np.concatenate([[-1], node[:-1]])
        out[self.start] = -1
        return out

    def word(self) -> np.ndarray:
        """The word of each token; -1 if n-grams with it aren't kept: an n-gram is seen so often only if its words are."""
        return np.where(self.counts >= self.trie.least, self.ids, -1)[self.at]

    def grams(self, context: np.ndarray) -> tuple[np.ndarray, Pairs]:
        """Tokens that have a context and a word that kept n-grams have, and their distinct (context, word) pairs."""
        word = self.word()
        ok = np.flatnonzero((context >= 0) & (word >= 0))
        return ok, Pairs(context[ok], word[ok])

    def nodes(self, n: int, context: np.ndarray) -> np.ndarray:
        """Level-n nodes of each token after its context."""
        out = np.full(len(self.at), -1, np.int64)
        ok, p = self.grams(context)
        out[ok] = self.trie.children(n, p.a, p.b)[p.inverse]
        return out


def write_shard(folder: str, level: int, shard: int, arrays: dict[str, np.ndarray]) -> str:
    fs, local = fs_of(folder)
    fs.create_dir(local, recursive=True)
    name = f"level-{level}-{shard:06d}-{TaskContext.get().taskAttemptId()}.trie"
    with fs.open_output_stream(f"{local}/{name}") as f:
        write_arrays(f, arrays)
    return f"{folder}/{name}"


LISTED = "shard bigint, path string, nodes bigint, total bigint, once bigint, frequent array<bigint>, frequent_count array<bigint>"


def listed_row(shard: int, path: str, counts: np.ndarray, hot_count: int) -> pa.RecordBatch:
    """A shard's row: its frequent nodes are at most as many as its tokens make of hot_count."""
    often = np.flatnonzero(counts > hot_count)
    row = _listed_row(shard, path, counts)
    return pa.RecordBatch.from_arrays([*row.columns, *(pa.array([x], pa.list_(pa.int64())) for x in (often, counts[often]))], [*row.schema.names, "frequent", "frequent_count"])


def shards_of(rows: list, context: np.ndarray, **hot) -> Shards:
    first = np.cumsum([0, *(r["nodes"] for r in rows)])[:-1]
    pairs = [(int(f) + x, n) for f, r in zip(first, rows) for x, n in zip(r["frequent"], r["frequent_count"])]
    often, count = np.array(pairs, np.int64).reshape(-1, 2).T
    return Shards([r["path"] for r in rows], first, context, frequent=often, frequent_count=count, **hot)


def _listed_row(shard: int, path: str, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((shard, pa.int64()), (path, pa.string()), (len(counts), pa.int64()), (int(counts.sum()), pa.int64()), (int((counts == 1).sum()), pa.int64()))], ["shard", "path", "nodes", "total", "once"])


def build_words(train: DataFrame, shards: int, folder: str, least: int, hot_count: int) -> Trie:
    """Level 1: words by range of hash, with exact counts; their probabilities follow from those and the totals."""
    bits = shards.bit_length() - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(1)
        for b in pieces(batches, "_text", PIECE):
            code, u = pd.factorize(Tokens(b.column(0)).hashes)
            counter.add((u,), np.bincount(code, minlength=len(u)))
            if counter.full(HELD):
                yield from send(counter)
                counter = Counter(1)
        yield from send(counter)

    def send(counter: Counter) -> Iterator[pa.RecordBatch]:
        u, n = counter.merge()
        cut = np.searchsorted(u >> U64(64 - bits) if bits else u * U64(0), np.arange(shards + 1).astype(U64))
        for k in np.flatnonzero(np.diff(cut)):
            yield payload(int(k), (u[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (u, n) in by_target(batches, 1):
            low = shard << (64 - bits) if bits else 0
            arrays = {"meta": np.array([0, len(u), 0, 0, 0], np.int64), "least": np.array([low], U64), "counts": n.astype("<u4" if n.max() < 1 << 32 else "<u8"), "code": np.zeros(0, np.uint8), "book": np.zeros(1)}
            path = write_shard(folder, 1, shard, arrays | named(build(u - U64(low), 1 << (64 - bits), get=False), "values"))
            yield listed_row(shard, path, n, hot_count)

    sent = arrow_map(train.select("_text"), emit, PAYLOAD)
    rows = stage(arrow_map(sent.repartition(min(n_parts(train.sparkSession), shards), "to").sortWithinPartitions("to"), make, LISTED), "lm1").orderBy("shard").collect()
    if not rows:
        return Trie(0, 0, 0, [], least)
    low = np.array([r["shard"] << (64 - bits) if bits else 0 for r in rows], U64)
    return Trie(sum(r["total"] for r in rows), int(sum(r["nodes"] for r in rows)), sum(r["once"] for r in rows), [shards_of(rows, low)], least, hot_count)


def build_level(words: DataFrame, trie: Trie, n: int, order: int, folder: str) -> Trie:
    """Level n of order of the trie: the kept n-grams as children of level n - 1."""
    above = trie.levels[n - 2]
    cold = len(above.paths)
    hot, parts = above.frequent, -(-above.frequent_count // trie.hot_count)
    begins = np.cumsum(parts) - parts  # places of the hot contexts' parts, after the other targets
    targets = cold + int(parts.sum())
    tasks = min(n_parts(words.sparkSession), targets)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(2)
        for b in batches:
            for row in b.to_pylist():
                r = Read(trie, row, train=True)
                word = r.word()
                context = r.before(word)
                for k in range(2, n):
                    context = r.before(r.nodes(k, context))
                ok = (context >= 0) & (word >= 0)
                counter.add((context[ok].astype(U64), word[ok].astype(U64)))
                if counter.full(HELD):
                    yield from send(counter)
                    counter = Counter(2)
        yield from send(counter)

    def send(counter: Counter) -> Iterator[pa.RecordBatch]:
        c, w, m = counter.merge()
        where, is_hot = among(hot, c.astype(np.int64))
        to = np.searchsorted(above.first, c.astype(np.int64), side="right") - 1
        to[is_hot] = cold + begins[where[is_hot]] + part_of(w[is_hot], parts[where[is_hot]], trie.types)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(targets + 1))
        for k in np.flatnonzero(np.diff(cut)):
            at = order[cut[k] : cut[k + 1]]
            yield payload(int(k), (c[at], w[at], m[at]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, (c, w, m) in by_target(batches, 2):
            ok = m >= trie.least
            c, w, m = c[ok], w[ok], m[ok]
            if len(m):
                row = payload(to, (c, w, m))
                more = [int((m == 1).sum()), int((m == 2).sum()), len(m), int(m.sum())]
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array([x], pa.int64()) for x in more)], [*row.schema.names, "once", "twice", "kinds", "tokens"])

    # one row a target from here on: it is read where it was written
    sent = arrow_map(words.select("n", "train", "words"), emit, PAYLOAD)
    kept = stage(arrow_map(sent.repartition(tasks, "to").sortWithinPartitions("to"), keep, KEPT), f"lm{n}-kept")
    once, twice = kept.agg(F.sum("once"), F.sum("twice")).first()
    discount = once / (once + 2 * twice) if trie.least == 1 and once and twice else DISCOUNT
    taken = np.zeros(len(hot))  # mass that a hot context's children have in all its parts
    for r in kept.where(F.col("to") >= cold).select("to", "kinds", "tokens").collect():
        taken[np.searchsorted(begins, r["to"] - cold, side="right") - 1] += r["tokens"] - discount * r["kinds"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, (c, w, m) in payload_rows(b):
                if shard < cold:
                    up = above.open(shard)
                    low, size, total = up.first, up.n, np.asarray(up.counts).astype(np.float64)
                else:
                    low, size = int(c[0]), 1
                    up = above.open(int(np.searchsorted(above.first, low, side="right")) - 1)
                    total = np.array([float(up.counts[low - up.first])])
                at = c.astype(np.int64) - low
                begin = np.searchsorted(at, np.arange(size + 1))
                values = at.astype(U64) * U64(trie.types) + w
                if shard < cold:
                    run = np.concatenate([[0.0], np.cumsum(m - discount)])
                    mass = run[begin[1:]] - run[begin[:-1]]
                else:
                    mass = taken[[np.searchsorted(begins, shard - cold, side="right") - 1]]
                weight = np.maximum(1 - mass / total, 1e-9)
                # order n - 1's probability: after the context's last word
                word = w.astype(np.int64)
                if n == 2:
                    lower = word_log_p(trie, word)
                else:
                    last = up.words()[at + (low - up.first)]
                    node = trie.children_any_order(2, last, word)
                    lower = trie.any_order(2, node, "log_p", 0.0)
                    none = np.flatnonzero(node < 0)
                    lower[none] = trie.any_order(2, last[none], "log_weight", 0.0) + word_log_p(trie, word[none])
                    del last, node, none
                # in place, as a shard's arrays are large
                p = np.power(10.0, lower, out=lower)
                p *= weight[at]
                p += (m - discount) / total[at]
                code, book = quantise(np.log10(p, out=p))
                del p, lower, word, at
                weight_code, weight_book = quantise(np.log10(weight))
                arrays = {"meta": np.array([0, len(w), low, size, trie.types], np.int64), "code": code, "book": book, "weight_code": weight_code, "weight_book": weight_book, "filter": pair_filter(c, w)}
                if n < order:  # what the next level's contexts are counted by
                    arrays["counts"] = m.astype(np.min_scalar_type(m.max()))
                arrays |= named(build(begin.astype(U64), len(w) + 1, get=False, find=False), "pointers") | named(build(values, size * trie.types, get=False), "values")
                yield listed_row(shard, write_shard(folder, n, shard, arrays), m, trie.hot_count)

    rows = stage(arrow_map(kept.select("to", "a", "b", "n"), make, LISTED), f"lm{n}").orderBy("shard").collect()
    discard(kept)
    if not rows:
        return trie
    place = {r["shard"]: i for i, r in enumerate(rows)}
    shards = shards_of(rows, above.first[[r["shard"] for r in rows if r["shard"] < cold]], hot=hot, parts=parts, part_path=np.array([place.get(k, -1) for k in range(cold, targets)], np.int64))
    return Trie(trie.total, trie.types, trie.once, [*trie.levels, shards], trie.least, trie.hot_count)


def word_log_p(trie: Trie, ids: np.ndarray) -> np.ndarray:
    """log10 p of words (ids in any order) by count; -1: unseen."""
    return count_log_p(trie, trie.any_order(1, ids, "counts", 0))


def count_log_p(trie: Trie, count: np.ndarray) -> np.ndarray:
    return np.log10(np.where(count > 0, (1 - trie.unseen) * count / max(trie.total, 1), trie.unseen))


def build_trie(rows: DataFrame, order: int = 3, shards: int | None = None, least: int = LEAST) -> tuple[Trie, DataFrame]:
    """The model of rows (_id, _held, _train, _text) with _train, and all rows' word table; least: the count from which n-grams are kept."""
    if not 1 <= order <= 3 or least < 1:
        raise ValueError("order is 1, 2 or 3, least is 1 or more")
    spark = rows.sparkSession
    train = rows.where("_train")
    total = train.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    if shards is None:
        shards = max(8, total // (SHARD_BYTES if least > 1 else SHARD_BYTES_ALL))
    shards = 1 << (int(shards) - 1).bit_length()
    folder = scratch_path(spark, "trie")
    trie = build_words(train, shards, folder, least, max(HOT_TOKENS, total // (6 * shards)))
    words = word_table(rows, trie)
    for n in range(2, order + 1):
        if len(trie.levels) == n - 1:
            trie = build_level(words, trie, n, order, folder)
    return trie, words


def score(trie: Trie, row: dict) -> np.ndarray:
    """The log10 probability of each text of a batch."""
    r = Read(trie, row)
    log_p = count_log_p(trie, r.counts)[r.at]
    context = r.before(r.ids[r.at])
    for n in range(2, len(trie.levels) + 1):
        # kept n-grams have their probability; else the context's weight, which also words without an id get
        u, inverse = distinct(context)
        log_p += trie.value(n, u, "log_weight", 0.0)[inverse]
        ok, p = r.grams(context)
        node_of = trie.children(n, p.a, p.b)
        node = np.full(len(r.at), -1, np.int64)
        node[ok] = node_of[p.inverse]
        kept = np.flatnonzero(node_of[p.inverse] >= 0)
        of = trie.any_order if len(trie.levels[n - 1].hot) else trie.value  # without hot contexts, nodes are in their order
        log_p[ok[kept]] = of(n, node_of, "log_p", 0.0)[p.inverse[kept]]
        context = r.before(node)
    log_p[r.start] = 0.0
    return np.bincount(np.repeat(np.arange(len(r.n)), r.n + 1), log_p, len(r.n))


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 3, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), held_out(doc_id).alias("_held"), training(doc_id).alias("_train"), F.col(text).alias("_text"))
    trie, words = build_trie(rows, order, least=least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, null, held, n, known, base = (np.frombuffer(row[c], t) for c, t in (("ids", "<i8"), ("nulls", np.uint8), ("held", np.uint8), ("n", "<i8"), ("known", "<i8"), ("base", "<f8")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=null > 0), pa.array(held > 0), pa.array(n), pa.array(known), pa.array(np.full(len(n), trie.total)), pa.array(base), pa.array(score(trie, row))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return arrow_map(words.drop("batch", "train"), run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
