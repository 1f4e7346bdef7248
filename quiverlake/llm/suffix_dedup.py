"""Repeated 200-byte strings, by a column-wise collection Burrows-Wheeler transform.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
anywhere else. Building the transform over whole texts would take as many rounds
as the longest text has bytes, so the collection is made of short windows that are
certain to hold every repeated string side by side:

1. *Anchors.* A string's anchor is the 48-byte gram in it with the smallest hash
   (the last of equals), so equal strings have equal anchors at equal offsets.
   Strings that follow each other and have the same anchor form a window of at
   most 352 bytes. Windows are counted by anchor through a packed exchange, equal
   ones of a batch of documents as one entry with a count, into as many buckets as
   the windows' bytes ask for: alone with its anchor, nothing in a window repeats;
   equal windows (told by 128 bits of hash) are one document of the collection with a
   multiplicity, so that strings in them repeat follows from the count.
2. *Transform.* Windows that differ but have an anchor in common go, by anchor,
   into collections, aligned at the anchor. Round by round, from the last column to
   the first, one symbol of each document is inserted: the documents, held in the
   order of what follows, are dealt by their symbol, and common prefixes grow by one or
   fall to the minimum between neighbours. Because documents are aligned, equal
   strings lie in equal columns, so the transform is positional: a round's symbols in
   the order of the documents are its column. The round that makes a column uses it,
   to deal the documents; it isn't read again and not kept. Symbols and prefixes are
   read and written in sequence, a column a round. A collection has at most
   ``MAX_WINDOWS`` documents of 352 bytes (more only if its last anchor has), so its
   files are buffers in memory: nothing is written to a machine's own folders. Two
   neighbours with 200 bytes in common share the string that starts there.
3. *Removal.* What the windows found goes back to their batches of documents, whose
   texts are cut.

An anchor with more than ``MAX_WINDOWS`` different windows (a passage's edge in very
many documents) doesn't go into one collection: its strings are counted by
128-bit hash instead, which splits over all tasks. Equality of windows and of these
strings is that of their hashes, never cut short.

Defined cases: a null or empty text has no bytes; a text under 200 bytes keeps all;
a very long text is a batch of its own, whose anchors are found in slices; repeated
rows repeat each other's strings, so go whole (of 200 bytes or more); strings
repeated within a text count; an empty table gives an empty result; a null doc_id
passes through; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, U64, arrow_map, mix, n_parts, pieces, prefix_hash, slice_hash, stage, text_bytes

LENGTH = 200
GRAM = 48
SPAN = LENGTH - GRAM + 1  # grams in a string
MAX_WINDOWS = 20_000
POSITION_BITS = 24
PIECE = 2 << 20
SLICE = 1 << 23

# -------------------------------------------------------------------- anchors


def sliding_min(k: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values that follow each other, by prefix and suffix minima of blocks of w."""
    n = len(k)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(np.uint64).max, U64)
    padded[:n] = k
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(U64), none.astype(U64), none, none, none
    p = prefix_hash(buf)
    i = np.arange(n - GRAM + 1)
    h = slice_hash(p, i, i + GRAM)
    low = U64((1 << POSITION_BITS) - 1)
    least = sliding_min((h & ~low) | (low - i.astype(U64)), SPAN)
    at = (low - (least & low)).astype(np.int64)
    blocked = np.zeros(n + 1, np.int32)  # starts too near a document's end
    ends = offsets[1:]
    np.add.at(blocked, np.maximum(ends - LENGTH + 1, offsets[:-1]), 1)
    np.add.at(blocked, ends, -1)
    start = np.flatnonzero(np.cumsum(blocked[:-1])[: n - LENGTH + 1] == 0)
    if not len(start):
        return none.astype(U64), none.astype(U64), none, none, none
    a = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 1) | (np.diff(a) != 0)
    first = np.flatnonzero(new)
    s, a = start[first], a[first]
    count = np.diff(np.append(first, len(start)))
    window = slice_hash(p, s, s + count + LENGTH - 1) ^ mix((a - s).astype(U64))
    return h[a], window, s, count, a - s


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each window: the anchor's hash, the window's hash, first start, number of starts, and the anchor's offset from the first start."""
    if len(buf) <= SLICE:
        return _anchors(buf, offsets)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):  # a very long text, by slices of starts
        for x in range(a, b, SLICE):
            y = min(b, x + SLICE + LENGTH - 1)
            got = _anchors(buf[x:y], np.array([0, y - x]))
            out.append((got[0], got[1], got[2] + x, got[3], got[4]))
    return tuple(np.concatenate(c) for c in zip(*out))


# ---------------------------------------------------- column-wise construction


class Collection:
    """Aligned documents, their symbols and common prefixes in sequential files.

    windows: byte strings; offsets: where each has the anchor. Columns run from
    -max(offset) to the last byte after the anchor. files makes an empty file.
    """

    def __init__(self, windows: list[bytes], offsets: np.ndarray, files: Callable = io.BytesIO):
        self.m = len(windows)
        size = np.fromiter(map(len, windows), np.int64, self.m)
        self.left = int(offsets.max())
        self.columns = self.left + int((size - offsets).max())
        self.first = self.left - offsets  # column of the first byte
        self.last = self.first + size  # past the last
        self.symbols, self.lcp = files(), files()
        block = np.zeros((self.columns, self.m), np.uint8)
        for k, w in enumerate(windows):
            block[self.first[k] : self.last[k], k] = np.frombuffer(w, np.uint8)
        for c in range(self.columns - 1, -1, -1):  # in the order of the rounds
            self.symbols.write(block[c].tobytes())
        self.symbols.seek(0)

    def close(self) -> None:
        for f in (self.symbols, self.lcp):
            f.close()

    def rounds(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(column, documents in the order of their suffixes from it, common prefixes with the one before)."""
        order = np.zeros(0, np.int64)
        entering = np.argsort(-self.last, kind="stable")
        come = 0
        for c in range(self.columns - 1, -1, -1):
            symbol = np.frombuffer(self.symbols.read(self.m), np.uint8)
            self.lcp.seek(0)
            lcp = np.frombuffer(self.lcp.read(2 * len(order)), np.uint16)
            now = come
            while now < self.m and self.last[entering[now]] == c + 1:
                now += 1
            if now > come:  # documents that end here come first: nothing follows
                order = np.concatenate([entering[come:now], order])
                lcp = np.concatenate([np.zeros(now - come, np.uint16), lcp])
                come = now
            alive = self.first[order] <= c
            if not alive.all():
                order, lcp = self.without(order, lcp, alive)
            s = symbol[order]  # the transform's column
            deal = np.argsort(s, kind="stable")
            new = np.zeros(len(order), np.uint16)
            if len(order) > 1:
                same = s[deal[1:]] == s[deal[:-1]]
                i, j = deal[:-1][same], deal[1:][same]
                new[1:][same] = np.minimum(range_min(lcp, i + 1, j + 1) + 1, 60_000)
            order = order[deal]
            self.lcp.seek(0)
            self.lcp.write(new.tobytes())
            yield c, order, new

    @staticmethod
    def without(order: np.ndarray, lcp: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """order and lcp without the documents that have no symbol left."""
        at = np.flatnonzero(keep)
        if len(at) == 0:
            return order[:0], lcp[:0]
        low = np.append(0, at[:-1] + 1)
        return order[at], np.minimum.reduceat(np.append(lcp, np.uint16(0)), np.stack([low, at + 1], 1).ravel())[::2] if len(at) else lcp[:0]


def range_min(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(d[a:b]) of each (a, b), a < b, by a sparse table as deep as the widest."""
    if not len(a):
        return np.zeros(0, d.dtype)
    width = b - a
    level = np.frexp(width)[1] - 1
    out = np.empty(len(a), d.dtype)
    table, k = d, 0
    while True:
        on = level == k
        out[on] = np.minimum(table[a[on]], table[b[on] - (1 << k)])
        if k == level.max():
            return out
        step = 1 << k
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
        k += 1


def repeated_starts(windows: list[bytes], offsets: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """(windows, columns) bool: the string of ``length`` bytes that starts there is also in another window; columns as the windows' own bytes from their first."""
    col = Collection(windows, offsets)
    hit = np.zeros((col.m, max(map(len, windows))), bool)
    try:
        for c, order, lcp in col.rounds():
            long = lcp >= length
            if long.any():
                both = long.copy()
                both[:-1] |= long[1:]
                docs = order[both]
                hit[docs, c - col.first[docs]] = True
    finally:
        col.close()
    return hit


# ------------------------------------------------------------------ the batches


def compress(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def decompress(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


TABLE = "batch bigint, ids binary, nulls binary, sizes binary, texts binary, h binary, w binary, places binary"


def batch_table(docs: DataFrame) -> DataFrame:
    """A row a batch of documents: ids, nulls, sizes, the compressed texts, and the windows' hashes (h: anchors', w: their own) and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        for b in pieces(batches, "_text", PIECE):
            buf, offsets = text_bytes(b.column(1))
            ids = b.column(0)
            h, w, s, n, at = anchors(buf, offsets)
            places = np.diff(s, prepend=0).astype("<u4").tobytes() + n.astype(np.uint8).tobytes() + at.astype(np.uint8).tobytes()
            cells = [np.asarray(ids.fill_null(0)).astype("<i8").tobytes(), np.asarray(ids.is_null()).astype(np.uint8).tobytes(), np.diff(offsets).astype("<i8").tobytes(), compress(buf.tobytes()), h.tobytes(), w.tobytes(), compress(places)]
            yield pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), *[pa.array([x], pa.binary()) for x in cells]], [f.split()[0] for f in TABLE.split(", ")])
            seq += 1

    return stage(arrow_map(docs, run, TABLE), "texts")


def places_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts, and the anchor's offset of each window of a batch."""
    raw = decompress(row["places"])
    k = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, "<u4", k).astype(np.int64)), np.frombuffer(raw, np.uint8, k, 4 * k).astype(np.int64), np.frombuffer(raw, np.uint8, k, 5 * k).astype(np.int64)


def texts_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.frombuffer(row["sizes"], "<i8")
    buf = np.frombuffer(decompress(row["texts"]), np.uint8) if sizes.sum() else np.zeros(0, np.uint8)
    return buf, np.concatenate([[0], np.cumsum(sizes)])


ALONE, WHOLE, OPEN, WITNESS, HOT, HOT_WITNESS = range(6)


BUCKET_BYTES = 24 << 20  # of hashes in a bucket


def combined(h: np.ndarray, w: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Different windows of a batch in the order of their buckets: anchors, hashes, counts; each window's place among them; the buckets' ranges."""
    to = (mix(h) % U64(buckets)).astype(np.int64)
    order = np.lexsort((w, h, to))
    hs, ws = h[order], w[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])
    first = np.flatnonzero(new)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return hs[first], ws[first], np.diff(np.append(first, len(h))), place, np.searchsorted(to[order][first], np.arange(buckets + 1))


def codes(h: np.ndarray, window: np.ndarray, count: np.ndarray, max_windows: int) -> np.ndarray:
    """What becomes of each entry (windows of a batch with a count)."""
    order = np.lexsort((window, h))
    hs, ws = h[order], window[order]
    new_h, new_w = np.ones(len(h), bool), np.ones(len(h), bool)
    new_h[1:] = hs[1:] != hs[:-1]
    new_w[1:] = new_h[1:] | (ws[1:] != ws[:-1])
    times = np.add.reduceat(count[order], np.flatnonzero(new_w))[np.cumsum(new_w) - 1]
    kinds = np.add.reduceat(new_w.astype(np.int64), np.flatnonzero(new_h))[np.cumsum(new_h) - 1]
    hot = kinds > max_windows
    code = np.where(times > 1, WHOLE, np.where(kinds > 1, np.where(hot, HOT, OPEN), ALONE))
    witness = (times > 1) & (kinds > 1) & new_w  # one of equal windows
    code[witness] = np.where(hot[witness], HOT_WITNESS, WITNESS)
    out = np.empty(len(h), np.uint8)
    out[order] = code
    return out


OPENED = "h bigint, batch bigint, idx int, at int, open boolean, bytes binary, ha array<bigint>, hb array<bigint>, codes binary"


def repeats(docs: DataFrame, doc_id: str, text: str, max_windows: int) -> DataFrame:
    """The batches with, for each, the windows' codes and the opened windows' repeated starts."""
    spark = docs.sparkSession
    parts = n_parts(spark)
    table = batch_table(docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text")))
    total = table.agg(F.sum(F.length("h"))).first()[0] or 0
    buckets = int(max(3 * parts, 2 * total // BUCKET_BYTES + 1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                h, w, n, _, cut = combined(np.frombuffer(r["h"], U64), np.frombuffer(r["w"], U64), buckets)
                full = np.flatnonzero(np.diff(cut))
                cells = [[x[cut[k] : cut[k + 1]].tobytes() for k in full] for x in (h, w, n.astype("<u4"))]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([r["batch"]] * len(full), pa.int64()), *[pa.array(c, pa.binary()) for c in cells]], ["tb", "batch", "h", "w", "n"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list) -> pa.RecordBatch:
            code = codes(*(np.frombuffer(b"".join(x[k] for x in held), t) for k, t in ((2, U64), (3, U64), (4, "<u4"))), max_windows)
            cut = np.cumsum([0, *(len(x[2]) // 8 for x in held)])
            return pa.RecordBatch.from_arrays([pa.array([x[1] for x in held], pa.int64()), pa.array([x[0] for x in held], pa.int64()), pa.array([compress(code[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["_b", "tb", "code"])

        held: list = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if held and held[0][0] != row[0]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    sent = arrow_map(table.select("batch", "h", "w"), emit, "tb bigint, batch bigint, h binary, w binary, n binary")
    answered = arrow_map(sent.repartition(parts, "tb").sortWithinPartitions("tb"), decide, "_b bigint, tb bigint, code binary")
    answered = answered.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("tb", "code"))).alias("codes"))

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
        fields = [f.split() for f in OPENED.split(", ")]
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, kinds[t])) for k, t in fields], [k for k, _ in fields])

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                buf, _ = texts_of(r)
                h = np.frombuffer(r["h"], U64)
                s, n, at = places_of(r)
                code = codes_of(r["codes"], h, np.frombuffer(r["w"], U64), buckets)
                yield rows(1, batch=pa.array([r["batch"]], pa.int64()), codes=pa.array([compress(code.tobytes())], pa.binary()))
                for hot, kinds in ((False, (OPEN, WITNESS)), (True, (HOT, HOT_WITNESS))):
                    every = np.flatnonzero(np.isin(code, kinds))
                    for i in range(0, len(every), 1000):
                        idx = every[i : i + 1000]
                        common = {"h": pa.array(h[idx].view(np.int64)), "batch": pa.array([r["batch"]] * len(idx), pa.int64()), "idx": pa.array(idx.astype(np.int32)), "at": pa.array(at[idx].astype(np.int32)), "open": pa.array(code[idx] == kinds[0])}
                        whole = [buf[s[k] : s[k] + n[k] + LENGTH - 1] for k in idx]
                        if hot:
                            yield rows(len(idx), **common, **{c: pa.array([string_hashes(x, salt) for x in whole], pa.list_(pa.int64())) for salt, c in enumerate(("ha", "hb"))})
                        else:
                            yield rows(len(idx), **common, bytes=pa.array([x.tobytes() for x in whole], pa.binary()))

    opened = stage(arrow_map(table.select("batch", "sizes", "texts", "h", "w", "places").join(answered, table["batch"] == answered["_b"]).drop("_b"), open_, OPENED), "opened")

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list) -> pa.RecordBatch:
            hit = repeated_starts([x[4] for x in held], np.array([x[2] for x in held]))
            rows = [(x[0], x[1], np.flatnonzero(hit[k]).astype("<u2").tobytes()) for k, x in enumerate(held) if x[3] and hit[k].any()]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary())], ["batch", "idx", "starts"])

        held, last = [], None
        for b in batches:
            for h, *row in zip(*(b.column(i).to_pylist() for i in range(6))):
                if len(held) >= max_windows and h != last:  # all windows of an anchor are in one collection
                    yield done(held)
                    held = []
                held.append(row)
                last = h
        if held:
            yield done(held)

    cold = opened.where("bytes is not null").select("h", "batch", "idx", "at", "open", "bytes").repartition(parts, "h").sortWithinPartitions("h")
    found = arrow_map(cold, transform, "batch bigint, idx int, starts binary").select("batch", "idx", "starts", F.lit(None).cast("int").alias("k"))

    strings = opened.where("ha is not null").select("h", "batch", "idx", "open", F.posexplode(F.arrays_zip("ha", "hb")).alias("k", "z"))
    strings = strings.select("batch", "idx", "open", "k", F.col("z.ha").alias("ha"), F.col("z.hb").alias("hb"))
    often = strings.groupBy("ha", "hb").agg(F.sum(F.when(F.col("open"), 1).otherwise(2)).alias("n")).where("n > 1").drop("n")
    hot = strings.where("open").join(often, ["ha", "hb"], "left_semi").select("batch", "idx", F.lit(None).cast("binary").alias("starts"), "k")
    found = stage(found.unionAll(hot), "found").groupBy(F.col("batch").alias("_f")).agg(F.collect_list(F.struct("idx", "starts", "k")).alias("found"))
    coded = opened.where("codes is not null").select(F.col("batch").alias("_c"), "codes")
    decided = coded.join(found, F.col("_c") == F.col("_f"), "left").drop("_f")
    return table.drop("h", "w").join(decided, table["batch"] == F.col("_c"), "left").drop("_c")


def string_hashes(raw: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of all strings of LENGTH bytes of a window; the salts' hashes are independent."""
    b = raw if salt == 0 else (raw ^ np.uint8(0xA5))
    p = prefix_hash(b)
    i = np.arange(len(raw) - LENGTH + 1)
    return slice_hash(p, i, i + LENGTH).view(np.int64)


def codes_of(answers: list[dict], h: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """The code of each window of a batch, from its entries' codes."""
    if not len(h):
        return np.zeros(0, np.uint8)
    *_, place, _ = combined(h, w, buckets)
    entry = np.frombuffer(b"".join(decompress(x["code"]) for x in answers), np.uint8)
    code = entry[place]
    _, first = np.unique(place, return_index=True)
    again = np.ones(len(h), bool)
    again[first] = False
    code[again & np.isin(code, (WITNESS, HOT_WITNESS))] = WHOLE  # one of equal windows is enough
    return code


def removed_mask(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's bytes, documents' offsets, and whether each byte goes."""
    buf, offsets = texts_of(row)
    s, n, _ = places_of(row)
    code = np.frombuffer(decompress(row["codes"]), np.uint8) if row["codes"] is not None else np.zeros(0, np.uint8)
    step = np.zeros(len(buf) + 1, np.int32)
    whole = np.isin(code, (WHOLE, WITNESS, HOT_WITNESS)).nonzero()[0]
    np.add.at(step, s[whole], 1)
    np.add.at(step, s[whole] + n[whole] + LENGTH - 1, -1)
    for x in row["found"] or ():
        starts = s[x["idx"]] + (np.frombuffer(x["starts"], "<u2").astype(np.int64) if x["starts"] is not None else np.array([x["k"]]))
        np.add.at(step, starts, 1)
        np.add.at(step, starts + LENGTH, -1)
    return buf, offsets, np.cumsum(step[:-1]) > 0


KEPT = "doc_id bigint, spans array<struct<start: int, end: int>>, kept binary"


def suffix_kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, spans (removed bytes, from start up to end) and kept (the other bytes) of each row of docs."""
    table = repeats(docs, doc_id, text, max_windows)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                buf, offsets, gone = removed_mask(r)
                ids, nulls = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["nulls"], np.uint8)
                spans, kept = [], []
                for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    g = gone[a:e]
                    turn = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)).tolist()
                    spans.append([{"start": x, "end": y} for x, y in zip(turn[::2], turn[1::2])])
                    kept.append((buf[a:e][~g] if turn else buf[a:e]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=nulls > 0), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["doc_id", "spans", "kept"])

    return arrow_map(table, run, KEPT)


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs, from its spans and kept bytes."""
    rows = suffix_kept(docs, doc_id, text, max_windows)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + (x["end"] - x["start"]))
    return rows.select("doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
