"""Elias-Fano coded monotone sequences over plain byte arrays, with vectorised queries.

A sequence of n values below u keeps the low l = log2(u / n) bits of each value
packed, and the high parts as a bit vector (a one for each value, a zero for each
step of the high part). The place of every fourth one (for ``get``) and zero (for
``find``) is sampled; where four of them don't lie within one 64-bit window, all four
places are stored, so a select reads one window or one place. A sequence that is only
read as a whole needs no samples. All arrays can be slices of a mapped file.
"""

from __future__ import annotations

import json
import struct

import numpy as np

U64 = np.uint64
STEP = 4


def pack_low(v: np.ndarray, l: int) -> np.ndarray:
    """l bits of each value, one after another: 64 values fill l words, so each of the 64 is put in its place in all such groups at once."""
    if l == 0 or len(v) == 0:
        return np.zeros(16, np.uint8)
    groups = -(-len(v) // 64)
    padded = np.zeros(groups * 64, U64)
    padded[: len(v)] = v
    padded = np.ascontiguousarray(padded.reshape(groups, 64).T)
    words = np.zeros((l + 1, groups), U64)
    for j in range(64):
        at, shift = divmod(j * l, 64)
        words[at] |= padded[j] << U64(shift)
        if shift + l > 64:
            words[at + 1] |= padded[j] >> U64(64 - shift)
    raw = np.ascontiguousarray(words[:l].T).astype("<u8").view(np.uint8).ravel()
    return np.concatenate([raw[: (len(v) * l + 7) // 8], np.zeros(16, np.uint8)])


def places(at: np.ndarray, name: str, kind: str) -> dict[str, np.ndarray]:
    """Samples of ascending places, flags of the blocks that are too wide for a window, and those blocks with all their places."""
    first = at[::STEP]
    last = at[np.minimum(np.arange(len(first)) * STEP + STEP - 1, len(at) - 1)] if len(at) else at
    wide = last - first > 56
    block = np.flatnonzero(wide)
    k = np.minimum(block[:, None] * STEP + np.arange(STEP), max(0, len(at) - 1)).ravel()
    return {name: first.astype(kind), f"{name}_wide": wide.astype(np.uint8), f"{name}_block": block.astype("<u8"), f"{name}_all": at[k].astype(kind) if len(at) else at.astype(kind)}


def build(values: np.ndarray, universe: int, get: bool = True, find: bool = True) -> dict[str, np.ndarray]:
    """Arrays of the coded sequence; values: ascending uint64 below universe; get, find: what it is sampled for."""
    n = len(values)
    v = values.astype(U64)
    l = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
    high = (v >> U64(l)).astype(np.int64)
    size = n + (int(universe - 1) >> l if universe else 0) + 2
    bits = np.zeros(size, bool)
    bits[high + np.arange(n)] = True
    kind = "<u4" if size < 1 << 32 else "<u8"
    return {
        "meta": np.array([n, l], np.int64),
        "last": v[-1:].astype("<u8"),
        "low": pack_low(v & U64((1 << l) - 1), l),
        "high": np.concatenate([np.packbits(bits, bitorder="little"), np.zeros(16, np.uint8)]),
        **(places(np.flatnonzero(bits), "one", kind) if get else {}),
        **(places(np.flatnonzero(~bits), "zero", kind) if find else {}),
    }


def windows(b: np.ndarray) -> np.ndarray:
    """A 64-bit little-endian window at every byte."""
    return np.ndarray((max(0, len(b) - 7),), "<u8", b, strides=(1,))


class Sequence:
    def __init__(self, a: dict[str, np.ndarray]):
        self.n, self.l = (int(x) for x in a["meta"])
        self.one, self.zero = ([a.get(f"{k}{x}") for x in ("", "_wide", "_block", "_all")] for k in ("one", "zero"))
        self.low, self.high, self.bits = windows(a["low"]), windows(a["high"]), a["high"]
        self.last = U64(a["last"][0]) if self.n else U64(0)

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """The place of the k-th (from 0) one or zero of the high bits."""
        sample, wide, block, every = self.one if bit else self.zero
        b, r = k // STEP, k % STEP
        out = sample[b].astype(np.int64)
        w = self.high[out >> 3]
        w = (w if bit else ~w) >> (out & 7).astype(U64)
        for i in range(STEP - 1):
            w = np.where(r > i, w & (w - U64(1)), w)
        out += np.bitwise_count((w & (~w + U64(1))) - U64(1))
        far = np.flatnonzero(wide[b])
        if len(far):
            out[far] = every[np.searchsorted(block, b[far].astype(U64)) * STEP + r[far]]
        return out

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if self.l == 0:
            return np.zeros(len(i), U64)
        at = i * self.l
        return (self.low[at >> 3] >> (at & 7).astype(U64)) & U64((1 << self.l) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self.select(i, 1) - i).astype(U64) << U64(self.l)) | self.low_of(i)

    def all(self) -> np.ndarray:
        """All values."""
        i = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(self.bits[:-16], bitorder="little"))[: self.n]
        return ((ones - i).astype(U64) << U64(self.l)) | self.low_of(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of a value equal to each x, or -1."""
        x = np.asarray(x, U64)
        out = np.full(len(x), -1, np.int64)
        if self.n == 0 or not len(x):
            return out
        if not (inside := x <= self.last).all():
            out[inside] = self.find(x[inside])
            return out
        high, low = (x >> U64(self.l)).astype(np.int64), x & U64((1 << self.l) - 1)
        begin = np.zeros(len(x), np.int64)
        later = np.flatnonzero(high > 0)
        begin[later] = self.select(high[later] - 1, 0) + 1 - high[later]
        # values of one high part are a run of ones
        at = begin + high
        shift = (at & 7).astype(U64)
        w = ~(self.high[at >> 3] >> shift)
        run = np.bitwise_count((w & (~w + U64(1))) - U64(1)).astype(np.int64)
        beyond = np.flatnonzero(run >= 64 - shift.astype(np.int64))
        if len(beyond):
            run[beyond] = self.select(high[beyond], 0) - at[beyond]
        todo = np.flatnonzero(run > 0)
        a, b, want = begin[todo], begin[todo] + run[todo], low[todo]
        while (wide := b - a > 1).any():
            k = np.flatnonzero(wide)
            middle = (a[k] + b[k]) >> 1
            right = self.low_of(middle) <= want[k]
            a[k] = np.where(right, middle, a[k])
            b[k] = np.where(right, b[k], middle)
        same = self.low_of(a) == want
        out[todo[same]] = a[same]
        return out


# ---------------------------------------------------------- membership filter


def pair_bits(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """A bit place of each pair; size: a power of two."""
    h = (a.astype(U64) * U64(0x9E3779B97F4A7C15) + b.astype(U64)) * U64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> U64(32))) & U64(size - 1)).astype(np.int64)


def pair_filter(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Four bits or more a pair, one set for each: tells most pairs that aren't there without a search."""
    size = 1 << max(6, (4 * len(a) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[pair_bits(a, b, size)] = True
    return np.packbits(bits, bitorder="little")


def maybe(filter_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = pair_bits(a, b, 8 * len(filter_))
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


# ------------------------------------------------------- arrays in one file


def write_arrays(out, arrays: dict[str, np.ndarray]) -> None:
    at, index = 0, {}
    for k, a in arrays.items():
        index[k] = [at, a.dtype.str, len(a)]
        at += (a.nbytes + 15) // 16 * 16
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 8) % 16)
    out.write(struct.pack("<Q", len(head)) + head)
    for a in arrays.values():
        out.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 16))


def read_arrays(buf: np.ndarray) -> dict[str, np.ndarray]:
    n = struct.unpack("<Q", buf[:8].tobytes())[0]
    index = json.loads(buf[8 : 8 + n].tobytes())
    return {k: np.frombuffer(buf, kind, count, 8 + n + at) if count else np.zeros(0, kind) for k, (at, kind, count) in index.items()}


def part(arrays: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    return {k[len(name) + 1 :]: a for k, a in arrays.items() if k.startswith(name + ".")}


def named(arrays: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": a for k, a in arrays.items()}
