"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters look at a document's words in three readings - as they are, with
look-alike characters read as letters ("1d10t"), and with runs of a letter
squeezed ("stuuupid") - and vote toxic, clean or abstain:

- fixed lexicons, one voter each and reading;
- mined words and beginnings of words (of 5 to 10 bytes): those whose share of
  labelled toxic documents is far above their share of the others, one voter each;
- patterns: several distinct lexicon words, insult density, no lexicon word at all.

The label model takes each voter's accuracy and coverage as unknown. Labels calibrate
it, but are no voter: votes are counted by class over all labelled rows that may be
learned from, as are the mined words. Voters' correlations are estimated from the
residual covariance of their votes given the class, over the same rows, and the
log-odds of correlated voters are discounted by it. The posterior of a document is that
of its votes alone. A logistic regression on hashed words and votes is then fitted to
posterior labels: those of a sample of unlabelled documents, and of labelled ones, where
the class is known. Two numbers that turn its sums into probabilities are fitted to
the labelled rows' classes. Every document is scored whole.

Bounds: the classifier is fitted on the driver, on at most about ``max_labelled``
labelled and ``max_unlabelled`` unlabelled rows (taken by hash of doc_id); all counts are
over all rows.

Defined cases: a null or empty text has no words and gets the score of the bias
and the clean voter; a very long text is read in slices; repeated rows each count; of
several labels of one doc_id the largest counts; with no labelled toxic or no clean
row, scores come from the fixed lexicons alone; an empty table gives an empty
result; a null doc_id is scored and counts as not held out, but is not learned from;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, arrow_map, n_parts, pieces, prefix_hash, slice_hash, stage, text_bytes, word_slices

#: General insults, by theme.
LEXICONS = {
    "stupidity": "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile fool clown clowns brainless dimwit dunce",
    "worth": "worthless loser losers pathetic trash garbage scum useless failure lowlife vermin filth",
    "disgust": "disgusting vile gross revolting repulsive nasty despicable",
    "profanity": "damn crap bastard bastards bitch asshole jerk",
    "hate": "hate kill die shut ugly freak creep",
}
HASH_BITS = 18
SIZE = 1 << HASH_BITS
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True
LOOKS = LOWER.copy()
for a, b in zip(b"0134578@$!", b"oieastbasi"):
    LOOKS[a] = b
BEGINNINGS = (5, 6, 7, 8, 9, 10)
READINGS = ("plain", "looks", "squeezed")


def word_hash(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(slice_hash(prefix_hash(b), np.array([0]), np.array([len(b)]))[0])
    return np.array(out, U64)


class Reading:
    """Words (runs of letters) of a batch: hashes h, documents d, and their beginnings."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, reading: str):
        found = [self._words(buf[x:y], np.clip(offsets, x, y) - x, reading) for x, y in word_slices(buf)]
        self.h, self.d, first, size = (np.concatenate(c) if len(found) > 1 else c[0] for c in zip(*found))
        self.first, self.size = first, size

    @staticmethod
    def _words(buf: np.ndarray, offsets: np.ndarray, reading: str) -> tuple[np.ndarray, ...]:
        """Words' hashes, documents, hashes of their first bytes by number (a column each of BEGINNINGS), and sizes."""
        b = (LOOKS if reading == "looks" else LOWER)[buf]
        if reading == "squeezed":
            keep = np.ones(len(b), bool)
            keep[1:] = (b[1:] != b[:-1]) | ~LETTER[b[1:]]
            keep[offsets[:-1][offsets[:-1] < len(b)]] = True
            run = np.concatenate([[0], np.cumsum(keep)])
            b, offsets = b[keep], run[offsets]
        n = len(b)
        word = LETTER[b]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        p = prefix_hash(b)
        size = ends - starts
        d = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
        first = np.zeros((len(starts), len(BEGINNINGS) if reading == "plain" else 0), U64)
        if reading == "plain":
            for i, k in enumerate(BEGINNINGS):
                at = np.flatnonzero(size > k)
                first[at, i] = slice_hash(p, starts[at], starts[at] + k) ^ U64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return slice_hash(p, starts, ends), d, first, size

    def beginnings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first k bytes of the words longer than that, and their documents."""
        at = np.flatnonzero(self.size > k)
        return self.first[at, BEGINNINGS.index(k)], self.d[at]

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield self.h, self.d
        for k in BEGINNINGS:
            yield self.beginnings(k)


class HashSet:
    """Membership in a small set of hashes, by a bitmap first."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.map = np.zeros(1 << 16, bool)
        self.map[(self.values & U64(0xFFFF)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.map[(h & U64(0xFFFF)).astype(np.int64)])
        return at[np.isin(h[at], self.values)]


def squeeze(word: str) -> str:
    return "".join(c for i, c in enumerate(word) if i == 0 or c != word[i - 1])


@dataclass
class Voters:
    """What each voter looks for. names has one entry a column of votes()."""

    mined: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    names: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lists = {}
        for reading in READINGS:
            for k, words in LEXICONS.items():
                own = [squeeze(w) for w in words.split()] if reading == "squeezed" else words.split()
                self.lists[reading, k] = np.unique(word_hash(own))
        self.every = {r: HashSet(np.concatenate([self.lists[r, k] for k in LEXICONS])) for r in READINGS}
        self.mined_set, self.column = HashSet(self.mined), {int(m): i for i, m in enumerate(self.mined)}
        self.names = [f"{r}:{k}" for r in READINGS for k in LEXICONS] + [f"mined:{i}" for i in range(len(self.mined))] + ["several", "dense", "none"]

    def votes(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, voters) int8 of 1, 0 and -1, and the plain words' hashes and documents."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.names)), np.int8)
        col, hits, distinct = 0, np.zeros(n, np.int64), np.zeros(n, np.int64)
        plain = None
        for reading in READINGS:
            r = Reading(buf, offsets, reading)
            at = self.every[reading].places(r.h)
            hh, dd = r.h[at], r.d[at]
            for k in LEXICONS:
                out[dd[np.isin(hh, self.lists[reading, k])], col] = 1
                col += 1
            if reading == "plain":
                plain = r
                hits += np.bincount(dd, minlength=n)
                pairs = np.unique(np.stack([dd.astype(U64), hh]), axis=1) if len(dd) else np.zeros((2, 0), U64)
                distinct += np.bincount(pairs[0].astype(np.int64), minlength=n)
        for h, d in plain.features():
            at = self.mined_set.places(h)
            if len(at):
                u, inverse = np.unique(h[at], return_inverse=True)
                out[d[at], col + np.array([self.column[int(x)] for x in u])[inverse]] = 1
        col += len(self.mined)
        words = np.bincount(plain.d, minlength=n)
        out[distinct >= 2, col] = 1
        out[100 * hits >= np.maximum(words, 1), col + 1] = 1
        out[(out[:, :col] == 0).all(axis=1), col + 2] = -1
        return out, plain.h, plain.d


@dataclass
class LabelModel:
    """P(vote | class) of each voter, and correlation-discounted log-odds."""

    prior: float = 0.1
    weights: np.ndarray = field(default_factory=lambda: np.zeros((3, 0)))  # log-odds of vote -1, 0, 1

    @staticmethod
    def counted(mass: np.ndarray, outcomes: np.ndarray, products: np.ndarray, apart: int = 0) -> LabelModel:
        """From counts by class (0, 1): rows (2), rows by vote -1, 0, 1 and voter (2, 3, m), and sums of products of votes (m, m) over all rows. Nothing is discounted for the last ``apart`` voters."""
        seen = outcomes.sum(axis=0) > 0  # outcomes that a voter has at all
        p = (outcomes + 0.5) / (mass[:, None, None] + 1.5)
        odds = np.where(seen, np.log(p[1]) - np.log(p[0]), 0.0)
        mean = (outcomes[:, 2] - outcomes[:, 0]) / np.maximum(mass, 1e-9)[:, None]
        cov = (products - sum(w * np.outer(m, m) for w, m in zip(mass, mean))) / max(mass.sum(), 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), -1, 1)
        np.fill_diagonal(corr, 1.0)
        corr[np.abs(corr) < 0.3] = 0
        share = 1.0 / np.abs(corr).sum(axis=1)
        share[len(share) - apart :] = 1.0
        return LabelModel(float(np.clip(mass[1] / max(mass.sum(), 1), 1e-3, 0.5)), odds * share)

    @staticmethod
    def fit(votes: np.ndarray, start: np.ndarray, rounds: int = 30, apart: int = 0) -> LabelModel:
        """By expectation maximisation on votes without labels, from a first posterior of each row."""
        p = np.clip(start, 0.02, 0.98)
        model = LabelModel()
        products = votes.astype(float).T @ votes
        for _ in range(rounds):
            outcomes = np.stack([[q @ (votes == v) for v in (-1, 0, 1)] for q in (1 - p, p)])
            model = LabelModel.counted(np.array([(1 - p).sum(), p.sum()]), outcomes, products, apart)
            p = model.posterior(votes)
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for k, v in enumerate((-1, 0, 1)):
            z += (votes == v).astype(np.float32) @ self.weights[k].astype(np.float32)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def buckets(h: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hashed word) pairs."""
    key = np.unique((d.astype(U64) << U64(HASH_BITS)) | (h & U64(SIZE - 1)))
    return (key >> U64(HASH_BITS)).astype(np.int64), (key & U64(SIZE - 1)).astype(np.int64)


def fit_linear(rows: np.ndarray, cols: np.ndarray, votes: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on hashed words (weight 1/sqrt of their number in a document) and votes, by full-batch Adam."""
    n, m = votes.shape
    size = np.bincount(rows, minlength=n)
    x = (1 / np.sqrt(np.maximum(size, 1))).astype(np.float32)[rows]
    w = np.zeros(SIZE + m + 1)
    v1, v2 = np.zeros_like(w), np.zeros_like(w)
    vf = votes.astype(np.float32)
    for i in range(1, rounds + 1):
        z = np.bincount(rows, w.astype(np.float32)[cols] * x, n) + vf @ w[SIZE:-1].astype(np.float32) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.concatenate([np.bincount(cols, err.astype(np.float32)[rows] * x, SIZE), vf.T @ err.astype(np.float32), [err.sum()]])
        g[:-1] += l2 * w[:-1]
        v1, v2 = 0.9 * v1 + 0.1 * g, 0.999 * v2 + 0.001 * g * g
        w -= rate * (v1 / (1 - 0.9**i)) / (np.sqrt(v2 / (1 - 0.999**i)) + 1e-8)
    return w[:SIZE], w[SIZE:-1], float(w[-1])


def held_out(doc_id: str):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def calibrated(z: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple[float, float]:
    """a and b for which a z + b are log-odds of y, by Newton's method; held near 1 and 0 where there is little to go by."""
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        gradient = x @ (p - y) / len(y) + l2 * (w - [1.0, 0.0])
        curvature = (x * np.maximum(p * (1 - p), 1e-9)) @ x.T / len(y) + l2 * np.eye(2)
        w = w - np.linalg.solve(curvature, gradient)
    return float(w[0]), float(w[1])


#: Up to so many labels (two numbers each) are broadcast; more are joined by merging.
MAX_BROADCAST_LABELS = 500_000


def taken(key: str, n: int, most: int):
    """Whether a row is among about ``most`` of n, by hash."""
    return F.lit(True) if n <= most else F.pmod(F.xxhash64(key), F.lit(1_000_000)) < 1_000_000 * most // n


@dataclass
class Model:
    voters: Voters
    words: np.ndarray
    vote_weights: np.ndarray
    bias: float
    scale: float = 1.0

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, offsets = text_bytes(column)
        votes, h, d = self.voters.votes(buf, offsets)
        rows, cols = buckets(h, d, len(votes))
        return 1 / (1 + np.exp(-np.clip(self.scale * self.sums(rows, cols, votes) + self.bias, -30, 30))), votes

    def sums(self, rows: np.ndarray, cols: np.ndarray, votes: np.ndarray) -> np.ndarray:
        size = np.bincount(rows, minlength=len(votes))
        return np.bincount(rows, self.words[cols] / np.sqrt(np.maximum(size, 1))[rows], len(votes)) + votes @ self.vote_weights


def mined_words(labelled: DataFrame, max_mined: int) -> tuple[np.ndarray, int, int]:
    """Hashes of words and beginnings that tell labelled (_text, _y) toxic documents, and the numbers of toxic and clean ones; copies of a text in a batch count once."""

    def counted(u: np.ndarray, a: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(a.astype(np.int64)), pa.array(c.astype(np.int64))], ["w", "a", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text", 4 << 20):
            buf, offsets = text_bytes(b.column(b.schema.get_field_index("_text")))
            y = np.asarray(b.column(b.schema.get_field_index("_y")))
            r = Reading(buf, offsets, "plain")
            text_key = np.bincount(r.d, (r.h >> U64(40)).astype(float), len(y))
            _, first = np.unique(np.stack([text_key, y.astype(float)]), axis=1, return_index=True)
            own = np.zeros(len(y), bool)
            own[first] = True
            for h, d in r.features():
                keep = own[d]
                pair = np.unique(np.stack([h[keep], d[keep].astype(U64)]), axis=1) if keep.any() else np.zeros((2, 0), U64)
                toxic = y[pair[1].astype(np.int64)] == 1
                u, inverse = np.unique(pair[0], return_inverse=True)
                a = np.bincount(inverse, toxic, len(u))
                yield counted(u, a, np.bincount(inverse, ~toxic, len(u)))
            yield counted(np.array([0], U64), np.array([(y[first] == 1).sum()]), np.array([(y[first] == 0).sum()]))

    counts = arrow_map(labelled.select("_text", "_y"), count, "w bigint, a bigint, c bigint").groupBy("w").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    counts = stage(counts.where("w = 0 or a >= 3"), "tox-words")
    total = counts.where("w = 0").first()
    toxic, clean = (total["a"], total["c"]) if total else (0, 0)
    if not toxic or not clean:
        return np.zeros(0, U64), toxic, clean
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    top = counts.where("w <> 0").where((F.col("a") >= max(3, toxic // 200)) & (odds >= 3.0) & (F.col("a") >= 2 * F.col("c"))).orderBy((odds * F.sqrt("a")).desc(), "w").limit(max_mined).collect()
    return np.array([r["w"] for r in top], np.int64).view(U64), toxic, clean


def vote_counts(labelled: DataFrame, voters: Voters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LabelModel.counted's counts over all labelled rows: summed in each task, then a voter's row at a time."""
    m = len(voters.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, outcomes, products = np.zeros(2, np.int64), np.zeros((2, 3, m), np.int64), np.zeros((m, m), np.int64)
        for b in pieces(batches, "_text"):
            votes, *_ = voters.votes(*text_bytes(b.column(b.schema.get_field_index("_text"))))
            y = np.asarray(b.column(b.schema.get_field_index("_y")))
            for c in (0, 1):
                own = votes[y == c]
                mass[c] += len(own)
                outcomes[c] += np.stack([(own == v).sum(axis=0) for v in (-1, 0, 1)])
            v = votes.astype(np.float32)  # sums of a batch are exact
            products += (v.T @ v).astype(np.int64)
        table = np.concatenate([np.pad(mass, (0, m - 2))[None], outcomes.reshape(6, m), products])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table)), pa.int64()), pa.array([x.astype("<i8").tobytes() for x in table], pa.binary())], ["k", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(n, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["k", "n"])

    sent = arrow_map(labelled.select("_text", "_y"), count, "k bigint, n binary")
    got = arrow_map(sent.repartition(n_parts(labelled.sparkSession), "k"), add, "k bigint, n binary").collect()  # m + 7 rows of m numbers
    table = np.zeros((m + 7, m))
    for r in got:
        table[r["k"]] = np.frombuffer(r["n"], "<i8")
    return table[0, :2], table[1:7].reshape(2, 3, m), table[7:]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 10_000, max_unlabelled: int = 5_000, max_mined: int = 256, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    own = labels.where(~held_out(doc_id) & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_l")).agg(F.max(label).cast("int").alias("_y"))
    n_labels = own.count()
    hint = F.broadcast if n_labels <= MAX_BROADCAST_LABELS else lambda x: x.hint("merge")
    rows = docs.where(~held_out(doc_id) & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    labelled = stage(rows.join(hint(own), F.col("_id") == F.col("_l")).select("_id", "_text", "_y"), "tox-labelled", "zstd")
    mined, toxic, clean = mined_words(labelled, max_mined)
    voters = Voters(mined)
    if not toxic or not clean:
        return Model(voters, np.zeros(SIZE), np.where([x == "none" for x in voters.names], 0.5, 1.5), -1.0)
    model = LabelModel.counted(*vote_counts(labelled, voters))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            votes, h, d = voters.votes(*text_bytes(b.column(b.schema.get_field_index("_text"))))
            at, cols = buckets(h, d, len(votes))
            y = np.asarray(b.column(b.schema.get_field_index("_y"))).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (votes.tobytes(), y.tobytes(), at.astype("<u4").tobytes(), cols.astype("<u4").tobytes())], ["v", "y", "r", "c"])

    some = labelled.where(taken("_id", n_labels, max_labelled)).select("_text", "_y")
    n_other = max(rows.count() - n_labels, 0)
    other = rows.where(taken("_id", n_other, max_unlabelled)).join(hint(own.select("_l")), F.col("_id") == F.col("_l"), "left_anti").select("_text", F.lit(-1).alias("_y"))
    # at most about max_labelled + max_unlabelled rows of some hundred hashed words
    parts = sorted(arrow_map(some.unionAll(other), vote, "v binary, y binary, r binary, c binary").collect(), key=lambda p: (bytes(p["y"]), bytes(p["v"]), bytes(p["c"])))
    m = len(voters.names)
    votes = np.concatenate([np.frombuffer(p["v"], np.int8).reshape(-1, m) for p in parts])
    y = np.concatenate([np.frombuffer(p["y"], np.int8) for p in parts])
    at = np.cumsum([0, *(len(p["y"]) for p in parts)])
    rows_ = np.concatenate([np.frombuffer(p["r"], "<u4").astype(np.int32) + np.int32(a) for p, a in zip(parts, at)])
    cols = np.concatenate([np.frombuffer(p["c"], "<i4") for p in parts])
    del parts
    words, weights, bias = fit_linear(rows_, cols, votes, np.where(y < 0, model.posterior(votes), np.where(y == 1, 0.98, 0.02)))
    known = y >= 0
    scale, shift = calibrated((Model(voters, words, weights, 0.0).sums(rows_, cols, votes) + bias)[known], y[known])
    return Model(voters, words, weights, scale * bias + shift, scale)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id=doc_id, text=text, **options))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            score, _ = model.value.score(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return arrow_map(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")
