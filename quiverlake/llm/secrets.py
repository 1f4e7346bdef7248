"""Secret scan: fixed patterns, and tokens that pass a battery of randomness tests.

Candidates are runs of 20 or more characters of the usual encodings' alphabets
(split at - and _, where a run has + or / too). The smallest alphabet that holds a
candidate is its inferred encoding. The battery has three statistics: chi-squared
against a uniform alphabet, runs of a class of characters (of the upper and lower half
of the alphabet, for the test of randomness), and the serial correlation of
neighbours. Each is read twice:

- *as random*: a candidate for which any of them rejects uniform randomness at
  ``ALPHA`` is structured, whatever else;
- *as text*: how improbable it would be in text - so small a chi-squared (non-central,
  normal approximation), so many runs of classes (binomial), so small a correlation
  (normal). The three p-values are combined by Fisher's method. What text is like is
  measured for each encoding over all texts of the table, but for the candidates: how much likelier than among
  uniform symbols two symbols agree, how often the class changes between neighbours, and
  how neighbours correlate; ``PRIOR_SYMBOLS`` symbols of ``PRIOR`` are added, which
  matter in small tables only.

False discoveries are controlled over all candidates of the table, by Benjamini and
Hochberg's rule at level ``fdr`` on those p-values within strata of length, from counts
by bin of -log10 p (a bounded number of rows).

Defined cases: null and empty texts have no spans; repeated rows each count; an empty
table gives an empty result; extra columns are ignored; a very long text is scanned
whole, in memory that grows with it by a constant factor. Candidates that overlap a span
of the fixed patterns add nothing; tokens of digits only infer no encoding.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, stage, text_bytes

#: Fixed values of the contract: kind -> (pattern, group whose length counts, least length).
KINDS = {
    "assign": (re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # maximal runs, as [0-9a-f]+ finds them
}
NAMES = [*KINDS, "random"]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings and their alphabets, smaller ones first.
ENCODINGS = [
    ("hex", DIGITS + LOWER[:6]),
    ("HEX", DIGITS + UPPER[:6]),
    ("lower", LOWER),
    ("upper", UPPER),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("letters", UPPER + LOWER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
]
ALPHABETS = dict(ENCODINGS)
#: What text is taken for before any is read: agreement of two symbols beyond uniform (k * sum(q * q) - 1), changes of class, correlation.
PRIOR = (1.0, 0.15, 0.0)
PRIOR_SYMBOLS = 2000
ALPHA = 0.001
STRATA = (20, 32, 48, 96)
BINS = 600  # of 0.1 in -log10 p


# --------------------------------------------------------- what text is like


CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((DIGITS, LOWER, UPPER)):
    CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k + 1
PLACES = {}
for _name, _chars in ENCODINGS:
    PLACES[_name] = np.full(256, -1, np.int16)
    PLACES[_name][np.frombuffer(_chars.encode(), np.uint8)] = np.arange(len(_chars))

SEEN = "name string, symbols array<bigint>, pairs bigint, changes bigint, products bigint"


def in_long_runs(buf: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each byte is in a run as long as a candidate."""
    token = PLACES["base64"][buf] >= 0
    token |= PLACES["base64url"][buf] >= 0
    turn = np.diff(token.astype(np.int8), prepend=0, append=0)
    start, end = turn[:-1] == 1, turn[1:] == -1
    start[1:] |= token[1:] & last[:-1]
    end |= token & last
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = b - a >= STRATA[0]
    step = np.zeros(len(buf) + 1, np.int8)
    step[a[long]] = 1
    step[b[long]] -= 1
    return np.cumsum(step[:-1], dtype=np.int8) > 0


def count_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each encoding: counts of its symbols in the texts, and of neighbours that are both of it, how many, how many of two classes, and the sum of products."""
    total = {name: [np.zeros(len(alphabet), np.int64), 0, 0, 0] for name, alphabet in ENCODINGS}
    for b in pieces(batches, "_text", 8 << 20):
        buf, offsets = text_bytes(b.column(b.schema.get_field_index("_text")))
        last = np.zeros(len(buf), bool)
        last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True  # a text's last byte has no neighbour
        long = in_long_runs(buf, last)
        for i in range(0, len(buf), 4 << 20):
            own = buf[i : i + (4 << 20) + 1]
            change = CLASS[own[1:]] != CLASS[own[:-1]]
            inside = ~last[i : i + len(own) - 1]
            for name, t in total.items():
                x = PLACES[name][own]
                x[long[i : i + len(own)]] = -1
                is_in = x >= 0
                t[0] += np.bincount(x[: 4 << 20][is_in[: 4 << 20]], minlength=len(t[0]))
                both = np.flatnonzero(is_in[1:] & is_in[:-1] & inside)
                t[1] += len(both)
                t[2] += int(change[both].sum())
                t[3] += int((x[both].astype(np.int64) * x[both + 1]).sum())
    yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([t[0].tolist() for t in total.values()], pa.list_(pa.int64())), *[pa.array([t[k] for t in total.values()], pa.int64()) for k in (1, 2, 3)]], ["name", "symbols", "pairs", "changes", "products"])


def text_model(rows: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Agreement, changes and correlation in all the texts (column _text), by encoding."""
    sums = {name: [np.zeros(len(alphabet)), 0, 0, 0] for name, alphabet in ENCODINGS}
    # a row a task and encoding, summed before it gets here
    seen = arrow_map(rows.select("_text"), count_text, SEEN).select("name", "pairs", "changes", "products", F.posexplode("symbols").alias("k", "n"))
    first = F.col("k") == 0
    for r in seen.groupBy("name", "k").agg(F.sum("n").alias("n"), *[F.sum(F.when(first, F.col(c)).otherwise(0)).alias(c) for c in ("pairs", "changes", "products")]).collect():
        own = sums[r["name"]]
        own[0][r["k"]] = r["n"]
        for i, c in enumerate(("pairs", "changes", "products")):
            own[i + 1] += r[c]
    return {name: text_traits(*own) for name, own in sums.items()}


def text_traits(symbols: np.ndarray, pairs: int, changes: int, products: int) -> tuple[float, float, float]:
    n, k = float(symbols.sum()), len(symbols)
    q = symbols / max(n, 1.0)
    x = np.arange(k)
    mean = float((q * x).sum())
    var = float((q * x * x).sum()) - mean * mean
    measured = (k * float((q * q).sum()) - 1, changes / max(pairs, 1), (products / pairs - mean * mean) / var if pairs and var > 0 else 0.0)
    return tuple((PRIOR_SYMBOLS * a + w * b) / (PRIOR_SYMBOLS + w) for a, b, w in zip(PRIOR, measured, (n, pairs, pairs)))


# ------------------------------------------------------------------ the battery


def upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def upper_chi2(x: float, k: float) -> float:
    """P(chi-squared with k degrees of freedom >= x), Wilson-Hilferty."""
    return upper_normal(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def infer_encoding(token: str) -> tuple[str, str] | None:
    own = set(token)
    if own <= set(DIGITS):
        return None  # numbers
    return next(((name, alphabet) for name, alphabet in ENCODINGS if own <= set(alphabet)), None)


def battery(token: str, model: dict[str, tuple[float, float, float]]) -> tuple[bool, float]:
    """(whether no test rejects uniform randomness, p of so random a token if it were text)."""
    token = token.rstrip("=")
    n = len(token)
    got = infer_encoding(token)
    if got is None or n < STRATA[0]:
        return False, 1.0
    name, alphabet = got
    raw = np.frombuffer(token.encode(), np.uint8)
    k, x = len(alphabet), PLACES[name][raw].astype(float)
    # as random
    chi = float(((np.bincount(x.astype(int), minlength=k) - n / k) ** 2).sum() * k / n)
    above = x >= k / 2
    n1 = int(above.sum())
    n0 = n - n1
    if n1 == 0 or n0 == 0:
        return False, 1.0
    runs = 1 + int((above[1:] != above[:-1]).sum())
    mean = 1 + 2 * n1 * n0 / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = 2 * upper_normal(abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    d = x - x.mean()
    r = float((d[1:] * d[:-1]).sum() / (d * d).sum())
    p_serial = 2 * upper_normal(abs(r + 1 / n) * math.sqrt(n))
    if min(upper_chi2(chi, k - 1), p_runs, p_serial) < ALPHA:
        return False, 1.0
    # as text
    agree, change, along = model[name]
    excess = max(agree, 0.0) * n
    t_chi = upper_normal(((k - 1) + excess - chi) / math.sqrt(2 * (k - 1 + 2 * excess)))
    change = min(max(change, 0.01), 0.99)
    changes = int((CLASS[raw[1:]] != CLASS[raw[:-1]]).sum())
    t_runs = upper_normal((changes - 0.5 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change)))
    t_serial = upper_normal(((along - 1 / n) - r) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (t_chi, t_runs, t_serial))
    return True, max(math.exp(-half) * (1 + half + half * half / 2), 1e-300)  # chi-squared with six degrees of freedom


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = []
    for k, (pattern, group, least) in enumerate(KINDS.values()):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def candidate_spans(text: str) -> Iterator[tuple[int, int]]:
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if WIDE.search(text, s, e) and URL.search(text, s, e):  # no encoding has both: its parts
            yield from (p.span() for p in PART.finditer(text, s, e))
        else:
            yield s, e


WIDE, URL, PART = re.compile("[+/]"), re.compile("[_-]"), re.compile(r"[A-Za-z0-9+/]{20,}={0,2}")


def candidates(text: str, base: list[tuple[int, int, int]], model: dict[str, tuple[float, float, float]]) -> list[tuple[int, int, int, float]]:
    """(start, end, length without padding, p) of candidates clear of the base spans; p is 1 where they don't look random."""
    # base spans by start, and the furthest end up to each
    starts, ends = [a for a, _, _ in base], []
    for _, _, b in base:
        ends.append(max(b, ends[-1]) if ends else b)
    out = []
    for s, e in candidate_spans(text):
        before = bisect_left(starts, e)  # spans that start before the candidate's end
        if before == 0 or ends[before - 1] <= s:
            token = text[s:e]
            ok, p = battery(token, model)
            out.append((s, e, len(token.rstrip("=")), p if ok else 1.0))
    return out


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in spans)


FOUND = "doc_id bigint, base array<struct<start:bigint,kind:int,end:bigint>>, more array<struct<start:bigint,end:bigint,n:int,score:double>>"


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fdr: float = 0.001) -> DataFrame:
    """doc_id, base (start, kind, end) and more (start, end, n, score = -log10 p): the spans of each row, after false-discovery control."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    model = text_model(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))), ("more", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n", pa.int32()), ("score", pa.float64())])))])
        for b in pieces(batches, "_text", 8 << 20):
            base = [base_spans(t or "") for t in b.column(1).to_pylist()]
            more = [candidates(t or "", s, model) for t, s in zip(b.column(1).to_pylist(), base)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[dict(zip(("start", "kind", "end"), x)) for x in s] for s in base], schema.field(1).type), pa.array([[{"start": s, "end": e, "n": n, "score": -math.log10(p)} for s, e, n, p in c] for c in more], schema.field(2).type)], schema=schema
            )

    found = stage(arrow_map(rows, run, FOUND), "secrets")
    # Benjamini-Hochberg by stratum, from at most len(STRATA) * BINS counts
    stratum = lambda n: sum((F.when(n >= x, 1).otherwise(0) for x in STRATA[1:]), F.lit(0))
    bins = found.select(F.explode("more").alias("m")).select(stratum(F.col("m.n")).alias("s"), F.least(F.lit(BINS), F.floor(F.col("m.score") * 10)).cast("int").alias("b")).groupBy("s", "b").count().collect()
    least = {}
    for s in range(len(STRATA)):
        own = np.zeros(BINS + 1)
        for r in bins:
            if r["s"] == s:
                own[r["b"]] += r["count"]
        over = np.cumsum(own[::-1])[::-1]  # p <= 10 ** (-bin / 10)
        good = np.flatnonzero((own.sum() * 10.0 ** (-np.arange(BINS + 1) / 10) <= fdr * over) & (over > 0))
        least[s] = float(good[0] / 10) if len(good) else 1e9
    cut = lambda x: sum((F.when(stratum(x["n"]) == s, F.lit(v)).otherwise(0.0) for s, v in least.items()), F.lit(0.0))
    return found.withColumn("more", F.filter("more", lambda x: x["score"] >= cut(x)))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_secrets' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                base = [(x["start"], x["kind"], x["end"]) for x in r["base"]]
                extra = [(x["start"], len(KINDS), x["end"]) for x in r["more"]]
                n = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                out.append((r["doc_id"], *n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(sorted(base + extra)), len(extra)))
            c = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return arrow_map(found, run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint")
