import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import common
from quiverlake.llm import suffix_dedup as D

from . import cases


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for i in range(len(b) - 199):
            count[b[i : i + 200]] = count.get(b[i : i + 200], 0) + 1
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    r = random.Random(4)
    common = cases.words(60, 9, 5000)
    out = [cases.words(r.randrange(30, 200), 100 + i, 5000) for i in range(12)]
    out += [out[0], out[1][:300] + "X" + out[1][300:], common + out[2], out[3] + common + out[4], "ab" * 300, "é" * 260, "z" * 199, "z" * 200, None, ""]
    edits = [list(out[5]) for _ in range(8)]
    for e in edits:
        for _ in range(3):
            e[r.randrange(len(e))] = r.choice("xyz")
    return out + ["".join(e) for e in edits]


@pytest.mark.parametrize("max_windows", [20_000, 2])
def test_equals_brute_force(spark, max_windows):
    t = texts()
    got = D.suffix_dedup(cases.docs(spark, t), max_windows=max_windows).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(t)


def test_collection_finds_what_pairs_share():
    r = np.random.default_rng(3)
    for _ in range(40):
        core, windows, offsets = bytes(r.integers(97, 99, 4)), [], []
        for _ in range(int(r.integers(1, 9))):
            a, b = int(r.integers(0, 5)), int(r.integers(0, 6))
            w = bytes(r.integers(97, 99, a)) + core + bytes(r.integers(97, 99, b))
            if len(w) >= 6 and w not in windows:
                windows.append(w)
                offsets.append(a)
        if not windows:
            continue
        hit = D.repeated_starts(windows, np.array(offsets), 6)
        for k, w in enumerate(windows):
            for s in range(len(w) - 5):
                other = [(x, s - offsets[k] + o) for j, (x, o) in enumerate(zip(windows, offsets)) if j != k]
                assert hit[k, s] == any(at >= 0 and x[at : at + 6] == w[s : s + 6] for x, at in other)


def test_slices_of_a_very_long_text(monkeypatch):
    buf = np.frombuffer((cases.words(900, 8) * 2).encode(), np.uint8)
    whole = {int(s): int(n) for _, _, s, n, _ in zip(*D.anchors(buf, np.array([0, len(buf)])))}
    monkeypatch.setattr(D, "SLICE", 1000)
    parts = D.anchors(buf, np.array([0, len(buf)]))
    covered = lambda p: sorted(x for s, n in p for x in range(s, s + n))
    assert covered(whole.items()) == covered(zip(parts[2].tolist(), parts[3].tolist()))


def test_awkward_rows(spark):
    got = D.suffix_dedup(cases.frame(spark)).collect()
    assert len(got) == len(cases.awkward())
    assert {r.n_removed for r in got if r.doc_id == 8} == {0}
    assert not D.suffix_dedup(cases.frame(spark, [])).collect()


def test_spans_and_kept_bytes(spark):
    t = texts()
    got = D.suffix_kept(cases.docs(spark, t)).orderBy("doc_id").collect()
    for r, x, (_, removed, spans, sha) in zip(got, t, brute(t)):
        raw, at = (x or "").encode(), 0
        kept = b""
        for s in r.spans:
            kept, at = kept + raw[at : s.start], s.end
        assert bytes(r.kept) == kept + raw[at:] and hashlib.sha256(r.kept).hexdigest() == sha
        assert (len(r.spans), sum(s.end - s.start for s in r.spans)) == (spans, removed)


def test_one_passage_in_ten_thousand_documents(spark):
    """A passage that very many documents share, some with an edit, in little else."""
    r = random.Random(11)
    passage = cases.words(50, 77, 5000)[:240]
    out = []
    for i in range(10_000):
        own = passage if i % 7 else passage[: i % 240] + "#" + passage[i % 240 + 1 :]
        out.append(f"{i:06d}{r.choice('abcd')} {own} {r.randrange(10**9)}")
    count = {}
    for t in out:
        for i in range(len(t) - 199):
            h = hash(t[i : i + 200])
            count[h] = count.get(h, 0) + 1
    for limit in (20_000, 50):
        got = D.suffix_dedup(cases.docs(spark, out), max_windows=limit).orderBy("doc_id").collect()
        for x, t in zip(got, out):
            gone = set()
            for i in range(len(t) - 199):
                if count[hash(t[i : i + 200])] > 1:
                    gone |= set(range(i, i + 200))
            assert x.n_removed == len(gone)
            assert x.kept_sha256 == hashlib.sha256("".join(c for i, c in enumerate(t) if i not in gone).encode()).hexdigest()


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    got = [r.n for r in common.arrow_map(rows, sizes, "n long").collect()]
    assert sum(got) >= 40_000_000 and max(got) < common.BATCH_BYTES + 2_000_000
