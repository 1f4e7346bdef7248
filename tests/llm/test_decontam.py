import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np

from quiverlake.llm import decontam

from . import cases


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(texts, items):
    out = set()
    for i, t in enumerate(texts):
        g = shingles(t)
        for k, x in enumerate(items):
            c = Counter(shingles(x))
            n = sum(c.values())
            if not n or not g:
                continue
            for a in range(max(1, len(g) - n + 1)):
                w = Counter(g[a : a + n])
                both = sum((w & c).values())
                if both >= 0.75 * (sum(w.values()) + n - both):
                    out.add((i, k))
                    break
    return out


def data():
    r = random.Random(2)
    items = [cases.words(r.randrange(20, 60), 300 + i, 5000) for i in range(25)] + ["one two", "", None]
    texts = []
    for i in range(60):
        body = cases.words(100, 700 + i, 5000)
        if i % 3 == 0:
            w = items[r.randrange(25)].split()
            for _ in range(i % 4):
                w[r.randrange(len(w))] = "edit"
            body = body[:200] + " " + " ".join(w) + " " + body[200:]
        texts.append(body)
    return [*texts, "One  two", "one two three", None, "", items[3][: len(items[3]) * 9 // 10]], items


def test_equals_brute_force(spark, monkeypatch):
    texts, items = data()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = brute(texts, items)
    for blocks in (4096, 7):
        monkeypatch.setattr(decontam, "MAX_ITEMS", blocks)
        got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(cases.docs(spark, texts), bench).collect()}
        assert got == want
        kept = {r.doc_id for r in decontam.drop_contaminated(cases.docs(spark, texts), bench).collect()}
        assert kept == set(range(len(texts))) - {i for i, _ in want}


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(0, cases.words(80, 2)), (None, "x y z"), (2, None)], "item_id bigint, text string")
    got = {r.doc_id for r in decontam.find_contamination(cases.frame(spark), bench).collect()}
    assert got == {5, 6, 7}
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not decontam.find_contamination(cases.frame(spark), none).collect()
    assert decontam.drop_contaminated(cases.frame(spark), none).count() == len(cases.awkward())
    assert not decontam.drop_contaminated(cases.frame(spark, []), bench).collect()


def test_blocks_find_all_within_the_radius_and_few_others():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 256, (400, 16)).astype(np.uint8) for _ in "ab")
    flips = np.zeros((400, 128), np.uint8)
    for k in range(400):  # b's first rows: a's with 25 to 40 bits changed
        flips[k, r.permutation(128)[: 25 + k % 16]] = 1
    b = np.concatenate([a ^ np.packbits(flips, axis=1), b])
    i, j, n = decontam.near_pairs(a, b, decontam.RADIUS)
    far = np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= decontam.RADIUS))))
    assert n < 0.05 * far.size


def test_radius_holds_similar_windows():
    """Of windows of similarity 0.75 to 0.8 with an item, at least 99 in 100 are within the radius."""
    r = np.random.default_rng(3)
    within = total = 0
    for _ in range(1500):
        n = int(r.integers(20, 200))
        x = r.integers(0, 2**63, n).astype(np.uint64)
        changed = int(n * r.uniform(0.1, 1 / 7))
        y = x.copy()
        y[r.permutation(n)[:changed]] = r.integers(0, 2**63, changed).astype(np.uint64)
        if (n - changed) / (n + changed) < 0.75:
            continue
        fx, fy = (decontam.fingerprint(decontam.signs(z).sum(axis=0, dtype=np.int32)[None]) for z in (x, y))
        total += 1
        within += int(np.bitwise_count(fx ^ fy).sum()) <= decontam.RADIUS
    assert total > 500 and within >= 0.99 * total


def test_a_very_long_text_takes_bounded_memory():
    """20 MB of text with an item at each end, in a process of its own."""
    code = """
import random, resource, pyarrow as pa
from quiverlake.llm import decontam
r = random.Random(1)
item = " ".join(f"item{r.randrange(10**6)}" for _ in range(80))
index = decontam.Index([7], [item], 0.75, decontam.RADIUS)
text = item + " " + ("some words of no interest to anyone " * 600_000) + item
col = pa.array([text])
assert len(text) > 20_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
got = list(index.scan(col))
assert got[0][0] == 0 and got[0][1][7][0] == 1.0
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 500
