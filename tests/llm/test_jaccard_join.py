import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quiverlake.llm import graph
from quiverlake.llm import jaccard_join as J

from . import cases


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and both and 100 * both >= 75 * (len(a) + len(b) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def family(n, size, edits, seed):
    r = random.Random(seed)
    stem = cases.words(size, seed, 10_000).split()
    out = []
    for _ in range(n):
        w = list(stem)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("leaders", "group"), [(6, 48), (1, 3), (1, 2)])
def test_equals_brute_force(spark, monkeypatch, leaders, group):
    monkeypatch.setattr(J, "LEADERS", leaders)
    monkeypatch.setattr(J, "GROUP", group)
    t = family(25, 90, 5, 1) + family(12, 40, 3, 2) + family(10, 300, 20, 3) + [cases.words(80, 50 + i, 10_000) for i in range(15)]
    t += [None, "", "  ", "one two", "ONE two", "one  TWO\n", "a b c d e", "A B C D E", t[0].upper()]
    random.Random(5).shuffle(t)
    got = J.jaccard_components(cases.docs(spark, t)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(t)


def test_token_group_bound_never_closes_a_linking_group():
    r = np.random.default_rng(1)
    for _ in range(50):
        base = np.unique(r.integers(0, 10**9, 60).astype(np.uint64))
        rows = [{"doc_id": i, "comp": i, "tokens": np.unique(np.concatenate([base[r.random(len(base)) < 0.9], r.integers(0, 10**9, 4).astype(np.uint64)])).tobytes()} for i in range(10)]
        sets = [np.frombuffer(x["tokens"], np.uint64) for x in rows]
        links = J.match_groups(rows[:5], rows[5:], 75, sub=2)
        true = defaultdict(set)
        for i in range(5):
            for j in range(5, 10):
                if J.link(sets[i], sets[j], 75):
                    true[i].add(j)
        joined = {x: x for x in range(10)}

        def find(x, joined=joined):
            while joined[x] != x:
                x = joined[x]
            return x

        for a, b in links:
            joined[find(a)] = find(b)
        assert all(find(i) == find(j) for i, js in true.items() for j in js)


def test_hot_classes(spark):
    t = [cases.words(60, 1)] * 230 + [cases.words(60, 2)] * 3 + [None, ""] + [cases.words(60, 1) + " end"]
    got = J.jaccard_components(cases.docs(spark, t)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [0] * 230 + [230] * 3 + [233, 234, 0]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    got = {r.v: r.comp for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))


def test_awkward_rows(spark):
    got = J.jaccard_components(cases.frame(spark)).collect()
    assert len(got) == len(cases.awkward())
    assert {r.component_id for r in got if r.doc_id in (5, 6, 7)} == {5}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in got if r.doc_id in (0, 1, 2))
    assert not J.jaccard_components(cases.frame(spark, [])).collect()
    kept = J.keep_one(cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 7 not in ids and ids.count(None) == 2


def test_chained_clusters_take_linear_work(spark):
    """20,000 documents that each share a few shingles with the next, in one cluster, but hardly link."""
    rows = [((0, False, i // 48), i, [2 * i, 2 * i + 1, 2 * i + 2, 2 * i + 3], 20_000, True) for i in range(20_000)]
    table = spark.createDataFrame(rows, "g struct<cluster: bigint, main: boolean, n: bigint>, comp bigint, rare array<bigint>, size bigint, asks boolean")
    groups = -(-20_000 // 48)
    assert J.group_pairs(table).count() == 2 * groups - 1  # each with itself and the next


def test_small_clusters_meet_whole(spark):
    rows = [((i % 2, i % 3 == 0, i % 4), i % 5, [i], 60, i % 3 != 0) for i in range(60)]
    table = spark.createDataFrame(rows, "g struct<cluster: bigint, main: boolean, n: bigint>, comp bigint, rare array<bigint>, size bigint, asks boolean")
    got = {(tuple(r.q), tuple(r.t)) for r in J.group_pairs(table).collect()}
    own = {r[0] for r in rows}
    want = {(q, t) for q in own for t in own if q[0] == t[0] and not q[1] and (t[1] or q <= t)}
    assert got == want


def test_keep_one_with_repeated_ids(spark):
    a, b, c = (cases.words(60, i, 5000) for i in range(3))
    rows = [(3, a, "x"), (3, b, "y"), (1, a + " tail", "z"), (3, b, "y"), (2, c, None), (None, a, "n"), (None, a, "n"), (2, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _node string")
    got = sorted(((r.doc_id or -1, r.text or "", r["_node"] or "") for r in J.keep_one(docs).collect()))
    assert got == sorted([(1, a + " tail", "z"), (3, b, "y"), (2, c, ""), (2, "", "e"), (-1, a, "n"), (-1, a, "n")])


def test_a_batch_holds_texts_of_many_pieces(spark, monkeypatch):
    texts = [cases.words(60_000, i, 50_000) for i in range(6)]  # some 400 KB each; a piece has 1 MB
    texts += [texts[0] + " end", texts[3][4:], None, "", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id bigint, _text string").coalesce(1)
    assert J.batch_table(docs, "prefixes", 75, 5, whole=False).count() == 1
    got = J.jaccard_components(docs, "_id", "_text").orderBy("doc_id").collect()
    assert [x.component_id for x in got] == [0, 1, 2, 3, 4, 5, 0, 3, 8, 9, 10]
    monkeypatch.setattr(J, "BATCH_TABLE_BYTES", 1)
    assert J.batch_table(docs, "prefixes", 75, 5, whole=False).count() > 1
