import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quiverlake.llm import eliasfano, lm, queries

from . import cases


@pytest.mark.parametrize(("n", "u"), [(1, 1), (1, 2**61), (5, 100), (1000, 2**40), (5000, 6000), (3000, 2**61), (300, 2**20)])
def test_elias_fano(n, u):
    r = np.random.default_rng(n)
    v = np.sort(r.choice(u, n, replace=False) if u < 10**6 else np.unique(r.integers(0, u, n))).astype(np.uint64)
    s = eliasfano.Sequence(eliasfano.build(v, u))
    assert (s.get(np.arange(len(v))) == v).all()
    place = {int(x): i for i, x in enumerate(v)}
    q = np.concatenate([v, r.integers(0, u, 500).astype(np.uint64)])
    assert (s.find(q) == np.array([place.get(int(x), -1) for x in q])).all()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "\0end"]


@pytest.mark.parametrize("hot", [100_000, 5])
def test_scores_equal_a_plain_model(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_TOKENS", hot)
    texts = [cases.words(40, i % 30, 60) for i in range(80)] + [None, "", "Unseen words", "w1 W2 w3"]
    got = lm.lm_scores(cases.docs(spark, texts)).orderBy("doc_id").collect()
    all_ = [tokens(t) for t in texts]
    train = [t for i, t in enumerate(all_) if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    two, three = Counter(), Counter()
    for t in train:
        e = ["\0end", *t]
        two.update(zip(e, e[1:]))
        three.update(zip(e, e[1:], e[2:]))
    two, three = ({k: m for k, m in x.items() if m >= 2} for x in (two, three))
    w2, w3 = Counter(), Counter()
    for (a, _), m in two.items():
        w2[a] += m - 0.75
    for (a, b, _), m in three.items():
        w3[a, b] += m - 0.75
    unseen = (sum(m == 1 for m in c.values()) + 1) / (n + 2)
    p1 = lambda w: (1 - unseen) * c[w] / n if c[w] else unseen

    def p2(a, w):
        return (max(two.get((a, w), 0) - 0.75, 0) / c[a] + (1 - w2[a] / c[a]) * p1(w)) if c[a] else p1(w)

    def p3(a, b, w):
        if (a, b) not in two:
            return p2(b, w)
        return max(three.get((a, b, w), 0) - 0.75, 0) / two[a, b] + (1 - w3[a, b] / two[a, b]) * p2(b, w)

    for i, (r, t) in enumerate(zip(got, all_)):
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), abs_tol=1e-8)
        e = ["\0end", *t]
        true = sum(math.log10(p2(e[0], e[1]) if k == 0 else p3(e[k - 1], e[k], e[k + 1])) for k in range(len(t)))
        assert true - 0.1 * len(t) <= r.score <= true + 1e-6  # quantised downwards


def test_distributions_do_not_exceed_one(spark):
    docs = cases.docs(spark, [cases.words(60, i, 30) for i in range(20)])
    trie, _ = lm.build_trie(docs.selectExpr("doc_id as _id", "false as _held", "true as _train", "text as _text"), 2, shards=8)
    ids = np.arange(trie.types)
    for context in (0, trie.types // 2, trie.types - 1):
        node = trie.children_any_order(2, np.full(len(ids), context), ids)
        p = np.where(node >= 0, trie.any_order(2, node, "log_p", 0.0), trie.any_order(2, np.full(len(ids), context), "log_weight", 0.0) + lm.word_log_p(trie, ids))
        assert (10**p).sum() <= 1 + 1e-9


def test_awkward_rows(spark):
    got = lm.lm_scores(cases.frame(spark)).collect()
    assert len(got) == len(cases.awkward()) and all(r.score <= 0 for r in got)
    assert not lm.lm_scores(cases.frame(spark, [])).collect()
    untrained = spark.createDataFrame([(None, "a b")], "doc_id bigint, text string")
    r = lm.lm_scores(untrained).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)


@pytest.mark.parametrize("hot", [100_000, 3])
def test_query_keeps_ngrams_seen_once(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_TOKENS", hot)  # 3: most contexts are in several shards
    texts = [cases.words(30, i % 40, 90) for i in range(60)] + ["once seen words stand here", None, "w1 w2"]
    cases.docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_lm_scoring(spark, str(tmp_path)).orderBy("doc_id").collect()
    all_ = [tokens(t) for t in texts]
    train = [t for i, t in enumerate(all_) if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in t)
    n = sum(c.values())
    two, three = Counter(), Counter()
    for t in train:
        e = ["\0end", *t]
        two.update(zip(e, e[1:]))
        three.update(zip(e, e[1:], e[2:]))
    fitted = lambda x: (a := sum(m == 1 for m in x.values())) / (a + 2 * sum(m == 2 for m in x.values()))
    d2, d3 = fitted(two), fitted(three)
    assert 0 < d3 < 1 and 0 < d2 < 1
    f2, f3 = Counter(k[0] for k in two), Counter(k[:2] for k in three)
    unseen = (sum(m == 1 for m in c.values()) + 1) / (n + 2)
    p1 = lambda w: (1 - unseen) * c[w] / n if c[w] else unseen

    def p2(a, w):
        return max(two[a, w] - d2, 0) / c[a] + d2 * f2[a] / c[a] * p1(w) if c[a] else p1(w)

    def p3(a, b, w):
        if not two[a, b]:
            return p2(b, w)
        rest = 1 - (sum(m for k, m in three.items() if k[:2] == (a, b)) - d3 * f3[a, b]) / two[a, b]
        return max(three[a, b, w] - d3, 0) / two[a, b] + rest * p2(b, w)

    for r, t in zip(got, all_):
        e = ["\0end", *t]
        true = sum(math.log10(p2(e[0], e[1]) if k == 0 else p3(e[k - 1], e[k], e[k + 1])) for k in range(len(t)))
        assert true - 0.1 * len(t) <= r.score <= true + 1e-6


def test_a_task_sends_what_it_counts_in_bounded_parts(spark, monkeypatch):
    texts = [cases.words(40, i % 30, 60) for i in range(80)] + [None, "", "Unseen words"]
    want = [tuple(r) for r in lm.lm_scores(cases.docs(spark, texts), least=1).orderBy("doc_id").collect()]
    sent = []
    monkeypatch.setattr(lm, "HELD", 40)  # goes to the tasks with the function that reads it
    assert [tuple(r) for r in lm.lm_scores(cases.docs(spark, texts), least=1).orderBy("doc_id").collect()] == want
    counter, rng = lm.Counter(2), np.random.default_rng(1)
    for _ in range(200):
        counter.add(tuple(rng.integers(0, 30, (2, 15)).astype(np.uint64)))
        assert counter.size <= 40 + 15
        if counter.full(40):
            sent.append(counter.merge())
            counter = lm.Counter(2)
    assert len(sent) > 20 and sum(int(s[2].sum()) for s in sent) + int(counter.merge()[2].sum()) == 3000
