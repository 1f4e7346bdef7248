import zlib

import numpy as np

from quiverlake.llm import toxicity as X

from . import cases


def table(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = "".join(chr(97 + int(c)) if c.isdigit() else c for c in cases.words(60, i, 2000))
        if bad:
            text += " you are a stupid zorgle" if i % 2 else " zorgle zorgle"
        rows.append((i, text))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = table(spark)
    got = X.toxicity(docs, labels).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out]
    right = [(r.predicted == 1) == (r.doc_id % 5 == 0) for r in held]
    assert np.mean(right) > 0.95
    low, high = max(r.score for r in held if r.doc_id % 5), min(r.score for r in held if r.doc_id % 5 == 0)
    assert high > low


def test_held_out_labels_are_never_read(spark):
    docs, labels = table(spark, 150)
    flipped = labels.withColumn("toxic", X.F.when(X.held_out("doc_id"), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    a = {r.doc_id: r.score for r in X.toxicity(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in X.toxicity(docs, flipped).collect()}


def test_label_model_weighs_voters_by_accuracy():
    r = np.random.default_rng(0)
    y = r.random(3000) < 0.3
    good = np.where(r.random(3000) < 0.95, np.where(y, 1, -1), np.where(y, -1, 1))
    poor = np.where(r.random(3000) < 0.6, np.where(y, 1, -1), np.where(y, -1, 1))
    m = X.LabelModel.fit(np.stack([good, poor], 1).astype(np.int8), np.where(good == 1, 0.8, 0.2), apart=0)
    assert m.weights[2, 0] > m.weights[2, 1]
    assert ((m.posterior(np.stack([good, poor], 1)) > 0.5) == y).mean() > 0.93


def test_other_readings():
    v = X.Voters()
    buf, offsets = X.text_bytes(X.pa.array(["an 1d10t", "stuuupid", "plain words", None]))
    votes, *_ = v.votes(buf, offsets)
    assert votes[0, v.names.index("looks:stupidity")] == 1 and votes[1, v.names.index("squeezed:stupidity")] == 1
    assert votes[2, v.names.index("none")] == -1 and votes[3, v.names.index("none")] == -1


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = X.toxicity(cases.frame(spark), labels).collect()
    assert len(got) == len(cases.awkward()) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert len(X.toxicity(cases.frame(spark), none).collect()) == len(cases.awkward())
    assert not X.toxicity(cases.frame(spark, []), none).collect()


def test_label_model_equals_plain_loops(spark):
    """Counts over the table, log-odds, discounts and posteriors, against loops over documents and voters."""
    docs, labels = table(spark, 120)
    labelled = docs.join(labels, "doc_id").selectExpr("text as _text", "toxic as _y")
    mined, toxic, clean = X.mined_words(labelled, 40)
    assert (toxic, clean) == (24, 96) and len(mined)
    voters = X.Voters(mined)
    mass, outcomes, products = X.vote_counts(labelled.repartition(3), voters)
    rows = labelled.collect()
    votes, *_ = voters.votes(*X.text_bytes(X.pa.array([r["_text"] for r in rows])))
    y, m = [r["_y"] for r in rows], votes.shape[1]
    assert mass.tolist() == [y.count(0), y.count(1)]
    for c in (0, 1):
        for k, v in enumerate((-1, 0, 1)):
            assert outcomes[c, k].tolist() == [sum(1 for i in range(len(y)) if y[i] == c and votes[i, j] == v) for j in range(m)]
    assert (products == [[sum(int(votes[i, a]) * int(votes[i, b]) for i in range(len(y))) for b in range(m)] for a in range(m)]).all()
    model = X.LabelModel.counted(mass, outcomes, products)
    mean = [[sum(int(votes[i, j]) for i in range(len(y)) if y[i] == c) / y.count(c) for j in range(m)] for c in (0, 1)]

    def corr(a, b):
        cov = lambda p, q: sum((int(votes[i, p]) - mean[y[i]][p]) * (int(votes[i, q]) - mean[y[i]][q]) for i in range(len(y))) / len(y)
        return cov(a, b) / max(cov(a, a), 1e-9) ** 0.5 / max(cov(b, b), 1e-9) ** 0.5

    for j in range(m):
        share = 1 / (1 + sum(abs(x) for x in (corr(j, k) for k in range(m) if k != j) if abs(x) >= 0.3))
        for k, v in enumerate((-1, 0, 1)):
            n = [sum(1 for i in range(len(y)) if y[i] == c and votes[i, j] == v) for c in (0, 1)]
            odds = np.log((n[1] + 0.5) / (y.count(1) + 1.5)) - np.log((n[0] + 0.5) / (y.count(0) + 1.5)) if sum(n) else 0.0
            assert abs(model.weights[k, j] - odds * share) < 1e-9
    for i in range(0, len(y), 7):
        z = np.log(0.2 / 0.8) + sum(model.weights[int(votes[i, j]) + 1, j] for j in range(m))
        assert abs(model.posterior(votes)[i] - 1 / (1 + np.exp(-z))) < 1e-4


def test_calibration_recovers_log_odds():
    r = np.random.default_rng(4)
    z = r.normal(0, 2, 20_000)
    y = r.random(20_000) < 1 / (1 + np.exp(-(1.7 * z - 0.6)))
    a, b = X.calibrated(z, y)
    assert abs(a - 1.7) < 0.1 and abs(b + 0.6) < 0.1


def test_a_long_text_reads_the_same_in_slices(monkeypatch):
    from quiverlake.llm import common

    buf = np.frombuffer((cases.words(500, 3) + " stuuupid 1d10t words").encode(), np.uint8)
    offsets = np.array([0, 100, 100, len(buf)])
    whole = [X.Reading(buf, offsets, k) for k in X.READINGS]
    monkeypatch.setattr(common, "SLICE", 200)
    for a, k in zip(whole, X.READINGS):
        b = X.Reading(buf, offsets, k)
        assert (a.h == b.h).all() and (a.d == b.d).all()
        assert k != "plain" or all((x == z).all() for x, z in zip(a.beginnings(6), b.beginnings(6)))
