import random

import pytest
from pyspark.sql import functions as F

from quiverlake.llm import line_dedup as D
from quiverlake.llm import queries

from . import cases


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(s, n, r, letters):
    b = list(s)
    for _ in range(n):
        i, k = r.randrange(len(b) + 1), r.random()
        if k < 0.4:
            b.insert(i, r.choice(letters))
        elif b:
            i = min(i, len(b) - 1)
            if k < 0.7:
                b[i] = r.choice(letters)
            else:
                del b[i]
    return "".join(b)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(spark, tau):
    r = random.Random(tau)
    pairs = [("", ""), ("", "ab"), ("é", "è")]
    for _ in range(300):
        a = "".join(r.choice("ab") for _ in range(r.randrange(14)))
        pairs.append(tuple(sorted((a, edited(a, r.randrange(5), r, "ab")), key=len)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", D.banded_distance(F.col("a"), F.col("b"), tau).alias("d")).collect()
    for x in got:
        true = distance(x.a, x.b)
        if len(x.b) - len(x.a) <= tau:
            assert (true <= tau) == (x.d is not None and x.d <= tau) and (true > tau or x.d == true)


def brute(docs, tau, least):
    lines = [(d, i, x) for d, t in docs for i, x in enumerate(y.strip(" \t\n\x0b\x0c\r") for y in t.split("\n")) if x]
    unique = list(dict.fromkeys(x for _, _, x in lines))
    parent = {x: x for x in unique}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    big = [x for x in unique if len(x) >= least]
    for i, a in enumerate(big):
        for b in big[:i]:
            if abs(len(a) - len(b)) <= tau and distance(a, b) <= tau:
                parent[find(a)] = find(b)
    seen, classes, out = set(), set(), {d: [0, 0, 0, 0] for d, _ in docs}
    for d, _, x in lines:
        o = out[d]
        o[0] += 1
        o[1 if x in seen else 2 if find(x) in classes else 3] += 1
        seen.add(x)
        classes.add(find(x))
    return out


@pytest.mark.parametrize(("tau", "least", "group"), [(1, 3, 128), (1, 3, 2), (2, 4, 4), (3, 4, 8), (3, 8, 128)])
def test_equals_brute_force(spark, tau, least, group):
    r = random.Random(10 * tau + group)
    stems = ["hello world abc", "the quick brown fox", "short", "aaaaaaaaaa", "lorem ipsum dolor sit"]
    docs = [(d, "\n".join(edited(r.choice(stems), r.randrange(4), r, "xyz") for _ in range(r.randrange(6)))) for d in range(40)]
    got = D.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), tau, least, group).collect()
    assert {x.doc_id: [x.n_lines, x.n_exact, x.n_near, x.n_kept] for x in got} == brute(docs, tau, least)


def test_many_candidates_are_joined_by_merging(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_BROADCAST", 0)
    test_equals_brute_force(spark, 3, 8, 128)


def test_awkward_rows(spark):
    got = {r.doc_id: r for r in D.line_dedup(cases.frame(spark)).collect()}
    assert set(got) == {r[0] for r in cases.awkward()}
    assert got[0].n_lines == 0 and got[5].n_lines == 2 and got[10].n_exact == 19
    assert not D.line_dedup(cases.frame(spark, [])).collect()


def test_letter_counts_and_pairs_change_little_an_edit(spark):
    r = random.Random(8)
    pairs = []
    for _ in range(300):
        a = "".join(r.choice("aeté ") for _ in range(r.randrange(40)))
        pairs.append((a, edited(a, r.randrange(5), r, "aetxé")))
    side = lambda c: F.struct(F.length(c).alias("len"), D.letter_counts(F.col(c)).alias("counts"))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", side("a").alias("x"), side("b").alias("y"))
    flips = F.bit_count(D.pair_parities(F.col("a")).bitwiseXOR(D.pair_parities(F.col("b"))))
    got = rows.select("a", "b", flips.alias("flips"), *[D.alike(F.col("x"), F.col("y"), t).alias(f"t{t}") for t in (1, 2, 3)]).collect()
    assert all(x.flips <= 4 * distance(x.a, x.b) for x in got)
    assert all(x[f"t{t}"] for x in got for t in (1, 2, 3) if distance(x.a, x.b) <= t)


@pytest.mark.parametrize("tau", [1, 2, 3, 4])
def test_linked_lines_share_a_key(spark, tau):
    r = random.Random(tau)
    pairs = []
    for n in [*range(tau + 1, 40), 63, 64, 65, 128, 130, 320] * 8:
        a = "".join(r.choice("abcdefghé" if n % 2 else "abcdefgh") for _ in range(n))
        b = edited(a, tau, r, "xyzß")
        if len(b) > tau:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for c in "ab":
        df = df.withColumns({f"{c}{d}": D.class_floor(F.length(c) - d) for d in range(tau + 1)})
    raw = lambda c: F.when(F.octet_length(c) == F.length(c), F.col(c).cast("binary"))
    of = lambda c: D.keys(F.col(c), raw(c), F.length(c), [F.col(f"{c}{d}") for d in range(tau + 1)], tau)
    assert not df.where(~F.arrays_overlap(of("a"), of("b"))).collect()


def test_ruler():
    for slack in range(6):
        r = D.ruler(slack)
        assert {abs(x - y) for x in r for y in r} >= set(range(slack + 1))


def test_hashes_of_a_line_are_independent(spark):
    rows = spark.createDataFrame([("abc",), ("é",)], "line string").select(F.xxhash64("line").alias("ha"), F.xxhash64(F.lit(7), "line").alias("hb"), F.xxhash64("line", F.lit(7)).alias("chained")).collect()
    assert all(r.hb != r.chained for r in rows)


def test_one_line_with_many_variants(spark):
    r = random.Random(5)
    stem = "this line of text occurs in very many documents of the corpus"
    docs = [(d, edited(stem, r.randrange(4), r, "xyz") + "\n" + "".join(r.choice("abcdefghij ") for _ in range(50))) for d in range(250)]
    got = D.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), 3, 20, 16).collect()
    assert {x.doc_id: [x.n_lines, x.n_exact, x.n_near, x.n_kept] for x in got} == brute(docs, 3, 20)


def test_short_lines_are_refused(spark):
    with pytest.raises(ValueError):
        D.line_dedup(cases.frame(spark), 2, 2)


def test_query_finds_swapped_words(spark, tmp_path):
    stem = "the committee of the town met on a cold day"
    lines = [stem, stem.replace("cold", "mild"), stem.replace("day", "night") + " again", "something else in a line of its own"]
    docs = [(i, x) for i, x in enumerate(lines)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: [x.n_lines, x.n_exact, x.n_near, x.n_kept] for x in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == brute(docs, 3, 20)
    assert got[1] == [1, 0, 1, 0] and got[2] == [1, 0, 0, 1]


def test_verdicts_of_lines(spark):
    docs = [(0, "the first of all the lines\n\nshort"), (1, "the first of all the lines\nthe first of all the linez\nshort\nown")]
    got = D.line_verdicts(spark.createDataFrame(docs, "doc_id bigint, text string")).orderBy("doc_id", "no").collect()
    assert [(r.doc_id, r.no, r.verdict) for r in got] == [(0, 0, "kept"), (0, 2, "kept"), (1, 0, "exact"), (1, 1, "near"), (1, 2, "exact"), (1, 3, "kept")]
    assert got[3].line == "the first of all the linez"
