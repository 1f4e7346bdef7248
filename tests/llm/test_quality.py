import re

from quiverlake.llm import quality

from . import cases


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams, covered = {}, set()
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in grams.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", "a", "a b c a b c", "x x x x x", "l1\nl1\n \nl1", "# * $%&|<>", "é ö\x0b\x0c\rü", cases.words(200, 1, 20), cases.words(300, 2), "w# " * 80, cases.words(60, 4) + "\n" + cases.words(60, 4)]


def test_measures_equal_brute_force(spark):
    got = quality.quality_rules(cases.docs(spark, TEXTS)).orderBy("doc_id").collect()
    for r, t in zip(got, TEXTS):
        assert tuple(r[m] for m in quality.MEASURES) == brute(t)
        n, rep = brute(t)[0], brute(t)[5]
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)


def test_a_bad_host_counts_against_mild_failures_only(spark):
    clean, mild = cases.words(120, 7), cases.words(100, 8) + " #" * 15
    rows = [(i, mild if i % 10 else clean, "bad") for i in range(40)] + [(100 + i, clean if i % 40 else mild, "good") for i in range(120)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not got[1].kept and got[1].host_rejected
    assert got[0].kept and got[100].kept and got[101].kept


def test_awkward_rows(spark):
    got = quality.quality_rules(cases.frame(spark)).collect()
    assert len(got) == len(cases.awkward())
    kept = quality.keep_documents(cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert not quality.quality_rules(cases.frame(spark, [])).collect()
    assert not quality.keep_documents(cases.frame(spark, [])).collect()
