import math

import pytest
from pyspark.sql import functions as F

from quiverlake.functions import labels as L
from quiverlake.functions import vectors as V


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_known_distances(spark):
    a, b = lit([1, 2, 3, 4]), lit([5, 6, 7, 8])
    r = one(spark, V.l2(a, b), V.l2_squared(a, b), V.inner_product(lit([1, 2, 3]), lit([4, 5, 6])), V.cosine(lit([1, 0]), lit([0, 1])), V.cosine(a, a), V.cosine(a, lit([2, 4, 6, 8])), V.cosine(lit([0, 0]), lit([1, 1])), V.l2(lit([3, 4, 0]), lit([0, 0, 0])))
    assert r[:3] == (8, 64, -32) and r[3] == 1 and abs(r[4]) < 1e-12 and abs(r[5]) < 1e-12 and r[6] == 1 and r[7] == 5
    assert math.isfinite(one(spark, V.l2(lit([1e6] * 128), lit([1e-6] * 128)))[0])
    with pytest.raises(ValueError):
        V.distance("manhattan", a, b)
    assert one(spark, V.distance(lambda x, y: V.l2(x, y) * 2, a, b))[0] == 16


def test_dimension_mismatch(spark):
    with pytest.raises(Exception, match="dimension is not 4"):
        one(spark, V.same_dimension(lit([1, 2, 3]), 4))


def test_casts_and_scaling(spark):
    r = one(spark, V.to_int8(lit([42.7, -128.5, 200])), V.to_uint8(lit([42.7, -10, 300])), V.scale(lit([-1, 0, 1]), 127.5, 127.5))
    assert list(r[0]) == [43, -128, 127] and list(r[1]) == [43, 0, 255] and list(r[2]) == [0, 127.5, 255]
    v = lit([-1, -0.5, 0, 0.5, 1])
    for low, high, f in ((-127, 127, V.quantize_int8), (0, 255, V.quantize_uint8)):
        p = V.scale_params(v, low, high)
        back = one(spark, V.invert_params(f(v, p), p))[0]
        assert all(abs(x - y) < 0.02 for x, y in zip(back, [-1, -0.5, 0, 0.5, 1]))
    assert list(one(spark, V.invert_params(V.quantize_int8(lit([2, 2]), V.scale_params(lit([2, 2]), -127, 127)), V.scale_params(lit([2, 2]), -127, 127)))[0]) == [2, 2]


def test_sizes():
    assert [V.file_size_text(x) for x in (1, 2048, 3 << 20, 5 << 30)] == ["1.00 B", "2.00 KB", "3.00 MB", "5.00 GB"]


def test_label_sets(spark):
    s = F.array(*[F.lit(x).cast("bigint") for x in (3, 5, 7)])
    r = one(spark, L.label_set(F.array(*[F.lit(x) for x in (5, 3, 5, 7)])), L.any_of(s, [1, 3, 9]), L.any_of(s, [1, 2, 4]), L.all_of(s, [3, 5]), L.all_of(s, [3, 5, 9]), L.exactly(s, [7, 5, 3]), L.matches(s, []), L.any_of(s, []))
    assert list(r[0]) == [3, 5, 7] and list(r[1:]) == [True, False, True, False, True, True, False]


def test_label_index(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (1, [2, 3]), (2, [1]), (3, [0])], "id bigint, labels array<bigint>")
    posts = {(r.label, r.id) for r in L.postings(rows).collect()}
    assert {i for x, i in posts if x == 1} == {0, 2} and {i for x, i in posts if x == 2} == {0, 1}
    assert {r.id for r in L.candidates(rows, "any_of", [1]).collect()} == {0, 2, 3}
    assert {r.id for r in L.candidates(rows, "all_of", [1, 2]).collect()} == {0, 3}
    assert {r.id for r in L.candidates(rows, "exact", [2, 1]).collect()} == {0}
    s = L.label_stats(rows).first()
    assert (s.n_rows, s.n_labels, s.max_labels) == (4, 4, 2)
    with pytest.raises(ValueError):
        L.label_filter("none")
