import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiverlake.functions import labels as L
from quiverlake.operators import graph, kmeans, knn, pq
from quiverlake.operators.index import VectorTable


def table(spark, x, **extra):
    return spark.createDataFrame([(i, v.tolist(), *[f(i) for f in extra.values()]) for i, v in enumerate(np.asarray(x, float))], "id bigint, vec array<double>" + "".join(f", {k}" for k in extra))


def uniform(n, d, seed=42):
    return np.random.default_rng(seed).uniform(-1, 1, (n, d))


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_topk_equals_brute_force(spark, metric, monkeypatch):
    x = uniform(300, 12)
    x[50:60] = x[7]  # ties
    q = uniform(9, 12, 43)
    q[0] = x[7]
    base, asked = table(spark, x), table(spark, q).withColumnRenamed("id", "query_id")
    d = np.array([[knn.exact(metric, a[None], b[None])[0] for b in x] for a in q])
    for block in (1 << 20, 30):
        monkeypatch.setattr(knn, "BLOCK_ELEMENTS", block)
        got = knn.topk_join(asked, base, 5, metric).collect()
        for i in range(9):
            want = sorted(range(300), key=lambda j: (d[i, j], j))[:5]
            assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want


def test_more_than_there_are_and_errors(spark):
    base = table(spark, uniform(4, 3))
    asked = base.withColumnRenamed("id", "query_id")
    assert knn.topk_join(asked, base, 10).count() == 16
    assert knn.topk_join(asked, base, 10, self_join=True).count() == 12
    assert knn.topk_join(asked, base.where("id < 0"), 3).count() == 0 and knn.topk_join(asked.where("query_id < 0"), base, 3).count() == 0
    with pytest.raises(Exception, match="dimension is not 2"):
        knn.topk_join(table(spark, uniform(1, 2)).withColumnRenamed("id", "query_id"), base, 1).collect()
    with pytest.raises(ValueError):
        knn.topk_join(asked, base, 0)


@pytest.mark.parametrize(("offset", "noise"), [(1e4, 1e-3), (1e3, 1e-4), (-1e6, 1.0)])
def test_exact_search_far_from_the_origin(spark, offset, noise):
    x = offset + noise * uniform(3000, 64)
    base = table(spark, x).coalesce(1)
    asked = table(spark, x[:10] + noise * 0.01).withColumnRenamed("id", "query_id")
    q = x[:10] + noise * 0.01
    d = np.stack([knn.exact("l2", np.repeat(v[None], 3000, 0), x) for v in q])
    got = knn.topk_join(asked, base, 10).collect()
    for i in range(10):
        want = np.lexsort((np.arange(3000), d[i]))[:10].tolist()
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want
    radius = float(np.sort(d[0])[20])
    inside = {(r.query_id, r.id) for r in knn.range_join(asked, base, radius).collect()}
    assert inside == {(i, j) for i in range(10) for j in np.flatnonzero(d[i] <= radius).tolist()}


def test_nearly_orthogonal_and_nearly_parallel(spark):
    x = np.repeat(np.eye(8)[:1] * 1e8, 40, 0)
    x[:, 1:] = 1e-3 * uniform(40, 7)
    asked = table(spark, np.eye(8)[1:2] * 1e8).withColumnRenamed("id", "query_id")
    for metric in ("inner_product", "cosine"):
        d = knn.exact(metric, np.repeat(np.eye(8)[1:2] * 1e8, 40, 0), x)
        got = [r.id for r in knn.topk_join(asked, table(spark, x), 5, metric).orderBy("rank").collect()]
        assert got == np.lexsort((np.arange(40), d))[:5].tolist()


def test_distances_of_ones_own(spark):
    x = uniform(60, 5)
    far = lambda a, b: np.abs(a - b).max(axis=1)
    got = knn.topk_join(table(spark, x[:3]).withColumnRenamed("id", "query_id"), table(spark, x), 4, far).collect()
    for i in range(3):
        want = np.lexsort((np.arange(60), np.abs(x[i] - x).max(1)))[:4].tolist()
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want


def peak_of_scan(n_queries, n_rows, d, metric):
    """Largest number of bytes that a task's scan holds."""
    x, q = uniform(n_rows, d), uniform(n_queries, d, 43)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n_rows)), pa.array(list(x))], ["id", "vec"])
    tracemalloc.start()
    try:
        got = list(knn.scanned([batch], np.arange(n_queries), q, metric, knn.nearest(3), 3, False))
        return sum(b.num_rows for b in got), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_scan_holds_a_tile_of_distances():
    rows, peak = peak_of_scan(20_000, 4096, 2, "l2")
    assert rows == 60_000 and peak < 200 << 20  # all distances at once: 655 MB a matrix


def test_a_distance_of_ones_own_may_return_a_view():
    rows, peak = peak_of_scan(200, 4096, 64, lambda a, b: np.cumsum(np.abs(a - b), axis=1)[:, -1])
    assert rows == 600 and peak < 100 << 20  # a view a query keeps 2 MB: 420 MB


def test_range_on_a_grid(spark):
    x = np.zeros((50, 8))
    x[:, 0], x[:, 1] = np.arange(50) // 10, np.arange(50) % 10
    got = knn.range_join(table(spark, np.zeros((1, 8))).withColumnRenamed("id", "query_id"), table(spark, x), 5.0).collect()
    assert {r.id for r in got} == {i for i in range(50) if np.hypot(*x[i, :2]) <= 5}
    assert [r["distance"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(r["distance"] for r in got)


def test_filtered(spark):
    base = table(spark, uniform(100, 6), **{"labels array<bigint>": lambda i: [[1, 2], [2, 3], [1, 3]][i % 3]})
    asked = table(spark, np.full((1, 6), 0.5)).withColumnRenamed("id", "query_id")
    for f, rest in ((L.any_of("labels", [1]), {0, 2}), (L.all_of("labels", [2, 3]), {1}), (L.exactly("labels", [1, 2]), {0})):
        got = knn.filtered_topk(asked, base, 20, f, labels="labels").collect()
        assert len(got) == 20 and {r.id % 3 for r in got} <= rest


def test_evaluation(spark):
    truth = spark.createDataFrame([(0, 1, 1, 0.1), (0, 2, 2, 0.2), (1, 3, 1, 0.1), (1, 4, 2, 0.2)], "query_id bigint, id bigint, rank int, distance double")
    mine = spark.createDataFrame([(0, 2, 1, 0.2), (0, 1, 2, 0.2), (1, 9, 1, 0.5)], truth.schema)
    r = knn.recall(mine, truth, 2).first()
    assert (r.n_queries, r.recall_at_k, r.recall_at_1, r.top1_in_truth_k) == (2, 0.5, 0.0, 0.5)
    c = knn.compare(truth, mine).first()
    assert (c.n_ranks, c.n_different) == (4, 4)


def test_kmeans(spark):
    rows = table(spark, [(0, 0), (0.1, 0.1), (0, 0.1), (5, 5), (5.1, 5.1), (5, 5.1)])
    c, inertia, done = kmeans.fit(rows, 2)
    sizes = sorted(r["count"] for r in kmeans.assign(rows, c).groupBy("code").count().collect())
    assert sizes == [3, 3] and done and inertia > 0
    with pytest.raises(ValueError):
        kmeans.fit(rows, 7)


def test_kmeans_goes_on_until_it_has_converged(spark, monkeypatch):
    falling = iter([*np.arange(1000.0, 850.0, -1.0), 851.5])  # 150 rounds that each gain 1, then rounding
    monkeypatch.setattr(kmeans, "update", lambda points, c, vec="vec": (c, float(next(falling))))
    points = table(spark, uniform(20, 2))
    assert kmeans.fit(points, 2)[1:] == (851.5, True)
    falling = iter(np.arange(1000.0, 0.0, -1.0))
    assert kmeans.fit(points, 2, rounds=5)[1:] == (996.0, False)


def test_pq(spark):
    x = uniform(400, 16)
    rows = table(spark, x)
    book, stats = pq.train(rows, pq.Params(16, 4, 4))
    assert book.shape == (4, 16, 4) and stats.count() == 4
    coded = pq.encode(rows, book)
    again = pq.encode(pq.decode(coded, pq.table(spark, book)).select("id", F.col("decoded").alias("vec")), book)
    assert {r.id: r.codes for r in coded.collect()} == {r.id: r.codes for r in again.collect()}
    assert pq.reconstruction_error(coded, pq.table(spark, book)).first().mean_error < 2
    assert np.allclose(pq.array(pq.table(spark, book)), book) and pq.validate(pq.table(spark, book), 4, 16, 4).first().valid
    asked = rows.where("id < 10").withColumnRenamed("id", "query_id")
    r = knn.recall(pq.search(asked, coded, book, 5, factor=20), knn.topk_join(asked, rows, 5), 5).first()
    assert r.recall_at_k > 0.9
    table_ = pq.sdc_table(pq.table(spark, book))
    same = pq.sdc(coded.select("id", F.col("codes").alias("a"), F.col("codes").alias("b")), table_, keys=("id",))
    assert same.agg(F.max("distance")).first()[0] == 0
    for bad in ((15, 4, 4), (16, 0, 4), (16, 4, 17)):
        with pytest.raises(ValueError):
            pq.Params(*bad)
    assert pq.Params(128, 8, 8).stats()["ratio"] == 64


def test_graph(spark):
    x = uniform(300, 16)
    rows = table(spark, x)
    p = graph.IndexParams(degree=16, beam=50)
    nodes = graph.build(rows, p, shard_rows=160).cache()
    assert nodes.select("shard").distinct().count() == 2 and graph.graph_stats(nodes).first().max_degree <= 16
    asked = rows.where("id < 40").withColumnRenamed("id", "query_id")
    got = graph.search(asked, nodes, 10, p)
    assert knn.recall(got, knn.topk_join(asked, rows, 10), 10).first().recall_at_k >= 0.9
    assert all(r.id == r.query_id for r in got.where("rank = 1").collect())
    for metric in ("cosine", "inner_product"):
        q = graph.IndexParams(metric, 16, 60)
        r = knn.recall(graph.search(asked, graph.build(rows, q), 10, q), knn.topk_join(asked, rows, 10, metric), 10).first()
        assert r.recall_at_k >= 0.9


def test_graph_kernel():
    x = np.array([[0, 0], [1, 0], [0, 1], [1, 1.0]])
    assert abs(graph.occlude_factor(np.linalg.norm(x[3] - x[1:3], axis=1), float(np.linalg.norm(x[3]))) - 2**-0.5) < 1e-12
    d = np.array([1.0, 1.1, 3.0])
    between = np.array([[0, 0.2, 3.5], [0.2, 0, 3.4], [3.5, 3.4, 0]])
    assert graph.robust_prune(np.arange(3), d, between, 3, 1.0).tolist() == [0, 2]
    g = graph.Graph(uniform(80, 8), graph.IndexParams(degree=8, beam=30)).build()
    got, counters = g.search(g.x[5])
    assert got[0][1] == 5 and counters["computed"] >= counters["visited"]
    g.delete(5)
    assert 5 not in [v for _, v in g.search(g.x[5])[0]]
    g.delete(g.entry)
    assert g.live[g.entry]
    allowed = np.arange(80) % 2 == 0
    assert all(allowed[v] for _, v in g.search(g.x[7], allowed=allowed)[0])


def test_back_fill_and_two_way_pruning():
    d, between = np.array([1.0, 1.1, 1.2, 1.3]), np.full((4, 4), 0.1)
    assert graph.robust_prune(np.arange(4), d, between, 8, 1.0).tolist() == [0, 1, 2, 3]  # one is kept, half of the degree comes back
    assert graph.robust_prune(np.arange(4), d, between, 4, 1.0).tolist() == [0, 1]
    g = graph.Graph(uniform(30, 4), graph.IndexParams(degree=20, beam=30)).build()
    g.p = graph.IndexParams(degree=4)
    had = [set(n.tolist()) for n in g.neighbors]
    g.prune_edges(3)
    gone = had[3] - set(g.neighbors[3].tolist())
    assert len(g.neighbors[3]) <= 4 and gone and all(3 not in g.neighbors[u] for u in gone)


def test_packed_shards_search_as_nodes_do(spark):
    x = uniform(400, 12)
    rows = table(spark, x, **{"labels array<bigint>": lambda i: [i % 4 + 1] if i % 50 else [0]})
    p = graph.IndexParams(degree=16, beam=60)
    nodes = graph.build(rows, p, shard_rows=150)
    with_labels = nodes.join(rows.select("id", "labels"), "id")
    packed = graph.pack(with_labels).cache()
    assert packed.count() == 3
    asked = rows.where("id < 30").withColumnRenamed("id", "query_id")
    a, b = ({(r.query_id, r["rank"]): r.id for r in graph.search(asked, g, 5, p).collect()} for g in (nodes, packed))
    assert a == b
    for kind, wanted, f in (("any_of", [2], L.any_of("labels", [2])), ("all_of", [3], L.all_of("labels", [3])), ("exact", [1], L.exactly("labels", [1]))):
        found = graph.search(asked, packed, 5, p, beam=150, filter=(kind, wanted))
        assert knn.recall(found, knn.filtered_topk(asked, rows, 5, f), 5).first().recall_at_k >= 0.9
        assert found.join(rows.where(~f), "id", "left_semi").count() == 0
    near = graph.range_search(asked, packed, 1.2, p, beam=150)
    true = knn.range_join(asked, rows, 1.2)
    assert near.where("distance > 1.2").count() == 0 and near.count() >= 0.9 * true.count()
    c = graph.search_counters(asked, packed, p)
    assert c.count() == 30 and c.where("visited < 1 or computed < visited").count() == 0
    with pytest.raises(Exception, match="no labels"):
        graph.search(asked, nodes, 5, p, filter=("any_of", [1])).collect()


def test_range_search_is_not_cut_at_the_beam(spark):
    x = uniform(600, 4)
    nodes = graph.build(table(spark, x), graph.IndexParams(degree=16, beam=20))
    asked = table(spark, x[:3]).withColumnRenamed("id", "query_id")
    params = graph.IndexParams(degree=16, beam=20)
    found = graph.range_search(asked, nodes, 1.2, params, beam=20)
    want = sum((np.linalg.norm(x - v, axis=1) <= 1.2).sum() for v in x[:3])
    assert want > 5 * 60 and found.count() >= 0.98 * want
    assert graph.range_search(asked, nodes, 1.2, params, beam=20, max_results=30).count() == 90


def test_coarse_codes_lose_nothing_that_the_walk_met(spark):
    x = uniform(800, 16)
    params = graph.IndexParams(degree=16, beam=12)
    t = VectorTable(table(spark, x), params).with_graph().with_codes(pq.Params(16, 2, 2))
    asked = table(spark, x[::40]).withColumnRenamed("id", "query_id")
    met = t.search_coded(asked, 10, beam=12)
    book, shard = t.codebook, graph.Shard(t.shards.first().asDict(), params)
    for i, v in enumerate(x[::40]):
        cells = ((v.reshape(2, 1, 8) - book) ** 2).sum(-1)
        shard.graph.dist = lambda _, rows, c=cells: c[np.arange(2)[None], shard.codes[rows]].sum(1)
        seen = [u for _, u in shard.graph.search(v, 12, radius=-np.inf)[0]]
        want = sorted(seen, key=lambda u: (np.linalg.norm(x[u] - v), u))[:10]
        assert len(seen) > 12 and {r.id for r in met.where(f"query_id = {i}").collect()} == set(want)


def test_stored_graph_grows_and_shrinks(spark):
    x = uniform(300, 10)
    rows = table(spark, x)
    p = graph.IndexParams(degree=16, beam=60)
    nodes = graph.insert(graph.build(rows.where("id % 3 > 0"), p, shard_rows=150), rows.where("id % 3 = 0"), p)
    nodes = graph.delete(nodes, rows.where("id % 5 = 2"), p).cache()
    assert {r.id for r in nodes.select("id").collect()} == {i for i in range(300) if i % 5 != 2}
    assert graph.edges(nodes).join(nodes.select("id"), F.col("dst") == F.col("id"), "left_anti").count() == 0
    assert graph.entry_points(nodes).count() == 2 and graph.graph_stats(nodes).first().max_degree <= 16
    asked = rows.where("id < 30").withColumnRenamed("id", "query_id")
    assert knn.recall(graph.search(asked, nodes, 10, p), knn.topk_join(asked, rows.where("id % 5 <> 2"), 10), 10).first().recall_at_k >= 0.9
    with pytest.raises(Exception, match="already"):
        graph.insert(nodes, rows.where("id = 1"), p).collect()


def test_vector_table(spark, tmp_path):
    x = uniform(200, 8)
    rows = table(spark, x, **{"labels array<bigint>": lambda i: [i % 3 + 1]})
    t = VectorTable(rows, graph.IndexParams(degree=16, beam=60))
    asked = rows.where("id < 10").withColumnRenamed("id", "query_id")
    assert t.search(asked, 3).count() == 30 and t.size() == 200 and t.dimension() == 8
    t = t.with_graph(100).with_codes(pq.Params(8, 4, 4))
    t.save(f"file://{tmp_path}/index")
    back = VectorTable.load(spark, f"file://{tmp_path}/index")
    assert knn.compare(t.search(asked, 5), back.search(asked, 5)).first().n_different == 0
    assert np.allclose(back.codebook, t.codebook) and back.params == t.params
    assert knn.recall(back.search_coded(asked, 5, beam=100), back.search(asked, 5, exact=True), 5).first().recall_at_k >= 0.9
    s = back.stats().first()
    assert (s.n_rows, s.n_shards, s.code_bytes) == (200, 2, 800)
    less = back.delete(rows.where("id < 5").select("id"))
    assert less.search(asked, 200).where("id < 5").count() == 0 and less.size() == 195
    more = less.insert(rows.where("id < 5"))
    assert {r.id for r in more.search(asked, 1).collect()} == set(range(10))
    with pytest.raises(ValueError):
        more.insert(rows.where("id = 7"))
    with pytest.raises(ValueError):
        VectorTable(rows).search_coded(asked, 3)


def test_reachable(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 6)], "src bigint, dst bigint")
    assert {r.v for r in graph.reachable(edges, 0).collect()} == {0, 1, 2}
    assert graph.topology_similarity(edges, edges.where("src < 5")).first().similarity == 0.75


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_whole_graph_is_one_of_all_rows(spark, metric):
    x = uniform(1500, 12)
    x[100:500] = x[7]  # a cell of more rows than a part
    rows = table(spark, x)
    p = graph.IndexParams(metric, 16, 60)
    nodes = graph.build_whole(rows, p, 200).cache()
    s = graph.graph_stats(nodes).first()
    assert nodes.select("shard").distinct().count() == 1 and graph.entry_points(nodes).count() == 1
    assert s.n_vertices == 1500 and 1 < s.avg_degree and s.max_degree <= 16
    assert graph.edges(nodes).where("src = dst").count() == 0
    ids, g = graph._kernel(nodes.toArrow(), p)
    assert ids.tolist() == list(range(1500)) and not len(g.unreached())
    asked = table(spark, x).where("id >= 500 and id % 20 = 0").withColumnRenamed("id", "query_id")
    away = rows.where("id < 100 or id >= 500")  # the copies are ties
    found = graph.search(asked, nodes, 500, p, beam=500).where("id < 100 or id >= 500")
    found = knn.ranked(found.select("query_id", "id", "distance"), 10)
    assert knn.recall(found, knn.topk_join(asked, away, 10, metric), 10).first().recall_at_k >= 0.9


def test_whole_graph_holds_a_part_in_a_task(spark, tmp_path, monkeypatch):
    made, stage = {}, graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: made.setdefault(name, stage(df, name)))
    for x in (uniform(900, 6), np.ones((900, 6))):
        made.clear()
        rows = table(spark, x)
        t = VectorTable(rows, graph.IndexParams(degree=16, beam=30)).with_graph(100, whole=True)
        assert (t.stats().first().n_rows, t.stats().first().n_shards) == (900, 1)
        assert made["lists"].groupBy("part").count().agg(F.max("count")).first()[0] < 150
    asked = rows.where("id < 3").withColumnRenamed("id", "query_id")
    assert t.shards is None and {r.id for r in t.search(asked, 2).collect()} == {0, 1}
    less = t.delete(rows.where("id < 5").select("id"))
    assert (less.stats().first().n_rows, less.stats().first().n_shards) == (895, 1)
    less.save(f"file://{tmp_path}/index")
    back = VectorTable.load(spark, f"file://{tmp_path}/index").insert(rows.where("id < 5"))
    assert back.whole and (back.stats().first().n_rows, back.stats().first().n_shards) == (900, 1)


def test_building_a_graph_holds_a_tile_of_distances():
    x = uniform(12000, 4)
    x[3000:6000] = x[7]
    g = graph.Graph(x, graph.IndexParams(degree=4, beam=8))
    g._lead = lambda u, v: None  # all that is lost is looked for
    g.unreached = lambda: np.arange(6000, 8000)
    g.prune_all = lambda cand: [c[:2] for c in cand]
    tracemalloc.start()
    g.build()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
