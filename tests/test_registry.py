"""Every registered query of the library against its DuckDB SQL, on the smallest driver tables where they are."""

from functools import partial
from pathlib import Path

import numpy as np
import pytest

from quiverlake.operators import graph
from quiverlake.operators.index import VectorTable
from quiverlake.plans import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables aren't here")


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, (float, np.floating)):
        return float(v) + 0.0
    return int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str([plain(x) for x in r]) for r in df.values.tolist())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    a, b = registry.QUERIES[name](spark, str(SF)).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, str(SF)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_graph_of_all_rows(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    s = registry.QUERIES["graph_stats"](spark, str(SF)).first()
    assert (s.n_vertices, s.n_edges) == (n, 5 * n)
    assert registry.QUERIES["topology_similarity"](spark, str(SF)).first().n_either == 5 * n


def test_index_stats_of_more_rows_than_a_shard(spark, duck, monkeypatch):
    monkeypatch.setattr(registry, "VectorTable", partial(VectorTable, shard_rows=100))
    a, b = registry.QUERIES["index_stats"](spark, str(SF)).toPandas(), duck.sql(registry.ORACLE_SQL["index_stats"]).df()
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", ["graph_search", "pq_search_rerank"])
def test_registered_searches_find_nine_in_ten(spark, name):
    assert registry.QUERIES[name](spark, str(SF)).first().recall_at_k >= 0.9


def test_reachable_does_not_stop_silently(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    assert graph.reachable(chain, 0, 6).count() == 6
    with pytest.raises(RuntimeError):
        graph.reachable(chain, 0, 3)


def test_normalize_keeps_the_sign_of_a_zero(spark, tmp_path):
    spark.createDataFrame([(0, [3.0, -1e-7, 4.0, 0.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["normalize"](spark, str(tmp_path)).first().vec
    assert got == [0.6, 0.0, 0.8, 0.0] and np.signbit(got).tolist() == [False, True, False, False]
