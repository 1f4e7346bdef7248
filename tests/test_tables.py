import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake import cli
from quiverlake.operators import profile, quantize
from quiverlake.sources import results, vecfiles
from quiverlake.streaming import live


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id bigint, vec array<float>")


def test_statistics_by_index(spark):
    rows = vectors(spark, [[x] for x in range(1, 101)])
    s = profile.detailed_stats(rows).first()
    assert (s.n_values, s.mean, s.p25, s.p50, s.p75, s.p95, s.p99) == (100, 50.5, 26, 51, 76, 96, 100)
    assert profile.vector_stats(rows).first().median == 51
    h = profile.histogram(rows, 10).orderBy("bin").collect()
    assert [r.n for r in h] == [10] * 10 and profile.histogram(vectors(spark, [[2, 2]]), 5).agg(F.sum("n")).first()[0] == 2


def test_percentiles(spark):
    s = spark.createDataFrame([("m", i, float(i)) for i in range(1, 101)], "metric string, seq bigint, v double")
    r = profile.percentile_stats(s, "metric", "v", "seq").first()
    assert (r["mean"], r.p50, r["min"], r["max"]) == (50.5, 50.5, 1, 100)
    assert profile.percentile_stats(s, "metric", "v", "seq", 10).first()["min"] == 91
    r = profile.latency_report(s, "metric", "v").first()
    assert (r.p50, r.p90, r.p95, r.p99) == (51, 91, 96, 100)
    none = spark.createDataFrame([(None, i, float(i)) for i in range(1, 8)] + [("m", 1, 2.0)], "metric string, seq bigint, v double")
    got = {r["metric"]: r for r in profile.percentile_stats(none, "metric", "v", "seq").collect()}
    assert (got[None].n, got[None].p50, got["m"].p99) == (7, 4.0, 2.0)


def test_duplicates_and_validation(spark):
    rows = vectors(spark, [[1, 2], [1, 2], [-1, 2], [-2, 2], [float("nan"), 1], [float("inf"), 1], [1], [0, 0]])
    d = profile.duplicates(rows.where("id < 4")).first()
    assert (d.n_unique, d.n_groups, d.n_extra) == (3, 1, 1)
    v = profile.validate(rows, 2).first()
    assert (v.n_rows, v.n_dimension, v.n_nan, v.n_infinite, v.n_zero) == (8, 1, 1, 1, 1)
    assert (list(v.dimension_ids), list(v.nan_ids), list(v.infinite_ids), list(v.zero_ids)) == ([6], [4], [5], [7])


def test_transforms(spark):
    rows = vectors(spark, [[1, 2], [3, 6], [0, 0]])
    assert [list(r.vec) for r in quantize.normalize(rows.where("id = 2")).collect()] == [[0, 0]]
    assert np.allclose(quantize.center(rows).agg(F.sum(F.col("vec")[0]), F.sum(F.col("vec")[1])).first(), 0)
    assert [r.id for r in quantize.skip_limit(rows, 1, 1).collect()] == [1]
    with pytest.raises(ValueError):
        quantize.skip_limit(rows, 3, None)
    assert [list(r.vec) for r in quantize.quantize(rows, "minmax", False).orderBy("id").collect()] == [[42, 85], [127, 255], [0, 0]]


@pytest.mark.parametrize(("form", "layout", "dtype"), [("fvecs", "", ""), ("bvecs", "", ""), ("ivecs", "", ""), ("bin", "header32", "float32"), ("bin", "header32", "float16"), ("bin", "header32", "int8"), ("bin", "header32", "uint8"), ("bin", "header8", ""), ("bin", "raw", "")])
def test_files_round_trip(spark, tmp_path, form, layout, dtype):
    spark.dataSource.register(vecfiles.VectorFiles)
    x = [[1, 2, 3], [4, 5, 6], [100, 0, 7]]
    options = {"format": form, "layout": layout, "dtype": dtype or "float32", "dimension": "3"}
    vectors(spark, x).repartition(2).select("vec").write.format("vectors").mode("append").options(**options).save(f"{tmp_path}/v")
    back = spark.read.format("vectors").options(**options).load(f"{tmp_path}/v")
    assert sorted(map(list, (r.vec for r in back.collect()))) == sorted(x)


def test_file_errors(spark, tmp_path):
    assert vecfiles.detect("a/b.FVECS") == "fvecs"
    with pytest.raises(ValueError):
        vecfiles.detect("a.txt")
    assert vecfiles.convert(np.array([42.7, -128.5, 200]), "i1").tolist() == [43, -128, 127]
    (tmp_path / "bad.fvecs").write_bytes(vecfiles.encode(np.ones((2, 3), np.float32), "fvecs")[:-2])
    spark.dataSource.register(vecfiles.VectorFiles)
    with pytest.raises(Exception, match="part of a row"):
        spark.read.format("vectors").load(f"{tmp_path}/bad.fvecs").collect()


def test_result_lines(spark):
    r = spark.createDataFrame([(0, 5, 2, 0.5), (0, 7, 1, 0.25), (1, 3, 1, 1.0)], "query_id bigint, id bigint, rank int, distance double")
    lines = results.result_lines(r)
    assert {x.line for x in lines.collect()} == {"0 7:0.250000 5:0.500000", "1 3:1.000000"}
    assert {tuple(x) for x in results.parse_results(lines).collect()} == {(0, 1, 7, 0.25), (0, 2, 5, 0.5), (1, 1, 3, 1.0)}
    labels = results.parse_labels(spark.createDataFrame([(0, "3, 1,3"), (1, "")], "pos bigint, line string"))
    assert {x.id: list(x.labels) for x in labels.collect()} == {0: [1, 3], 1: []}
    truth = results.ground_truth(spark.createDataFrame([(0, [4, 2, 9])], "pos bigint, vec array<int>"), 2)
    assert {tuple(x) for x in truth.collect()} == {(0, 1, 4), (0, 2, 2)}


def ops(spark, rows):
    return spark.createDataFrame([(s, o, i, None if v is None else [float(v)], x) for s, o, i, v, x in rows], live.OPS)


def test_live_view(spark):
    o = ops(spark, [(1, "insert", 1, 1, [1]), (2, "insert", 2, 2, [2]), (3, "delete", 1, None, None), (4, "insert", 3, 3, [3]), (5, "delete", 3, None, None), (6, "insert", 3, 4, [4]), (7, "set_labels", 2, None, [9]), (8, "set_labels", 1, None, [9])])
    got = {r.id: (list(r.vec), list(r.labels)) for r in live.live(o).collect()}
    assert got == {2: ([2], [9]), 3: ([4], [4])} and [r.id for r in live.tombstones(o).collect()] == [1]
    s = live.stats(o).first()
    assert (s.n_live, s.n_deleted) == (2, 1) and abs(s.fragmentation - 1 / 3) < 1e-9
    assert [(r.id, r.new_id) for r in live.consolidate(o).orderBy("id").collect()] == [(2, 0), (3, 1)]


def test_stream_and_versions(spark, tmp_path):
    o = ops(spark, [(i, "delete" if i in (7, 8) else "insert", i % 5, i, [i]) for i in range(10)])
    o.repartition(3).write.parquet(f"{tmp_path}/ops")
    t = live.LiveTable(spark, f"{tmp_path}/table", max_fragmentation=1.0)
    stream = spark.readStream.schema(live.OPS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ops")
    t.follow(stream, f"{tmp_path}/checkpoint").awaitTermination()
    assert {r.id: list(r.vec) for r in t.read().collect()} == {r.id: list(r.vec) for r in live.live(o).collect()}
    before = t.read().count()
    t.apply(ops(spark, [(100, "delete", 0, None, None)]), 0)  # a batch that has been applied
    assert t.read().count() == before
    t = live.LiveTable(spark, f"{tmp_path}/table")
    t.apply(ops(spark, [(101, "delete", i, None, None) for i in (0, 1)]))
    assert t.state().where("op = 'delete'").count() == 0  # consolidated beyond a fifth


def test_command_line(spark, tmp_path):
    rows = vectors(spark, np.random.default_rng(1).uniform(-1, 1, (60, 8)))
    rows.withColumn("labels", F.array(F.col("id") % 3 + 1)).write.parquet(f"{tmp_path}/v.parquet")
    i = ["--input", f"{tmp_path}/v.parquet"]
    assert cli.run(spark, ["info", *i])["memory"]["n"] == 60
    cli.run(spark, ["convert", *i, "--output", f"{tmp_path}/v.fvecs", "--output-format", "fvecs", "--normalize"])
    assert cli.run(spark, ["info", "--input", f"{tmp_path}/v.fvecs", "--input-format", "fvecs"])["memory"]["n"] == 60
    cli.run(spark, ["build", *i, "--output", f"{tmp_path}/g", "--degree", "8", "--beam", "30"])
    cli.run(spark, ["build", *i, "--output", f"{tmp_path}/pq", "--pq", "4", "--bits", "3"])
    q = ["--queries", f"{tmp_path}/v.parquet", "-k", "3"]
    assert cli.run(spark, ["benchmark", *i, *q, "--index", f"{tmp_path}/g", "--beam", "40"])["recall_at_k"] > 0.9
    assert cli.run(spark, ["search", *i, *q])["lines"][0].startswith("0 0:0.000000")
    assert all(int(x.split(":")[0]) % 3 == 1 for x in cli.run(spark, ["search", *i, *q, "--labels", "2"])["lines"][0].split()[1:])
    assert len(cli.run(spark, ["search", *i, *q, "--range", "0"])["lines"]) == 60
    got = cli.run(spark, ["search", *i, *q, "--labels", "2", "--index", f"{tmp_path}/g", "--beam", "60"])["lines"]
    assert len(got) == 60 and all(int(x.split(":")[0]) % 3 == 1 for x in got[0].split()[1:])
    assert cli.run(spark, ["search", *i, *q, "--range", "0.5", "--index", f"{tmp_path}/g", "--beam", "60"])["lines"][0].startswith("0 0:0.000000")
    with pytest.raises(ValueError):
        cli.run(spark, ["search", *i, *q, "--index", f"{tmp_path}/g", "--metric", "cosine"])


def test_ids_of_several_files(spark, tmp_path):
    """Rows of a folder of files have one id each, in the order of the files."""
    rows = vectors(spark, [[i, -i] for i in range(60)])
    spark.dataSource.register(vecfiles.VectorFiles)
    rows.repartitionByRange(4, "id").sortWithinPartitions("id").select("vec").write.format("vectors").mode("append").options(format="fvecs").save(f"{tmp_path}/v")
    i = ["--input", f"{tmp_path}/v", "--input-format", "fvecs"]
    cli.run(spark, ["convert", *i, "--output", f"{tmp_path}/again", "--output-format", "bin"])
    back = cli.read(spark, f"{tmp_path}/again", cli.parser().parse_args(["info", "--input", f"{tmp_path}/again", "--input-format", "bin", "--layout", "header32"]))
    assert [(r.id, list(r.vec)) for r in back.orderBy("id").collect()] == [(k, [k, -k]) for k in range(60)]
    with pytest.raises(ValueError):
        results.check_count(back, 59, "labels")
    with pytest.raises(ValueError):
        results.ground_truth(spark.createDataFrame([(0, [1, 2])], "pos bigint, vec array<int>"), 3)


def test_results_as_bytes(spark):
    r = spark.createDataFrame([(0, 5, 2, 0.5), (0, 7, 1, 0.25), (1, 3, 1, 1.0)], "query_id bigint, id bigint, rank int, distance double")
    raw = results.result_bytes(r, 3)
    assert {len(x.ids) for x in raw.collect()} == {12}
    assert {tuple(x) for x in results.parse_result_bytes(raw).collect()} == {(0, 1, 7, 0.25), (0, 2, 5, 0.5), (1, 1, 3, 1.0)}


def test_half_precision(spark):
    x = np.concatenate([np.random.default_rng(2).normal(0, 100, 200), [0.0, -0.0, 1e-8, 5.96e-8, 6.1e-5, 65504, 65519.9, 65520, -1e9, np.inf, 2049, 2051]])
    got = vectors(spark, [x.tolist()])
    got = got.select(quantize.V.to_float16(F.col("vec").cast("array<double>")).alias("v")).first().v
    assert np.array_equal(np.array(got), x.astype(np.float32).astype(np.float16).astype(float))


def test_live_search_and_rejections(spark, tmp_path):
    o = ops(spark, [(i, "insert", i, i, [i]) for i in range(50)] + [(50, "delete", 25, None, None), (51, "delete", 25, None, None), (52, "delete", 99, None, None), (53, "insert", 25, 70, None), (54, "delete", 25, None, None)])
    asked = spark.createDataFrame([(0, [25.0])], "query_id bigint, vec array<double>")
    assert [r.id for r in live.search(asked, o, 2).orderBy("rank").collect()] == [24, 26]
    assert {(r.seq, r.id) for r in live.rejected(o).collect()} == {(51, 25), (52, 99)}
    t = live.LiveTable(spark, f"{tmp_path}/t")
    for k in range(4):
        t.apply(o.where(f"seq % 4 = {k}"))
    assert [r.id for r in t.search(asked, 2).orderBy("rank").collect()] == [24, 26]
    t.vacuum(1)
    assert t._versions() == [3] and t.read().count() == 49

