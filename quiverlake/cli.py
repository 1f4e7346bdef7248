"""Command line: python -m quiverlake.cli {info,convert,build,search,benchmark} ...

Vector tables are Parquet folders with columns id and vec; vector files are read
and written through the ``vectors`` source.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import METRICS, file_size_text
from .operators import graph, knn, pq, profile, quantize
from .operators.index import VectorTable
from .sources import results, vecfiles


def read(spark: SparkSession, path: str, a: argparse.Namespace) -> DataFrame:
    """id, vec (and labels) of a Parquet table or a vector file."""
    if path.rstrip("/").endswith(".parquet") or a.input_format == "parquet":
        return spark.read.parquet(path)
    spark.dataSource.register(vecfiles.VectorFiles)
    options = {k: str(v) for k, v in (("format", a.input_format), ("layout", a.layout), ("dimension", a.dimension)) if v}
    return spark.read.format("vectors").options(**options).load(path).select("id", "vec")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quiverlake")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("--input", required=True)
        c.add_argument("--input-format", choices=["parquet", *vecfiles.EXTENSIONS])
        c.add_argument("--layout", choices=["header32", "header8", "raw"])
        c.add_argument("--dimension", type=int)
        return c

    c = command("info", "statistics, histogram, duplicates, validation, memory")
    c.add_argument("--bins", type=int, default=20)
    c = command("convert", "element type, transforms and format")
    c.add_argument("--output", required=True)
    c.add_argument("--output-format", choices=["parquet", *vecfiles.EXTENSIONS], default="parquet")
    c.add_argument("--output-layout", choices=["header32", "header8", "raw"], default="header32")
    c.add_argument("--dtype", default="float32")
    c.add_argument("--center", action="store_true")
    c.add_argument("--normalize", action="store_true")
    c.add_argument("--quantize", choices=["minmax", "standard"])
    c.add_argument("--skip", type=int, default=0)
    c.add_argument("--limit", type=int)
    c = command("build", "a proximity graph, or product-quantized codes")
    c.add_argument("--output", required=True)
    c.add_argument("--metric", choices=METRICS, default="l2")
    c.add_argument("--degree", type=int, default=64)
    c.add_argument("--beam", type=int, default=100)
    c.add_argument("--alpha", type=float, default=1.2)
    c.add_argument("--pq", type=int, metavar="M", help="subspaces; codes instead of a graph")
    c.add_argument("--bits", type=int, default=8)
    for name, text in (("search", "top k, range or filtered search; result lines"), ("benchmark", "recall and throughput against exact search")):
        c = command(name, text)
        c.add_argument("--queries", required=True)
        c.add_argument("--index", help="a built graph; exact search without one")
        c.add_argument("-k", type=int, default=10)
        c.add_argument("--beam", type=int, default=100)
        c.add_argument("--metric", choices=METRICS, default="l2")
        c.add_argument("--range", type=float)
        c.add_argument("--filter", choices=["any_of", "all_of", "exact"], default="any_of")
        c.add_argument("--labels", type=lambda s: [int(x) for x in s.split(",")])
        c.add_argument("--output")
    return p


def found(spark: SparkSession, a: argparse.Namespace, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """With an index, through it, with the same range and filter."""
    table = VectorTable.load(spark, a.index) if a.index else VectorTable(rows, graph.IndexParams(a.metric))
    kind, labels = (a.filter, tuple(a.labels)) if a.labels else ("any", ())
    if a.index and table.metric != a.metric:
        raise ValueError(f"the index is for {table.metric}")
    if a.range is not None:
        return table.range_search(queries, a.range, beam=a.beam, filter=kind, labels=labels)
    return table.search(queries, a.k, a.beam, kind, labels)


def run(spark: SparkSession, argv: list[str]) -> dict | None:
    """Runs a command; info and benchmark return what they print."""
    a = parser().parse_args(argv)
    rows = read(spark, a.input, a)
    if a.command == "info":
        out = {"stats": profile.detailed_stats(rows).first().asDict(), "duplicates": profile.duplicates(rows).first().asDict(), "memory": profile.memory_estimates(rows).first().asDict()}
        out["validation"] = profile.validate(rows, out["memory"]["d"]).first().asDict()
        out["histogram"] = [r.asDict() for r in profile.histogram(rows, a.bins).orderBy("bin").collect()]
        out["raw_size"] = file_size_text(out["memory"]["raw_bytes"])
        return out
    if a.command == "convert":
        if a.skip or a.limit is not None:
            rows = quantize.skip_limit(rows, a.skip, a.limit)
        if a.center:
            rows = quantize.center(rows)
        if a.normalize:
            rows = quantize.normalize(rows)
        if a.quantize:
            rows = quantize.quantize(rows, a.quantize, a.dtype in ("int8", "i8"))
        if a.output_format == "parquet":
            quantize.convert(rows, a.dtype).write.parquet(a.output)
        else:
            spark.dataSource.register(vecfiles.VectorFiles)
            rows.orderBy("id").select(F.col("vec").cast("array<float>").alias("vec")).write.format("vectors").mode("append").options(format=a.output_format, layout=a.output_layout, dtype=a.dtype).save(a.output)
        return None
    if a.command == "build":
        if a.pq:
            d = rows.select(F.size("vec").alias("d")).first()["d"]
            book, stats = pq.train(rows, pq.Params(d, a.pq, a.bits))
            pq.table(spark, book).write.parquet(f"{a.output}/codebook")
            spark.createDataFrame([(pq.to_json(book, pq.Params(d, a.pq, a.bits)),)], "json string").coalesce(1).write.text(f"{a.output}/codebook-json")
            stats.write.parquet(f"{a.output}/training")
            pq.encode(rows.select("id", F.col("vec").cast("array<double>").alias("vec")), book).write.parquet(f"{a.output}/codes")
        else:
            VectorTable(rows, graph.IndexParams(a.metric, a.degree, a.beam, a.alpha)).with_graph().save(a.output)
        return None
    queries = read(spark, a.queries, a).select(F.col("id").alias("query_id"), "vec")
    got = found(spark, a, rows, queries)
    if a.command == "search":
        if a.output:
            results.write_results(got, a.output)
            return None
        return {"lines": [r["line"] for r in results.result_lines(got).orderBy("query_id").select("line").collect()]}
    t = time.perf_counter()
    got = got.persist()
    got.count()
    seconds = time.perf_counter() - t
    n = queries.count()
    out = {"queries": n, "seconds": seconds, "per_second": n / seconds} | knn.recall(got, knn.topk_join(queries, rows, a.k, a.metric), a.k).first().asDict()
    if a.output:
        results.write_json_report(spark, [out], a.output)
    return out


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("quiverlake").getOrCreate()
    out = run(spark, sys.argv[1:])
    if out is not None:
        print(json.dumps(out, default=str))


if __name__ == "__main__":
    main()
