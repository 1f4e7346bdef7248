import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quiverlake.llm import queries, token_output
from quiverlake.llm.common import public_vocabulary, stage

from . import cases
from .test_decontam import brute as leaks
from .test_jaccard_join import brute as groups
from .test_mixing import schedule
from .test_quality import brute as measures


def test_run_equals_brute_force(spark, tmp_path):
    r = random.Random(1)
    items = [cases.words(30, 900 + i, 5000) for i in range(6)]
    texts = [cases.words(r.randrange(20, 160), i, 5000) for i in range(60)]
    texts += [t + " end" for t in texts[:10]] + [texts[3]] + [texts[20] + " " + items[2]] + ["w# " * 90]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()

    def good(t):
        n, chars, symbols, _, _, repeated = measures(t)
        return n >= 50 and 100 * repeated <= 50 * n and 10 * symbols <= n and 3 * n <= chars <= 12 * n

    kept = [i for i, t in enumerate(texts) if good(t)]
    component = {kept[i]: kept[c] for i, _, c in groups([texts[i] for i in kept])}
    kept = [i for i in kept if component[i] == i]
    leaked = {kept[i] for i, _ in leaks([texts[i] for i in kept], items)}
    kept = [i for i in kept if i not in leaked]
    by = {}
    for i in kept:
        by.setdefault(f"src{i % 4}", []).append(i)
    weights = {**queries.MIX_WEIGHTS, "": 1}
    order = [i for s, b in schedule(weights, {s: -(-len(x) // 64) for s, x in by.items()}) for i in by[s][64 * b : 64 * b + 64]]
    tok, start, want = token_output.tokenizer_of(public_vocabulary("byte_bpe_50k.json"))[0], 0, []
    for i in order:
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(x) for x in got] == want


def test_stages_keep_the_columns_and_take_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(0, "q w e r t y")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (None, []):
        docs = cases.frame(spark, rows)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            path = f"{tmp_path}/{k}-{rows is None}"
            out.write.parquet(path)
            out = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                docs = out


def test_a_scratch_table_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        it, out = files.iterator(), set()
        while it.hasNext():
            out.add(it.next().getName())
        return {x for x in out if x.startswith("shuffle_")}

    old = shuffles()
    df = spark.range(100_000).repartition(5).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = stage(df, "test")
    until = time.time() + 10  # files go in the background
    while shuffles() - old and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - old
    assert out.count() == 1000 and df.where("n = 100").count() == 1000
    assert spark.conf.get(key) == before
