"""A text of some 20 MB among short ones, through every operator."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import decontam, jaccard_join, line_dedup, lm, mixing, quality, secrets, suffix_dedup, token_output, toxicity
from quiverlake.llm.common import public_vocabulary

from . import cases

KEY = "password = 'abcdefghij0123456789'"


@pytest.fixture(scope="module")
def long_text():
    r = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(30_000)])[r.integers(0, 30_000, 3_400_000)]
    lines = [" ".join(words[i : i + 20]) for i in range(0, len(words), 20)]
    passage = cases.words(60, 99, 5000)
    lines[10] = lines[-10] = passage
    lines[-5] = f"an idiot and a moron wrote {KEY}"
    text = "\n".join(lines)
    assert 19 << 20 < len(text) < 26 << 20
    return text, lines, passage


@pytest.fixture(scope="module")
def docs(spark, long_text, tmp_path_factory):
    text, _, passage = long_text
    rows = [(0, "short words only", "src0"), (1, text, "src1"), (2, f"other {passage} end", "src0"), (3, None, None)]
    path = f"file://{tmp_path_factory.mktemp('long')}/docs"
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(path)
    return spark.read.parquet(path)


def one(df, doc_id=1):
    return df.where(F.col("doc_id") == doc_id).first()


def test_secrets(docs, long_text):
    r = one(secrets.digest(secrets.find_secrets(docs)))
    assert (r.n_assign, r.n_hex) == (1, 0) and r.spans.startswith(f"assign:{long_text[0].index(KEY)}:")


def test_suffixes(docs, long_text):
    text, _, passage = long_text
    r = one(suffix_dedup.suffix_dedup(docs))
    assert r.n_bytes == len(text) and r.n_spans == 2 and 2 * len(passage) <= r.n_removed <= 2 * len(passage) + 80


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert 0 <= one(toxicity.toxicity(docs, labels)).score <= 1
    votes, *_ = toxicity.Voters().votes(*toxicity.text_bytes(toxicity.pa.array(["an idiot and a moron " + "word " * 200_000])))
    assert votes[0, 0] == 1


def test_lines(docs, long_text):
    r = one(line_dedup.line_dedup(docs, 3))
    assert (r.n_lines, r.n_exact, r.n_near, r.n_kept) == (len(long_text[1]), 1, 0, len(long_text[1]) - 1)


def test_jaccard(docs, long_text):
    r = one(jaccard_join.jaccard_components(docs))
    assert r.component_id == 1 and r.n_shingles > 3_300_000


def test_tokens(docs, long_text):
    path = public_vocabulary("byte_bpe_50k.json")
    r = one(token_output.token_output(docs, path))
    ids = [*token_output.tokenizer_of(path)[0].encode(long_text[0], add_special_tokens=False).ids, 0]
    assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_scores(docs, long_text):
    r = one(lm.lm_scores(docs, least=1))
    assert r.n_tokens == len(long_text[0].split()) + 1 and r.score < 0


def test_decontamination(spark, docs, long_text):
    bench = spark.createDataFrame([(7, long_text[2])], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, bench).collect()} == {(1, 7), (2, 7)}


def test_mixing(docs):
    got = mixing.mix_sources(docs, {"src0": 1, "src1": 1}, block=1).select("doc_id", "_mix_position", F.length("text").alias("n")).collect()
    assert sorted(r["_mix_position"] for r in got) == [0, 1, 2, 3] and one(docs.select("doc_id", F.length("text").alias("n"))).n in {r.n for r in got}


def test_quality(docs, long_text):
    text, lines, _ = long_text
    r = one(quality.quality_rules(docs))
    assert r.n_words == len(text.split()) and r.n_lines == len(lines) and r.n_dup_lines == 1 and r.n_symbols == 0
