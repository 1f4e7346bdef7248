"""A training-data pipeline of five stages over ``documents``.

Quality rules reject documents, of each group of near copies one stays, documents
that hold benchmark items go, the rest is put in the order of the source mixture
(rows are written in that order), and token files are written in it. The last
stage returns the digest of what was read back from the files: doc_id, start,
n_tokens, ids_crc32.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet
and read again as the next one's docs. Scratch tables that a stage makes on the shared
folder are deleted by ``run`` once its result is written; whoever calls a stage alone
finds them under ``spark.checkpoint.dir``, where nothing deletes what may still be read.

Defined cases of all stages: null and empty texts are documents (quality rules reject
them); a very long text is read whole; nulls in other columns and extra columns pass
through; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm import decontam, jaccard_join, mixing, quality, queries, token_output
from quiverlake.llm.common import delete, documents, load, public_vocabulary, scratch_path, scratch_scope, shuffles_deleted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and their host's verdict keep, rows without a doc_id too; equal rows fare alike."""
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links, that of the smallest doc_id; rows without a doc_id, and empty texts, link with nothing and stay. Of rows equal in doc_id and text one stays."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage like a benchmark item; equal rows fare alike."""
    return decontam.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files whose order of rows is the mixture's; rows of equal source and doc_id are ordered by a hash of all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), "doc_id", "source")
    mixed = mixing.mix_sources(rows, queries.MIX_WEIGHTS)
    return mixed.repartitionByRange("_mix_position").sortWithinPartitions("_mix_position").select("_d.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of each document from token files in the order of docs' files and rows; a null or empty text is the end id alone."""
    placed, order = token_output.in_file_order(docs)
    return token_output.token_output(placed, public_vocabulary("byte_bpe_50k.json"), order=order)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_files),
]

#: A tokenizer and an iterated join are not SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's scratch tables go when its result is written."""
    docs = documents(spark, sf_dir)
    for name, function in STAGES:
        path = scratch_path(spark, name.replace(" ", "-").replace("/", ""))
        with scratch_scope() as paths:
            out = function(spark, docs, sf_dir)
            with shuffles_deleted(spark):
                out.write.parquet(path)
        delete(spark, *paths)
        docs = spark.read.parquet(path)
    return docs
