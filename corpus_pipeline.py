"""From documents to token ids: five stages, each on all that the stage before has kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm import bpe, langid, partenum, tiling, toxicity
from colloquy.llm.common import cut_lineage, small_batches, table
from colloquy.llm.queries import content, split_pattern, vocabulary

#: Models and byte-pair merges cannot be said in SQL; tests/llm/test_pipeline_stages.py compares each stage with a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity cut, by a model fitted on the labelled ones."""
    small_batches(spark)
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with enough certainty, by a model fitted on those that name theirs."""
    small_batches(spark)
    return langid.keep(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity of 0.8 or more."""
    small_batches(spark)
    return partenum.keep_one(docs, n=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    small_batches(spark)
    return tiling.keep(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-level BPE ids of each document."""
    small_batches(spark)
    ids = bpe.encode(docs, content(vocabulary("byte_bpe_multi_50k.tiktoken")), split_pattern(), packed=False, memo_bytes=48 << 20)
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
