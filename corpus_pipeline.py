"""A corpus pipeline of four stages: language ID, SimHash near-duplicates, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billoom.llm import langid, mixing, packing, simhash
from billoom.llm.common import Scratch
from billoom.llm.queries import fold, vocabulary

#: A document is rejected if it has no letter or nearly none of its n-grams stands in its language's filter.
LEAST_COVERAGE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; without a letter (null and empty texts too), or nearly without known n-grams, they go.

    Learns as op7 does, from docs; a null lang teaches nothing, a null doc_id counts as not held out. Repeated rows stay or go together;
    an empty table gives an empty one; where no row has a language all go.
    """
    labelled = docs.filter(F.coalesce(fold("doc_id", 3) != 1, F.lit(True)))
    return langid.predict(docs, langid.fit(labelled)).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("coverage") >= LEAST_COVERAGE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the smallest doc_id (null after all), then the least hash of the row.

    Null and empty texts have fingerprint zero and are alike. Rows that repeat an id with different texts count each for
    themselves; rows equal in all columns are one. An empty table gives an empty one.
    """
    return simhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the square roots of their sizes; a document stands as often as it is drawn.

    A null source is the source ''; null and empty texts have no size; rows that repeat an id are drawn alike; an empty table gives an empty one.
    """
    return mixing.mix(docs, temperature=0.5, budget=1.0, seed=5).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixture and their places in sequences of 4096 tokens.

    Null and empty texts are the end id alone; repeated rows are pieces of their own; an empty table gives an empty one.
    """
    out = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("poisson_mix", mixture), ("pattern_packing", packed)]

#: SQL has neither XXH64 with a seed nor the tokenizers. tests/llm/test_pipeline.py holds run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result written and read again; what no later stage reads is deleted."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        kept = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(docs)
        docs = kept
    return docs
