"""Corpus preparation: language ID, line dedup, SimHash near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. Between stages the documents are
written as Parquet and read again by whoever runs STAGES; ``run`` does so in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colonnade.llm import decontaminate, langid, linededup, mixing, simhash
from colonnade.llm.common import reread

# Least share of a document's letters that its language must hold: below it a text is a mixture that no language names.
LANGUAGE_SHARE = 0.65


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no language (no letters, or a null text), or none that holds LANGUAGE_SHARE of their letters."""
    return langid.keep_identified(docs, min_score=LANGUAGE_SHARE)


def drop_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines of 50 words or more are cut out; documents of which nothing is left go."""
    return linededup.deduplicate(docs, min_words=50)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: three-word shingles, three bits or fewer."""
    return simhash.deduplicate(docs, shingle=3, max_bits=3)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a fifth of its words edited, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as the documents hold, weights halfway in entropy between the sources' own shares and equal ones."""
    return mixing.mix(docs, flatness=0.5)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_runs),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
]

# Trigram models, SimHash and the CGK walk have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = reread(docs)
    return docs
