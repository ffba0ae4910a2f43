"""From raw documents to token files: quality, near duplicates, benchmark passages, the mix of sources, tokens.

run() applies STAGES to documents in order. Each stage's rows are written as Parquet to the shared folder and read again,
so that each works on exactly what the one before kept and a lost executor costs one stage at most. Counted with the
operators in tallyloom.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontamination, jaccard, mixing, quality_rules, token_files
from tallyloom.llm.queries import END_ID, table, tokenizer_path
from tallyloom.llm.shared import kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; it is fitted on the labelled ones among them."""
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates."""
    return jaccard.without_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontamination.without_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and reads them back: doc_id, start, n_tokens, ids_crc32 of each row."""
    return token_files.read_token_files(spark, token_files.write_token_files(docs, tokenizer_path(), end_id=END_ID))


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("token files", tokens)]

#: A fitted ensemble, greedy rounding and a tokenizer aren't SQL; tests/llm hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
