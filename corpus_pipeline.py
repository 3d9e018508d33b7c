"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Each stage but the last takes documents (doc_id, text, source; any others) and gives back the same columns in any order of
rows; an empty table gives an empty one. Columns of other names pass through, whatever they are called. Whole texts are read at
any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonorant.llm import jaccard, mixing, packing, pii, quality
from sonorant.llm.common import materialize, read_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules pass. Null, empty and blank texts have no words and go; rows that repeat are judged
    alike."""
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of alike ones. Texts without words are like no other and stay; rows of
    equal id and text become one, rows that share the smallest id of a group and differ in text all stay; a null id is kept only
    where its group has no other."""
    return jaccard.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with [KIND] in place of personal data; null texts stay null, each row is masked by itself."""
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, from never to three times. Documents without words are never drawn, a null
    source is one of its own, and rows that repeat are documents of their own."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences, a row for each. A null or empty text is the end id alone; rows that repeat are documents of
    their own."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A tokenizer and a tagger are among the stages; tests hold the rows against plain versions of the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each but the last written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
