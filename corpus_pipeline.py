"""From documents to packed sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lekha.llm import exact_dedup, langid, ngram_join, packing, pii
from lekha.plans.shared import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter and a known language, all columns as they are; the others go.

    Null and empty texts go. Repeated rows are judged alike, each by its own text.
    The languages are learned from the rows with a lang; without any, all go. An
    empty table stays empty.
    """
    return langid.known(docs, langid.fit(docs.where(~langid.held_out())))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group of equal texts.

    Null texts equal empty ones. Rows without a doc_id go, as nothing can name
    them; rows that repeat a kept doc_id stay. An empty table stays empty.
    """
    found = exact_dedup.exact_dedup(docs)
    return docs.join(found.where("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles at 0.8 link: that with the smallest doc_id.

    Documents without words, texts null or empty, link with nothing and stay. Rows
    without a doc_id go. An empty table stays empty.
    """
    found = ngram_join.ngram_join(docs, words=5, percent=80)
    return docs.join(found.where("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets masked in their texts; n_chars counts anew.

    Null and empty texts stay as they are; repeated rows are masked alike; an empty
    table stays empty.
    """
    return pii.masked(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 4096 tokens; a null text is empty and keeps its end id, rows without a doc_id go."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies),
    ("PII", private_data), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokens, masks by a trained model and components of a similarity graph are beyond SQL.
ORACLE_SQL = None
