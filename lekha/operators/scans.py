"""Spell scans that are kept up by differences, and vocabularies as sketches that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekha.functions import text as t
from lekha.plans.shared import written
from lekha.sources import appends

_MEMBERS, _WORDS, _TOTALS = "doc_id bigint, n bigint", "doc_id bigint, word string, n bigint", "word string, n bigint, n_docs bigint"


def _words(docs: DataFrame, profile: str) -> DataFrame:
    """(doc_id, word, n) of the words of each document."""
    return docs.select("doc_id", F.explode(t.clean_tokens(F.col("text"), profile)).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def _append(spark: SparkSession, path: str, members: DataFrame, words: DataFrame) -> None:
    """Append a batch: documents and their words, with counts above zero for what comes in and below for what goes out, and each word's totals in it."""
    batch = appends.new_batch()
    members.write.parquet(appends.place(path, "members", batch))
    words.write.parquet(appends.place(path, "words", batch))
    made = spark.read.schema(_WORDS).parquet(appends.place(path, "words", batch))
    totals = made.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.signum("n")).cast("bigint").alias("n_docs")).where("n <> 0 or n_docs <> 0")
    totals.write.parquet(appends.place(path, "totals", batch))
    appends.finish(spark, path, batch)


def scan(docs: DataFrame, path: str, profile: str) -> None:
    """Begin a scan at path with docs (doc_id, text): the words of each document, and the totals of each word.

    doc_id is unique; rows without one are left out; null texts have no words.
    """
    docs = docs.where("doc_id is not null")
    _append(docs.sparkSession, path, docs.select("doc_id", F.lit(1).cast("bigint").alias("n")), _words(docs, profile))


def replace(spark: SparkSession, path: str, ids: DataFrame, docs: DataFrame | None, profile: str) -> None:
    """Take the documents of ids (doc_id) out of the scan, and put docs (doc_id, text) into it: those that take their place, and new ones.

    Nothing but docs is tokenised: what a document put in is taken out again, by
    rows with negative counts. Ids that the scan lacks change nothing; a document of
    docs that the scan holds must be in ids too.
    """
    ids = written(ids.where("doc_id is not null").select("doc_id").distinct(), "ids")
    less = lambda kind, schema, keys: appends.read(spark, path, kind, schema).join(ids, "doc_id", "left_semi").groupBy(*keys).agg((-F.sum("n")).alias("n")).where("n < 0")
    members, words = less("members", _MEMBERS, ["doc_id"]), less("words", _WORDS, ["doc_id", "word"])
    if docs is not None:
        docs = docs.where("doc_id is not null")
        members = members.unionByName(docs.select("doc_id", F.lit(1).cast("bigint").alias("n")))
        words = words.unionByName(_words(docs, profile))
    _append(spark, path, members, words)


def word_totals(spark: SparkSession, path: str, dropped: DataFrame | None = None) -> DataFrame:
    """(word, n, n_docs) as the scan stands, without the words (word) that were dropped from the report."""
    rows = appends.read(spark, path, "totals", _TOTALS).groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")).where("n > 0")
    return rows if dropped is None else rows.join(dropped.select("word"), "word", "left_anti")


def summary(spark: SparkSession, path: str, trusted: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(n_docs, n_words, n_unknown, n_occurrences) as passages.scan_summary gives them, from the stored totals; no document is read.

    trusted (word) are known words; dropped (word) are not reported any more, but
    still count as words.
    """
    totals = word_totals(spark, path)
    unknown = totals.where(~F.col("word").rlike("^[0-9०-९]+$")).join(trusted.select("word"), "word", "left_anti")
    unknown = unknown if dropped is None else unknown.join(dropped.select("word"), "word", "left_anti")
    parts = [
        appends.read(spark, path, "members", _MEMBERS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs")), totals.agg(F.count("*").alias("n_words")),
        unknown.agg(F.count("*").alias("n_unknown"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_occurrences"))]
    rows = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return rows.agg(*(F.max(c).alias(c) for c in ("n_docs", "n_words", "n_unknown", "n_occurrences")))


def vocabulary_sketches(docs: DataFrame, profile: str, size: int = 14) -> DataFrame:
    """(section, sketch) of docs (section, text): HyperLogLog sketches of each section's words, of 2^size places (error about 1.04 / 2^(size/2)).

    Sketches of parts, days or runs can be stored and merged by merged_sketches;
    words are not made distinct first, and a task sends a sketch a section.
    """
    words = docs.select("section", F.explode(t.clean_tokens(F.col("text"), profile)).alias("word"))
    return words.groupBy("section").agg(F.hll_sketch_agg("word", size).alias("sketch"))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """(section, sketch): one a section, of all that were made of it."""
    return sketches.groupBy("section").agg(F.hll_union_agg("sketch").alias("sketch"))


def vocabulary_estimates(sketches: DataFrame) -> DataFrame:
    """(section, estimate) of distinct words by section, and of all sections together with a null section; documents without a section count in that alone. Without words the whole is 0."""
    whole = sketches.agg(F.hll_union_agg("sketch").alias("sketch")).where("sketch is not null").select(F.lit(None).cast("string").alias("section"), "sketch")
    rows = merged_sketches(sketches.where("section is not null")).unionByName(whole)
    return rows.select("section", F.hll_sketch_estimate("sketch").alias("estimate"))
