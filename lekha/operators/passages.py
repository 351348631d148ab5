"""Tokens with offsets, references, snippets, paragraphs, and order within groups."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekha.functions import text as t
from lekha.operators.listings import positions, title_key


def _offsets(profile: str, least: int):
    run_of, edges = re.compile(t.PROFILES[profile][0]), re.compile(f"^{t.EDGES}|{t.EDGES}$")

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            row, words, starts, stops = [], [], [], []
            for i, text in enumerate(texts.to_pylist()):
                for m in run_of.finditer(text or ""):
                    word = edges.sub("", m[0])
                    if len(word) >= least:
                        row.append(i)
                        words.append(word)
                        starts.append(m.start())
                        stops.append(m.end())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int32())), pa.array(words, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], names=["doc_id", "word", "start", "stop"])

    return run


def token_offsets(docs: DataFrame, profile: str, least: int = 2) -> DataFrame:
    """(doc_id, word, start, stop) of each run of the script whose cleaned form has at least so many characters.

    Offsets are those of the run in code points, stop exclusive; they are those of
    one pass of a pattern over the text, so the work is linear in it. A null or
    empty text has no row; repeated rows and null doc_ids have their own.
    """
    rows = docs.select("doc_id", (F.lower("text") if profile == "ascii" else F.col("text")).alias("text"))
    return rows.mapInArrow(_offsets(profile, least), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, word string, start bigint, stop bigint")


def first_references(occurrences: DataFrame, most: int = 8) -> DataFrame:
    """(word, rank, doc_id, pos): where occurrences (doc_id, pos, word) first have each word.

    Ranks are limited within each task before the shuffle, so a frequent word sends
    a few rows a task.
    """
    rank = F.row_number().over(Window.partitionBy("word").orderBy("doc_id", "pos"))
    rows = occurrences.select("word", "doc_id", F.col("pos").cast("bigint").alias("pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("word", F.col("rank").cast("bigint").alias("rank"), "doc_id", "pos")


def scan_summary(docs: DataFrame, counts: DataFrame, unknown: DataFrame) -> DataFrame:
    """(n_docs, n_words, n_unknown, n_occurrences): documents scanned, their distinct words (counts), and unknown (word, n) words and occurrences."""
    words = counts.agg(F.count("*").alias("n_words"))
    flagged = unknown.agg(F.count("*").alias("n_unknown"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_occurrences"))
    rows = docs.agg(F.count("*").alias("n_docs")).unionByName(words, True).unionByName(flagged, True)
    return rows.agg(*(F.max(c).alias(c) for c in ("n_docs", "n_words", "n_unknown", "n_occurrences")))


def snippets(text: Column, find: str, radius: int = 40, most: int = 3) -> Column:
    """Up to so many places where a literal stands, with the characters around; an ellipsis marks a cut."""
    k = len(find)
    parts = F.split(text, f"\\Q{find}\\E", most + 1)
    before = lambda i: F.length(F.array_join(F.slice(parts, 1, i), find))

    def around(i: Column) -> Column:
        start, end = F.greatest(F.lit(0), before(i) - radius), F.least(F.length(text), before(i) + k + radius)
        body = F.regexp_replace(F.substring(text, start + 1, end - start), r"\s+", " ")
        return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))

    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), around)).otherwise(F.array().cast("array<string>"))


def context_snippets(docs: DataFrame, find: str, radius: int = 40, most: int = 3) -> DataFrame:
    """(doc_id, rank, snippet) of the first places in each document; find has two characters at least."""
    if len(find) < 2 or "\\E" in find:
        raise ValueError("find needs two characters at least, and no \\E")
    hit = docs.where(F.col("text").contains(find))
    return hit.select("doc_id", F.posexplode(snippets(F.col("text"), find, radius, most)).alias("rank", "snippet")).withColumn("rank", F.col("rank").cast("bigint") + 1)


def paragraphs(texts: DataFrame, key: str) -> DataFrame:
    """(key, pos, kind, text): a text's blocks between blank lines; a first line [commentary] makes one a commentary."""
    rows = texts.select(key, F.posexplode(F.filter(F.transform(F.split("text", r"\n\s*\n+"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")).alias("pos", "block"))
    marked = F.lower(F.trim(F.split("block", "\n", 2)[0])) == "[commentary]"
    body = F.when(marked, F.regexp_replace(F.coalesce(F.get(F.split("block", "\n", 2), F.lit(1)), F.lit("")), r"^\s+|\s+$", "")).otherwise(F.col("block"))
    return rows.select(key, F.col("pos").cast("bigint").alias("pos"), F.when(marked, "commentary").otherwise("antara").alias("kind"), body.alias("text"))


def group_order(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(section, doc_id, number): groups in the order in which they are first seen, then by title, then doc_id; documents without a group go last."""
    rows = docs.join(sections.where("grouped").select("section", "section_pos"), "section")
    first = rows.where("group_name is not null").groupBy("section", "group_name").agg(F.min("doc_id").alias("seen"))
    keyed = rows.join(first, ["section", "group_name"], "left").select(
        "section", "section_pos", "doc_id", F.col("seen").isNull().alias("loose"), F.coalesce("seen", F.lit(0)).alias("seen"), title_key(docs, F.col("title")).alias("key"))
    placed = positions(keyed, ["section_pos", "loose", "seen", "key", "doc_id"])
    start = placed.groupBy("section").agg(F.min("position").alias("start"))
    return placed.join(start, "section").select("section", "doc_id", (F.col("position") - F.col("start") + 1).alias("number"))
