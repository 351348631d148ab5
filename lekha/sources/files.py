"""Documents in files of their own, and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the files that path names, a row each, without a byte-order mark, line ends as newlines."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n").alias("text"))


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """(word): distinct words of a list with affix flags after a slash; a line of digits alone is the count, not a word."""
    word = F.trim(F.substring_index(F.regexp_replace("value", "^﻿|\r$", ""), "/", 1))
    return spark.read.text(path).select(word.alias("word")).where("word <> '' and not word rlike '^[0-9]+$'").distinct()


def write_wordlist(words: DataFrame, path: str, collation: str | None = None) -> None:
    """Write the count, then the distinct words (word) in order, over text files whose names keep that order.

    The order is that of code points, or of a collation (hi), and of code points
    where that holds words equal.
    """
    rows = words.where("word is not null").select("word").distinct()
    lines = rows.agg(F.count("*").cast("string").alias("value")).select(F.lit(0).alias("k"), "value").unionByName(rows.select(F.lit(1).alias("k"), F.col("word").alias("value")))
    order = ["value"] if collation is None else [F.collate("value", collation), "value"]
    lines.orderBy("k", *order).select("value").write.text(path)
