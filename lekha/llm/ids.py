"""Operators on documents whose ids may repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.operators.listings import positions
from lekha.plans.shared import written


def by_row(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """operator's result on docs (doc_id, text), one row for each row with an id.

    Where ids repeat, rows are numbered in order of id and text, the operator works
    on the numbers, and those in the named columns of its result become ids again.
    """
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    n, k = rows.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == k:
        return operator(rows)
    placed = positions(rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)), ["doc_id", "digest"])
    numbered = written(placed.select("position", "doc_id", "text"), "numbered")
    out = operator(numbered.select(F.col("position").alias("doc_id"), "text"))
    names = out.columns
    for c in columns:
        out = out.join(numbered.select(F.col("position").alias(c), F.col("doc_id").alias("__id")), c).drop(c).withColumnRenamed("__id", c)
    return out.select(names)
