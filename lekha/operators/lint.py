"""Lint rules as data: what they find, fix and add up to; keys outside a whitelist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern and what replaces it; steps are applied in order."""

    id: str
    detect: str
    steps: tuple[tuple[str, str], ...]

    def fix(self, text: Column) -> Column:
        for pattern, by in self.steps:
            text = F.regexp_replace(text, pattern, by)
        return text


# Spellings that are wrong and what they should be.
_NOT_WITHIN = "(?<![ऀ-ॿ])"
TYPOS = (
    Rule("kachh_hum", _NOT_WITHIN + r"कछ\s+हम", ((_NOT_WITHIN + r"कछ\s+हम", "कछु हम"),)),
    Rule("bhay_nai", r"भय\s+भी\s+नाई", ((r"भय\s+भी\s+नाई", "भय भी नहीं"),)),
    Rule("mismatched_quotes", "'[^'\"]*\"|\"[^\"']*'", (("'([^'\"]*)\"", "'$1'"), ("\"([^\"']*)'", "'$1'"))),
    Rule("shum_din", _NOT_WITHIN + r"शुम\s+दिन", ((_NOT_WITHIN + r"शुम\s+दिन", "शुभ दिन"),)),
)


def issues(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rule_id, n_hits, auto_fixable), a row for each document and rule that finds something; a null text has no issue."""
    text = F.col("text")
    found = F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.size(F.regexp_extract_all(text, F.lit(r.detect), F.lit(0))).cast("bigint").alias("n_hits"), (r.fix(text) != text).alias("auto_fixable")) for r in rules))
    return docs.where(text.isNotNull()).select("doc_id", F.explode(F.filter(found, lambda x: x.n_hits > 0)).alias("x")).select("doc_id", "x.*")


def details(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rule_id, hits, before, after): what each rule finds, in order, and the text it would leave; after is null where it changes nothing."""
    text = F.col("text")
    found = F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.regexp_extract_all(text, F.lit(r.detect), F.lit(0)).alias("hits"), F.when(r.fix(text) != text, r.fix(text)).alias("after")) for r in rules))
    rows = docs.where(text.isNotNull()).select("doc_id", text.alias("before"), F.explode(F.filter(found, lambda x: F.size(x.hits) > 0)).alias("x"))
    return rows.select("doc_id", "x.rule_id", "x.hits", "before", "x.after")


def summary(found: DataFrame) -> DataFrame:
    """(rule_id, n_docs, n_hits) by rule."""
    return found.groupBy("rule_id").agg(F.count("*").alias("n_docs"), F.sum("n_hits").alias("n_hits"))


def fixed(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, text) of the documents that the rules, applied in order, change."""
    new = F.col("text")
    for r in rules:
        new = r.fix(new)
    return docs.select("doc_id", new.alias("new"), "text").where("new <> text").select("doc_id", F.col("new").alias("text"))


def unknown_keys(rows: DataFrame, json: str, known: list[str]) -> DataFrame:
    """(key, n) of the keys of a JSON object column that are not known; what is no object has no keys."""
    keys = rows.select(F.explode(F.json_object_keys(F.col(json))).alias("key"))
    return keys.where(~F.col("key").isin(known)).groupBy("key").agg(F.count("*").alias("n"))
