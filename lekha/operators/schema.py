"""Schema lint of documents in block form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.functions import lyrics as y
from lekha.functions import text as t
from lekha.operators import model
from lekha.sources.records import parse_docs

# Keys by level, and old lyrics keys with what replaces them.
DOC_KEYS = ("title", "tarz", "group", "swarachit", "also_in", "lyrics", "pre_shlok", "post_shlok", "dhvani", "shlok", "jabani")
LYRICS_KEYS = ("parts", "sthayi", "paragraphs", "sthayi_connect", "sthayi_connect_text", "pre_shlok", "pre_sthayi", "post_shlok", "dhvani", "shlok", "jabani")
PART_KEYS = ("sthayi", "paragraphs", "sthayi_connect", "sthayi_connect_text", "pre_shlok", "post_shlok")
DEPRECATED = {"pre_sthayi": "pre_shlok", "dhvani": "post_shlok", "shlok": "post_shlok", "jabani": "post_shlok"}

_KEY = r"([a-zA-Z_][\w-]*):"


def keys(raw: DataFrame) -> DataFrame:
    """(path, level, key, line, filled) of raw (path, text): keys of the document, its lyrics and their parts, by line from 1.

    filled: whether a value stands beside the key or below it. The lyrics' keys are
    those of a structured text only.
    """
    lines = raw.select("path", F.split(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", ""), "\r\n", "\n"), "\n").alias("lines"))
    lines = lines.withColumn("indexed", F.transform("lines", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    lines = lines.withColumn("top", F.filter("indexed", lambda p: p.x.rlike(f"^{_KEY}")))
    top = F.col("top")
    begin = F.array_min(F.transform(F.filter(top, lambda p: p.x.rlike(r"^lyrics:\s*$")), lambda p: p.i))
    plain = F.array_min(F.transform(F.filter(top, lambda p: p.x.rlike(r"^lyrics:\s*\|")), lambda p: p.i))
    end = F.coalesce(F.array_min(F.transform(F.filter(top, lambda p: (p.i > F.col("begin")) & p.x.rlike(rf"^{_KEY}\s")), lambda p: p.i)), F.size("lines"))
    # what lambdas compare with is named first, so that it is found once a document
    rows = lines.withColumns({"begin": begin, "plain": plain}).withColumn("end", end)
    structured = F.col("begin").isNotNull() & (F.col("plain").isNull() | (F.col("begin") < F.col("plain")))
    inner = F.when(structured, F.filter("indexed", lambda p: (p.i > F.col("begin")) & (p.i < F.col("end")))).otherwise(F.slice("indexed", 1, 0))
    rows = rows.withColumn("inner", inner)
    rows = rows.withColumn("parts", F.array_min(F.transform(F.filter("inner", lambda p: p.x.rlike(r"^  parts:")), lambda p: p.i)))
    parts, after = F.col("parts"), F.col("after")
    rows = rows.withColumn("after", F.coalesce(F.array_min(F.transform(F.filter("inner", lambda p: (p.i > parts) & p.x.rlike(f"^  {_KEY}")), lambda p: p.i)), F.col("end")))
    item = F.array_min(F.transform(F.filter("inner", lambda p: (p.i > parts) & (p.i < after) & p.x.rlike(r"^    -\s")), lambda p: p.i))

    def found(of: Column, pattern: str, level: str) -> Column:
        return F.transform(F.filter(of, lambda p: p.x.rlike(pattern)), lambda p: F.struct(F.lit(level).alias("level"), F.regexp_extract(p.x, _KEY, 1).alias("key"), p.i.alias("i"), p.x.alias("x")))

    every = F.concat(
        found(F.filter("indexed", lambda p: ~F.trim(p.x).startswith("#")), f"^{_KEY}", "doc"),
        found(F.filter("inner", lambda p: parts.isNull() | (p.i <= parts) | (p.i >= after)), f"^  {_KEY}", "lyrics"),
        found(t.bound(item, lambda it: F.filter("inner", lambda p: (p.i > it) & (p.i < after))), f"^      {_KEY}", "part"))
    rows = rows.select("path", "lines", F.explode(every).alias("k")).select("path", "lines", "k.*")
    below = F.get(F.filter(F.slice("lines", F.col("i") + 2, F.size("lines")), lambda x: F.trim(x) != ""), F.lit(0))
    indent = lambda x: F.length(x) - F.length(F.ltrim(x))
    beside = y.trimmed(F.regexp_replace("x", rf"^\s*{_KEY}", ""))
    filled = F.when(beside.contains("|") | (beside == ""), F.coalesce(~((indent(below) <= indent(F.col("x"))) & F.trim(below).rlike("^[a-zA-Z_]")), F.lit(False))).otherwise(True)
    return rows.select("path", "level", "key", (F.col("i") + 1).cast("bigint").alias("line"), filled.alias("filled"))


def deprecated_keys(found: DataFrame) -> DataFrame:
    """(path, key, replacement, line) of the lyrics' keys that have another name now."""
    names = F.create_map(*[F.lit(x) for kv in DEPRECATED.items() for x in kv])
    return found.where(F.col("level") == "lyrics").withColumn("replacement", names[F.col("key")]).where("replacement is not null").select("path", "key", "replacement", "line")


def unknown_keys(found: DataFrame) -> DataFrame:
    """(path, level, key, line) of keys that their level does not know."""
    known = F.when(F.col("level") == "doc", F.col("key").isin(*DOC_KEYS)).when(F.col("level") == "lyrics", F.col("key").isin(*LYRICS_KEYS)).otherwise(F.col("key").isin(*PART_KEYS))
    return found.where(~known).select("path", "level", "key", "line")


def lint(raw: DataFrame, slugs: list[str]) -> DataFrame:
    """(path, severity, code, key, line) of raw (path, text): all that is wrong with documents in block form.

    slugs: the sections that exist. A null text lacks both title and lyrics. path
    is unique. Every row is judged by itself; only keys and parsed documents meet,
    by path.
    """
    raw = raw.select(F.col("path").cast("string").alias("path"), "text")
    found = keys(raw)

    def issue(rows: DataFrame, severity: str, code: str | Column, key: Column, line: Column) -> DataFrame:
        return rows.select("path", F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), key.cast("string").alias("key"), line.cast("bigint").alias("line"))

    none = F.lit(None)
    has = lambda k, level="doc": F.max(F.when((F.col("level") == level) & (F.col("key") == k), F.col("line")))
    title = F.min(F.when((F.col("level") == "doc") & (F.col("key") == "title"), F.struct("line", "filled")))
    of = raw.select("path", F.coalesce("text", F.lit("")).alias("text")).join(
        found.groupBy("path").agg(title.alias("title"), F.collect_set(F.when(F.col("filled") & F.col("level").isin("doc", "lyrics"), F.col("key"))).alias("filled"),
                                  F.max(F.col("key") == "paragraphs").alias("has_paragraphs")), "path", "left")
    parsed = parse_docs(raw).withColumnRenamed("title", "parsed_title")
    of = of.join(parsed, "path", "left")
    body = F.regexp_replace("text", "^﻿", "")
    title_line = F.regexp_extract(body, r"(?m)^title:[ \t]*(.*)$", 1)
    no_lyrics = ~body.rlike(r"(?m)^lyrics:\s*(?:\||$)")
    text_of = lambda k: F.coalesce(y.trimmed(F.col("lyrics")[k]) != "", F.lit(False))
    part_paragraphs = F.exists(model.parts_of(F.col("lyrics")), lambda p: F.size(p.paragraphs) > 0)
    drops = {k: text_of("post_shlok" if k in ("post_shlok", "dhvani", "shlok", "jabani") else k) for k in ("sthayi", "pre_shlok", "post_shlok", "dhvani", "shlok", "jabani")}
    drops["parts"] = F.coalesce(F.size("lyrics.parts") > 0, F.lit(False))
    dropped = F.array_compact(F.array(*[F.when(F.array_contains("filled", k) & ~ok, F.lit(k)) for k, ok in drops.items()],
                                      F.when(F.coalesce(F.col("has_paragraphs"), F.lit(False)) & ~F.coalesce(part_paragraphs, F.lit(False)), F.lit("paragraphs"))))
    bad = F.filter(F.transform("also_in", F.trim), lambda s: (s != "") & ~s.isin(*slugs))
    unknown = unknown_keys(found)
    return (
        issue(of.where(F.col("text").startswith("﻿")), "warning", "utf8_bom", none, F.lit(1))
        .unionByName(issue(of.where("title is null"), "error", "missing_title", none, none))
        .unionByName(issue(of.where(F.col("title").isNotNull() & (F.trim(title_line) == "")), "error", "empty_title", none, F.col("title.line")))
        .unionByName(issue(of.where(no_lyrics), "error", "missing_lyrics", none, none))
        .unionByName(issue(of.where(~no_lyrics & ~F.coalesce(model.renderable(F.col("lyrics")), F.lit(False))), "error", "empty_lyrics", none, none))
        .unionByName(issue(of.select("path", F.explode(bad).alias("slug")), "error", "invalid_also_in", F.col("slug"), none))
        .unionByName(issue(of.select("path", F.explode(dropped).alias("k")), "error", "parse_drop", F.col("k"), none))
        .unionByName(issue(unknown, "error", F.concat(F.lit("unknown_"), F.col("level"), F.lit("_key")), F.col("key"), F.col("line")))
        .unionByName(issue(deprecated_keys(found), "warning", "deprecated_key", F.col("key"), F.col("line"))))


def counts(issues: DataFrame) -> DataFrame:
    """(severity, code, n_docs, n): issues by severity and code."""
    return issues.groupBy("severity", "code").agg(F.count_distinct("path").alias("n_docs"), F.count("*").alias("n"))
