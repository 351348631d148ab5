"""Queries of listings, verses, lint and correction over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.operators import lint, listings
from lekha.operators import words as w
from lekha.plans import registry
from lekha.plans.registry import PROFILE
from lekha.plans.shared import table

#: section_pos, section, sort, excluded, grouped.
SECTIONS = ((0, "en", "file", False, False), (1, "de", "title", False, True), (2, "fr", "title", True, False), (3, "es", "title", False, True))
RULES = (lint.Rule("doubled_word", "the the", (("the the", "the"),)), lint.Rule("doubled_mark", "[!?]{2,}", (("[!?]{2,}", "!"),)), lint.Rule("odd_sign", "[$%#@|]+", (("[$%#@|]+", ""),)))
KNOWN = ["ref"]


def _docs(spark, sf) -> DataFrame:
    title = F.split(F.col("text"), "\n", 2)[0]
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("section"), F.col("source").alias("group_name"), title.alias("title"))


def _sections(spark) -> DataFrame:
    return spark.createDataFrame(SECTIONS, "section_pos int, section string, sort string, excluded boolean, grouped boolean")


def display_order(spark, sf):
    return listings.display_order(_docs(spark, sf), _sections(spark))


def prev_next(spark, sf):
    return listings.neighbours(display_order(spark, sf))


def master_index(spark, sf):
    return listings.master_index(_docs(spark, sf), _sections(spark))


def unique_doc_count(spark, sf):
    return listings.unique_documents(_docs(spark, sf), _sections(spark))


def groups_list(spark, sf):
    return listings.groups(_docs(spark, sf), _sections(spark))


def verse_numbers(spark, sf):
    return listings.verse_numbers(table(spark, sf, "conversations"))


def typo_lint(spark, sf):
    return lint.issues(table(spark, sf, "documents"), RULES)


def typo_fix(spark, sf):
    return lint.fixed(table(spark, sf, "documents"), RULES)


def lint_summary(spark, sf):
    return lint.summary(typo_lint(spark, sf))


def unknown_keys(spark, sf):
    return lint.unknown_keys(table(spark, sf, "events"), "props", KNOWN)


def replace_words(spark, sf):
    docs = table(spark, sf, "documents")
    return w.replaced_words(docs, w.canonical_forms(registry.whole_counts(docs), PROFILE), PROFILE)


def suggest(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1").select("doc_id")
    counts = w.word_counts(docs.join(labels, "doc_id", "left_semi"), PROFILE, cleaned=True)
    unknown = w.unknown_words(docs.join(labels, "doc_id", "left_anti"), counts.select("word"), PROFILE)
    return w.suggestions(unknown, counts)


def suggest_turns(spark, sf):
    """For the words of conversations that no document has, the documents' words."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("").alias("lang"), "text")
    counts = w.word_counts(table(spark, sf, "documents"), PROFILE, cleaned=True)
    return w.suggestions(w.unknown_words(turns, counts.select("word"), PROFILE), counts)


QUERIES = {f.__name__: f for f in (display_order, prev_next, master_index, unique_doc_count, groups_list, verse_numbers, typo_lint, typo_fix, lint_summary, unknown_keys, replace_words, suggest, suggest_turns)}

_D = f"""s(section_pos, section, sort, excluded, grouped) AS (VALUES {', '.join(map(str, SECTIONS))}),
    d AS (SELECT doc_id, lang AS section, source AS group_name, coalesce(string_split(text, chr(10))[1], '') AS title FROM documents)"""
_ORDER = f"WITH {_D}, o AS (SELECT section, doc_id, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN sort = 'file' THEN '' ELSE title END, doc_id) AS number FROM d JOIN s USING (section))"
_LINT = r"""SELECT * FROM (
    SELECT doc_id, 'doubled_word' AS rule_id, len(regexp_extract_all(text, 'the the')) AS n_hits, replace(text, 'the the', 'the') <> text AS auto_fixable FROM documents
    UNION ALL SELECT doc_id, 'doubled_mark', len(regexp_extract_all(text, '[!?]{2,}')), regexp_replace(text, '[!?]{2,}', '!', 'g') <> text FROM documents
    UNION ALL SELECT doc_id, 'odd_sign', len(regexp_extract_all(text, '[$%#@|]+')), regexp_replace(text, '[$%#@|]+', '', 'g') <> text FROM documents) WHERE n_hits > 0"""

#: The words of all unlabelled documents are too many to compare with all known ones in SQL: suggest is tested by brute force.
SQL = {
    "display_order": f"{_ORDER} SELECT * FROM o",
    "prev_next": f"{_ORDER} SELECT *, lag(doc_id) OVER (PARTITION BY section ORDER BY number) AS prev_id, lead(doc_id) OVER (PARTITION BY section ORDER BY number) AS next_id FROM o",
    "master_index": f"WITH {_D} SELECT doc_id, row_number() OVER (ORDER BY title, doc_id) AS number FROM d JOIN s USING (section) WHERE NOT excluded",
    "unique_doc_count": f"WITH {_D} SELECT count(*) AS n FROM d JOIN s USING (section) WHERE NOT excluded",
    "groups_list": f"WITH {_D} SELECT DISTINCT section, group_name FROM d JOIN s USING (section) WHERE s.grouped AND group_name IS NOT NULL",
    "verse_numbers": r"WITH f AS (SELECT *, coalesce(role = 'user' AND trim(text) <> '' AND NOT regexp_matches(trim(text), '^जबानी\s*[-–—:：]'), false) AS flag FROM conversations), n AS (SELECT *, CAST(sum(CAST(flag AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS number FROM f) SELECT conv_id, turn, number FROM n WHERE flag",
    "typo_lint": _LINT,
    "typo_fix": r"SELECT doc_id, new AS text FROM (SELECT doc_id, text, regexp_replace(regexp_replace(replace(text, 'the the', 'the'), '[!?]{2,}', '!', 'g'), '[$%#@|]+', '', 'g') AS new FROM documents) WHERE new <> text",
    "lint_summary": f"SELECT rule_id, count(*) AS n_docs, CAST(sum(n_hits) AS BIGINT) AS n_hits FROM ({_LINT}) GROUP BY rule_id",
    "unknown_keys": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) WHERE key NOT IN ('ref') GROUP BY key",
    "replace_words": f"""WITH {registry._TOKENS}, c AS (SELECT word, count(*) AS n, regexp_replace(word, '[aeiou]', '', 'g') AS skeleton FROM t GROUP BY word HAVING count(*) >= 2),
        m AS (SELECT word, arg_min(word, struct_pack(n := -n, w := word)) OVER (PARTITION BY skeleton) AS canonical FROM c WHERE skeleton <> ''),
        x AS (SELECT doc_id, unnest(y) AS piece, generate_subscripts(y, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+|[^a-z]+') AS y FROM documents))
        SELECT doc_id, string_agg(coalesce(canonical, piece), '' ORDER BY pos) AS text, count(canonical) AS n_replaced FROM x LEFT JOIN (SELECT * FROM m WHERE canonical <> word) m ON piece = word GROUP BY doc_id HAVING count(canonical) > 0""",
    "suggest_turns": """WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), k AS (SELECT word, count(*) AS n FROM t WHERE length(word) >= 2 GROUP BY word),
        u AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) WHERE length(word) >= 2 AND word NOT IN (SELECT word FROM k)),
        b AS (SELECT word, CASE WHEN length(word) <= 3 THEN 1 WHEN length(word) <= 6 THEN 2 ELSE greatest(2, CAST(floor(length(word) * 0.32) AS INT)) END AS most FROM u),
        p AS (SELECT b.word, k.word AS suggestion, n, levenshtein(b.word, k.word) AS distance FROM b JOIN k ON abs(length(b.word) - length(k.word)) <= most AND levenshtein(b.word, k.word) <= most)
        SELECT * FROM (SELECT word, row_number() OVER (PARTITION BY word ORDER BY distance, n DESC, suggestion) AS rank, suggestion, distance FROM p) WHERE rank <= 8""",
}
