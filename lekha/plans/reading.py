"""Queries of offsets, references, snippets, paragraphs and group order over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lekha.operators import passages
from lekha.operators import words as w
from lekha.plans import publishing, registry
from lekha.plans.registry import PROFILE
from lekha.plans.shared import table


def token_offsets(spark, sf):
    return passages.token_offsets(table(spark, sf, "documents"), PROFILE)


def first_refs(spark, sf):
    return passages.first_references(w.occurrences(table(spark, sf, "documents"), PROFILE))


def scan_summary(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1").select("doc_id")
    scanned, trusted = docs.join(labels, "doc_id", "left_anti"), w.dictionary(docs.join(labels, "doc_id", "left_semi"), PROFILE)
    return passages.scan_summary(scanned, w.dictionary(scanned, PROFILE), w.unknown_words(scanned, trusted, PROFILE))


def context_snippets(spark, sf):
    return passages.context_snippets(table(spark, sf, "documents"), " the ")


def paragraphs(spark, sf):
    turn = F.concat(F.when(F.col("role") == "assistant", "[commentary]\n").otherwise(""), F.coalesce("text", F.lit("")))
    texts = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("x")))), lambda p: p.x), "\n\n").alias("text"))
    return passages.paragraphs(texts, "conv_id")


def group_order(spark, sf):
    return passages.group_order(publishing._docs(spark, sf), publishing._sections(spark))


QUERIES = {f.__name__: f for f in (token_offsets, first_refs, scan_summary, context_snippets, paragraphs, group_order)}

SQL = {
    "token_offsets": """WITH p AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+|[^a-z]+') AS x FROM documents)),
        e AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS e FROM p)
        SELECT doc_id, piece AS word, e - length(piece) AS start, e AS stop FROM e WHERE regexp_matches(piece, '^[a-z]{2,}$')""",
    "first_refs": f"WITH {registry._TOKENS}, r AS (SELECT word, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) AS rank, doc_id, CAST(pos AS BIGINT) AS pos FROM t) SELECT * FROM r WHERE rank <= 8",
    "scan_summary": f"""WITH {registry._TOKENS}, q AS (SELECT doc_id FROM labels WHERE quality = 1), s AS (SELECT word FROM t WHERE doc_id NOT IN (SELECT doc_id FROM q)), u AS (SELECT word FROM s WHERE word NOT IN (SELECT word FROM t WHERE doc_id IN (SELECT doc_id FROM q)))
        SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM q)) AS n_docs, (SELECT count(DISTINCT word) FROM s) AS n_words, (SELECT count(DISTINCT word) FROM u) AS n_unknown, (SELECT count(*) FROM u) AS n_occurrences""",
    "context_snippets": r"""WITH h AS (SELECT doc_id, text, string_split(text, ' the ') AS x FROM documents WHERE contains(text, ' the ')),
        i AS (SELECT *, unnest(range(1, least(len(x) - 1, 3) + 1)) AS rank FROM h),
        b AS (SELECT *, length(array_to_string(x[1:rank], ' the ')) AS n FROM i)
        SELECT doc_id, rank, CASE WHEN n > 40 THEN '…' ELSE '' END || regexp_replace(substr(text, greatest(0, n - 40) + 1, least(length(text), n + 45) - greatest(0, n - 40)), '\s+', ' ', 'g') || CASE WHEN n + 45 < length(text) THEN '…' ELSE '' END AS snippet FROM b""",
    "paragraphs": r"""WITH c AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN '[commentary]' || chr(10) ELSE '' END || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
        l AS (SELECT conv_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> '') AS x FROM c),
        u AS (SELECT conv_id, unnest(x) AS block, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS pos FROM l)
        SELECT conv_id, pos, CASE WHEN m THEN 'commentary' ELSE 'antara' END AS kind, CASE WHEN m THEN regexp_replace(regexp_replace(block, '^[^\n]*\n?', ''), '^\s+|\s+$', '', 'g') ELSE block END AS text
        FROM (SELECT *, lower(trim(string_split(block, chr(10))[1])) = '[commentary]' AS m FROM u)""",
    "group_order": f"""WITH {publishing._D}, g AS (SELECT section, section_pos, doc_id, title, group_name, min(doc_id) OVER (PARTITION BY section, group_name) AS seen FROM d JOIN s USING (section) WHERE s.grouped)
        SELECT section, doc_id, row_number() OVER (PARTITION BY section ORDER BY group_name IS NULL, CASE WHEN group_name IS NULL THEN 0 ELSE seen END, title, doc_id) AS number FROM g""",
}
