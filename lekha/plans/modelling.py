"""Queries of nested documents made from conversations, their lyrics' structure, lint and search items, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.functions import lyrics as y
from lekha.functions import text as t
from lekha.operators import documents as d
from lekha.operators import model, schema
from lekha.plans.shared import new_path, table, written
from lekha.sources import records

SLUGS = ["s0", "s1", "s2"]


def turns(spark, sf) -> DataFrame:
    """(path, xs): a conversation's turns (turn, role, text) in order."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("xs"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("conv_id").cast("string").alias("path"), "xs")


def docs(spark, sf) -> DataFrame:
    """Conversations as documents: the first turn's first line is the title. By id modulo 4 they are plain text, in one part, or of refrain and paragraphs."""
    xs = F.col("xs")
    rest = F.transform(F.slice(xs, F.lit(2), F.size(xs)), lambda x: F.struct(F.when(x.role == "assistant", "commentary").otherwise("antara").alias("kind"), x.text.alias("text")))
    kind = F.col("doc_id") % 4
    none = F.lit(None).cast("string")
    part = F.struct(xs[0].text.alias("sthayi"), none.alias("pre_shlok"), none.alias("post_shlok"), F.lit(None).cast("boolean").alias("sthayi_connect"), none.alias("sthayi_connect_text"), rest.alias("paragraphs"))
    whole = F.array_join(F.transform(xs, lambda x: x.text), "\n\n")
    lyrics = F.struct(
        F.when(kind < 2, xs[0].text).alias("sthayi"), none.alias("pre_shlok"), none.alias("post_shlok"), F.when(F.col("doc_id") % 5 == 1, False).alias("sthayi_connect"), none.alias("sthayi_connect_text"),
        F.when(kind < 2, rest).alias("paragraphs"), F.when(kind == 2, whole).alias("text"), F.when(kind == 3, F.array(part)).alias("parts")).cast(model.LYRICS)
    return turns(spark, sf).select(
        "doc_id", "path", F.split(xs[0].text, "\n", 2)[0].alias("title"), none.alias("tarz"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("g"), F.col("doc_id") % 3)).alias("group_name"),
        (F.col("doc_id") % 2 == 0).alias("self_authored"), F.array(F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string"))).alias("also_in"), lyrics.alias("lyrics"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("section"))


def texts(spark, sf) -> DataFrame:
    """(doc_id, title, text): the turns of conversations with blank lines between."""
    xs = F.col("xs")
    return turns(spark, sf).select("doc_id", F.split(xs[0].text, "\n", 2)[0].alias("title"), F.array_join(F.transform(xs, lambda x: x.text), "\n\n").alias("text"))


def raw_docs(spark, sf) -> DataFrame:
    """(path, text): conversations in block form, with a fault each by id modulo 8."""
    xs, k = F.col("xs"), F.col("doc_id") % 8
    indented = lambda x, pad: F.concat(F.lit(pad), F.regexp_replace(x, "\n", "\n" + pad))
    item = F.transform(F.slice(xs, F.lit(2), F.size(xs)), lambda x: F.concat(F.when(x.role == "assistant", "    - commentary: |\n").otherwise("    - |\n"), indented(x.text, "      ")))
    title = F.when(k == 1, "").when(k == 2, "title: \n").otherwise(F.concat(F.lit("title: "), F.split(xs[0].text, "\n", 2)[0], F.lit("\n")))
    more = F.when(k == 3, "colour: red\n").when(k == 4, F.concat(F.lit("also_in:\n  - s1\n  - s"), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise("")
    odd = F.when(k == 5, "  tempo: slow\n").when(k == 6, "  dhvani: |\n    closing\n").otherwise("")
    text = F.concat(F.when(k == 7, "﻿").otherwise(""), title, more, F.lit("lyrics:\n"), odd, F.lit("  sthayi: |\n"), indented(xs[0].text, "    "), F.lit("\n  paragraphs:\n"), F.array_join(item, "\n"), F.lit("\n"))
    return turns(spark, sf).select("path", text.alias("text"))


def _listings(spark, sf) -> DataFrame:
    """Documents in their own section and in those that they name, numbered by id in each."""
    from lekha.operators.listings import positions

    rows = docs(spark, sf).withColumn("home_section", F.col("section"))
    other = rows.where(~F.col("also_in")[0].eqNullSafe(F.col("section")) & F.col("also_in")[0].isin(*SLUGS)).withColumn("section", F.col("also_in")[0]).withColumn("is_cross_listed", F.lit(True))
    every = written(rows.withColumn("is_cross_listed", F.lit(False)).unionByName(other), "listings")
    placed = positions(every.select("section", "doc_id"), ["section", "doc_id"])
    first = placed.groupBy("section").agg(F.min("position").alias("first"))
    numbers = placed.join(first, "section").select("section", "doc_id", (F.col("position") - F.col("first") + 1).alias("number"))
    return every.join(numbers, ["section", "doc_id"])


def model_fields(spark, sf):
    return model.collect_fields(docs(spark, sf))


def editor_fields(spark, sf):
    return model.editor_fields(docs(spark, sf))


def flattened_lyrics(spark, sf):
    return docs(spark, sf).select("doc_id", model.flattened(F.col("lyrics")).alias("text"))


def lyric_lines(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.posexplode(model.lyric_lines(F.col("tarz"), F.col("lyrics"))).alias("pos", "line"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


def mapped_lyrics(spark, sf):
    return docs(spark, sf).select("doc_id", model.flattened(model.mapped(F.col("lyrics"), lambda x: F.translate(x, "aeiou", "AEIOU"))).alias("text"))


def resolved_flags(spark, sf):
    """On but for a document that says no, or section s2."""
    section = F.when(F.col("section") == "s2", False)
    found = docs(spark, sf).select("doc_id", model.connected(F.col("lyrics"), F.lit(True), section).alias("x"))
    return found.select("doc_id", "x.sthayi_connect", F.get("x.parts", F.lit(0)).sthayi_connect.alias("part_connect"))


def prepared_listings(spark, sf):
    rows = _listings(spark, sf).withColumns({"connect_config": F.lit(True), "connect_section": F.when(F.col("section") == "s2", False)})
    return model.prepared(rows).select("section", "doc_id", "title", "id", F.col("lyrics.sthayi_connect").alias("connect"))


def listing_badges(spark, sf):
    rows = _listings(spark, sf).withColumn("home_title", F.upper("home_section"))
    return model.badges(rows, "s0").select("section", "doc_id", "self_badge", "from_title")


def section_defaults(spark, sf):
    """Sections are the documents' languages; what they leave open depends on their length."""
    rows = table(spark, sf, "documents").groupBy(F.col("lang").alias("slug")).agg(F.count("*").alias("n")).where("slug is not null")
    return model.section_defaults(rows.select("slug", F.when(F.col("slug") == "en", "b.jpg").alias("banner"), F.when(F.col("slug") == "de", " File").alias("sort"), (F.col("n") % 2 == 0).alias("grouped"), F.when(F.col("slug") == "fr", " ").alias("count_unit")))


def search_items(spark, sf):
    rows = model.search_items(_listings(spark, sf))
    return rows.select("path", "section", "title", "id", F.size("lines").cast("bigint").alias("n_lines"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("lines_md5"), "href", "home_section")


def search_index_roundtrip(spark, sf):
    path = new_path(spark, "index")
    records.write_search_index(model.search_items(_listings(spark, sf)), path)
    back = spark.read.schema("path string, title string, id string, lines array<string>, href string, home_section string, section string").json(path)
    return back.select("path", "section", "title", "id", F.size("lines").cast("bigint").alias("n_lines"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("lines_md5"), "href", "home_section")


def search_titles(spark, sf):
    """The titles of conversations, with a word less, as queries on titles and lines of all."""
    rows = written(docs(spark, sf).select("doc_id", "title", model.flattened(F.col("lyrics")).alias("text")), "items")
    queries = rows.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("title", " "), F.lit(2), F.size(F.split("title", " "))), " ").alias("query"))
    return d.with_snippets(d.search(rows, queries, titles=True), rows)


def parsed_docs(spark, sf):
    """Block form read back: what was well formed comes back whole."""
    x = F.col("lyrics")
    of = records.parse_docs(raw_docs(spark, sf))
    return of.select("path", "title", x.sthayi.alias("sthayi"), F.coalesce(F.size(x.paragraphs), F.lit(0)).cast("bigint").alias("n_paragraphs"), F.md5(F.array_join(F.transform(x.paragraphs, lambda p: F.concat(p.kind, F.lit(":"), p.text)), "|").cast("binary")).alias("paragraphs_md5"),
                     x.post_shlok.alias("post"), F.array_join("also_in", ",").alias("also_in"))


def schema_lint(spark, sf):
    return schema.lint(raw_docs(spark, sf), SLUGS)


def schema_counts(spark, sf):
    return schema.counts(schema_lint(spark, sf))


def issues_roundtrip(spark, sf):
    path = new_path(spark, "issues")
    records.write_issues(schema_lint(spark, sf), path)
    return spark.read.parquet(path)


def deprecated_keys(spark, sf):
    return schema.deprecated_keys(schema.keys(raw_docs(spark, sf)))


def renderable_docs(spark, sf):
    x = F.col("lyrics")
    blank = x.withField("sthayi", F.lit(" ")).withField("paragraphs", F.slice(x.paragraphs, 1, 0))
    rows = docs(spark, sf).withColumn("lyrics", F.when(F.col("doc_id") % 8 == 0, blank).otherwise(x))
    return rows.select("doc_id", model.renderable(F.col("lyrics")).alias("renderable"), model.has_refrain(F.col("lyrics")).alias("has_refrain"), model.post_text(F.col("lyrics")).alias("post"))


def structured_texts(spark, sf):
    rows = texts(spark, sf).select("doc_id", y.structured(F.col("text")).alias("x"))
    return rows.select("doc_id", "x.strategy", "x.sthayi", F.size("x.paragraphs").cast("bigint").alias("n_paragraphs"), F.array_join("x.paragraphs", "\n\n").alias("paragraphs"), F.col("x.line_count").cast("bigint").alias("line_count"), F.col("x.block_count").cast("bigint").alias("block_count"))


def structured_documents(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", y.structured(F.col("text")).alias("x"))
    return rows.select("doc_id", "x.strategy", F.md5(F.col("x.sthayi").cast("binary")).alias("sthayi_md5"), F.size("x.paragraphs").cast("bigint").alias("n_paragraphs"), F.col("x.line_count").cast("bigint").alias("line_count"))


def structure_scores(spark, sf):
    docs_ = table(spark, sf, "documents").select("doc_id", y.structured(F.col("text")).alias("x"), F.split(F.coalesce("text", F.lit("")), "\n", 2)[0].alias("title"))
    rows = docs_.select("doc_id", y.scored(F.col("x"), F.col("title")).alias("s"))
    return rows.select("doc_id", F.col("s.score").cast("bigint").alias("score"), "s.tier", F.array_join("s.reasons", ",").alias("reasons"), F.array_join("s.flags", ",").alias("flags"), "s.auto_format", "s.review", "s.manual")


def refrain_tails(spark, sf):
    return texts(spark, sf).select("doc_id", y.refrain_tail(y.lines_of(F.col("text"))).alias("tail"))


def opening_repeats(spark, sf):
    """Turns as stanzas, the first one repeated at the end."""
    stanzas = F.transform(F.concat("xs", F.slice("xs", 1, 1)), lambda x: x.text)
    rows = turns(spark, sf).select("doc_id", F.size("xs").alias("n"), F.posexplode(y.without_opening_repeats(stanzas)).alias("pos", "stanza"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "stanza")


def hook_phrases(spark, sf):
    return texts(spark, sf).select("doc_id", F.array_join(y.hooks(y.lines_of(F.col("text")), F.col("title")), "|").alias("hooks"))


def refrain_lines(spark, sf):
    """Lines that only repeat a hook of their own text."""
    rows = texts(spark, sf).select("doc_id", y.lines_of(F.col("text")).alias("lines"), y.hooks(y.lines_of(F.col("text")), F.col("title")).alias("hooks"))
    rows = rows.select("doc_id", "hooks", F.posexplode("lines").alias("pos", "line"))
    return rows.where(y.is_refrain_only(F.col("line"), F.col("hooks"))).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


def heading_lines(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(y.is_heading(F.col("line"))).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


def sanitised_stanzas(spark, sf):
    return texts(spark, sf).select("doc_id", y.sanitised(F.col("text")).alias("text"))


def tunes(spark, sf):
    """Texts whose first line names a tune, by id modulo 3."""
    k, x = F.col("doc_id") % 3, F.col("text")
    named = F.when(k == 0, F.concat(F.lit("\nतर्ज: x "), x)).when(k == 1, F.concat(F.lit("(तर्ज - a b) (फिल्म: c) rest\n"), x)).otherwise(x)
    return texts(spark, sf).select("doc_id", y.tune(named).alias("t")).select("doc_id", "t.tarz", "t.rest")


def refrain_suffixes(spark, sf):
    return texts(spark, sf).select("doc_id", y.refrain_suffix(F.col("title")).alias("suffix"), y.with_refrain(F.col("text"), y.refrain_suffix(F.col("title"))).alias("text"))


def verse_marks(spark, sf):
    """Marks put behind titles by id: numbers, a word, a double mark; then read and cut."""
    k = F.col("doc_id") % 4
    line = F.concat("title", F.when(k == 0, " ॥१२॥").when(k == 1, " || टेर ||").when(k == 2, " ॥").otherwise(""))
    rows = texts(spark, sf).select("doc_id", line.alias("line"))
    return rows.select("doc_id", t.without_verse_numbers(F.col("line")).alias("bare"), t.end_marker(F.col("line")).marker.alias("marker"), t.end_marker(F.col("line")).body.alias("body"),
                       t.without_refrain_shorthand(F.concat("line", F.lit(" again..."))).alias("cut"), t.deva_digits(F.col("doc_id")).alias("number"))


QUERIES = {f.__name__: f for f in (
    model_fields, editor_fields, flattened_lyrics, lyric_lines, mapped_lyrics, resolved_flags, prepared_listings, listing_badges, section_defaults, search_items, search_index_roundtrip, search_titles,
    parsed_docs, schema_lint, schema_counts, issues_roundtrip, deprecated_keys, renderable_docs, structured_texts, structured_documents, structure_scores, refrain_tails, opening_repeats, hook_phrases,
    refrain_lines, heading_lines, sanitised_stanzas, tunes, refrain_suffixes, verse_marks)}

# --- SQL ---
_T = """c AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS i, role, coalesce(text, '') AS text FROM conversations),
    f AS (SELECT conv_id AS doc_id, text AS first, string_split(text, chr(10))[1] AS title FROM c WHERE i = 0),
    j AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS whole, string_agg(text, chr(10) ORDER BY i) FILTER (text <> '') AS flat,
        string_agg(CASE WHEN i > 0 AND role = 'assistant' THEN text ELSE translate(text, 'aeiou', 'AEIOU') END, chr(10) ORDER BY i) FILTER (text <> '') AS upped FROM c GROUP BY conv_id),
    x AS (SELECT doc_id, first, title, whole, CASE WHEN doc_id % 4 = 2 THEN whole ELSE coalesce(flat, '') END AS flat, CASE WHEN doc_id % 4 = 2 THEN translate(whole, 'aeiou', 'AEIOU') ELSE coalesce(upped, '') END AS upped, 's' || doc_id % 3 AS section FROM f JOIN j USING (doc_id))"""
_LINES = r"""l AS (SELECT doc_id, title, list_filter(list_transform(string_split(whole, chr(10)), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS ls FROM x)"""
_HOOKS = r"""h AS (SELECT doc_id, ls, list_filter(list_distinct([trim(title), CASE WHEN instr(trim(title), ',') > 1 THEN trim(string_split(trim(title), ',')[1]) END, nullif(trim(string_split(ls[1], ',')[1]), '')]), lambda v: v IS NOT NULL AND length(v) >= 6) AS hooks FROM l)"""


def _slug_sql(x: str) -> str:
    return rf"""coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(nfc_normalize({x})), '[\\/:*?"<>|]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 80), ''), 'bhajan')"""


_LISTINGS = f"""g AS (SELECT doc_id, section, section AS home_section, false AS is_cross_listed FROM x UNION ALL SELECT doc_id, 's' || doc_id % 5, section, true FROM x WHERE 's' || doc_id % 5 <> section AND doc_id % 5 < 3),
    n AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY doc_id) AS number FROM g),
    m AS (SELECT n.*, x.title, x.flat, n.section || '-' || {_slug_sql("coalesce(nullif(trim(x.title), ''), 'Untitled')")} || '-' || CASE WHEN number < 10 THEN '0' ELSE '' END || number AS id FROM n JOIN x USING (doc_id))"""
_ITEMS = rf"""WITH {_T}, {_LISTINGS}, k AS (SELECT *, list_filter(list_transform(string_split(flat, chr(10)), lambda v: regexp_replace(regexp_replace(v, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS lines FROM m)
    SELECT CAST(doc_id AS VARCHAR) AS path, section, title, id, len(lines) AS n_lines, md5(array_to_string(lines, chr(10))) AS lines_md5, section || '.html#' || id AS href, home_section FROM k"""
_PARAS = "p AS (SELECT conv_id AS doc_id, count(*) AS n_paragraphs, md5(string_agg(CASE WHEN role = 'assistant' THEN 'commentary' ELSE 'antara' END || ':' || text, '|' ORDER BY i)) AS paragraphs_md5 FROM c WHERE i > 0 GROUP BY conv_id)"
_LINT = f"""WITH {_T}, r AS (SELECT *, doc_id % 8 AS k, EXISTS (SELECT 1 FROM c WHERE conv_id = doc_id AND i > 0) AS more, len(string_split(first, chr(10))) AS h FROM x)
    SELECT CAST(doc_id AS VARCHAR) AS path, 'warning' AS severity, 'utf8_bom' AS code, NULL::VARCHAR AS key, 1::BIGINT AS line FROM r WHERE k = 7
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'error', 'missing_title', NULL, NULL FROM r WHERE k = 1
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'error', 'empty_title', NULL, 1 FROM r WHERE k = 2
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'error', 'unknown_doc_key', 'colour', 2 FROM r WHERE k = 3
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'error', 'invalid_also_in', 's' || doc_id, NULL FROM r WHERE k = 4 AND doc_id > 2
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'error', 'unknown_lyrics_key', 'tempo', 3 FROM r WHERE k = 5
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'error', 'empty_lyrics', NULL, NULL FROM r WHERE k = 5
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'error', 'parse_drop', 'sthayi', NULL FROM r WHERE k = 5
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'error', 'parse_drop', 'paragraphs', NULL FROM r WHERE k = 5
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'warning', 'deprecated_key', 'dhvani', 3 FROM r WHERE k = 6"""
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

_NORM = r"trim(regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '[॥|]', '', 'g'))"
_BODY = r"trim(regexp_replace({x}, '(\s*(\|\|\s*[^|]+\s*\|\|)|(\s*॥+))\s*$', ''))"
_BARE = r"trim(regexp_replace(regexp_replace(regexp_replace({x}, '!+[0-9]+!+', '', 'g'), '\|\|\s*[0-9]+\s*\|\|', '', 'g'), '\s\s+', ' ', 'g'))"


def _repeats_sql(line: str, hooks: str) -> str:
    """Whether a line is blank, cut by ellipses, or only repeats a hook."""
    body, short = _BODY.format(x=line), "string_split(hook, ',')[1]"
    one = f"""list_bool_or([false] || list_transform({hooks}, lambda hook: {_NORM.format(x='hook')} <> '' AND ({_NORM.format(x=body)} = {_NORM.format(x='hook')} OR length({_NORM.format(x=short)}) >= 8 AND {_NORM.format(x=body)} = {_NORM.format(x=short)}
        OR length({_NORM.format(x=short)}) >= 10 AND starts_with({_NORM.format(x=body)}, {_NORM.format(x=short)}) AND length({body}) <= length(hook) + 10 AND NOT contains({body}, ','))))"""
    return f"({line} = '' OR contains({line}, '...') OR (NOT (contains({body}, ',') AND length({body}) > 48) AND {one}))"


_STANZAS = rf"""w AS (SELECT doc_id, regexp_replace(regexp_replace(whole, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM x),
    ln AS (SELECT doc_id, body, list_filter(list_transform(string_split(body, chr(10)), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS ls,
        list_filter(list_transform(string_split_regex(body, '\n\s*\n+'), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS bs FROM w),
    hk AS (SELECT *, list_filter([trim(string_split(ls[1], ',')[1])], lambda v: v IS NOT NULL AND length(v) >= 6) AS hooks FROM ln),
    bl AS (SELECT doc_id, hooks, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM hk),
    bq AS (SELECT doc_id, i, hooks, list_filter(list_transform(string_split(b, chr(10)), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS bls FROM bl),
    bu AS (SELECT doc_id, i, hooks, unnest(bls) AS v, generate_subscripts(bls, 1) AS k FROM bq),
    sz AS (SELECT doc_id, i, string_agg(v, chr(10) ORDER BY k) AS s, regexp_replace(string_agg({_BARE.format(x='v')}, ' ' ORDER BY k), '\s+', ' ', 'g') AS flat FROM bu WHERE NOT {_repeats_sql('v', 'hooks')} GROUP BY doc_id, i),
    so AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, first_value(flat) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM sz),
    st AS (SELECT doc_id, list(s ORDER BY i) AS xs FROM so WHERE r = 1 OR NOT (flat <> '' AND head <> '' AND (flat = head OR starts_with(flat, head[:40]) OR starts_with(head, flat[:40]))) GROUP BY doc_id),
    ou AS (SELECT doc_id, ls, len(ls) AS n, len(bs) AS k, coalesce(xs, []) AS xs, len(xs) > 1 AND NOT contains(xs[1], chr(10)) AND contains(xs[2], chr(10)) AND len(string_split(xs[2], chr(10))) <= 4 AS joins FROM hk LEFT JOIN st USING (doc_id)),
    fi AS (SELECT doc_id, CASE WHEN k >= 2 AND len(xs) = 0 THEN 'empty-blocks' WHEN k >= 2 THEN 'stanza-blocks' WHEN n >= 2 THEN 'first-line-sthayi' WHEN n = 1 THEN 'single-line' ELSE 'empty' END AS strategy,
        CASE WHEN k >= 2 AND len(xs) = 0 OR n = 0 THEN '' WHEN k >= 2 AND joins THEN xs[1] || chr(10) || xs[2] WHEN k >= 2 THEN xs[1] ELSE {_BODY.format(x='ls[1]')} END AS sthayi,
        CASE WHEN k >= 2 AND joins THEN xs[3:] WHEN k >= 2 THEN xs[2:] WHEN n >= 2 THEN list_transform(ls[2:], lambda v: {_BARE.format(x='v')}) ELSE [] END AS ps, n AS line_count, CASE WHEN k >= 2 THEN k WHEN n > 0 THEN 1 ELSE 0 END AS block_count FROM ou)"""

SQL = {
    "model_fields": f"""WITH {_T}, a AS (SELECT doc_id, 0 AS o, 'title' AS field, NULL::VARCHAR AS kind, title AS text FROM x
        UNION ALL SELECT doc_id, 1, 'lyrics', NULL, whole FROM x WHERE doc_id % 4 = 2 UNION ALL SELECT doc_id, 1, 'lyrics.sthayi', NULL, first FROM x WHERE doc_id % 4 < 2
        UNION ALL SELECT conv_id, 1 + i, 'lyrics.paragraphs[' || i - 1 || ']', CASE WHEN role = 'assistant' THEN 'commentary' ELSE 'antara' END, text FROM c WHERE conv_id % 4 < 2 AND i > 0)
        SELECT CAST(doc_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS field_pos, field, kind, text FROM a WHERE text <> ''""",
    "editor_fields": f"""WITH {_T}, a AS (SELECT doc_id, 0 AS o, 'title' AS field, NULL::VARCHAR AS kind, title AS text FROM x UNION ALL SELECT doc_id, 1, 'lyrics.sthayi', NULL, first FROM x WHERE doc_id % 4 < 2
        UNION ALL SELECT conv_id, 1 + i, 'paragraph', CASE WHEN role = 'assistant' THEN 'commentary' ELSE 'antara' END, text FROM c WHERE conv_id % 4 < 2 AND i > 0 UNION ALL SELECT doc_id, 1000000, 'legacy', NULL, whole FROM x WHERE doc_id % 4 = 2)
        SELECT CAST(doc_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS field_pos, field, kind, text FROM a WHERE text <> ''""",
    "flattened_lyrics": f"WITH {_T} SELECT doc_id, flat AS text FROM x",
    "lyric_lines": rf"""WITH {_T}, k AS (SELECT doc_id, list_filter(list_transform(string_split(flat, chr(10)), lambda v: regexp_replace(regexp_replace(v, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS lines FROM x)
        SELECT doc_id, CAST(generate_subscripts(lines, 1) - 1 AS BIGINT) AS pos, unnest(lines) AS line FROM k""",
    "mapped_lyrics": f"WITH {_T} SELECT doc_id, upped AS text FROM x",
    "resolved_flags": f"WITH {_T}, r AS (SELECT doc_id, doc_id % 5 <> 1 AND section <> 's2' AS up FROM x) SELECT doc_id, CASE WHEN up THEN true END AS sthayi_connect, CASE WHEN up AND doc_id % 4 = 3 THEN true END AS part_connect FROM r",
    "prepared_listings": f"WITH {_T}, {_LISTINGS} SELECT section, doc_id, coalesce(nullif(trim(title), ''), 'Untitled') AS title, id, CASE WHEN doc_id % 5 <> 1 AND section <> 's2' THEN true END AS connect FROM m",
    "listing_badges": f"WITH {_T}, {_LISTINGS} SELECT section, doc_id, doc_id % 2 = 0 AND section <> 's0' AS self_badge, CASE WHEN is_cross_listed AND NOT (doc_id % 2 = 0 AND section <> 's0' AND home_section = 's0') THEN upper(home_section) END AS from_title FROM m",
    "section_defaults": "SELECT lang AS slug, CASE WHEN lang = 'en' THEN 'b.jpg' ELSE 'assets/icons/' || lang || '.jpg' END AS banner, CASE WHEN lang = 'de' THEN 'file' ELSE 'title' END AS sort, count(*) % 2 = 0 AS grouped, 'भजन' AS count_unit FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "search_items": _ITEMS,
    "search_index_roundtrip": _ITEMS,
    "search_titles": rf"""WITH {_T}, q AS (SELECT doc_id AS query_id, list_distinct(list_filter(string_split(lower(array_to_string(string_split(title, ' ')[2:], ' ')), ' '), lambda v: v <> '')) AS ws FROM x),
        b AS (SELECT doc_id, -1 AS line_no, lower(title) AS line, '' AS shown FROM x UNION ALL SELECT doc_id, generate_subscripts(string_split(flat, chr(10)), 1) - 1, lower(trim(regexp_replace(unnest(string_split(flat, chr(10))), '\s+', ' ', 'g'))), trim(regexp_replace(unnest(string_split(flat, chr(10))), '\s+', ' ', 'g')) FROM x),
        h AS (SELECT query_id, doc_id, min(line_no) AS line_no FROM q JOIN b ON len(ws) > 0 AND contains(b.line, ws[1]) AND len(list_filter(ws, lambda v: NOT contains(b.line, v))) = 0 GROUP BY query_id, doc_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank, doc_id, line_no FROM h)
        SELECT query_id, rank, doc_id, line_no < 0 AS in_title, CASE WHEN length(shown) > 100 THEN shown[:99] || '…' ELSE shown END AS snippet FROM r JOIN b USING (doc_id, line_no) WHERE rank <= 15""",
    "parsed_docs": rf"""WITH {_T}, {_PARAS} SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 8 NOT IN (1, 2) THEN trim(title) END AS title, CASE WHEN doc_id % 8 <> 5 THEN regexp_replace(first, '\n+$', '') END AS sthayi,
        CASE WHEN doc_id % 8 = 5 THEN 0 ELSE coalesce(n_paragraphs, 0) END AS n_paragraphs, CASE WHEN doc_id % 8 = 5 THEN NULL ELSE coalesce(paragraphs_md5, md5('')) END AS paragraphs_md5,
        CASE WHEN doc_id % 8 = 6 THEN 'closing' END AS post, CASE WHEN doc_id % 8 = 4 THEN 's1,s' || doc_id END AS also_in FROM x LEFT JOIN p USING (doc_id)""",
    "schema_lint": _LINT,
    "schema_counts": f"SELECT severity, code, count(DISTINCT path) AS n_docs, count(*) AS n FROM ({_LINT}) GROUP BY severity, code",
    "issues_roundtrip": _LINT,
    "deprecated_keys": f"WITH {_T} SELECT CAST(doc_id AS VARCHAR) AS path, 'dhvani' AS key, 'post_shlok' AS replacement, 3::BIGINT AS line FROM x WHERE doc_id % 8 = 6",
    "renderable_docs": f"WITH {_T} SELECT doc_id, doc_id % 8 <> 0 AND trim(whole) <> '' AS renderable, CASE WHEN doc_id % 8 = 0 THEN false ELSE trim(first) <> '' END AS has_refrain, '' AS post FROM x",
    "refrain_tails": rf"""WITH {_T}, {_LINES}, a AS (SELECT doc_id, ls, list_transform(ls, lambda v: coalesce(nullif(trim(string_split_regex(v, '[,،]')[-1]), ''), trim(v))) AS p FROM l),
        b AS (SELECT doc_id, list_transform(range(1, len(ls) + 1), lambda k: CASE WHEN length(p[k]) >= 12 THEN p[k] ELSE trim(ls[k][-40:]) END) AS ts FROM a)
        SELECT doc_id, CASE WHEN len(ts) >= 2 AND length(ts[1]) >= 8 AND len(list_filter(ts[2:], lambda v: contains(v, ts[1]) OR contains(ts[1], v))) >= greatest(1, CAST(floor((len(ts) - 1) * 0.45) AS INT)) THEN ts[1] END AS tail FROM b""",
    "hook_phrases": f"WITH {_T}, {_LINES}, {_HOOKS} SELECT doc_id, array_to_string(list_filter([trim(title), CASE WHEN instr(trim(title), ',') > 1 THEN trim(string_split(trim(title), ',')[1]) END, CASE WHEN trim(string_split(ls[1], ',')[1]) NOT IN (trim(title), CASE WHEN instr(trim(title), ',') > 1 THEN trim(string_split(trim(title), ',')[1]) ELSE '' END) THEN trim(string_split(ls[1], ',')[1]) END], lambda v: v IS NOT NULL AND length(v) >= 6), '|') AS hooks FROM l",
    "heading_lines": r"""WITH u AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)
        SELECT * FROM u WHERE length(regexp_replace(line, '^\s+|\s+$', '', 'g')) BETWEEN 1 AND 60 AND regexp_matches(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^[A-Za-z\s]+$')""",
    "sanitised_stanzas": rf"""WITH {_T}, {_LINES} SELECT doc_id, array_to_string(list_transform(ls, lambda v: trim(regexp_replace(v, '\s\s+', ' ', 'g'))), chr(10)) AS text FROM l""",
    "tunes": rf"""WITH {_T} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN trim('x ' || string_split(whole, chr(10))[1]) WHEN 1 THEN 'a b (c)' END AS tarz,
        CASE doc_id % 3 WHEN 0 THEN chr(10) || array_to_string(string_split(whole, chr(10))[2:], chr(10)) WHEN 1 THEN 'rest' || chr(10) || whole ELSE whole END AS rest FROM x""",
    "verse_marks": rf"""WITH {_T} SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 4 = 1 THEN title WHEN doc_id % 4 = 2 THEN title || ' ॥' ELSE title END, '\s\s+', ' ', 'g')) AS bare,
        CASE doc_id % 4 WHEN 1 THEN 'टेर' WHEN 2 THEN '॥' WHEN 0 THEN '॥' END AS marker, CASE WHEN doc_id % 4 = 0 THEN trim(title || ' ॥१२') ELSE trim(title) END AS body,
        CASE WHEN doc_id % 4 = 0 THEN trim(title || ' ॥१२॥') WHEN doc_id % 4 = 2 THEN trim(title || ' ॥') ELSE trim(regexp_replace(trim(title || CASE WHEN doc_id % 4 = 1 THEN ' || टेर ||' ELSE '' END || ' again...'), '\s+.+?\.\.\.\s*$', '')) END AS cut,
        translate(CAST(doc_id AS VARCHAR), '0123456789', '०१२३४५६७८९') AS number FROM x""",
    "opening_repeats": rf"""WITH {_T}, s AS (SELECT conv_id, i, text FROM c UNION ALL SELECT conv_id, 1000000, text FROM c WHERE i = 0),
        w AS (SELECT conv_id, i, text, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(regexp_replace(regexp_replace(v, '^\s+|\s+$', '', 'g'), '\s\s+', ' ', 'g'))), lambda v: v <> ''), ' ') AS flat FROM s WHERE text <> ''),
        o AS (SELECT conv_id, arg_min(flat, i) AS f, min(i) AS first_i FROM w GROUP BY conv_id)
        SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS pos, text AS stanza FROM w JOIN o USING (conv_id) WHERE i = first_i OR NOT (flat <> '' AND f <> '' AND (flat = f OR starts_with(flat, f[:40]) OR starts_with(f, flat[:40])))""",
    "refrain_suffixes": rf"""WITH {_T}, ws AS (SELECT *, list_filter(list_transform(string_split(trim(regexp_replace(title, '\s+', ' ', 'g')), ' '), lambda v: regexp_replace(v, '^[,;:.!?\-–—]+|[,;:.!?\-–—]+$', '', 'g')), lambda v: v <> '') AS ws FROM x),
        s AS (SELECT *, CASE WHEN len(ws) > 3 THEN array_to_string(ws[1:3], ' ') || '...' ELSE nullif(array_to_string(ws, ' '), '') END AS suffix, regexp_replace(whole, '^\s+|\s+$', '', 'g') AS body FROM ws),
        l AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS ls FROM s)
        SELECT doc_id, suffix, CASE WHEN suffix IS NULL THEN body WHEN contains(body, chr(10)) THEN array_to_string(ls, chr(10)) || '....' || suffix ELSE body || '....' || suffix END AS text FROM l""",
    "structured_documents": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS ls FROM documents)
        SELECT doc_id, CASE WHEN len(ls) >= 2 THEN 'first-line-sthayi' WHEN len(ls) = 1 THEN 'single-line' ELSE 'empty' END AS strategy, md5(coalesce(ls[1], '')) AS sthayi_md5, greatest(0, len(ls) - 1) AS n_paragraphs, len(ls) AS line_count FROM l""",
    "structure_scores": r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS title, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS raw FROM documents),
        k AS (SELECT doc_id, title, list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN i = 1 THEN raw[i] ELSE trim(regexp_replace(raw[i], '\s\s+', ' ', 'g')) END) AS ls FROM l),
        p AS (SELECT *, list_transform(ls, lambda v: coalesce(nullif(trim(string_split_regex(v, '[,،]')[-1]), ''), trim(v))) AS p, len(ls) - 1 AS n FROM k),
        t AS (SELECT *, list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN length(p[i]) >= 12 THEN p[i] ELSE trim(ls[i][-40:]) END) AS ts FROM p),
        r AS (SELECT *, n >= 1 AND length(ts[1]) >= 8 AND len(list_filter(ts[2:], lambda v: contains(v, ts[1]) OR contains(ts[1], v))) >= greatest(1, CAST(floor(n * 0.45) AS INT)) AS tail,
            len(list_filter(ls, lambda v: length(v) <= 60 AND regexp_matches(v, '^[A-Za-z\s]+$'))) > 0 AS heading, trim(title) <> '' AND trim(title) = trim(ls[1]) AS same FROM t),
        s AS (SELECT *, CASE WHEN n < 0 THEN 0 ELSE greatest(0, least(100, CASE WHEN n >= 1 THEN 72 + CASE WHEN tail THEN 14 ELSE 0 END + CASE WHEN n BETWEEN 2 AND 15 THEN 8 WHEN n > 20 THEN -12 WHEN n > 15 THEN -4 ELSE 0 END ELSE 38 END
            - CASE WHEN heading THEN 35 ELSE 0 END - CASE WHEN n + 1 > 35 THEN 10 ELSE 0 END - CASE WHEN same THEN 15 ELSE 0 END)) END AS score FROM r)
        SELECT doc_id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS tier,
            CASE WHEN n < 0 THEN 'empty-lyrics' ELSE array_to_string(list_filter([CASE WHEN n >= 1 THEN 'one-line-per-paragraph' END, CASE WHEN n >= 1 AND tail THEN 'refrain-hook-in-most-lines' END, CASE WHEN n BETWEEN 2 AND 15 THEN 'typical-bhajan-shape' END, CASE WHEN n = 0 THEN 'only-one-line' END], lambda v: v IS NOT NULL), ',') END AS reasons,
            CASE WHEN n < 0 THEN 'empty' ELSE array_to_string(list_filter([CASE WHEN n > 20 THEN 'many-single-line-paragraphs' END, CASE WHEN n BETWEEN 16 AND 20 THEN 'long-song-many-verses' END, CASE WHEN n = 0 THEN 'needs-manual-structure' END, CASE WHEN heading THEN 'heading-line-in-lyrics' END, CASE WHEN n + 1 > 35 THEN 'very-long-song' END, CASE WHEN same THEN 'sthayi-equals-title' END], lambda v: v IS NOT NULL), ',') END AS flags,
            score >= 80 AS auto_format, score BETWEEN 60 AND 79 AS review, score < 60 AS manual FROM s""",
    "refrain_lines": f"WITH {_T}, {_LINES}, {_HOOKS}, rl AS (SELECT doc_id, hooks, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS pos FROM h) SELECT doc_id, pos, line FROM rl WHERE {_repeats_sql('line', 'hooks')}",
    "structured_texts": f"WITH {_T}, {_STANZAS} SELECT doc_id, strategy, sthayi, len(ps) AS n_paragraphs, array_to_string(ps, chr(10) || chr(10)) AS paragraphs, line_count, block_count FROM fi",
}
