"""Queries of decisions, unknown words by field, edits, names, matches, files and Devanagari views over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.functions import text as t
from lekha.operators import documents as d
from lekha.operators import edits, lint, listings
from lekha.operators import words as w
from lekha.plans import modelling, publishing, registry
from lekha.plans.registry import PROFILE
from lekha.plans.shared import new_path, table
from lekha.sources import files, records

#: A view of the texts in another script: letters, vowel signs, digits and a closing mark.
LATIN = "abcdefghijklmnopqrstuvwxyz0123456789."
DEVANAGARI = "ाबचदेफगहिजकलमनोपतरसटुवठयडढ०१२३४५६७८९।"


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


def deva_docs(spark, sf) -> DataFrame:
    return _docs(spark, sf).withColumn("text", F.translate(F.lower("text"), LATIN, DEVANAGARI))


def deva_dictionary(spark, sf):
    return w.dictionary(deva_docs(spark, sf), "devanagari")


def deva_word_counts(spark, sf):
    """The variant scan's tokens: marks stay, stop words and lengths beyond 30 go."""
    return w.word_counts(deva_docs(spark, sf), "devanagari").select("word", "n")


def deva_replace(spark, sf):
    """Cleaned forms: a run is replaced whole, with the marks at its edges."""
    counts = w.word_counts(deva_docs(spark, sf), "devanagari", cleaned=True)
    pairs = counts.where("n >= 100").select("word", F.concat(F.lit("<"), "word", F.lit(">")).alias("canonical"))
    out = w.replaced_words(deva_docs(spark, sf), pairs, "devanagari", cleaned=True)
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_replaced")


def _clusters(spark, sf):
    return w.skeleton_clusters(w.word_counts(_docs(spark, sf), PROFILE, 2), PROFILE)


def _decisions(spark, sf):
    """Saved decisions: clusters whose id begins with 0 to 7 are to be fixed, to their last form."""
    base = w.default_decisions(_clusters(spark, sf))
    path = new_path(spark, "decisions")
    records.write_decisions(base.where("id < '8'").select("id", F.lit("fix").alias("action"), F.element_at("forms", -1).alias("canonical")), path)
    return records.read_decisions(spark, path, base)


def skeleton_pairs(spark, sf):
    return w.skeleton_pairs(w.word_counts(_docs(spark, sf), PROFILE, 2), PROFILE)


def decisions(spark, sf):
    return _decisions(spark, sf).select("id", "action", "canonical", F.array_join("replace", ",").alias("replace"))


def apply_decisions(spark, sf):
    out = w.applied_decisions(_docs(spark, sf), _decisions(spark, sf), PROFILE)
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_replaced")


def decision_hits(spark, sf):
    return w.decision_hits(_docs(spark, sf), _decisions(spark, sf), PROFILE)


def _flagged(spark, sf):
    return w.flagged_fields(modelling.model.collect_fields(modelling.docs(spark, sf)), w.dictionary(_docs(spark, sf), PROFILE), PROFILE)


def unknown_clusters(spark, sf):
    return w.unknown_clusters(_flagged(spark, sf))


def field_issues(spark, sf):
    return w.field_issues(_flagged(spark, sf))


def oov_allowed(spark, sf):
    """Unknown words of conversations, less an allow list: the benchmark's words."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("").alias("lang"), "text")
    allowed = w.dictionary(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("").alias("lang"), "text"), PROFILE)
    return w.unknown_words(turns, w.dictionary(_docs(spark, sf), PROFILE), PROFILE, allowed)


def apply_edits(spark, sf):
    """Edits are events: their user is the document, their value's whole part by ten the version that they were made on."""
    docs = _docs(spark, sf).select(F.col("doc_id").alias("path"), (F.col("doc_id") % 10).cast("string").alias("sha"), F.lit("old").alias("text"))
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "create").otherwise("update")
    made = table(spark, sf, "events").select((F.col("user_id") * 3).alias("path"), F.col("event_id").alias("version"), op.alias("op"), (F.floor("value") % 10).cast("string").alias("sha"), F.concat(F.lit("new"), F.col("event_id").cast("string")).alias("text"))
    return edits.apply_edits(docs, made)


def _existing(spark, sf):
    """The names of documents whose id is even: numbered in their section, some with a further number."""
    rows = listings.display_order(publishing._docs(spark, sf).where("doc_id % 2 = 0"), publishing._sections(spark).withColumn("sort", F.lit("file")))
    name = F.concat(F.format_string("%03d", "number"), F.lit("-"), t.slug(F.col("title")), F.when(F.col("doc_id") % 7 == 0, "-2").otherwise(""), F.lit(".yaml"))
    return rows.join(publishing._docs(spark, sf).select("doc_id", "title"), "doc_id").select(F.col("section").alias("folder"), "doc_id", "title", name.alias("name"))


def allocate_names(spark, sf):
    new = publishing._docs(spark, sf).where("doc_id % 2 = 1 and section is not null").select(F.col("section").alias("folder"), "doc_id", "title")
    return edits.allocate_names(new, _existing(spark, sf).select("folder", "name"))


def renamed(spark, sf):
    """Every third title gets a new end; names that a further number tells apart differ as well."""
    old = _existing(spark, sf)
    title = F.when(F.col("doc_id") % 3 == 0, F.concat("title", F.lit(" new"))).otherwise(F.col("title"))
    return edits.rename(old.withColumn("title", title), old.select("folder", "name"))


def ranked_matches(spark, sf):
    return d.ranked_matches(d.find_matches(_docs(spark, sf), "the", ignore_case=True))


def match_totals(spark, sf):
    return d.match_totals(d.find_matches(_docs(spark, sf), "t[hi]+[aeo]", True, True), _docs(spark, sf))


def find_regex(spark, sf):
    return d.find_matches(_docs(spark, sf), "t[hi]+[aeo]", ignore_case=True, regex=True)


def replace_regex(spark, sf):
    return d.replaced(_docs(spark, sf), "t(h)e", "T$1E", ignore_case=True, regex=True).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def replace_any_case(spark, sf):
    return d.replaced(_docs(spark, sf), "the", "$1", ignore_case=True).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def lint_details(spark, sf):
    return lint.details(_docs(spark, sf), publishing.RULES).select("doc_id", "rule_id", F.array_join("hits", " ").alias("hits"), F.md5(F.col("after").cast("binary")).alias("after_md5"))


def mixed_quotes(spark, sf):
    """Turns with a quotation that ends in another sign than it begins with."""
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.concat(F.lit("'"), "text", F.when(F.col("turn") % 2 == 0, '"').otherwise("'"), "text").alias("text"))
    quotes = tuple(r for r in lint.TYPOS if r.id == "mismatched_quotes")
    return lint.details(turns, quotes).select("doc_id", F.array_join("hits", " ").alias("hits"), "after")


def titles(spark, sf):
    """Slugs, anchors, names and their parts of titles."""
    name = F.concat(F.lit("a\\b/0"), (F.col("doc_id") % 9).cast("string"), F.lit("-"), F.when(F.col("doc_id") % 2 == 0, t.slug(F.col("title"))).otherwise("x"), F.lit(".YML"))
    rows = publishing._docs(spark, sf).where("section is not null").withColumn("name", name)
    parts = t.basename_parts(F.element_at(F.split("name", r"[\\/]"), -1))
    return rows.select("doc_id", t.slug(F.col("title")).alias("slug"), t.anchor_id(F.col("section"), F.col("title"), F.col("doc_id")).alias("anchor"), parts.prefix.alias("prefix"), parts.slug.alias("name_slug"),
                       t.slug_differs(F.col("name"), F.col("title")).alias("differs"), t.snippet(F.col("title"), 40).alias("snippet"))


def invalid_also_in(spark, sf):
    """Words of two letters as the sections that a document names; some are no section."""
    named = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))), lambda x: x.isin("de", "en", "la", "re"))
    return d.invalid_listings(_docs(spark, sf).withColumn("also_in", named), registry.sections(spark))


def collector_listings(spark, sf):
    """Sources stand for the sections' titles; the section en lists its documents there too."""
    docs = registry._also(_docs(spark, sf)).withColumn("group_name", F.col("source"))
    return d.cross_listings(docs, registry.sections(spark).withColumn("title", F.concat(F.lit("src"), F.col("section_pos"))), collector="en")


def listing_numbers(spark, sf):
    return listings.listing_numbers(publishing._docs(spark, sf), publishing._sections(spark))


def verse_group_numbers(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("text", F.regexp_replace("text", r"\.\n", "...\n\n"))
    return listings.verse_group_numbers(turns)


def collated_order(spark, sf):
    return listings.display_order(publishing._docs(spark, sf), publishing._sections(spark), collation="hi")


def collated_index(spark, sf):
    return listings.master_index(publishing._docs(spark, sf), publishing._sections(spark), collation="hi")


def wordlist_roundtrip(spark, sf):
    path = new_path(spark, "words")
    files.write_wordlist(w.dictionary(_docs(spark, sf), PROFILE), path)
    return files.read_wordlist(spark, path)


def files_roundtrip(spark, sf):
    """Benchmark texts as files of their own, by one partition each of a text sink; whole files are read back."""
    path = new_path(spark, "files")
    table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.regexp_replace("text", "\n", "\r\n").alias("value")).write.partitionBy("item").text(path)
    rows = files.read_documents(spark, f"{path}/*/*.txt")
    return rows.select(F.regexp_extract("path", "item=([0-9]+)", 1).cast("bigint").alias("item_id"), F.regexp_replace("text", "\n$", "").alias("text"))


def changed_docs(spark, sf):
    """What a repair changes, written by section and read back."""
    path, docs = new_path(spark, "changed"), _docs(spark, sf)
    new = d.replaced(docs, "the the", "the")
    after = docs.select("doc_id", F.col("lang").alias("section")).join(new, "doc_id")
    records.write_changed(docs, after, path)
    return spark.read.schema("doc_id long, text string, section string").parquet(path).select("doc_id", "section", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def repaired_count(spark, sf):
    return d.changed_count(_docs(spark, sf), d.repaired_ends(_docs(spark, sf)))


def selected_paths(spark, sf):
    return d.find_matches(d.only(_docs(spark, sf), table(spark, sf, "labels").where("quality = 1")), "the")


QUERIES = {f.__name__: f for f in (
    deva_dictionary, deva_word_counts, deva_replace, skeleton_pairs, decisions, apply_decisions, decision_hits, unknown_clusters, field_issues, oov_allowed, apply_edits, allocate_names, renamed, ranked_matches,
    match_totals, find_regex, replace_regex, replace_any_case, lint_details, mixed_quotes, titles, invalid_also_in, collector_listings, listing_numbers, verse_group_numbers, collated_order, collated_index,
    wordlist_roundtrip, files_roundtrip, changed_docs, repaired_count, selected_paths)}

_DEVA = f"v AS (SELECT doc_id, translate(lower(text), '{LATIN}', '{DEVANAGARI}') AS text FROM documents)"
_STOP = ", ".join(f"'{x}'" for x in t.STOP_WORDS)
_EDGE = "regexp_replace({x}, '^[0-9।-ॿ‌‍]+|[0-9।-ॿ‌‍]+$', '', 'g')"
_C2 = "c AS (SELECT word, count(*) AS n, regexp_replace(word, '[aeiou]', '', 'g') AS skeleton FROM t GROUP BY word HAVING count(*) >= 2)"
_GROUPS = f"{registry._TOKENS}, {_C2}, g AS (SELECT substr(md5(array_to_string(list_sort(list(word)), '|')), 1, 12) AS id, arg_min(word, struct_pack(n := -n, w := word)) AS first, list_sort(list(word)) AS forms FROM c WHERE skeleton <> '' GROUP BY skeleton HAVING count(*) > 1), s AS (SELECT id, CASE WHEN id < '8' THEN 'fix' ELSE 'ignore' END AS action, CASE WHEN id < '8' THEN forms[-1] ELSE first END AS canonical, forms FROM g)"
_FIELDS = modelling.SQL["model_fields"].replace("WITH ", "", 1).rsplit("SELECT", 1)[0]
_UNKNOWN = f"""WITH {_FIELDS}, w AS (SELECT doc_id, field, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM a WHERE text <> ''),
    z AS (SELECT CAST(doc_id AS VARCHAR) AS path, field, word, count(*) AS n FROM w WHERE length(word) >= 2 AND word NOT IN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents WHERE text IS NOT NULL) GROUP BY ALL)"""
_SLUG = modelling._slug_sql
_NAMES = f"""{publishing._D}, e AS (SELECT section AS folder, doc_id, title, row_number() OVER (PARTITION BY section ORDER BY doc_id) AS k FROM d WHERE doc_id % 2 = 0 AND section IN ('en', 'de', 'fr', 'es')),
    n AS (SELECT folder, doc_id, title, CASE WHEN k < 10 THEN '00' WHEN k < 100 THEN '0' ELSE '' END || k AS num, {_SLUG('title')} AS slug, CASE WHEN doc_id % 7 = 0 THEN '-2' ELSE '' END AS more FROM e)"""

SQL = {
    "deva_dictionary": f"WITH {_DEVA}, r AS (SELECT unnest(regexp_extract_all(text, '[ऀ-ॿ]+')) AS raw FROM v), k AS (SELECT DISTINCT {_EDGE.format(x='nfc_normalize(' + _EDGE.format(x='raw') + ')')} AS word FROM r) SELECT word FROM k WHERE length(word) >= 2",
    "deva_word_counts": f"WITH {_DEVA}, r AS (SELECT unnest(regexp_extract_all(text, '[ऀ-ॿ]+')) AS word FROM v) SELECT word, count(*) AS n FROM r WHERE length(word) BETWEEN 2 AND 30 AND word NOT IN ({_STOP}) GROUP BY word",
    "deva_replace": f"""WITH {_DEVA}, x AS (SELECT doc_id, unnest(y) AS piece, generate_subscripts(y, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[ऀ-ॿ]+|[^ऀ-ॿ]+') AS y FROM v)),
        k AS (SELECT *, CASE WHEN regexp_matches(piece, '^[ऀ-ॿ]') THEN {_EDGE.format(x='piece')} END AS word FROM x), m AS (SELECT word FROM k WHERE length(word) >= 2 GROUP BY word HAVING count(*) >= 100)
        SELECT doc_id, md5(string_agg(CASE WHEN m.word IS NULL THEN piece ELSE '<' || m.word || '>' END, '' ORDER BY pos)) AS text_md5, count(m.word) AS n_replaced FROM k LEFT JOIN m ON k.word = m.word GROUP BY doc_id HAVING count(m.word) > 0""",
    "skeleton_pairs": f"WITH {registry._TOKENS}, {_C2}, m AS (SELECT word, min(word) OVER (PARTITION BY skeleton) AS a FROM c) SELECT a, word AS b FROM m WHERE a <> word",
    "decisions": f"WITH {_GROUPS} SELECT id, action, canonical, array_to_string(list_filter(forms, lambda x: x <> canonical), ',') AS replace FROM s",
    "apply_decisions": f"""WITH {_GROUPS}, m AS (SELECT canonical, word FROM (SELECT canonical, unnest(forms) AS word FROM s WHERE action = 'fix') WHERE word <> canonical),
        x AS (SELECT doc_id, unnest(y) AS piece, generate_subscripts(y, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+|[^a-z]+') AS y FROM documents))
        SELECT doc_id, md5(string_agg(coalesce(canonical, piece), '' ORDER BY pos)) AS text_md5, count(canonical) AS n_replaced FROM x LEFT JOIN m ON piece = word GROUP BY doc_id HAVING count(canonical) > 0""",
    "decision_hits": f"""WITH {_GROUPS}, m AS (SELECT id, canonical, word FROM (SELECT id, canonical, unnest(forms) AS word FROM s WHERE action = 'fix') WHERE word <> canonical),
        x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents) SELECT id, word, canonical, count(*) AS n_docs FROM m JOIN x USING (word) GROUP BY ALL""",
    "unknown_clusters": f"{_UNKNOWN} SELECT word, CAST(sum(n) OVER (PARTITION BY word) AS BIGINT) AS total, path, field, n FROM z",
    "field_issues": f"{_UNKNOWN} SELECT path, count(*) AS n FROM z GROUP BY path",
    "oov_allowed": """WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE text IS NOT NULL UNION SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark),
        u AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) SELECT word, count(*) AS n, count(DISTINCT conv_id) AS n_docs FROM u WHERE length(word) >= 2 AND word NOT IN (SELECT word FROM k) GROUP BY word""",
    "apply_edits": """WITH x AS (SELECT doc_id AS path, CAST(doc_id % 10 AS VARCHAR) AS sha FROM documents),
        e AS (SELECT user_id * 3 AS path, arg_max(CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'create' ELSE 'update' END, event_id) AS op, arg_max(CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR), event_id) AS base, 'new' || max(event_id) AS new FROM events GROUP BY user_id),
        b AS (SELECT coalesce(x.path, e.path) AS path, x.path IS NOT NULL AS there, sha, op, base, new FROM x FULL JOIN e ON x.path = e.path),
        s AS (SELECT *, CASE WHEN op IS NULL THEN 'same' WHEN op = 'create' AND NOT there THEN 'created' WHEN op = 'update' AND there AND sha = base THEN 'updated' WHEN op = 'delete' AND there AND sha = base THEN 'deleted' ELSE 'conflict' END AS status FROM b)
        SELECT path, status, CASE WHEN status IN ('created', 'updated') THEN md5(new) WHEN status <> 'deleted' THEN sha END AS sha, CASE WHEN status IN ('created', 'updated') THEN new WHEN status <> 'deleted' AND there THEN 'old' END AS text FROM s""",
    "allocate_names": f"""WITH {_NAMES}, z AS (SELECT section AS folder, doc_id, title, coalesce((SELECT count(*) FROM n WHERE n.folder = d.section), 0) + row_number() OVER (PARTITION BY section ORDER BY doc_id) AS pos FROM d WHERE doc_id % 2 = 1 AND section IS NOT NULL)
        SELECT folder, doc_id, CASE WHEN pos < 10 THEN '00' WHEN pos < 100 THEN '0' ELSE '' END || pos || '-' || {_SLUG('title')} || '.yaml' AS name FROM z""",
    "renamed": f"""WITH {_NAMES}, w AS (SELECT folder, doc_id, num || '-' || slug || more || '.yaml' AS name, num, slug || more AS old, {_SLUG("CASE WHEN doc_id % 3 = 0 THEN title || ' new' ELSE title END")} AS s FROM n)
        SELECT folder, doc_id, name, num || '-' || s || '.yaml' AS new_name FROM w WHERE s <> old""",
    "ranked_matches": f"SELECT row_number() OVER (ORDER BY n DESC, doc_id) AS rank, doc_id, n FROM ({registry.SQL['find_matches']})",
    "match_totals": "WITH m AS (SELECT len(regexp_extract_all(text, '(?i)t[hi]+[aeo]')) AS n FROM documents) SELECT CAST(sum(n) AS BIGINT) AS n_matches, count(*) FILTER (n > 0) AS n_docs, count(*) AS n_scanned FROM m",
    "find_regex": "SELECT * FROM (SELECT doc_id, len(regexp_extract_all(text, '(?i)t[hi]+[aeo]')) AS n FROM documents) WHERE n > 0",
    "replace_regex": r"SELECT doc_id, md5(new) AS text_md5 FROM (SELECT doc_id, text, regexp_replace(text, '(?i)t(h)e', 'T\1E', 'g') AS new FROM documents) WHERE new <> text",
    "replace_any_case": "SELECT doc_id, md5(new) AS text_md5 FROM (SELECT doc_id, text, regexp_replace(text, '(?i)the', '$1', 'g') AS new FROM documents) WHERE new <> text",
    "lint_details": r"""SELECT * FROM (
        SELECT doc_id, 'doubled_word' AS rule_id, array_to_string(regexp_extract_all(text, 'the the'), ' ') AS hits, md5(nullif(replace(text, 'the the', 'the'), text)) AS after_md5 FROM documents
        UNION ALL SELECT doc_id, 'doubled_mark', array_to_string(regexp_extract_all(text, '[!?]{2,}'), ' '), md5(nullif(regexp_replace(text, '[!?]{2,}', '!', 'g'), text)) FROM documents
        UNION ALL SELECT doc_id, 'odd_sign', array_to_string(regexp_extract_all(text, '[$%#@|]+'), ' '), md5(nullif(regexp_replace(text, '[$%#@|]+', '', 'g'), text)) FROM documents) WHERE hits <> ''""",
    "mixed_quotes": r"""WITH q AS (SELECT conv_id || '-' || turn AS doc_id, '''' || text || CASE WHEN turn % 2 = 0 THEN '"' ELSE '''' END || text AS text FROM conversations),
        r AS (SELECT doc_id, text, array_to_string(regexp_extract_all(text, '''[^''"]*"|"[^"'']*'''), ' ') AS hits, regexp_replace(regexp_replace(text, '''([^''"]*)"', '''\1''', 'g'), '"([^"'']*)''', '''\1''', 'g') AS new FROM q)
        SELECT doc_id, hits, nullif(new, text) AS after FROM r WHERE hits <> ''""",
    "titles": rf"""WITH {publishing._D}, r AS (SELECT doc_id, section, title, {_SLUG('title')} AS slug FROM d WHERE section IS NOT NULL)
        SELECT doc_id, slug, section || '-' || slug || '-' || CASE WHEN doc_id < 9 THEN '0' ELSE '' END || doc_id + 1 AS anchor, '0' || doc_id % 9 AS prefix, CASE WHEN doc_id % 2 = 0 THEN slug ELSE 'x' END AS name_slug, doc_id % 2 = 1 AND slug <> 'x' AS differs,
            CASE WHEN length(trim(regexp_replace(title, '\s+', ' ', 'g'))) > 40 THEN trim(regexp_replace(title, '\s+', ' ', 'g'))[:39] || '…' ELSE trim(regexp_replace(title, '\s+', ' ', 'g')) END AS snippet FROM r""",
    "invalid_also_in": "SELECT DISTINCT section, doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS section FROM documents) WHERE section IN ('la', 're')",
    "collector_listings": f"WITH {registry._CROSS} SELECT * FROM listings UNION SELECT section, doc_id, true FROM documents JOIN {registry._SECTIONS_SQL} ON source = 'src' || section_pos WHERE lang = 'en' AND section <> 'en'",
    "listing_numbers": f"""WITH {publishing._D}, j AS (SELECT * FROM d JOIN s USING (section)), a AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN sort = 'file' OR grouped THEN '' ELSE title END, doc_id) AS anchor, min(doc_id) OVER (PARTITION BY section, group_name) AS seen, grouped OR count(group_name) OVER (PARTITION BY section) > 0 AS uses FROM j),
        l AS (SELECT section, doc_id, row_number() OVER (PARTITION BY section ORDER BY seen, CASE WHEN sort = 'file' THEN '' ELSE title END, doc_id) AS label FROM a WHERE group_name IS NOT NULL)
        SELECT a.section, a.doc_id, anchor, CASE WHEN uses THEN label ELSE anchor END AS label FROM a LEFT JOIN l USING (section, doc_id)""",
    "verse_group_numbers": r"""WITH q AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(regexp_replace(text, '\.\n', '...' || chr(10) || chr(10), 'g'), '\n[\t\f\r ]*\n\s*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS gs FROM conversations WHERE role = 'user'),
        u AS (SELECT conv_id, turn, CAST(generate_subscripts(gs, 1) - 1 AS BIGINT) AS pos, unnest(gs) AS g FROM q),
        f AS (SELECT *, trim(string_split(g, chr(10))[-1]) AS l FROM u), r AS (SELECT *, NOT contains(l, '....') AND (ends_with(l, '...') OR (ends_with(l, '..') AND length(l) < 48)) AS refrain FROM f)
        SELECT conv_id, turn, pos, CASE WHEN NOT refrain THEN CAST(sum(CASE WHEN refrain THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn, pos) AS BIGINT) END AS number FROM r""",
    "collated_order": f"WITH {publishing._D} SELECT section, doc_id, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN sort = 'file' THEN '' ELSE title END COLLATE hi, doc_id) AS number FROM d JOIN s USING (section)",
    "collated_index": f"WITH {publishing._D} SELECT doc_id, row_number() OVER (ORDER BY title COLLATE hi, doc_id) AS number FROM d JOIN s USING (section) WHERE NOT excluded",
    "wordlist_roundtrip": f"WITH {registry._TOKENS} SELECT DISTINCT word FROM t",
    "files_roundtrip": "SELECT item_id, text FROM benchmark",
    "changed_docs": "SELECT doc_id, lang AS section, md5(replace(text, 'the the', 'the')) AS text_md5 FROM documents WHERE contains(text, 'the the')",
    "repaired_count": f"SELECT (SELECT count(*) FROM ({registry.SQL['line_ends']})) AS n_changed, (SELECT count(*) FROM documents) AS n",
    "selected_paths": "SELECT doc_id, n FROM (SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE n > 0",
}
