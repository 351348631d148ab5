"""Queries of edit batches, names and the store over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.functions import text as t
from lekha.operators import documents as d
from lekha.operators import edits, listings, passages, postings, scans, words
from lekha.plans import correction, modelling, publishing, registry
from lekha.plans.shared import new_path, table, written
from lekha.sources import store


def _batch(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Events as edits, in order of their ids, of the documents of their users' ids.

    A view creates, a click updates, an error deletes, other events rename, within
    eight paths. Three in four are made on the text of the edit before on their path.
    """
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("sha"), "text")
    new = F.concat(F.lit("new"), F.col("event_id").cast("string"))
    op = F.when(F.col("event_type") == "view", "create").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "error", "delete").otherwise("rename")
    rows = table(spark, sf, "events").select("event_id", "user_id", op.alias("op"), new.alias("new"))
    before = rows.join(d.previous(rows, "user_id", "event_id", "new"), ["user_id", "event_id"], "left")
    moves = F.col("op") == "rename"
    return docs, before.select(
        F.col("user_id").alias("path"), F.col("event_id").alias("version"), "op", F.when(F.col("event_id") % 4 != 0, F.md5(F.col("previous").cast("binary"))).alias("sha"),
        F.when(moves, F.expr("user_id div 8 * 8 + event_id % 8")).alias("to"), F.when(~moves | (F.col("event_id") % 3 == 0), F.col("new")).alias("text"))


def _as_paths(spark, sf) -> tuple[DataFrame, DataFrame]:
    docs, made = _batch(spark, sf)
    return docs.withColumn("path", F.col("path").cast("string")), made.withColumns({"path": F.col("path").cast("string"), "to": F.col("to").cast("string")})


def edit_outcomes(spark, sf):
    return edits.apply_batch(*_as_paths(spark, sf))[0]


def edited_docs(spark, sf):
    out = edits.apply_batch(*_as_paths(spark, sf))[1]
    return out.select("path", "sha", "origin", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def names_in_one_folder(spark, sf):
    """All documents in one folder, renamed to their section: all of a section want one name."""
    docs = publishing._docs(spark, sf).where("section is not null")
    rows = docs.select(F.lit("all").alias("folder"), "doc_id", F.concat(F.lit("007-"), F.col("doc_id").cast("string"), F.lit(".yaml")).alias("name"), F.col("section").alias("title"))
    taken = docs.where("doc_id % 3 = 0").select(F.lit("all").alias("folder"), F.concat(F.lit("007-"), "section", F.when(F.col("doc_id") > 3, F.concat(F.lit("-"), F.col("doc_id").cast("string"))).otherwise(""), F.lit(".yaml")).alias("name"))
    return edits.rename(rows, taken).select("doc_id", "new_name")


def _stored(spark, sf) -> str:
    """A store of the documents, and a commit: a repair's changes, every 97th document removed, every benchmark text added."""
    path = new_path(spark, "store")
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("section"), "text")
    store.create(docs, path)
    fixed = docs.drop("text").join(d.replaced(docs, "the the", "the"), "doc_id").select(docs.columns)
    new = table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit("new").alias("section"), "text")
    store.commit(spark, path, fixed.unionByName(new), docs.where("doc_id % 97 = 0").select("doc_id"))
    return path


def store_commit(spark, sf):
    return store.read(spark, _stored(spark, sf)).select("doc_id", "section", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def store_versions(spark, sf):
    """Each version as it can still be read: documents and characters by section."""
    path = _stored(spark, sf)
    found = None
    for v in store.versions(spark, path):
        rows = store.read(spark, path, v).groupBy("section").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars")).withColumn("version", F.lit(v))
        found = rows if found is None else found.unionByName(rows)
    return found


def store_vacuum(spark, sf):
    """What is left by section, once the first version and the files that only it names are gone."""
    path = _stored(spark, sf)
    store.vacuum(spark, path, keep=1)
    (version,) = store.versions(spark, path)
    rows = store.read(spark, path).groupBy("section").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars"))
    return rows.withColumn("version", F.lit(version))


def cleaned_docs(spark, sf):
    """Documents and their tunes, less what a page builder leaves: license lines stand for its lines, in turn, and first lines for tunes."""
    left = ("Google Sites", "Report abuse", "SKIP to main content", "Skip to navigation", "Embedded Files", " Search this site\t", "DOCS_timing['x']", "window.WIZ_global", "Page built by Google Sites")
    line = F.element_at(F.array(*(F.lit(x) for x in left)), (F.col("doc_id") % 9 + 1).cast("int"))
    text = F.regexp_replace("text", F.lit("(?m)^licensed under .*$"), line)
    tune = F.when(F.col("doc_id") % 5 == 0, line).otherwise(F.split("text", "\n", 2)[0])
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(text, F.lit("\n \n"))).otherwise(text).alias("text"), tune.alias("tarz"))
    return d.cleaned_documents(docs, t.JUNK).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "tarz")


def _indexed(spark, sf) -> str:
    """An index of all documents, made in two calls."""
    path, docs = new_path(spark, "index"), table(spark, sf, "documents")
    for k in (0, 1):
        postings.add(docs.where(F.coalesce(F.col("doc_id") % 2, F.lit(0)) == k), path)
    return path


def search_index(spark, sf):
    """All benchmark texts in two batches of queries of one index."""
    path = _indexed(spark, sf)
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return postings.search(spark, path, queries.where("query_id % 2 = 0")).unionByName(postings.search(spark, path, queries.where("query_id % 2 = 1")))


def search_index_short(spark, sf):
    """The sections' names, words of two letters, as queries."""
    names = table(spark, sf, "documents").select(F.col("lang").alias("query_id"), F.col("lang").alias("query")).where("query is not null").distinct()
    return postings.search(spark, _indexed(spark, sf), names, most=None)


def gram_counts(spark, sf):
    return postings.gram_counts(spark, _indexed(spark, sf)).select("gram", "n")


def collated_listings(spark, sf):
    """All orders and numbers by title in Hindi order, from one stored rank."""
    docs, sections = listings.with_title_ranks(publishing._docs(spark, sf)), publishing._sections(spark)
    out = listings.listing_numbers(docs, sections).join(listings.display_order(docs, sections).withColumnRenamed("number", "display"), ["section", "doc_id"])
    out = out.join(passages.group_order(docs, sections).withColumnRenamed("number", "in_groups"), ["section", "doc_id"], "left")
    return out.join(listings.master_index(docs, sections).withColumnRenamed("number", "in_index"), "doc_id", "left").select("section", "doc_id", "anchor", "label", "display", "in_groups", "in_index")


def scan_retractions(spark, sf):
    """The scan's summary after documents went, others were replaced by benchmark texts, and words were dropped; and that of a fresh scan."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1").select("doc_id")
    trusted = words.dictionary(docs.join(labels, "doc_id", "left_semi"), registry.PROFILE)
    scanned, path = docs.join(labels, "doc_id", "left_anti").select("doc_id", "text"), new_path(spark, "scan")
    scans.scan(scanned, path, registry.PROFILE)
    new = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    scans.replace(spark, path, scanned.where("doc_id % 7 = 0"), None, registry.PROFILE)
    scans.replace(spark, path, new, new, registry.PROFILE)
    dropped = table(spark, sf, "benchmark").select(F.explode(t.clean_tokens(F.col("text"), registry.PROFILE)).alias("word")).distinct()
    return scans.summary(spark, path, trusted, dropped)


def vocab_sketches(spark, sf):
    """Distinct words by section and in all, exact, and whether the estimate of merged sketches is within three percent."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("section"), "text")
    path = new_path(spark, "sketches")
    for k in range(3):  # three runs of a part of the documents each
        scans.vocabulary_sketches(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k), registry.PROFILE).write.mode("append").parquet(path)
    found = scans.vocabulary_estimates(spark.read.schema("section string, sketch binary").parquet(path))
    exact = words.vocabulary_sizes(table(spark, sf, "documents"), registry.PROFILE)
    both = exact.withColumnRenamed("section", "s").join(found, F.col("s").eqNullSafe(F.col("section")))
    return both.select("section", "n_words", (F.abs(F.col("estimate") - F.col("n_words")) <= 0.03 * F.col("n_words")).alias("is_near"))


def lexicon_sides(spark, sf):
    """The words of conversations against those of documents: known ones, new ones, and ones that no conversation uses."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("").alias("lang"), "text")
    return words.lexicon_sides(words.dictionary(turns, registry.PROFILE), words.dictionary(table(spark, sf, "documents"), registry.PROFILE))


def lexicon_side_counts(spark, sf):
    return lexicon_sides(spark, sf).groupBy("side").agg(F.count("*").alias("n"))


def unknown_suggested(spark, sf):
    """Unknown words of conversations by field, but only those that a document's word is near enough to suggest."""
    docs = table(spark, sf, "documents")
    counts = words.word_counts(docs, registry.PROFILE, cleaned=True)
    flagged = words.flagged_fields(modelling.model.collect_fields(modelling.docs(spark, sf)), counts, registry.PROFILE)
    flagged = written(flagged, "flagged")
    return words.unknown_clusters(flagged, words.suggestions(flagged.select("word"), counts))


def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.excerpt(F.col("text")).alias("excerpt"))


QUERIES = {f.__name__: f for f in (lexicon_sides, lexicon_side_counts, unknown_suggested, excerpts, collated_listings, scan_retractions, vocab_sketches, search_index, search_index_short, gram_counts, edit_outcomes, edited_docs, names_in_one_folder, store_commit, store_versions, store_vacuum, cleaned_docs)}

_FOLD = """
    docs AS (SELECT doc_id AS path, md5(coalesce(text, '')) AS sha, text FROM documents),
    e AS (SELECT user_id // 8 AS g, event_id AS version, user_id AS path, CASE event_type WHEN 'view' THEN 'create' WHEN 'click' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'rename' END AS op,
        CASE WHEN event_type NOT IN ('view', 'click', 'error') THEN user_id // 8 * 8 + event_id % 8 END AS goal, CASE WHEN event_id % 4 <> 0 THEN md5('new' || lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id)) END AS base,
        CASE WHEN event_type IN ('view', 'click', 'error') OR event_id % 3 = 0 THEN 'new' || event_id END AS new, row_number() OVER (PARTITION BY user_id // 8 ORDER BY event_id) AS k FROM events),
    r AS (
        SELECT g, CAST(0 AS BIGINT) AS k, coalesce(map_from_entries(list(ROW(path, {'sha': sha, 'origin': path, 'edit': CAST(NULL AS BIGINT)})) FILTER (path IS NOT NULL)), MAP([]::BIGINT[], []::STRUCT(sha VARCHAR, origin BIGINT, edit BIGINT)[])) AS s,
            CAST(NULL AS BIGINT) AS version, CAST(NULL AS BIGINT) AS path, NULL::VARCHAR AS op, CAST(NULL AS BIGINT) AS goal, NULL::VARCHAR AS reason
        FROM (SELECT DISTINCT g FROM e) LEFT JOIN docs ON path // 8 = g GROUP BY g
        UNION ALL
        SELECT g, k, CASE WHEN reason IS NOT NULL THEN s
                WHEN op = 'delete' THEN map_from_entries(list_filter(map_entries(s), lambda x: x.key <> path))
                WHEN op = 'rename' AND goal <> path THEN map_concat(map_from_entries(list_filter(map_entries(s), lambda x: x.key <> path)), MAP([goal], [CASE WHEN new IS NULL THEN cur ELSE nu END]))
                WHEN new IS NULL THEN s ELSE map_concat(s, MAP([path], [nu])) END, version, path, op, goal, reason
        FROM (SELECT *, CASE WHEN op = 'create' THEN CASE WHEN cur IS NOT NULL THEN 'exists' END WHEN cur IS NULL THEN 'missing' WHEN base <> cur.sha THEN 'stale'
                WHEN op = 'rename' AND goal <> path AND map_contains(s, goal) THEN 'exists' END AS reason
            FROM (SELECT r.g, e.k, s, e.version, e.path, e.op, e.goal, base, new, s[e.path] AS cur, {'sha': md5(new), 'origin': CAST(NULL AS BIGINT), 'edit': e.version} AS nu FROM r JOIN e ON e.g = r.g AND e.k = r.k + 1)))"""
_STORE = """v1 AS (SELECT doc_id, coalesce(lang, 'none') AS section, text FROM documents),
    v2 AS (SELECT doc_id, section, replace(text, 'the the', 'the') AS text FROM v1 WHERE doc_id % 97 <> 0 UNION ALL SELECT -1 - item_id, 'new', text FROM benchmark)"""
_LEFT = "['Google Sites', 'Report abuse', 'SKIP to main content', 'Skip to navigation', 'Embedded Files', ' Search this site' || chr(9), 'DOCS_timing[''x'']', 'window.WIZ_global', 'Page built by Google Sites'][doc_id % 9 + 1]"

_LINES = r"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), n AS (SELECT doc_id, line_no, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS line FROM l)"

_HI = "title COLLATE hi"
_SIDES = """a AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) WHERE length(word) >= 2), b AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) >= 2),
    z AS (SELECT coalesce(a.word, b.word) AS word, CASE WHEN b.word IS NULL THEN 'first' WHEN a.word IS NULL THEN 'second' ELSE 'both' END AS side FROM a FULL JOIN b ON a.word = b.word)"""

SQL = {
    "lexicon_sides": f"WITH {_SIDES} SELECT * FROM z",
    "lexicon_side_counts": f"WITH {_SIDES} SELECT side, count(*) AS n FROM z GROUP BY side",
    "unknown_suggested": f"""{correction._UNKNOWN}, kn AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), u AS (SELECT DISTINCT word, CASE WHEN length(word) <= 3 THEN 1 WHEN length(word) <= 6 THEN 2 ELSE greatest(2, CAST(floor(length(word) * 0.32) AS INT)) END AS most FROM z),
        g AS (SELECT DISTINCT word FROM u JOIN kn ON length(w) >= 2 AND abs(length(word) - length(w)) <= most AND levenshtein(word, w) <= most)
        SELECT word, CAST(sum(n) OVER (PARTITION BY word) AS BIGINT) AS total, path, field, n FROM z SEMI JOIN g USING (word)""",
    "excerpts": r"SELECT doc_id, CASE WHEN length(x) > 120 THEN x[:120] || '…' ELSE x END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)",
    "collated_listings": f"""WITH {publishing._D}, j AS (SELECT * FROM d JOIN s USING (section)),
        a AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN sort = 'file' OR grouped THEN '' ELSE title END COLLATE hi, doc_id) AS anchor, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN sort = 'file' THEN '' ELSE title END COLLATE hi, doc_id) AS display,
            min(doc_id) OVER (PARTITION BY section, group_name) AS seen, grouped OR count(group_name) OVER (PARTITION BY section) > 0 AS uses FROM j),
        l AS (SELECT section, doc_id, row_number() OVER (PARTITION BY section ORDER BY seen, CASE WHEN sort = 'file' THEN '' ELSE title END COLLATE hi, doc_id) AS label FROM a WHERE group_name IS NOT NULL),
        g AS (SELECT section, doc_id, row_number() OVER (PARTITION BY section ORDER BY group_name IS NULL, CASE WHEN group_name IS NULL THEN 0 ELSE seen END, {_HI}, doc_id) AS in_groups FROM a WHERE grouped),
        x AS (SELECT doc_id, row_number() OVER (ORDER BY {_HI}, doc_id) AS in_index FROM j WHERE NOT excluded)
        SELECT a.section, a.doc_id, anchor, CASE WHEN uses THEN label ELSE anchor END AS label, display, in_groups, in_index FROM a LEFT JOIN l USING (section, doc_id) LEFT JOIN g USING (section, doc_id) LEFT JOIN x USING (doc_id)""",
    "scan_retractions": """WITH q AS (SELECT doc_id FROM labels WHERE quality = 1), tr AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE doc_id IN (SELECT doc_id FROM q)),
        now AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM q) AND doc_id % 7 <> 0 AND doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, text FROM benchmark),
        w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM now), v AS (SELECT word FROM w WHERE length(word) >= 2), dr AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
        u AS (SELECT word FROM v WHERE word NOT IN (SELECT word FROM tr) AND word NOT IN (SELECT word FROM dr))
        SELECT (SELECT count(*) FROM now) AS n_docs, (SELECT count(DISTINCT word) FROM v) AS n_words, (SELECT count(DISTINCT word) FROM u) AS n_unknown, (SELECT count(*) FROM u) AS n_occurrences""",
    "vocab_sketches": f"SELECT *, true AS is_near FROM ({registry.SQL['vocab_by_section']})",
    "search_index": registry.SQL["search"],
    "search_index_short": f"WITH {_LINES}, q AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), h AS (SELECT lang AS query_id, doc_id, CAST(min(line_no) AS BIGINT) AS line_no FROM q JOIN n ON contains(line, lang) GROUP BY ALL) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank, doc_id, line_no FROM h",
    "gram_counts": f"WITH {_LINES}, g AS (SELECT DISTINCT doc_id, line_no, substr(line || chr(10) || chr(10), i, 3) AS gram FROM n, unnest(range(1, length(line) + 1)) u(i) WHERE line <> '') SELECT gram, count(*) AS n FROM g GROUP BY gram",
    "edit_outcomes": f"""WITH RECURSIVE {_FOLD} SELECT version, CAST(path AS VARCHAR) AS path, op, CAST(goal AS VARCHAR) AS "to",
        CASE WHEN reason IS NOT NULL THEN 'conflict' ELSE CASE op WHEN 'create' THEN 'created' WHEN 'update' THEN 'updated' WHEN 'delete' THEN 'deleted' ELSE 'renamed' END END AS status, reason FROM r WHERE k > 0""",
    "edited_docs": f"""WITH RECURSIVE {_FOLD}, f AS (SELECT unnest(map_entries(arg_max(s, k))) AS x FROM r GROUP BY g),
        a AS (SELECT x.key AS path, x.value.sha AS sha, x.value.origin AS origin, x.value.edit AS edit FROM f UNION ALL SELECT path, sha, path, NULL FROM docs WHERE path // 8 NOT IN (SELECT g FROM e))
        SELECT CAST(a.path AS VARCHAR) AS path, a.sha, CAST(a.origin AS VARCHAR) AS origin, CASE WHEN edit IS NOT NULL THEN md5('new' || edit) ELSE md5(coalesce(o.text, '')) END AS text_md5 FROM a LEFT JOIN docs o ON o.path = a.origin""",
    "names_in_one_folder": f"""WITH {publishing._D}, x AS (SELECT doc_id, section, row_number() OVER (PARTITION BY section ORDER BY doc_id) AS r FROM d WHERE section IS NOT NULL),
        tk AS (SELECT DISTINCT section, CASE WHEN doc_id > 3 THEN doc_id ELSE 1 END AS k FROM d WHERE section IS NOT NULL AND doc_id % 3 = 0),
        f AS (SELECT section, k, row_number() OVER (PARTITION BY section ORDER BY k) AS r FROM (SELECT section, unnest(range(1, 2 * (SELECT count(*) FROM d) + 10)) AS k FROM (SELECT DISTINCT section FROM x)) ANTI JOIN tk USING (section, k))
        SELECT doc_id, '007-' || section || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.yaml' AS new_name FROM x JOIN f USING (section, r)""",
    "store_commit": f"WITH {_STORE} SELECT doc_id, section, md5(text) AS text_md5 FROM v2",
    "store_vacuum": f"WITH {_STORE} SELECT 2 AS version, section, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM v2 GROUP BY ALL",
    "store_versions": f"WITH {_STORE}, a AS (SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2) SELECT version, section, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM a GROUP BY ALL",
    "cleaned_docs": rf"""WITH x AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN starts_with(l, 'licensed under ') THEN {_LEFT} ELSE l END), chr(10)) || CASE WHEN doc_id % 4 = 0 THEN chr(10) || ' ' || chr(10) ELSE '' END AS text,
            CASE WHEN doc_id % 5 = 0 THEN {_LEFT} ELSE string_split(text, chr(10))[1] END AS tarz FROM documents),
        j AS (SELECT *, p FROM x, (SELECT '(?i)^(google sites$|report abuse$|skip to main content$|skip to navigation$|embedded files$|search this site$|docs_timing($|[^a-z0-9_])|window\.wiz_|page built by google)' AS p)),
        y AS (SELECT doc_id, text, tarz, regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(regexp_replace(l, '^\s+|\s+$', '', 'g'), p)), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS new,
            CASE WHEN NOT regexp_matches(regexp_replace(tarz, '^\s+|\s+$', '', 'g'), p) THEN tarz END AS tune FROM j)
        SELECT doc_id, md5(new) AS text_md5, tune AS tarz FROM y WHERE new <> text OR tune IS DISTINCT FROM tarz""",
}
