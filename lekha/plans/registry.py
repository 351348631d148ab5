"""The reference operators' queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekha.operators import documents as d
from lekha.operators import words as w
from lekha.plans.shared import table

#: The sections that the documents' languages stand for, in order; it has no documents.
SECTIONS = ("en", "de", "fr", "es", "it")
BOILERPLATE = "(?i)^licensed under .*$"
PROFILE = "ascii"

_SECTIONS_SQL = "(VALUES (0, 'en'), (1, 'de'), (2, 'fr'), (3, 'es'), (4, 'it')) s(section_pos, section)"
_TOKENS = "t AS (SELECT doc_id, lang AS section, unnest(x) AS word, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda y: length(y) BETWEEN 2 AND 30) AS x FROM documents))"


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SECTIONS)), "section_pos int, section string")


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _also(docs: DataFrame) -> DataFrame:
    """Documents with the language codes that stand in their texts as the sections they also name."""
    return docs.withColumn("also_in", F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))), lambda x: x.isin("de", "en", "es", "fr", "xx")))


def word_counts(spark, sf):
    return w.word_counts(_docs(spark, sf), PROFILE)


def corpus_dictionary(spark, sf):
    return w.dictionary(_docs(spark, sf), PROFILE)


def vocab_by_section(spark, sf):
    return w.vocabulary_sizes(_docs(spark, sf), PROFILE)


def subset_vocab(spark, sf):
    return w.dictionary(_docs(spark, sf), PROFILE, ["de", "fr"])


def merge_lexicons(spark, sf):
    docs = _docs(spark, sf)
    return w.dictionary(docs, PROFILE, ["en"]).union(w.dictionary(docs, PROFILE, ["es"])).distinct()


def lexicon_diff(spark, sf):
    docs = _docs(spark, sf)
    return w.dictionary(docs, PROFILE, ["es"]).exceptAll(w.dictionary(docs, PROFILE, ["en"]))


def oov_tokens(spark, sf):
    docs, labels = _docs(spark, sf), table(spark, sf, "labels").where("quality = 1").select("doc_id")
    trusted = w.dictionary(docs.join(labels, "doc_id", "left_semi"), PROFILE)
    return w.unknown_words(docs.join(labels, "doc_id", "left_anti"), trusted, PROFILE)


def whole_counts(docs: DataFrame) -> DataFrame:
    """The words that the reference scans: of two letters or more, seen at least twice."""
    return w.word_counts(docs, PROFILE, 2)


def variant_pairs(spark, sf):
    return w.variant_pairs(whole_counts(_docs(spark, sf)).select("word")).withColumn("distance", F.col("distance").cast("bigint"))


def variant_clusters(spark, sf):
    return w.variant_clusters(whole_counts(_docs(spark, sf)), PROFILE)


def cluster_variants(spark, sf):
    docs = _docs(spark, sf)
    out = w.cluster_variants(whole_counts(docs), w.occurrences(docs, PROFILE), PROFILE)
    return out.withColumn("samples", F.array_join(F.transform("samples", lambda x: F.concat_ws(":", x.doc_id, x.pos)), " "))


def cross_list(spark, sf):
    return d.cross_listings(_also(_docs(spark, sf)), sections(spark))


def listing_counts(spark, sf):
    return d.listing_counts(cross_list(spark, sf), sections(spark))


def global_ids(spark, sf):
    return d.global_ids(_docs(spark, sf), sections(spark))


def verse_gaps(spark, sf):
    return d.verse_gaps(table(spark, sf, "conversations"))


def coverage_report(spark, sf):
    return d.coverage(table(spark, sf, "conversations"))


def find_matches(spark, sf):
    return d.find_matches(_docs(spark, sf), "the", ignore_case=True)


def find_replace(spark, sf):
    return d.replaced(_docs(spark, sf), " the ", " the$1 ")


def boilerplate_lines(spark, sf):
    return d.without_boilerplate(_docs(spark, sf), BOILERPLATE)


def line_ends(spark, sf):
    return d.repaired_ends(_docs(spark, sf))


def search(spark, sf):
    """Each benchmark text, with all its words, as a query."""
    return d.search(_docs(spark, sf), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


QUERIES = {f.__name__: f for f in (
    word_counts, corpus_dictionary, vocab_by_section, subset_vocab, merge_lexicons, lexicon_diff, oov_tokens, variant_pairs, variant_clusters, cluster_variants,
    cross_list, listing_counts, global_ids, verse_gaps, coverage_report, find_matches, find_replace, boilerplate_lines, line_ends, search)}
FLAGSHIP = variant_clusters

_COUNTS = "c AS (SELECT word, count(*) AS n, min(struct_pack(d := doc_id, p := pos)) AS first FROM t GROUP BY word HAVING count(*) >= {least})"
#: Words that have a string in common after a deletion, or two where both are longer than four letters, are compared.
_NEAR = """k AS MATERIALIZED (SELECT word, n, first, length(word) AS l FROM c),
    d1 AS (SELECT DISTINCT word, l, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM k, unnest(range(1, l + 1)) u(i)),
    d2 AS (SELECT DISTINCT word, l, substr(rest, 1, i - 1) || substr(rest, i + 1) AS rest FROM d1, unnest(range(1, l)) u(i) WHERE l > 4),
    dd AS MATERIALIZED (SELECT word, l, word AS rest FROM k UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2),
    e AS MATERIALIZED (SELECT DISTINCT x.word AS a, y.word AS b FROM dd x JOIN dd y ON x.rest = y.rest AND x.word < y.word AND levenshtein(x.word, y.word) <= CASE WHEN least(x.l, y.l) <= 4 THEN 1 ELSE 2 END)"""
_CLUSTERS = _COUNTS.format(least=2) + f""", {_NEAR},
    sk AS (SELECT *, regexp_replace(word, '[aeiou]', '', 'g') AS skeleton FROM k), st AS (SELECT word, min(word) OVER (PARTITION BY skeleton) AS m FROM sk),
    ed AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT word, m FROM st WHERE word <> m UNION SELECT m, word FROM st WHERE word <> m),
    cc(word, root) USING KEY (word) AS (SELECT DISTINCT a, a FROM ed UNION (SELECT u.word, min(v.root) FROM recurring.cc u JOIN ed ON ed.a = u.word JOIN cc v ON v.word = ed.b WHERE v.root < u.root GROUP BY u.word)),
    cl AS (SELECT root, substr(md5(array_to_string(list_sort(list(word)), '|')), 1, 12) AS id, arg_min(word, struct_pack(n := -n, d := first.d, p := first.p)) AS canonical, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_forms,
        arg_min(skeleton, struct_pack(n := -n, d := first.d, p := first.p)) AS skeleton FROM cc JOIN sk USING (word) GROUP BY root HAVING sum(n) >= 4 AND count(*) > 1)"""
_CROSS = f"""
    own AS (SELECT lang AS section, doc_id, false AS is_cross_listed FROM documents),
    other AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS section, doc_id, lang FROM documents),
    listings AS (SELECT * FROM own UNION ALL SELECT o.section, doc_id, true FROM other o JOIN {_SECTIONS_SQL} ON o.section = s.section WHERE o.section <> lang AND o.section IN ('de', 'en', 'es', 'fr', 'xx'))"""
_VERSES = "v AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)"

SQL = {
    "word_counts": f"WITH {_TOKENS}, {_COUNTS.format(least=1)} SELECT word, n, first.d AS first_doc, CAST(first.p AS BIGINT) AS first_pos FROM c",
    "corpus_dictionary": f"WITH {_TOKENS} SELECT DISTINCT word FROM t",
    "vocab_by_section": f"WITH {_TOKENS} SELECT section, count(DISTINCT word) AS n_words FROM t GROUP BY section UNION ALL SELECT NULL, count(DISTINCT word) FROM t",
    "subset_vocab": f"WITH {_TOKENS} SELECT DISTINCT word FROM t WHERE section IN ('de', 'fr')",
    "merge_lexicons": f"WITH {_TOKENS} SELECT DISTINCT word FROM t WHERE section IN ('en', 'es')",
    "lexicon_diff": f"WITH {_TOKENS} SELECT DISTINCT word FROM t WHERE section = 'es' AND word NOT IN (SELECT word FROM t WHERE section = 'en')",
    "oov_tokens": f"WITH {_TOKENS}, q AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t WHERE doc_id NOT IN (SELECT doc_id FROM q) AND word NOT IN (SELECT word FROM t WHERE doc_id IN (SELECT doc_id FROM q)) GROUP BY word",
    "variant_pairs": f"WITH {_TOKENS}, {_COUNTS.format(least=2)}, {_NEAR} SELECT a, b, levenshtein(a, b) AS distance FROM e",
    "variant_clusters": f"""WITH RECURSIVE {_TOKENS}, {_CLUSTERS} SELECT id, canonical, total, n_forms, skeleton FROM cl""",
    "cluster_variants": f"""WITH RECURSIVE {_TOKENS}, {_CLUSTERS}, rk AS (SELECT root, id, total, row_number() OVER (ORDER BY total DESC, id) AS rank FROM cl),
        o AS (SELECT word, doc_id, pos, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) AS r FROM t), so AS (SELECT word, string_agg(doc_id || ':' || pos, ' ' ORDER BY r) AS samples FROM o WHERE r <= 5 GROUP BY word)
        SELECT rank, id, total, word AS form, n, samples FROM cc JOIN rk USING (root) JOIN k USING (word) JOIN so USING (word)""",
    "cross_list": f"WITH {_CROSS} SELECT * FROM listings",
    "listing_counts": f"WITH {_CROSS} SELECT s.section, count(doc_id) AS n FROM {_SECTIONS_SQL} LEFT JOIN listings USING (section) GROUP BY s.section",
    "global_ids": f"SELECT doc_id, row_number() OVER (ORDER BY section_pos, doc_id) AS number FROM documents JOIN {_SECTIONS_SQL} ON lang = section",
    "verse_gaps": f"WITH {_VERSES} SELECT conv_id, turn FROM v WHERE role = 'user' AND (next IS NULL OR next <> 'assistant')",
    "coverage_report": f"WITH {_VERSES} SELECT conv_id, count(*) FILTER (role = 'user') AS verses, count(*) FILTER (role = 'assistant') AS commentaries, count(*) FILTER (role = 'user' AND coalesce(next <> 'assistant', true)) AS missing FROM v GROUP BY conv_id",
    "find_matches": "SELECT * FROM (SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS n FROM documents) WHERE n > 0",
    "find_replace": "SELECT doc_id, replace(text, ' the ', ' the$1 ') AS text FROM documents WHERE contains(text, ' the ')",
    "boilerplate_lines": r"""SELECT doc_id, x AS text FROM (SELECT doc_id, text, regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(trim(l), '(?i)^licensed under .*$')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS x FROM documents) WHERE x <> text""",
    "line_ends": r"""WITH x AS (SELECT doc_id, text, array_to_string(list_transform(list_transform(string_split(text, chr(10)), lambda l: struct_pack(l := l, b := regexp_replace(l, '\s+$', ''))), lambda s:
            CASE WHEN s.b = '' THEN s.l WHEN ends_with(s.b, '॥') THEN s.b WHEN regexp_matches(s.b, '।[.,]$') THEN s.b[:-2] WHEN ends_with(s.b, '।') THEN s.b
            WHEN regexp_matches(s.b, '[.,]$') THEN regexp_replace(s.b, '[.,]$', '') || '।' ELSE s.b || '।' END), chr(10)) AS new FROM documents)
        SELECT doc_id, new AS text FROM x WHERE new <> text""",
    "search": r"""WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS ws FROM benchmark),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
        n AS (SELECT doc_id, line_no, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS line FROM l),
        h AS (SELECT query_id, doc_id, min(line_no) AS line_no FROM q JOIN n ON len(ws) > 0 AND contains(n.line, ws[1]) AND len(list_filter(ws, lambda x: NOT contains(n.line, x))) = 0 GROUP BY query_id, doc_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank, doc_id, CAST(line_no AS BIGINT) AS line_no FROM h)
        SELECT * FROM r WHERE rank <= 15""",
}
