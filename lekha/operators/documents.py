"""Listings, verse audits, repair, and find and replace over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekha.functions import text as t
from lekha.operators.listings import positions, ranked
from lekha.plans.shared import written


def cross_listings(docs: DataFrame, sections: DataFrame, also: str = "also_in", collector: str | None = None) -> DataFrame:
    """(section, doc_id, is_cross_listed): each document's own section, and the valid others that it names.

    A document of the section `collector` is also listed in the section whose title
    its group_name is (sections then has titles). sections is a small table, one row
    a section; it is left to the planner whether it is broadcast.
    """
    own = docs.select(F.col("lang").alias("section"), "doc_id", F.lit(False).alias("is_cross_listed"))
    other = docs.select(F.explode(F.array_distinct(also)).alias("section"), "doc_id", "lang").where("section <> lang")
    other = other.join(sections.select("section"), "section", "left_semi").select("section", "doc_id")
    if collector is not None:
        named = docs.where((F.col("lang") == collector) & F.col("group_name").isNotNull()).select("doc_id", F.trim("group_name").alias("title"))
        titled = sections.where(F.col("section") != collector).groupBy("title").agg(F.min_by("section", "section_pos").alias("section"))
        other = other.unionByName(named.join(titled, "title").select("section", "doc_id")).distinct()
    return own.unionByName(other.select("section", "doc_id", F.lit(True).alias("is_cross_listed")))


def invalid_listings(docs: DataFrame, sections: DataFrame, also: str = "also_in") -> DataFrame:
    """(section, doc_id) of the sections that documents name and that do not exist; a null list names none."""
    named = docs.select(F.explode(F.array_distinct(also)).alias("section"), "doc_id")
    return named.join(sections.select("section"), "section", "left_anti").select("section", "doc_id")


def listing_counts(listings: DataFrame, sections: DataFrame) -> DataFrame:
    """(section, n), 0 for a section without listings."""
    n = listings.groupBy("section").agg(F.count("*").alias("n"))
    return sections.select("section").join(n, "section", "left").select("section", F.coalesce("n", F.lit(0)).alias("n"))


def global_ids(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, number): 1, 2, ... over sections, then doc_id, by ranks in parts and the parts' prefix sums."""
    rows = docs.select("doc_id", F.col("lang").alias("section")).join(sections, "section")
    return positions(rows, ["section_pos", "doc_id"]).select("doc_id", F.col("position").alias("number"))


def verse_gaps(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role) whose verse (user) has no commentary (assistant) right after it."""
    follows = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("next", follows).where("role = 'user' and (next is null or next <> 'assistant')").select("conv_id", "turn")


def coverage(turns: DataFrame) -> DataFrame:
    """(conv_id, verses, commentaries, missing)."""
    follows = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    lacks = (F.col("role") == "user") & F.coalesce(F.col("next") != "assistant", F.lit(True))
    return turns.withColumn("next", follows).groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("verses"), F.count_if(F.col("role") == "assistant").alias("commentaries"), F.count_if(lacks).alias("missing"))


def _pattern(find: str, regex: bool, ignore_case: bool) -> str:
    """A Java pattern; a regex that Java can't read is refused when the job is planned."""
    if len(find) < 2:
        raise ValueError("find needs two characters at least")
    return ("(?iu)" if ignore_case else "") + (find if regex else "\\Q" + find.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def find_matches(docs: DataFrame, find: str, ignore_case: bool = False, regex: bool = False) -> DataFrame:
    """(doc_id, n) of the documents that hold a literal, or match a regex."""
    if not regex:
        return docs.select("doc_id", t.occurrences(F.col("text"), find, ignore_case).alias("n")).where("n > 0")
    return docs.select("doc_id", F.regexp_count("text", F.lit(_pattern(find, True, ignore_case))).cast("bigint").alias("n")).where("n > 0")


def match_totals(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """(n_matches, n_docs, n_scanned) of matches (doc_id, n) in docs."""
    found = matches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches"), F.count("*").alias("n_docs")).withColumn("n_scanned", F.lit(None).cast("bigint"))
    scanned = docs.agg(F.lit(None).cast("bigint").alias("n_matches"), F.lit(None).cast("bigint").alias("n_docs"), F.count("*").alias("n_scanned"))
    return found.unionByName(scanned).agg(*(F.max(c).alias(c) for c in ("n_matches", "n_docs", "n_scanned")))


def ranked_matches(matches: DataFrame) -> DataFrame:
    """(rank, doc_id, n): most matches first, then the smaller doc_id, numbered without a single task."""
    rows = matches.withColumn("less", -F.col("n"))
    return positions(rows, ["less", "doc_id"]).select(F.col("position").alias("rank"), "doc_id", "n")


def replaced(docs: DataFrame, find: str, by: str, ignore_case: bool = False, regex: bool = False) -> DataFrame:
    """(doc_id, text) of the documents that replacing changes; `by` is literal, but for $1, $2, ... and $0 of a regex."""
    if not regex and not ignore_case:
        new = F.replace("text", F.lit(find), F.lit(by))
    else:
        new = F.regexp_replace("text", _pattern(find, regex, ignore_case), by if regex else by.replace("\\", "\\\\").replace("$", "\\$"))
    return docs.select("doc_id", new.alias("new"), "text").where("new <> text").select("doc_id", F.col("new").alias("text"))


def only(docs: DataFrame, paths: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that paths names; repeated names count once."""
    return docs.join(paths.select(key), key, "left_semi")


def changed_count(before: DataFrame, changed: DataFrame) -> DataFrame:
    """(n_changed, n): how many documents a repair changed, of how many."""
    n = before.agg(F.lit(0).cast("bigint").alias("n_changed"), F.count("*").alias("n"))
    return n.unionByName(changed.agg(F.count("*").alias("n_changed"), F.lit(0).cast("bigint").alias("n"))).agg(F.max("n_changed").alias("n_changed"), F.max("n").alias("n"))


def repaired_ends(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents whose line ends change."""
    return docs.select("doc_id", t.line_ends(F.col("text")).alias("new"), "text").where("new <> text").select("doc_id", F.col("new").alias("text"))


def without_boilerplate(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, text) of the documents that lose lines."""
    return docs.select("doc_id", t.without_lines(F.col("text"), pattern).alias("new"), "text").where("new <> text").select("doc_id", F.col("new").alias("text"))


def cleaned_documents(docs: DataFrame, pattern: str = t.JUNK) -> DataFrame:
    """(doc_id, text, tarz) of the documents that lose lines, blanks at their ends, or a tune (tarz) that is itself such a line."""
    tune = F.when(~t.edgeless(F.col("tarz")).rlike(pattern), F.col("tarz"))
    rows = docs.select("doc_id", t.without_lines(F.col("text"), pattern).alias("new"), tune.alias("tune"), "text", "tarz")
    return rows.where(~F.col("new").eqNullSafe(F.col("text")) | ~F.col("tune").eqNullSafe(F.col("tarz"))).select("doc_id", F.col("new").alias("text"), F.col("tune").alias("tarz"))


def previous(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, order, previous): the value of the row before in its group, null for the first; a group with all rows is spread over many tasks."""
    placed = written(ranked(rows.select(group, order, value), [group], [order]), "placed")
    before = placed.select(group, (F.col("rank") + 1).alias("rank"), F.col(value).alias("previous"))
    return placed.join(before, [group, "rank"], "left").select(group, order, "previous")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of non-blank lines, blanks collapsed."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line")).where("line <> ''")


#: Lines of about every so many documents tell which grams are rare; that only bears on the cost.
RARITY_SAMPLE = 16


def _grams(line: Column, size: int) -> Column:
    """The distinct substrings of a size, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _probes(words: DataFrame, body: DataFrame) -> DataFrame:
    """(query_id, gram): of each query the gram that is rarest in a sample of lines; of three letters, or a whole word where all are shorter."""
    size = F.least(F.lit(3), F.max(F.length("word")).over(Window.partitionBy("query_id")))
    of = words.withColumn("size", size).where(F.length("word") >= F.col("size"))
    grams = None
    for k in (1, 2, 3):
        found = of.where(F.col("size") == k).select("query_id", F.explode(_grams(F.col("word"), k)).alias("gram"))
        grams = found if grams is None else grams.union(found)
    grams = written(grams.distinct(), "grams")
    some = body.where(F.pmod(F.xxhash64("doc_id"), F.lit(RARITY_SAMPLE)) == 0)
    wanted = grams.select("gram").distinct()
    counts = some.select(F.explode(_grams(F.col("line"), 3)).alias("gram")).join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(counts, "gram", "left").groupBy("query_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), -F.length("gram"), "gram")).alias("gram"))
    return written(rarest, "probes")


#: Up to so many grams of queries are broadcast, and lines pass them where they are; beyond, ids are dealt out instead of lines.
FEW_PROBES = 10_000


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, word) of queries (query_id, query): distinct words in the form that lines are searched in."""
    return queries.select("query_id", F.explode(F.array_distinct(F.split(t.search_form(F.col("query")), " "))).alias("word")).where("word <> ''")


def searchable_lines(docs: DataFrame, titles: bool = False) -> DataFrame:
    """(doc_id, line_no, line) in small letters, without joiners; with titles, these are line -1."""
    body = lines(docs)
    if titles:
        body = body.unionByName(docs.select("doc_id", F.lit(-1).cast("bigint").alias("line_no"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("line")).where("line <> ''"))
    return body.select("doc_id", "line_no", F.lower(F.regexp_replace("line", "[\u200c\u200d]", "")).alias("line"))


def first_matches(full: DataFrame, most: int | None) -> DataFrame:
    """(query_id, rank, doc_id, line_no) of matching lines: each document's first one, documents in order."""
    full = full.groupBy("query_id", "doc_id").agg(F.min("line_no").alias("line_no"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")).cast("bigint")
    ranked = full.withColumn("rank", rank) if most is None else full.withColumn("rank", rank).where(F.col("rank") <= most)
    return ranked.select("query_id", "rank", "doc_id", "line_no")


def search(docs: DataFrame, queries: DataFrame, most: int | None = 15, titles: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, line_no): documents one of whose lines holds every word of the query, in order of doc_id.

    Words are substrings without regard to case; short ones count too. A query's
    rarest gram finds the lines that may match, by their ids; these are verified
    with all words. With titles, docs has a title, which is looked at as line -1. A
    query without words has no row. most: None for all documents.
    """
    words = written(query_words(queries), "words")
    body = searchable_lines(docs, titles)
    probes = _probes(words, body)
    few = probes.count() <= FEW_PROBES
    met = None
    for size in [r.size for r in probes.select(F.length("gram").alias("size")).distinct().collect()] or [3]:  # at most three
        of = probes.where(F.length("gram") == size)
        carried = ["doc_id", "line_no", "line"] if few else ["doc_id", "line_no"]  # a shuffle of grams with their lines grows with the square of a line
        grams = body.select(*carried, F.explode(_grams(F.col("line"), size)).alias("gram"))
        found = grams.join(F.broadcast(of) if few else of, "gram").select("query_id", *carried)
        met = found if met is None else met.union(found)
    met = met.join(words.groupBy("query_id").agg(F.collect_list("word").alias("words")), "query_id")
    if not few:
        fetched = body.select(F.col("doc_id").alias("of_doc"), F.col("line_no").alias("of_line"), "line")
        met = met.join(fetched, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("line_no") == F.col("of_line")))
    return first_matches(met.where(F.forall("words", lambda w: F.col("line").contains(w))), most)


def with_snippets(found: DataFrame, docs: DataFrame, most: int = 100) -> DataFrame:
    """found (query_id, rank, doc_id, line_no) of a search with titles, with in_title and snippet: the first lyric line, cut; empty where the title matched."""
    rows = found.join(docs.select("doc_id", F.split("text", "\n").alias("lines")), "doc_id")
    line = F.when(F.col("line_no") >= 0, F.get("lines", F.col("line_no").cast("int"))).otherwise("")
    return rows.select("query_id", "rank", "doc_id", (F.col("line_no") < 0).alias("in_title"), t.snippet(line, most).alias("snippet"))
