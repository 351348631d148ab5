"""Dictionaries, spelling variants and spell scans over a corpus's words."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lekha.functions import text as t
from lekha.operators.fuzzy import near_words
from lekha.operators.graph import connected_components
from lekha.operators.listings import positions
from lekha.operators.passages import first_references
from lekha.plans.shared import join_groups, written


def occurrences(docs: DataFrame, profile: str, cleaned: bool = False) -> DataFrame:
    """(doc_id, section, pos, word) of every token; cleaned: as dictionaries and spell scans take them."""
    words = (t.clean_tokens if cleaned else t.tokens)(F.col("text"), profile)
    return docs.select("doc_id", F.col("lang").alias("section"), F.posexplode(words).alias("pos", "word"))


def _composed(words: DataFrame, profile: str) -> DataFrame:
    """Distinct words in composed form, clean again at the edges; ASCII words are composed as they are."""
    return words if profile == "ascii" else words.withColumn("word", t.clean_token(t.nfc(F.col("word")))).where("length(word) >= 2")


def _distinct_words(docs: DataFrame, profile: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., word): distinct words as dictionaries take them. Runs are cleaned and composed once they are distinct."""
    runs = docs.select(*by, F.explode(t.runs(F.col("text"), profile)).alias("word")).distinct()
    if profile == "ascii":  # no run has marks or digits at its edges
        return runs.where("length(word) >= 2")
    return _composed(runs.withColumn("word", t.clean_token(F.col("word"))), profile).distinct()


def word_counts(docs: DataFrame, profile: str, least: int = 1, cleaned: bool = False) -> DataFrame:
    """(word, n, first_doc, first_pos): how often, and where a word is first seen. Cleaned words are composed (NFC) once they are distinct."""
    first = F.min(F.struct("doc_id", "pos"))
    out = occurrences(docs, profile, cleaned).groupBy("word").agg(F.count("*").alias("n"), first.alias("first"))
    if cleaned and profile != "ascii":
        out = _composed(out, profile).groupBy("word").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return out.where(F.col("n") >= least).select("word", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").cast("bigint").alias("first_pos"))


def dictionary(docs: DataFrame, profile: str, sections: list[str] | None = None) -> DataFrame:
    return _distinct_words(docs if sections is None else docs.where(F.col("lang").isin(sections)), profile)


def vocabulary_sizes(docs: DataFrame, profile: str) -> DataFrame:
    """(section, n_words), and the whole with a null section; distinct first, so that each count is a plain sum."""
    pairs = _distinct_words(docs.withColumnRenamed("lang", "section"), profile, ("section",))
    return pairs.groupBy("section").agg(F.count("*").alias("n_words")).unionByName(pairs.select("word").distinct().agg(F.count("*").alias("n_words")).withColumn("section", F.lit(None).cast("string")))


def lexicon_sides(first: DataFrame, second: DataFrame) -> DataFrame:
    """(word, side) of the words of two lists (word): first, second or both, each word once; nulls are left out."""
    marked = first.select("word", F.lit(1).alias("k")).unionByName(second.select("word", F.lit(2).alias("k"))).where("word is not null")
    sides = marked.groupBy("word").agg(F.max(F.col("k") == 1).alias("a"), F.max(F.col("k") == 2).alias("b"))
    return sides.select("word", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").otherwise("second").alias("side"))


def variant_pairs(words: DataFrame) -> DataFrame:
    """(a, b, distance), a < b, of words within the variants' bound: two edits where both have five letters or more, else one."""
    words = written(words.select("word"), "words")
    longer = words.where(F.length("word") > 4)
    two = near_words(longer, longer, 2).where("a < b")
    one = near_words(words, words, 1).where("a < b").where(F.least(F.length("a"), F.length("b")) <= 4)
    return two.unionByName(one)


def skeleton_pairs(words: DataFrame, profile: str) -> DataFrame:
    """(a, b): each word and the least one with its skeleton."""
    rows = words.select("word", t.skeleton(F.col("word"), profile).alias("skeleton"))
    least = rows.groupBy("skeleton").agg(F.min("word").alias("a"), F.count("*").alias("n")).where("n > 1")
    return rows.join(least, "skeleton").where("word <> a").select("a", F.col("word").alias("b"))


def clustered_words(counts: DataFrame, profile: str) -> DataFrame:
    """(component, word, n, first_doc, first_pos) of the words that variants join; one without a skeleton is joined by edits, and with its like."""
    edges = variant_pairs(counts).select("a", "b").union(skeleton_pairs(counts, profile))
    return connected_components(edges, "a", "b").withColumnRenamed("node", "word").join(counts, "word")


def _digests(batches):
    """(component, id) of rows (component, word) that come in order: each component's words are digested as they pass."""
    now, digest = None, None
    for batch in batches:
        out = []
        for component, word in zip(batch.column("component").to_pylist(), batch.column("word").to_pylist(), strict=True):
            if component != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()[:12]))
                now, digest = component, hashlib.md5(word.encode())
            else:
                digest.update(b"|" + word.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names=["component", "id"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()[:12]])], names=["component", "id"])


def _clusters(rows: DataFrame, profile: str, least_total: int) -> DataFrame:
    rank = F.struct(-F.col("n"), "first_doc", "first_pos")
    ids = rows.select("component", "word").repartition("component").sortWithinPartitions("component", "word").mapInArrow(_digests, "component string, id string")
    found = rows.groupBy("component").agg(F.min_by("word", rank).alias("canonical"), F.sum("n").alias("total"), F.count("*").alias("n_forms"))
    return found.where((F.col("total") >= least_total) & (F.col("n_forms") > 1)).join(ids, "component").select(
        "component", "id", "canonical", "total", "n_forms", t.skeleton(F.col("canonical"), profile).alias("skeleton"))


def variant_clusters(counts: DataFrame, profile: str, least_total: int = 4) -> DataFrame:
    """(id, canonical, total, n_forms, skeleton) of words that variants join.

    The canonical form is the most frequent; ties go to the one seen first. An id
    is a digest of all forms in order, which pass through a task one by one and are
    nowhere gathered.
    """
    return _clusters(written(clustered_words(counts, profile), "clustered"), profile, least_total).drop("component")


def cluster_variants(counts: DataFrame, occurrences: DataFrame, profile: str, least_total: int = 4, samples: int = 5) -> DataFrame:
    """(rank, id, total, form, n, samples array<struct<doc_id, pos>>): the forms of each cluster, a row each, with the first places where they stand.

    rank numbers the clusters by their total, the largest first; ties go to the
    smaller id. occurrences (doc_id, pos, word) are those that counts counts. A
    cluster's forms are rows of their own, so none has to fit a row or a task.
    """
    rows = written(clustered_words(counts, profile), "clustered")
    found = written(_clusters(rows, profile, least_total), "clusters")
    placed = positions(found.select("component", "id", "total", "n_forms", (-F.col("total")).alias("less")), ["less", "id"]).withColumnRenamed("position", "rank").drop("less")
    forms = join_groups(rows.select("component", "word", "n"), written(placed, "placed"), ["component"], "n_forms", rows.count()).where("rank is not null")
    seen = first_references(occurrences.join(rows.select("word"), "word", "left_semi"), samples)
    seen = seen.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("doc_id", "pos"))).alias("samples"))  # so many places at most
    return forms.join(seen, "word").select("rank", "id", "total", F.col("word").alias("form"), "n", "samples")


def unknown_words(docs: DataFrame, trusted: DataFrame, profile: str, allowed: DataFrame | None = None) -> DataFrame:
    """(word, n, n_docs) of the words of docs that trusted (word) lacks; words are looked up once each.

    allowed (word): allow, ignore and custom lists together. Words of digits alone
    are never unknown.
    """
    runs = docs.select("doc_id", F.explode(t.runs(F.col("text"), profile)).alias("run"))
    forms = None
    if profile != "ascii":
        forms = _composed(runs.select("run").distinct().withColumn("word", t.clean_token(F.col("run"))), profile)
    words = runs.withColumnRenamed("run", "word").where("length(word) >= 2") if forms is None else runs.join(forms, "run").select("doc_id", "word")
    counts = words.groupBy("doc_id", "word").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))
    known = trusted.select("word") if allowed is None else trusted.select("word").unionByName(allowed.select("word"))
    return counts.where(~F.col("word").rlike("^[0-9०-९]+$")).join(known, "word", "left_anti")


def suggestions(unknown: DataFrame, counts: DataFrame, most: int = 8) -> DataFrame:
    """(word, rank, suggestion, distance): the nearest words of counts (word, n), then the more frequent, then by word.

    The bound on edits grows with the word's length. Words are sought in rings, the
    nearest first: within one edit, then two, four, eight, ... up to their bounds. A
    ring is complete, so a word that has `most` suggestions by then has the nearest
    ones and goes no further; wide rings, whose joins cost most, meet only what is
    still short. A word without a near one has no row; nulls have none.
    """
    left = written(unknown.where("word is not null").select("word").distinct().withColumn("bound", t.spell_bound(F.length("word"))), "unknown")
    counts = written(counts.where("word is not null").select("word", "n"), "known")
    near, low, high = None, 0, 1
    while True:
        reach = F.least("bound", F.lit(high))
        for k in sorted(r.reach for r in left.select(reach.alias("reach")).distinct().collect()) or [1]:  # the bounds in (low, high]
            ring = near_words(left.where(reach == k).select("word"), counts.select("word"), k).where(F.col("distance") > low)
            near = ring if near is None else near.union(ring)
        near = written(near, "rings")
        if not left.isEmpty():
            enough = near.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") >= most)
            left = written(left.where(F.col("bound") > high).join(enough.select(F.col("a").alias("word")), "word", "left_anti"), "short")
        if left.isEmpty():
            break
        low, high = high, 2 * high
    ranked = near.join(counts.select(F.col("word").alias("b"), "n"), "b")
    rank = F.row_number().over(Window.partitionBy("a").orderBy("distance", F.desc("n"), "b"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("a").alias("word"), F.col("rank").cast("bigint").alias("rank"), F.col("b").alias("suggestion"), F.col("distance").cast("bigint").alias("distance"))


def _rewritten(profile: str, cleaned: bool):
    """(doc_id, text, n_replaced) of rows (doc_id, text, hits): one pass over each text, in which a run is looked up in a table of the text's hits."""
    run_of, edges = re.compile(t.PROFILES[profile][0]), re.compile(f"^{t.EDGES}|{t.EDGES}$")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts, counts = [], []
                for text, hits in zip(batch.column("text"), batch.column("hits"), strict=True):
                    new = {k: v for k, v in hits.as_py() if v is not None}
                    n = 0

                    def put(m):
                        nonlocal n
                        x = new.get(edges.sub("", m[0]) if cleaned else m[0])
                        n += x is not None
                        return m[0] if x is None else x

                    texts.append(run_of.sub(put, text.as_py()))
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "text", "n_replaced"])

    return run


def replaced_words(docs: DataFrame, mapping: DataFrame, profile: str, cleaned: bool = False) -> DataFrame:
    """(doc_id, text, n_replaced) of the documents with runs that mapping (word, canonical) rewrites.

    A run is looked up whole or, cleaned, by what is left without marks and digits
    at its edges; it is replaced whole. Each document's distinct words meet the
    mapping, and only documents with a hit are rewritten, by a hash table of their
    own hits (a look into a map of Spark's reads it from its start). doc_id is
    unique; a null text has no row.
    """
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(t.PROFILES[profile][0]), F.lit(0)))
    words = F.array_distinct(F.transform(words, t.clean_token)) if cleaned else words
    hits = docs.select("doc_id", F.explode(words).alias("word")).join(mapping.select("word", "canonical"), "word").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "canonical"))).alias("hits"))
    rows = docs.select("doc_id", "text").join(hits, "doc_id").select("doc_id", "text", "hits")
    kind = docs.schema["doc_id"].dataType
    return rows.mapInArrow(_rewritten(profile, cleaned), f"doc_id {kind.simpleString()}, text string, n_replaced bigint")


def canonical_forms(counts: DataFrame, profile: str) -> DataFrame:
    """(word, canonical): each word whose skeleton a more frequent (then smaller) word shares, and that word."""
    rows = counts.select("word", "n", t.skeleton(F.col("word"), profile).alias("skeleton")).where("skeleton <> ''")
    best = rows.groupBy("skeleton").agg(F.min_by("word", F.struct(-F.col("n"), "word")).alias("canonical"))
    return rows.join(best, "skeleton").where("word <> canonical").select("word", "canonical")


def flagged_fields(fields: DataFrame, trusted: DataFrame, profile: str) -> DataFrame:
    """(path, field, word, n) of the unknown words of fields (path, field, text), by field."""
    words = fields.select("path", "field", F.explode(t.clean_tokens(F.col("text"), profile)).alias("word"))
    return words.groupBy("path", "field", "word").agg(F.count("*").alias("n")).where(~F.col("word").rlike("^[0-9०-९]+$")).join(trusted.select("word"), "word", "left_anti").select("path", "field", "word", "n")


def unknown_clusters(flagged: DataFrame, suggested: DataFrame | None = None) -> DataFrame:
    """(word, total, path, field, n): where each unknown word stands, and how often in all.

    With suggested (word, suggestion, rank), only words with a suggestion are
    reported, as others are names or new. Rows stay long, so that a word that
    stands everywhere is no single row.
    """
    totals = flagged.groupBy("word").agg(F.sum("n").alias("total"))
    totals = totals if suggested is None else totals.join(suggested.select("word").distinct(), "word", "left_semi")
    return flagged.join(totals, "word").select("word", "total", "path", "field", "n")


def field_issues(flagged: DataFrame) -> DataFrame:
    """(path, n): distinct unknown words of each field, summed over the document."""
    return flagged.groupBy("path").agg(F.count("*").alias("n"))


def skeleton_clusters(counts: DataFrame, profile: str) -> DataFrame:
    """(id, canonical, forms) of words (word, n) that share a skeleton; the canonical form is the most frequent, then the smaller."""
    rows = counts.select("word", "n", t.skeleton(F.col("word"), profile).alias("skeleton")).where("skeleton <> ''")
    forms = rows.groupBy("skeleton").agg(F.min_by("word", F.struct(-F.col("n"), "word")).alias("canonical"), F.array_sort(F.collect_list("word")).alias("forms")).where(F.size("forms") > 1)
    return forms.select(t.cluster_id(F.col("forms")).alias("id"), "canonical", "forms")


def default_decisions(clusters: DataFrame) -> DataFrame:
    """(id, action, canonical, replace, forms): every cluster (id, canonical, forms) is ignored until decided."""
    return clusters.select("id", F.lit("ignore").alias("action"), "canonical", F.filter("forms", lambda x: x != F.col("canonical")).alias("replace"), "forms")


def applied_decisions(docs: DataFrame, decisions: DataFrame, profile: str) -> DataFrame:
    """(doc_id, text, n_replaced) of the documents that decisions (action, canonical, replace) to fix change: whole runs, as they stand."""
    pairs = decisions.where("action = 'fix'").select("canonical", F.explode("replace").alias("word")).where("word <> canonical").groupBy("word").agg(F.min("canonical").alias("canonical"))
    return replaced_words(docs, pairs, profile)


def decision_hits(docs: DataFrame, decisions: DataFrame, profile: str) -> DataFrame:
    """(id, word, canonical, n_docs): in how many documents each pair to fix has a hit; pairs without one are left out."""
    pairs = decisions.where("action = 'fix'").select("id", "canonical", F.explode("replace").alias("word")).where("word <> canonical")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(t.PROFILES[profile][0]), F.lit(0)))).alias("word"))
    n = words.groupBy("word").agg(F.count("*").alias("n_docs"))
    return pairs.join(n, "word").select("id", "word", "canonical", "n_docs")
