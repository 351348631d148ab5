"""The posting index, suggestions in rings, and clusters that are nowhere gathered."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lekha.functions import text as t
from lekha.operators import documents, postings
from lekha.operators import words as w
from lekha.sources import appends


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


def by_hand(docs, queries):
    out = []
    for q, query in queries:
        words = {x for x in (query or "").lower().split() if x}
        if words:
            hits = sorted((i, next((k for k, line in enumerate(text.split("\n")) if line.strip() and all(x in " ".join(line.lower().split()) for x in words)), None)) for i, text in docs if text is not None)
            out += [(q, r + 1, i, k) for r, (i, k) in enumerate([h for h in hits if h[1] is not None])]
    return sorted(out)


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(2)
    line = lambda: " ".join("".join(rng.choice("abकÉ") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(6)))
    docs = [(i, "\n".join(line() for _ in range(rng.randrange(5)))) for i in range(150)] + [(900, None), (901, ""), (902, "a"), (903, "x\n ab"), (904, "common line\n" * 300)]
    queries = [(i, line()) for i in range(60)] + [(70, "a"), (71, "b क"), (72, "ab"), (73, "zzz"), (74, None), (75, " "), (76, "COMMON line"), (77, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(queries, "query_id long, query string")
    path = f"file://{tmp_path}/index"
    postings.add(frame.where("doc_id < 100"), path)
    first = {p for p in tmp_path.rglob("*.parquet")}
    assert found(postings.search(spark, path, asked, most=None)) == by_hand([d for d in docs if d[0] < 100], queries)
    postings.add(frame.where("doc_id >= 100"), path)
    assert first < {p for p in tmp_path.rglob("*.parquet")}  # files are only added
    want = by_hand(docs, queries)
    assert found(postings.search(spark, path, asked, most=None)) == want == found(documents.search(frame, asked, most=None))
    assert found(postings.search(spark, path, asked, most=2)) == [x for x in want if x[1] <= 2]
    assert postings.search(spark, path, asked.limit(0)).collect() == []


def test_a_failed_addition_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    postings.add(spark.createDataFrame([(1, "good line")], "doc_id long, text string"), path)
    with pytest.raises(Exception, match="lost"):
        postings.add(spark.range(5).select(F.col("id").alias("doc_id"), F.expr("if(id = 4, raise_error('lost'), 'good line')").alias("text")), path)
    asked = spark.createDataFrame([(1, "good")], "query_id long, query string")
    assert found(postings.search(spark, path, asked)) == [(1, 1, 1, 0)] and len(appends.batches(spark, path)) == 1


def test_titles_are_line_minus_one(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = spark.createDataFrame([(1, "Shri  Ram", "one"), (2, "other", "shri\nram shri"), (3, None, "x")], "doc_id long, title string, text string")
    postings.add(rows, path, titles=True)
    asked = spark.createDataFrame([(1, "ram shri")], "query_id long, query string")
    assert found(postings.search(spark, path, asked)) == [(1, 1, 1, -1), (1, 2, 2, 1)]


def test_only_the_queries_buckets_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    postings.add(spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("line of words "), F.col("id").cast("string")).alias("text")), path)
    plan = postings.search(spark, path, spark.createDataFrame([(1, "words")], "query_id long, query string"))._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.split("PartitionFilters: [")[1:] if "bucket" in x.split("]")[0]]
    assert filters and any("bucket#" in x.split("PushedFilters")[0] and " IN " in x or "bucket" in x.split("]")[0] for x in filters)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_suggestions_in_rings_like_brute_force(spark):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abcd") for _ in range(k))
    long = [word(30) for _ in range(3)]
    known = {word(rng.randrange(1, 9)): rng.randrange(1, 5) for _ in range(150)} | {x: 2 for x in long}
    far = lambda x, k: "".join("z" if i < k else c for i, c in enumerate(x))
    unknown = {x for x in (word(rng.randrange(1, 9)) for _ in range(60)) if x not in known} | {far(long[0], 3), far(long[1], 9), far(long[2], 10)}
    bound = lambda n: 1 if n <= 3 else 2 if n <= 6 else max(2, int(n * 0.32))
    want = []
    for u in unknown:
        near = sorted((edits(u, x), -n, x) for x, n in known.items() if edits(u, x) <= bound(len(u)))[:8]
        want += [(u, r + 1, x, d) for r, (d, _, x) in enumerate(near)]
    got = w.suggestions(spark.createDataFrame([(x,) for x in unknown] + [(None,)], "word string"), spark.createDataFrame(list(known.items()), "word string, n long"))
    assert found(got) == sorted(want)
    assert {u for u, *_ in want} >= {far(long[0], 3), far(long[1], 9)}


def test_cluster_ids_are_digests_of_streams(spark):
    docs = spark.createDataFrame([(1, "de", "karma karmo karma"), (2, "de", "karmi karma dhyana zu"), (3, "de", "dhyano dhyana dhyana"), (4, "de", None)], "doc_id long, lang string, text string")
    counts = w.word_counts(docs, "ascii")
    got = found(w.cluster_variants(counts, w.occurrences(docs, "ascii"), "ascii", samples=2))
    ident = lambda *forms: hashlib.md5("|".join(sorted(forms)).encode()).hexdigest()[:12]
    a, b = ident("karma", "karmo", "karmi"), ident("dhyana", "dhyano")
    at = lambda *xs: [tuple(x) for x in xs]
    rows = [(r, i, n, f, k, [tuple(s) for s in samples]) for r, i, n, f, k, samples in got]
    assert rows == [
        (1, a, 5, "karma", 3, at((1, 0), (1, 2))), (1, a, 5, "karmi", 1, at((2, 0),)), (1, a, 5, "karmo", 1, at((1, 1),)),
        (2, b, 4, "dhyana", 3, at((2, 2), (3, 1))), (2, b, 4, "dhyano", 1, at((3, 0),))]
    assert {r.id for r in w.variant_clusters(counts, "ascii").collect()} == {a, b}
    stream = spark.range(3000).select(F.lit("one").alias("component"), F.format_string("w%05d", "id").alias("word")).orderBy(F.desc("word"))
    passed = stream.repartition("component").sortWithinPartitions("component", "word").mapInArrow(w._digests, "component string, id string").collect()
    assert [tuple(r) for r in passed] == [("one", ident(*(f"w{i:05d}" for i in range(3000))))]


def test_unknown_words_are_cleaned_once_distinct(spark):
    docs = spark.createDataFrame([(1, "राम। राम श्याम ॥राम॥ १२ क"), (2, "श्याम,राम।"), (3, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([("श्याम",)], "word string")
    assert found(w.unknown_words(docs, trusted, "devanagari")) == [("राम", 4, 2)]
    assert found(w.dictionary(docs, "devanagari")) == [("राम",), ("श्याम",)]
    assert t.EDGES
