"""Scans kept up by differences, vocabularies as sketches, and ranks of titles."""

import random

import pytest
from pyspark.sql import functions as F

from lekha.operators import listings, passages, scans
from lekha.operators import words as w
from lekha.sources import appends

PROFILE = "devanagari"
WORDS = ["राम", "श्याम", "सीता।", "गीत", "१२", "क", "मीरा", "रामा"]


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "") for i, t in rows], "doc_id long, text string, lang string")


def fresh(spark, rows, trusted, dropped=()):
    docs = texts(spark, rows)
    unknown = w.unknown_words(docs, trusted, PROFILE)
    unknown = unknown.where(~F.col("word").isin(*dropped)) if dropped else unknown
    return tuple(passages.scan_summary(docs, w.dictionary(docs, PROFILE), unknown).first())


def test_differences_equal_a_fresh_scan(spark, tmp_path):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(9)))
    path, now = f"file://{tmp_path}/scan", {i: line() for i in range(40)} | {40: None, 41: ""}
    trusted = spark.createDataFrame([("राम",), ("मीरा",)], "word string")
    scans.scan(texts(spark, [*now.items(), (None, "राम गीत")]), path, PROFILE)
    assert tuple(scans.summary(spark, path, trusted).first()) == fresh(spark, now.items(), trusted)
    for step in range(3):
        gone = rng.sample(sorted(now), 6) + [40, 999]
        new = {i: line() for i in gone[:3]} | {100 + step: line(), 200 + step: ""}
        scans.replace(spark, path, texts(spark, [(i, None) for i in (*gone, gone[0], None)]), texts(spark, new.items()) if step else None, PROFILE)
        now = {i: t for i, t in now.items() if i not in gone} | (new if step else {})
        dropped = ["गीत", "सीता"][:step]
        frame = spark.createDataFrame([(x,) for x in dropped], "word string")
        got = scans.summary(spark, path, trusted, frame)
        assert tuple(got.first()) == fresh(spark, now.items(), trusted, dropped)
    files = got.inputFiles()
    assert any("/totals/" in f for f in files) and not any("/words/" in f for f in files)
    scans.scan(texts(spark, []), f"file://{tmp_path}/none", PROFILE)
    assert tuple(scans.summary(spark, f"file://{tmp_path}/none", trusted).first()) == (0, 0, 0, 0)
    assert len(appends.batches(spark, path)) == 4


def test_sketches_merge(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("s"), (F.col("id") % 2).cast("string"))).alias("section"), F.concat(F.lit("word"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" same")).alias("text"))
    whole = scans.vocabulary_sketches(rows, "ascii")
    parts = scans.vocabulary_sketches(rows.where("doc_id < 1000"), "ascii").unionByName(scans.vocabulary_sketches(rows.where("doc_id >= 900"), "ascii"))
    one, two = ({r.section: r.estimate for r in scans.vocabulary_estimates(x).collect()} for x in (whole, parts))
    assert all(abs(one[k] - two[k]) <= 0.03 * one[k] for k in one) and set(one) == {"s0", "s1", None}
    assert abs(one[None] - 3001) <= 90 and abs(one["s1"] - 1501) <= 45 and abs(one["s0"] - 751) <= 23
    assert scans.vocabulary_estimates(scans.vocabulary_sketches(rows.limit(0), "ascii")).collect() == [(None, 0)]


@pytest.mark.parametrize("collation", ["hi", "UNICODE_CI"])
def test_ranks_sort_as_the_collation(spark, collation):
    titles = ["क", "ख", "का", None, "b", "B", "a", "अ", "क", ""]
    docs = spark.createDataFrame([(i, "s", x, "g" if i % 2 else None) for i, x in enumerate(titles)], "doc_id long, section string, title string, group_name string")
    sections = spark.createDataFrame([(0, "s", "title", False, True)], "section_pos int, section string, sort string, excluded boolean, grouped boolean")
    ranked = listings.with_title_ranks(docs, collation)
    assert sorted(ranked.columns) == sorted([*docs.columns, "title_rank"])
    for order in (listings.display_order, listings.master_index):
        assert sorted(map(tuple, order(ranked, sections).collect())) == sorted(map(tuple, order(docs, sections, collation=collation).collect()))
    rank = {r.doc_id: r.title_rank for r in ranked.collect()}
    assert rank[0] == rank[8] and rank[3] == rank[9] == 1 and (rank[4] == rank[5]) == (collation == "UNICODE_CI")
    groups = sorted((r.number, r.doc_id) for r in passages.group_order(ranked, sections).collect())
    want = sorted(range(10), key=lambda i: (i % 2 == 0, rank[i], i))
    assert [i for _, i in groups] == want


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    from lekha.operators import graph

    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(few)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)] + [(7, 7), (None, 3)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = graph.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == {i: find(i) for i in list(root)}
