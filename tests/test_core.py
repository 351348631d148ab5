import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lekha.functions import text as t
from lekha.operators.fuzzy import near_words
from lekha.operators.graph import connected_components
from lekha.operators import documents, fuzzy, lint, passages
from lekha.operators import words as w
from lekha.plans import correction, modelling, publishing, reading, registry
from lekha.sources import files

SF = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("line", "want"), [("राम", "राम।"), ("राम,", "राम।"), ("राम.", "राम।"), ("राम।", "राम।"), ("॥१॥", "॥१॥"), ("राम।.", "राम।"), ("", ""), ("राम।  ", "राम।")])
def test_line_end(spark, line, want):
    assert one(spark, line, t.line_end) == want


def test_tokens(spark):
    assert one(spark, "देवा देवा। हरि ह", t.tokens) == ["देवा", "देवा।", "हरि"]
    assert one(spark, "॥१॥", t.clean_token) == ""
    assert one(spark, "१२राम।", t.clean_token) == "राम"
    assert one(spark, "हरि", t.skeleton) == one(spark, "हरी", t.skeleton)


def test_names(spark):
    assert one(spark, ' राम: "श्याम"  गान ', t.slug) == "राम-श्याम-गान"
    assert one(spark, "??", t.slug) == "bhajan"
    assert one(spark, "a" * 101, t.snippet) == "a" * 99 + "…"
    assert one(spark, "a" * 100, t.snippet) == "a" * 100
    assert one(spark, "aaa", lambda c: t.occurrences(c, "aa")) == 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("most", "longest"), [(1, 20), (2, 20), (3, 20), (1, 4), (2, 5)])
def test_near_words_equal_brute_force(spark, most, longest, monkeypatch):
    monkeypatch.setattr(fuzzy, "LONGEST", longest)  # words beyond it go by segments
    r = random.Random(most)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(120)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(x.a, x.b, x.distance) for x in near_words(df, df, most).collect()}
    assert got == {(a, b, d) for a in words for b in words if a != b and (d := distance(a, b)) <= most}


@pytest.mark.parametrize("most", [1, 3, 5])
def test_segments_lose_no_pair_and_meet_few(spark, most, monkeypatch):
    met = {}
    monkeypatch.setattr(fuzzy, "_meeting", lambda a, b, on: met.setdefault("rows", a).join(b, on))
    r = random.Random(most)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 11))) for _ in range(60)}
    words = sorted(words | {w[:i] + r.choice(["", "a", "bc"]) + w[i + r.randint(0, 1) :] for w in words for i in (r.randint(0, len(w)),)} - {""})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(x.a, x.b, x.distance) for x in fuzzy._by_segments(df, df, most).collect()}
    assert got == {(a, b, d) for a in words for b in words if a != b and (d := distance(a, b)) <= most}
    # for a difference of lengths x, (most * most - x * x) / 2 + most + 1 places at most
    bounds = {w: sum((most * most - x * x) // 2 + most + 1 for x in range(-most, most + 1)) for w in words}
    assert all(x["count"] <= bounds[x.a] for x in met["rows"].groupBy("a").count().collect())


@pytest.mark.parametrize("most", [2, 3])
def test_near_words_are_never_broadcast(spark, most, capsys, tmp_path):
    """Strings of a small file's words are taken for small whatever they grow to, so a join must not choose by that."""
    spark.createDataFrame([("abcde",), ("abcdf",), ("xyz",)], "word string").write.parquet(f"{tmp_path}/words")
    df = spark.read.parquet(f"{tmp_path}/words")
    near_words(df, df, most).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


PLANS = (registry, publishing, reading, modelling, correction)
QUERIES, SQL = ({k: v for p in PLANS for k, v in getattr(p, n).items()} for n in ("QUERIES", "SQL"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "conversations", "benchmark", "events"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(r) for r in df.select(columns).collect()], key=repr)
    want = con.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize(("text", "rule", "want"), [
    ("कछ हम", "kachh_hum", "कछु हम"), ("भय  भी नाई", "bhay_nai", "भय भी नहीं"), ("'x\"", "mismatched_quotes", "'x'"), ("\"x'", "mismatched_quotes", "'x'"), ("शुम दिन", "shum_din", "शुभ दिन")])
def test_typos(spark, text, rule, want):
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in lint.issues(docs, lint.TYPOS).collect()] == [(1, rule, 1, True)]
    assert [tuple(r) for r in lint.fixed(docs, lint.TYPOS).collect()] == [(1, want)]


def test_suggestions_equal_brute_force(spark):
    r = random.Random(5)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 12))) for _ in range(90)})
    known, unknown = {x: i % 3 + 1 for i, x in enumerate(words[::2])}, words[1::2]
    got = w.suggestions(spark.createDataFrame([(x,) for x in unknown], "word string"), spark.createDataFrame(list(known.items()), "word string, n long"))
    bound = lambda n: 1 if n <= 3 else 2 if n <= 6 else max(2, int(n * 0.32))
    want = set()
    for a in unknown:
        near = sorted((d, -known[b], b) for b in known if (d := distance(a, b)) <= bound(len(a)))[:8]
        want |= {(a, i + 1, b, d) for i, (d, _, b) in enumerate(near)}
    assert {tuple(x) for x in got.collect()} == want
    assert w.suggestions(spark.createDataFrame([], "word string"), spark.createDataFrame([], "word string, n long")).count() == 0


def test_passages(spark):
    docs = spark.createDataFrame([(1, "१२राम। हरि, ह"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in passages.token_offsets(docs, "devanagari").collect()) == [(1, "राम", 0, 6), (1, "हरि", 7, 10)]
    docs = spark.createDataFrame([(1, "aa" * 4), (2, None), (3, ""), (4, "x" * 50 + "$1" + "y" * 50)], "doc_id long, text string")
    assert [tuple(r) for r in passages.context_snippets(docs, "aa", radius=1).collect()] == [(1, 1, "aaa…"), (1, 2, "…aaaa…"), (1, 3, "…aaaa…")]
    assert [tuple(r) for r in passages.context_snippets(docs, "$1").collect()] == [(4, 1, "…" + "x" * 40 + "$1" + "y" * 40 + "…")]
    texts = spark.createDataFrame([(1, " a\nb \n \n[Commentary]\nc\n\n\n[commentary]"), (2, None), (3, " ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in passages.paragraphs(texts, "doc_id").collect()) == [(1, 0, "antara", "a\nb"), (1, 1, "commentary", "c"), (1, 2, "commentary", "")]


@pytest.mark.parametrize(("f", "value", "want"), [
    (t.without_verse_numbers, "राम आए ॥१॥", "राम आए"), (t.without_verse_numbers, "राम आए || टेर ||", "राम आए"), (t.without_verse_numbers, "राम !!२!! आए", "राम आए"), (t.without_verse_numbers, "राम आए॥", "राम आए॥"), (t.without_verse_numbers, None, None),
    (t.end_marker, "राम || टेर ||", ("राम", "टेर")), (t.end_marker, "राम || १ ||", ("राम", "numbered")), (t.end_marker, "राम॥", ("राम", "॥")), (t.end_marker, " राम ", ("राम", None)), (t.end_marker, "राम || दो ||", ("राम", "दो")),
    (t.without_refrain_shorthand, "भरपूर॥ पूर है...", "भरपूर॥"), (t.without_refrain_shorthand, "राम आए हरि...", "राम"), (t.without_refrain_shorthand, "राम आए", "राम आए"),
    (t.basename_parts, "008-राम-गान.yaml", ("008", "राम-गान")), (t.basename_parts, "राम गान.yml", (None, "राम-गान")), (lambda c: t.slug_differs(c, F.lit("राम गान")), "a/b/001-राम-गान.yaml", False), (lambda c: t.slug_differs(c, F.lit("हरि")), "a/001-राम.yaml", True),
    (lambda c: t.anchor_id(F.lit("en"), c, F.lit(6)), "राम गान", "en-राम-गान-07")])
def test_lines_and_names(spark, f, value, want):
    got = one(spark, value, f)
    assert (tuple(got) if isinstance(want, tuple) else got) == want


def test_files(spark, tmp_path):
    (tmp_path / "list.dic").write_text("3\r\nराम/A\r\nहरि\n\n राम \n", encoding="utf-8")
    words = files.read_wordlist(spark, str(tmp_path / "list.dic"))
    assert sorted(r.word for r in words.collect()) == ["राम", "हरि"]
    files.write_wordlist(words, str(tmp_path / "out"))
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]
    assert lines == ["2", "राम", "हरि"]
    assert sorted(r.word for r in files.read_wordlist(spark, str(tmp_path / "out")).collect()) == ["राम", "हरि"]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.yaml").write_bytes("\ufefftitle: x\r\ny\n".encode())
    assert [(r.path.rsplit("/", 1)[-1], r.text) for r in files.read_documents(spark, str(tmp_path / "docs")).collect()] == [("a.yaml", "title: x\ny\n")]


def test_invalid_listings(spark):
    docs = spark.createDataFrame([(1, ["en", "zz", "zz"]), (2, None), (3, [])], "doc_id long, also_in array<string>")
    assert [tuple(r) for r in documents.invalid_listings(docs, spark.createDataFrame([("en",)], "section string")).collect()] == [("zz", 1)]


def test_whole_variant_queries_equal_brute_force(spark, tmp_path):
    r = random.Random(11)
    vocab = sorted({"".join(r.choice("abcde") for _ in range(r.randint(2, 7))) for _ in range(60)})
    texts = [" ".join(r.choice(vocab) for _ in range(20)) for _ in range(12)]
    spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = [x for text in texts for x in text.split()]
    n = {x: seen.count(x) for x in set(seen) if seen.count(x) >= 2}
    bare = {x: "".join(c for c in x if c not in "aeiou") for x in n}
    pairs = {(a, b, d) for a in n for b in n if a < b and (d := distance(a, b)) <= (1 if min(len(a), len(b)) <= 4 else 2)}
    assert pairs and {tuple(x) for x in registry.variant_pairs(spark, str(tmp_path)).collect()} == pairs
    group = {x: {x} for x in n}
    for a, b in [p[:2] for p in pairs] + [(a, b) for a in n for b in n if a < b and bare[a] == bare[b]]:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[a]:
                group[x] = group[a]
    clusters = {(min(g, key=lambda x: (-n[x], seen.index(x))), sum(n[x] for x in g), len(g)) for g in map(frozenset, group.values()) if len(g) > 1 and sum(n[x] for x in g) >= 4}
    assert clusters and {(x.canonical, x.total, x.n_forms) for x in registry.variant_clusters(spark, str(tmp_path)).collect()} == clusters
    best = {x: min((y for y in n if bare[y] == bare[x]), key=lambda y: (-n[y], y)) for x in n if bare[x]}
    want = {i: " ".join(best.get(x, x) for x in text.split()) for i, text in enumerate(texts)}
    assert {x.doc_id: x.text for x in publishing.replace_words(spark, str(tmp_path)).collect()} == {i: x for i, x in want.items() if x != texts[i]}


def test_search_keeps_short_words(spark):
    docs = spark.createDataFrame([(1, "the cat\nIt is a  cat"), (2, "the dog"), (3, None), (4, ""), (5, "राम का")], "doc_id long, text string")
    queries = [(1, "is cat"), (2, "a"), (3, "it"), (4, "का"), (5, "a dog"), (6, " "), (7, None), (8, "the")]
    texts = {1: ["the cat", "it is a cat"], 2: ["the dog"], 5: ["राम का"]}
    want = set()
    for q, x in queries:
        ws = (x or "").split()
        found = [(doc, min(i for i, line in enumerate(ls) if all(y in line for y in ws))) for doc, ls in texts.items() if ws and any(all(y in line for y in ws) for line in ls)]
        want |= {(q, k + 1, doc, at) for k, (doc, at) in enumerate(found)}
    assert {tuple(r) for r in documents.search(docs, spark.createDataFrame(queries, "query_id long, query string")).collect()} == want
    assert documents.search(docs, spark.createDataFrame([], "query_id long, query string")).count() == 0


def test_dictionaries_clean_words_of_any_length(spark):
    long = "क" * 31
    docs = spark.createDataFrame([(1, "राम। १ " + long, "hi"), (2, "॥राम॥ ह। " + long, "hi"), (3, None, "hi")], "doc_id long, text string, lang string")
    known = w.dictionary(docs.where("doc_id = 1"), "devanagari")
    assert sorted(r.word for r in known.collect()) == sorted(["राम", long])
    assert w.unknown_words(docs.where("doc_id > 1"), known, "devanagari").count() == 0
    assert {(r.section, r.n_words) for r in w.vocabulary_sizes(docs, "devanagari").collect()} == {("hi", 2), (None, 2)}
    assert {(r.word, r.n) for r in w.word_counts(docs, "devanagari", cleaned=True).collect()} == {("राम", 2), (long, 2)}
    assert long not in {r.word for r in w.word_counts(docs, "devanagari").collect()}
