"""Nested documents, lyric structure, schema lint, edits and names on small Devanagari rows."""

import os
import random
import re
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lekha.functions import lyrics as y
from lekha.functions import text as t
from lekha.operators import documents, edits, lint, listings, model, schema
from lekha.operators import words as w
from lekha.plans.shared import join_groups, shared_dir, written
from lekha.sources import records

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def many(spark, values, f):
    return spark.createDataFrame([(values,)], "x array<string>").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("line", [*(x.strip("^$").replace("\\b", "").replace("\\.", ".") for x in t.BOILERPLATE), "  REPORT ABUSE "])
def test_boilerplate(spark, line):
    assert one(spark, f"राम\n{line}\n\n\n\nहरि\n", y.cleaned) == "राम\n\nहरि"


def test_headings(spark):
    got = [one(spark, x, y.is_heading) for x in ("शिव के भजन", "आरती गान", "Bhajan List", "राम आए", "", None, "a" * 61, "भजन")]
    assert got == [True, True, True, False, False, False, False, False]


@pytest.mark.parametrize(("text", "tarz", "rest"), [
    ("तर्ज: मन डोले\nराम आए", "मन डोले", "राम आए"), ("\n राग - भैरव\nराम", "भैरव", "\nराम"), ("(तर्ज - अ ब) (फिल्म - ग) राम आए\nहरि", "अ ब (ग)", "राम आए\nहरि"), ("(फिल्म: ग)\nहरि", "ग", "हरि"),
    ("(तर्ज अ)(राग ब)\nहरि", "अ · ब", "हरि"), ("राम आए\nतर्ज: x", None, "राम आए\nतर्ज: x"), ("", None, ""), ("\n\n", None, "\n\n")])
def test_tune(spark, text, tarz, rest):
    assert tuple(one(spark, text, y.tune)) == (tarz, rest)


@pytest.mark.parametrize(("line", "bare", "body"), [
    ("राम  आए", "राम आए", "राम  आए"), (" राम\tआए ", "राम\tआए", "राम\tआए"), ("राम आए ॥१॥", "राम आए", "राम आए ॥१"), ("राम !!२!! आए", "राम आए", "राम !!२!! आए"), ("राम आए ॥", "राम आए ॥", "राम आए"),
    ("राम आए || टेर ||", "राम आए", "राम आए"), ("राम | आए", "राम | आए", "राम | आए"), ("", "", ""), (None, None, None)])
def test_lines_with_and_without_marks(spark, line, bare, body):
    assert (one(spark, line, t.without_verse_numbers), one(spark, line, lambda x: t.end_marker(x).body)) == (bare, body)


def test_trimming_takes_every_kind_of_blank(spark):
    blanks = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    for trim in (y.trimmed, t.edgeless):
        assert [one(spark, x, trim) for x in (f"{blanks}राम {blanks}आए{blanks}", blanks, "", "\u200bराम", None)] == [f"राम {blanks}आए", "", "", "\u200bराम", None]
    assert one(spark, f" राम{blanks}", t.line_end) == " राम।" and one(spark, blanks, t.line_end) == blanks


def test_hooks_and_refrain_lines(spark):
    lines = ["श्याम प्यारे आ जाओ, दर्शन दे दो", "दूसरी पंक्ति"]
    assert many(spark, lines, lambda x: y.hooks(x, F.lit("मेरे मन के राम, आओ"))) == ["मेरे मन के राम, आओ", "मेरे मन के राम", "श्याम प्यारे आ जाओ"]
    assert many(spark, ["राम, आओ"], lambda x: y.hooks(x, F.lit(""))) == []
    phrases = F.array(F.lit("श्याम प्यारे आ जाओ"))
    got = [one(spark, x, lambda c: y.is_refrain_only(c, phrases)) for x in ("श्याम प्यारे आ जाओ ॥", "श्याम...", " ", "श्याम प्यारे आ जाओ रे", "श्याम प्यारे आ जाओ, अब तो", "राम आए")]
    assert got == [True, True, True, True, False, False]


def structure(spark, text):
    x = one(spark, text, y.structured)
    return x.strategy, x.sthayi, x.paragraphs, x.line_count, x.block_count


def test_structure(spark):
    assert structure(spark, None) == structure(spark, " \n") == ("empty", "", [], 0, 0)
    assert structure(spark, "राम आए || टेर ||") == ("single-line", "राम आए", [], 1, 1)
    assert structure(spark, "राम आए ॥\nहरि गए ॥१॥\nReport abuse\nश्याम") == ("first-line-sthayi", "राम आए", ["हरि गए", "श्याम"], 3, 1)
    text = "पहला पद सुनो रे\n\nदूसरा पद सुनो\nऔर गाओ\n\nपहला पद सुनो रे\n\nतीसरा पद"
    # the first line is a hook, so its own block is a refrain and the repeated one too
    assert structure(spark, text) == ("stanza-blocks", "दूसरा पद सुनो\nऔर गाओ", ["तीसरा पद"], 5, 4)
    assert structure(spark, "एक, पद\n\nदो पद\nऔर\n\nतीन पद")[:3] == ("stanza-blocks", "एक, पद\nदो पद\nऔर", ["तीन पद"])


def test_opening_repeats(spark):
    long = "क" * 45
    assert many(spark, ["राम आए", "", "हरि", "राम  आए", "हरि"], y.without_opening_repeats) == ["राम आए", "हरि", "हरि"]
    assert many(spark, [long + "अ", long + "ब", "ग"], y.without_opening_repeats) == [long + "अ", "ग"]
    assert many(spark, [], y.without_opening_repeats) == []


def test_refrain_tail(spark):
    tail = "श्याम तेरी बंसी बजे"
    assert many(spark, [f"पहली, {tail}", f"दूसरी, {tail}", "तीसरी"], y.refrain_tail) == tail
    assert many(spark, [f"पहली, {tail}", "दूसरी पंक्ति", "तीसरी पंक्ति"], y.refrain_tail) is None
    assert many(spark, ["एक"], y.refrain_tail) is None and many(spark, [], y.refrain_tail) is None


@pytest.mark.parametrize(("text", "title", "score", "tier", "flags"), [
    ("", "x", 0, "low", ["empty"]), ("राम आए", "x", 38, "low", ["needs-manual-structure"]), ("राम आए", "राम आए", 23, "low", ["needs-manual-structure", "sthayi-equals-title"]),
    ("राम आए\nहरि गए\nश्याम सोए", "x", 80, "high", []), ("राम आए\nहरि गए", "x", 72, "medium", []), ("राम आए\nहरि गए\nशिव के भजन", "x", 45, "low", ["heading-line-in-lyrics"]),
    ("\n".join(f"पद {'क' * i}" for i in range(1, 19)), "x", 68, "medium", ["long-song-many-verses"])])
def test_scores(spark, text, title, score, tier, flags):
    x = one(spark, text, lambda c: y.scored(y.structured(c), F.lit(title)))
    assert (x.score, x.tier, x.flags, x.auto_format, x.review, x.manual) == (score, tier, flags, score >= 80, 60 <= score < 80, score < 60)


def test_refrain_suffix(spark):
    assert one(spark, "श्याम, प्यारे। आ जाओ", y.refrain_suffix) == "श्याम प्यारे आ..."
    assert one(spark, "श्याम॥", y.refrain_suffix) == "श्याम" and one(spark, " ", y.refrain_suffix) is None
    assert one(spark, "एक\nदो ॥", lambda c: y.with_refrain(c, F.lit("श्याम"))) == "एक\nदो....श्याम"
    assert one(spark, " एक। ", lambda c: y.with_refrain(c, F.lit("श्याम"))) == "एक....श्याम"
    assert one(spark, "एक।", lambda c: y.with_refrain(c, F.lit(None).cast("string"))) == "एक।"


RAW = """﻿title: "राम: गान"
swarachit: true
also_in:
  - shiv
  - राम
lyrics:
  sthayi: |
    राम आए
    हरि गए

  sthayi_connect: false
  paragraphs:
    - |
      पहला
      पद
    - commentary: |
      अर्थ
  dhvani: |
    जय
shlok: |
  श्लोक
"""


def parsed(spark, text):
    return records.parse_docs(spark.createDataFrame([("a", text)], "path string, text string")).first()


def test_parse_documents(spark):
    d = parsed(spark, RAW.replace("\n", "\r\n"))
    assert (d.title, d.self_authored, d.also_in, d.lyrics.sthayi, d.lyrics.sthayi_connect, d.lyrics.post_shlok) == ("राम: गान", True, ["shiv", "राम"], "राम आए\nहरि गए", False, "श्लोक\n\nजय")
    assert [tuple(p) for p in d.lyrics.paragraphs] == [("antara", "पहला\nपद"), ("commentary", "अर्थ")]
    d = parsed(spark, "title: x\nalso_in: shiv\nlyrics: |\n  एक\n\n  दो\ngroup: ग\n")
    assert (d.lyrics.text, d.group_name, d.also_in) == ("एक\n\nदो", "ग", ["shiv"])
    d = parsed(spark, "lyrics:\n  parts:\n    - sthayi: |\n        एक\n      paragraphs:\n        - |\n          पद\n    - sthayi: |\n        दो\n")
    assert [(p.sthayi, [q.text for q in p.paragraphs]) for p in d.lyrics.parts] == [("एक", ["पद"]), ("दो", [])]
    assert parsed(spark, None).lyrics is None and parsed(spark, "").title is None


def test_sections(spark):
    text = "site_title: x\nsections:\n  - slug: ram\n    folder: 01\n    title: राम\n    grouped: true\n  # no\n  - slug: shiv\n    bhajan_order: file\n"
    rows = records.read_sections(spark, text).collect()
    assert [(r.section_pos, r.slug, r.title, r.grouped, r.sort) for r in rows] == [(0, "ram", "राम", True, None), (1, "shiv", None, None, "file")]


def documents_of(spark, *texts):
    return records.parse_docs(spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "path string, text string"))


def test_fields_and_texts(spark):
    docs = documents_of(spark, RAW, "title: x\nlyrics: |\n  सादा\n", "lyrics:\n  parts:\n    - sthayi: |\n        एक\n      paragraphs:\n        - |\n          पद\n", "title: y\n")
    assert [(r.path, r.field, r.kind) for r in model.collect_fields(docs).orderBy("path", "field_pos").collect()] == [
        ("0", "title", None), ("0", "lyrics.sthayi", None), ("0", "lyrics.post_shlok", None), ("0", "lyrics.paragraphs[0]", "antara"), ("0", "lyrics.paragraphs[1]", "commentary"), ("1", "title", None), ("1", "lyrics", None), ("3", "title", None)]
    assert [r.field for r in model.collect_fields(docs.where("path = '0'"), commentary=False).orderBy("field_pos").collect()][-1] == "lyrics.paragraphs[0]"
    assert [r.field for r in model.editor_fields(docs.where("path = '1'")).orderBy("field_pos").collect()] == ["title", "legacy"]
    x = F.col("lyrics")
    rows = docs.select("path", model.flattened(x).alias("t"), model.renderable(x).alias("r"), model.has_refrain(x).alias("h"), model.post_text(x).alias("p"), model.flattened(model.mapped(x, lambda c: F.concat(c, F.lit("!")))).alias("m")).orderBy("path").collect()
    assert [r.t for r in rows] == ["राम आए\nहरि गए\nपहला\nपद\nअर्थ\nश्लोक\n\nजय", "सादा", "एक\nपद", ""]
    assert [(r.r, r.h, r.p) for r in rows] == [(True, True, "श्लोक\n\nजय"), (True, True, ""), (True, True, ""), (False, False, "")]
    assert [r.m for r in rows] == ["राम आए\nहरि गए!\nपहला\nपद!\nअर्थ\nश्लोक\n\nजय", "सादा!", "एक!\nपद!", ""]
    lines = docs.select("path", model.lyric_lines(F.lit("तर्ज"), x).alias("l")).orderBy("path").collect()
    assert lines[1].l == ["तर्ज", "सादा"] and one(spark, "राम  आए ॥१॥", lambda c: model.lyric_lines(c, F.lit(None).cast(model.LYRICS))) == ["राम आए"]


def test_flags(spark):
    values = [(None, None, True), ("true", "false", False), ("false", "true", False), ("true", None, True), ("FALSE", None, False)]
    for a, b, want in values:
        assert spark.range(1).select(model.flag(F.lit(a).cast("string"), F.lit(b).cast("string")).alias("x")).first().x is want


def test_schema_lint(spark):
    texts = {
        "ok": "title: x\nlyrics: |\n  राम\n", "bom": "﻿title: x\nlyrics: |\n  राम\n", "no": "tarz: x\n", "empty": "title:\nlyrics: |\n  \n", "keys": "title: x\ncolour: y\nlyrics:\n  sthayi: |\n    राम\n  dhvani: |\n    जय\n",
        "drop": "title: x\nlyrics:\n  tempo: 1\n  sthayi: |\n    राम\n", "part": "title: x\nlyrics:\n  parts:\n    - sthayi: |\n        राम\n      odd: 1\n", "also": "title: x\nalso_in: zz\nlyrics: |\n  राम\n", "null": None}
    raw = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = sorted(((r.path, r.code, r.key, r.line) for r in schema.lint(raw, ["shiv"]).collect()), key=repr)
    want = [
        ("bom", "utf8_bom", None, 1), ("no", "missing_title", None, None), ("no", "missing_lyrics", None, None), ("empty", "empty_title", None, 1), ("empty", "empty_lyrics", None, None),
        ("keys", "unknown_doc_key", "colour", 2), ("keys", "deprecated_key", "dhvani", 6), ("drop", "unknown_lyrics_key", "tempo", 3), ("drop", "empty_lyrics", None, None), ("drop", "parse_drop", "sthayi", None),
        ("part", "unknown_part_key", "odd", 6), ("also", "invalid_also_in", "zz", None), ("null", "missing_title", None, None), ("null", "missing_lyrics", None, None)]
    assert got == sorted(want, key=repr)
    assert schema.lint(raw.limit(0), []).count() == 0


def test_edits(spark):
    docs = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "1", None), ("d", "1", "x")], "path string, sha string, text string")
    made = spark.createDataFrame([("a", 1, "update", "1", "old"), ("a", 2, "update", "1", "new"), ("b", 1, "delete", "0", None), ("c", 1, "delete", "1", None), ("e", 1, "create", None, "made"), ("d", 1, "create", None, "z"), ("f", 1, "update", "1", "z"), (None, 1, "create", None, "z")],
                                 "path string, version long, op string, sha string, text string")
    got = {r.path: (r.status, r.text) for r in edits.apply_edits(docs, made).collect()}
    assert got == {"a": ("updated", "new"), "b": ("conflict", "x"), "c": ("deleted", None), "d": ("conflict", "x"), "e": ("created", "made"), "f": ("conflict", None)}
    assert {r.status for r in edits.apply_edits(docs, made.limit(0)).collect()} == {"same"}


def test_names(spark):
    existing = spark.createDataFrame([("f", "001-a.yaml"), ("f", "003-b.yaml"), ("f", "003-b-2.yaml")], "folder string, name string")
    new = spark.createDataFrame([("f", 7, "c"), ("f", 9, "c"), ("g", 1, None), ("f", 8, "??")], "folder string, doc_id long, title string")
    got = {(r.folder, r.doc_id): r.name for r in edits.allocate_names(new, existing).collect()}
    assert got == {("f", 7): "004-c.yaml", ("f", 8): "005-bhajan.yaml", ("f", 9): "006-c.yaml", ("g", 1): "001-bhajan.yaml"}
    old = spark.createDataFrame([("f", 1, "003-x.yaml", "b"), ("f", 2, "001-a.yaml", "a"), ("f", 3, "plain.yaml", "d"), ("f", 4, "003-z.yaml", "b")], "folder string, doc_id long, name string, title string")
    assert {r.doc_id: r.new_name for r in edits.rename(old, existing).collect()} == {1: "003-b-3.yaml", 3: "001-d.yaml", 4: "003-b-4.yaml"}


def test_verse_groups_and_numbers(spark):
    rows = [(1, 0, "user", "एक\nदो\n\nतीन\nचार..."), (1, 1, "assistant", "अर्थ"), (1, 2, "user", "जबानी - सुनो"), (1, 3, "user", " "), (1, 4, "user", "पाँच"), (1, 5, "user", "छह....राम"), (2, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in listings.verse_group_numbers(turns).collect()) == sorted([(1, 0, 0, 1), (1, 0, 1, None), (1, 4, 0, 2), (1, 5, 0, 3)], key=lambda r: r[:3])


def test_decisions(spark, tmp_path):
    counts = spark.createDataFrame([("हरि", 3), ("हरी", 5), ("राम", 2)], "word string, n long")
    base = w.default_decisions(w.skeleton_clusters(counts, "devanagari"))
    (d,) = base.collect()
    assert (d.action, d.canonical, d.replace) == ("ignore", "हरी", ["हरि"])
    records.write_decisions(base.select("id", F.lit("fix").alias("action"), F.lit("हरि").alias("canonical")), str(tmp_path / "d"))
    saved = records.read_decisions(spark, str(tmp_path / "d"), base)
    docs = spark.createDataFrame([(1, "हरी आए हरी। हरि"), (2, "राम"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in w.applied_decisions(docs, saved, "devanagari").collect()] == [(1, "हरि आए हरी। हरि", 1)]  # a run is taken as it stands
    assert [(r.word, r.n_docs) for r in w.decision_hits(docs, saved, "devanagari").collect()] == [("हरी", 1)]
    pairs = spark.createDataFrame([("हरी", "हरि")], "word string, canonical string")
    assert [tuple(r) for r in w.replaced_words(docs, pairs, "devanagari", cleaned=True).collect()] == [(1, "हरि आए हरि हरि", 2)]


def test_stop_words_and_composed_words(spark):
    assert one(spark, "राम के है हैं", t.tokens) == ["राम"]
    docs = spark.createDataFrame([(1, "ऩील ऩील", "hi")], "doc_id long, text string, lang string")
    assert [r.word for r in w.dictionary(docs, "devanagari").collect()] == ["ऩील"]
    assert [(r.word, r.n) for r in w.word_counts(docs, "devanagari", cleaned=True).collect()] == [("ऩील", 2)]
    unknown = w.unknown_words(docs, spark.createDataFrame([], "word string"), "devanagari", spark.createDataFrame([("ऩील",)], "word string"))
    assert unknown.count() == 0


def test_matches(spark):
    docs = spark.createDataFrame([(1, "Aa.a aA"), (2, "$1 a"), (3, None), (4, "aaa")], "doc_id long, text string")
    assert [(r.doc_id, r.n) for r in documents.find_matches(docs, "a+", regex=True).orderBy("doc_id").collect()] == [(1, 3), (2, 1), (4, 1)]
    assert [(r.doc_id, r.text) for r in documents.replaced(docs, "aa", "$1", ignore_case=True).orderBy("doc_id").collect()] == [(1, "$1.a $1"), (4, "$1a")]
    assert [(r.rank, r.doc_id) for r in documents.ranked_matches(documents.find_matches(docs, "a+", regex=True)).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 4)]
    with pytest.raises(ValueError):
        documents.find_matches(docs, "a", regex=True).count()
        documents.replaced(docs, "a", "b", regex=True)
    hits = lint.details(spark.createDataFrame([(1, "'x\" और \"y'"), (2, None)], "doc_id long, text string"), lint.TYPOS).collect()
    assert [(r.rule_id, r.hits, r.after) for r in hits] == [("mismatched_quotes", ["'x\"", "\"y'"], "'x' और 'y'")]


def test_search_titles_and_snippets(spark):
    docs = spark.createDataFrame([(1, "राम गान", "एक\nदो " + "क" * 120), (2, None, "राम आए‍ गान"), (3, "x", None)], "doc_id long, title string, text string")
    queries = spark.createDataFrame([(1, "गान राम"), (2, "दो क")], "query_id long, query string")
    got = {(r.query_id, r.doc_id): (r.rank, r.in_title, len(r.snippet)) for r in documents.with_snippets(documents.search(docs, queries, titles=True), docs).collect()}
    assert got == {(1, 1): (1, True, 0), (1, 2): (2, False, 11), (2, 1): (1, False, 100)}


def test_join_groups(spark):
    r = random.Random(1)
    rows = written(spark.createDataFrame([(r.choice([1, 1, 1, *range(2, 2000)]), i) for i in range(3000)] + [(None, -1)], "k long, i long"), "rows")
    groups = rows.where("k is not null and k <> 7").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    got = sorted(tuple(x) for x in join_groups(rows, groups, ["k"], "n", 3001).select("k", "i", "first").na.fill(-5).collect())
    want = sorted(tuple(x) for x in rows.join(groups, "k", "left").select("k", "i", "first").na.fill(-5).collect())
    assert got == want and len(got) == 3001


def test_shared_folder_is_never_local_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://x:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_rest_works_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'op1_warc' not in n and 'pipeline' not in n and len(n) > 90 and set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
    assert not re.search(r"localCheckpoint\(", "".join(p.read_text() for p in (tmp_path / "r" / "lekha").rglob("*.py")))


def test_long_texts_with_many_hits_are_rewritten_by_a_table(spark, capsys):
    """A look into a map reads it from its start, so each word of a text met each of its hits."""
    letters = "abcdefghij"
    words = ["x" + "".join(letters[int(d)] for d in str(i)) for i in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words) + " X1xa-xb"), (2, None), (3, "none")], "doc_id long, text string")
    pairs = spark.createDataFrame([(w, f"{w}!") for w in words[:-1]] + [(words[-1], None)], "word string, canonical string")
    out = w.replaced_words(docs, pairs, "ascii")
    (row,) = out.collect()
    assert row.n_replaced == 20_001 and row.text == " ".join(f"{x}!" for x in words[:-1]) + f" {words[-1]} X1xa!-xb!"
    out.explain()
    assert "hits#" not in "".join(x for x in capsys.readouterr().out.splitlines() if "lambda" in x)


def test_search_deals_out_ids_when_grams_are_many(spark, capsys, monkeypatch):
    """Grams that are joined by a shuffle don't carry their lines; what is found is the same."""
    docs = spark.createDataFrame([(1, "one abcd line\nabcd two words"), (2, "two words abcd"), (None, "words of none, two"), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "abcd words"), (2, "two"), (3, "zzz"), (4, "")], "query_id long, query string")
    few = sorted(map(str, documents.search(docs, queries).collect()))
    assert len(few) == 5
    monkeypatch.setattr(documents, "FEW_PROBES", 0, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = documents.search(docs, queries)
        assert sorted(map(str, out.collect())) == few
        capsys.readouterr()
        out.explain()
        assert not re.search(r"Generate explode.*\bline#\d+\], false, \[gram", capsys.readouterr().out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
