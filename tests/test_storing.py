"""Edit batches, names, the store, and rules of cleaning and slugs."""

import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lekha.functions import text as t
from lekha.operators import documents, edits, listings, passages
from lekha.plans import shared
from lekha.sources import store

md5 = lambda x: hashlib.md5(x.encode()).hexdigest()


def batch(spark, docs, made):
    frames = spark.createDataFrame([(p, md5(x), x) for p, x in docs], "path string, sha string, text string"), spark.createDataFrame(made, "path string, version long, op string, sha string, to string, text string")
    out, left = edits.apply_batch(*frames)
    return sorted((r.version, r.status, r.reason) for r in out.collect()), {r.path: (r.text, r.sha, r.origin) for r in left.collect()}


def by_hand(docs, made):
    """(outcomes, documents) with every edit applied to a dictionary of all."""
    here, out = {p: (x, md5(x), p) for p, x in docs}, []
    for path, version, op, sha, to, text in sorted(made, key=lambda e: e[1]):
        cur = here.get(path)
        if op == "create":
            why = "exists" if cur else None
        elif cur is None:
            why = "missing"
        elif sha not in (None, cur[1]):
            why = "stale"
        else:
            why = "exists" if op == "rename" and to != path and to in here else None
        if not why:
            new = cur if op == "rename" and text is None else (text or "", md5(text or ""), None)
            if op == "delete":
                del here[path]
            elif op == "rename":
                del here[path]
                here[to] = new
            else:
                here[path] = new
        out.append((version, "conflict" if why else {"create": "created", "update": "updated", "delete": "deleted", "rename": "renamed"}[op], why))
    return sorted(out), here


def test_chains_swaps_and_conflicts(spark):
    docs = [("a", "A"), ("b", "B"), ("c", "C"), ("z", "Z")]
    made = [
        ("a", 1, "rename", md5("A"), "t", None), ("b", 2, "rename", None, "a", "B2"), ("t", 3, "rename", md5("A"), "b", None),  # a and b swap
        ("c", 4, "update", md5("C"), None, "C1"), ("c", 5, "update", md5("C"), None, "lost"), ("c", 6, "update", md5("C1"), None, "C2"), ("c", 7, "delete", md5("C2"), None, None), ("c", 8, "create", None, None, "C3"),
        ("c", 9, "rename", None, "a", None), ("n", 10, "update", None, None, "x"), ("n", 11, "create", None, None, None), ("c", 12, "paint", None, None, None), ("c", 13, "rename", None, None, "x"), ("c", 14, "rename", None, "c", "C4")]
    out, left = batch(spark, docs, made)
    assert [o[1:] for o in out] == [
        ("renamed", None), ("renamed", None), ("renamed", None), ("updated", None), ("conflict", "stale"), ("updated", None), ("deleted", None), ("created", None),
        ("conflict", "exists"), ("conflict", "missing"), ("created", None), ("conflict", "unknown"), ("conflict", "unknown"), ("renamed", None)]
    assert left == {"a": ("B2", md5("B2"), None), "b": ("A", md5("A"), "a"), "c": ("C4", md5("C4"), None), "n": ("", md5(""), None), "z": ("Z", md5("Z"), "z")}
    assert batch(spark, docs, []) == ([], {p: (x, md5(x), p) for p, x in docs})
    assert batch(spark, [], [(None, 1, "create", None, None, "x"), ("q", 2, "create", None, None, "y")]) == ([(2, "created", None)], {"q": ("y", md5("y"), None)})


@pytest.mark.parametrize("seed", range(2))
def test_batches_like_a_dictionary(spark, seed):
    rng = random.Random(seed)
    paths = [f"p{i}" for i in range(30)]
    docs = [(p, p.upper()) for p in paths if rng.random() < 0.6]
    made, last = [], {p: md5(x) for p, x in docs}
    for v in range(400):
        p = rng.choice(paths) if rng.random() < 0.7 else "p0"  # one path has a third of all edits
        op, text = rng.choice(["create", "update", "update", "delete", "rename"]), rng.choice([f"v{v}", None])
        made.append((p, v, op, rng.choice([None, last.get(p), md5("?")]), rng.choice(paths[int(p[1:]) // 5 * 5 :][:5]) if op == "rename" else None, text))
        last[p] = md5(text or "")
    assert batch(spark, docs, made) == by_hand(docs, made)


def test_names_like_one_after_another(spark):
    rng = random.Random(4)
    taken = {("f", n) for n in ("001-a.yaml", "001-a-2.yaml", "001-a-5.yaml", "001-a-07.yaml", "001-b-3.yaml", "002-a.yaml")} | {("g", f"003-x-{k}.yaml") for k in rng.sample(range(2, 60), 25)} | {("g", "003-x.yaml")}
    rows = [("f", i, f"{n:03}-old.yaml", title) for i, (n, title) in enumerate([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (1, "a"), (9, "old")] * 4)]
    rows += [("g", 100 + i, "003-old.yaml", "x") for i in range(40)]
    want, used = {}, set(taken)
    for folder, i, name, title in sorted(rows, key=lambda r: r[1]):
        if title != "old":
            new, k = f"{name[:3]}-{title}.yaml", 1
            while (folder, new) in used:
                k += 1
                new = f"{name[:3]}-{title}-{k}.yaml"
            used.add((folder, new))
            want[i] = new
    docs = spark.createDataFrame(rows, "folder string, doc_id long, name string, title string")
    existing = spark.createDataFrame(sorted(taken), "folder string, name string")
    assert {r.doc_id: r.new_name for r in edits.rename(docs, existing).collect()} == want
    fresh = edits.allocate_names(docs.where("folder = 'g'").select("folder", "doc_id", "title"), existing).orderBy("doc_id").collect()
    assert [r.name for r in fresh] == [f"{len([x for x in taken if x[0] == 'g']) + 1 + i:03}-x.yaml" for i in range(40)]


def stored(spark, tmp_path, n=400):
    path = f"file://{tmp_path}/a folder"
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s ü/"), (F.col("id") % 3).cast("string")).alias("section"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        store.create(docs, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path, docs


def test_commit_copies_only_what_changes(spark, tmp_path):
    path, docs = stored(spark, tmp_path)
    before = store.files(spark, path)
    assert len(before) > 2
    change = docs.where("doc_id = 0").withColumn("text", F.lit("new")).unionByName(docs.where("doc_id = 3"))  # 3 is as it was
    assert store.commit(spark, path, change, docs.where("doc_id = 6").select("doc_id")) == 2
    after = store.files(spark, path)
    kept = set(before) & set(after)
    assert len(kept) == len(before) - 1 and store.versions(spark, path) == [1, 2]
    rows = {r.doc_id: r.text for r in store.read(spark, path).collect()}
    assert len(rows) == 399 and rows[0] == "new" and 6 not in rows and rows[3] == "text 3"
    assert {r.doc_id: r.text for r in store.read(spark, path, 1).collect()} == {i: f"text {i}" for i in range(400)}
    assert store.commit(spark, path, docs.where("doc_id in (3, 5)")) == 2  # nothing new
    added = spark.createDataFrame([(1000, "t", "b"), (1000, "t", "a"), (None, "t", "x")], "doc_id long, section string, text string")
    assert store.commit(spark, path, added) == 3 and set(after) < set(store.files(spark, path))  # files are only added
    assert [r.text for r in store.read(spark, path).where("doc_id = 1000").collect()] == ["b"]


def test_failed_commit_leaves_the_old_version(spark, tmp_path):
    path, docs = stored(spark, tmp_path, 50)
    broken = docs.where("doc_id < 5").withColumn("text", F.expr("if(doc_id = 4, raise_error('lost'), 'new')"))
    with pytest.raises(Exception, match="lost"):
        store.commit(spark, path, broken)
    assert store.versions(spark, path) == [1] and store.read(spark, path).where("text = 'new'").isEmpty()
    # a version whose manifest was begun and not finished is not seen, and is written anew
    begun = tmp_path / "a folder" / "manifests" / "version=2" / "_temporary"
    begun.mkdir(parents=True)
    assert store.versions(spark, path) == [1]
    assert store.commit(spark, path, docs.where("doc_id = 4").withColumn("text", F.lit("y"))) == 2
    assert store.read(spark, path).where("text = 'y'").count() == 1


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_cleaning_trims_all_blanks(spark):
    clean = lambda x: one(spark, x, lambda c: t.without_lines(c, t.JUNK))
    assert clean("\nGoogle Sites\nfoo\n") == "foo" and clean("a\n\n\n\n report ABUSE \nb \n") == "a\n\nb"
    assert clean("DOCS_timing_x\nDOCS_timing = 1\nराम") == "DOCS_timing_x\nराम" and clean("Google Sites x") == "Google Sites x"
    rows = spark.createDataFrame([(1, "a", "राग"), (2, "a", " Google sites\n"), (3, "a\n", None), (4, None, None), (5, None, "Report abuse")], "doc_id long, text string, tarz string")
    assert sorted(tuple(r) for r in documents.cleaned_documents(rows).collect()) == [(2, "a", None), (3, "a", None), (5, None, None)]


def test_slugs_of_equal_spellings_are_equal(spark):
    title = "पढ़ो गाड़ी"
    a, b = unicodedata.normalize("NFC", title), title.replace("ढ़", "ढ़").replace("ड़", "ड़")
    assert a != b and one(spark, a, t.slug) == one(spark, b, t.slug) == unicodedata.normalize("NFC", "पढ़ो-गाड़ी")
    assert one(spark, "  राम\tनाम \n", t.slug) == "राम-नाम" and one(spark, None, t.slug) == "bhajan"
    assert one(spark, f"x/001-{one(spark, a, t.slug)}.yaml", lambda c: t.slug_differs(c, F.lit(b))) is False


def test_spoken_verses_need_a_sign(spark):
    rows = [(1, 0, "user", "जबानी का गीत"), (1, 1, "user", " जबानी : कथा"), (1, 2, "user", "जबानी–x"), (1, 3, "assistant", "टीका"), (1, 4, "user", " "), (1, 5, "user", "राम"), (1, 6, "user", None)]
    got = listings.verse_numbers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [(r.turn, r.number) for r in got] == [(0, 1), (5, 2)]


def test_offsets_of_a_long_text(spark):
    text = "१राम।, श्री रा a \U0001f600 क्ष॥ " * 5000
    rows = spark.createDataFrame([(1, text), (None, "राम"), (2, None), (3, "")], "doc_id long, text string")
    got = passages.token_offsets(rows, "devanagari").collect()
    assert len(got) == 4 * 5000 + 1 and {r.doc_id for r in got} == {1, None}
    clean = {"१राम।": "राम", "श्री": "श्री", "रा": "रा", "क्ष॥": "क्ष"}
    assert all(clean[text[r.start : r.stop]] == r.word for r in got if r.doc_id == 1)


def test_wordlists_in_collated_order(spark, tmp_path):
    from lekha.sources import files

    words = ["ख", "का", "क", "zeta", "Alpha", "alpha", "ज़", "ज"]
    files.write_wordlist(spark.createDataFrame([(w,) for w in [*words, "क", None]], "word string"), f"file://{tmp_path}/w", collation="hi")
    lines = [x for p in sorted((tmp_path / "w").glob("part-*")) for x in p.read_text().splitlines()]
    want = [r.w for r in spark.createDataFrame([(w,) for w in words], "w string").orderBy(F.collate("w", "hi"), "w").collect()]
    assert lines == [str(len(words)), *want] and lines[1:] != sorted(words)
    assert {r.word for r in files.read_wordlist(spark, f"file://{tmp_path}/w").collect()} == set(words)


def test_excerpts_keep_their_length(spark):
    assert one(spark, " a\n b ", lambda c: t.excerpt(c, 3)) == "a b" and one(spark, "राम राम", lambda c: t.excerpt(c, 4)) == "राम …"[:4] + "…"


def test_vacuum_keeps_what_kept_versions_name(spark, tmp_path):
    path, docs = stored(spark, tmp_path, 50)
    assert store.vacuum(spark, path) == (0, 0) and store.versions(spark, path) == [1]
    change = lambda i, x: docs.where(F.col("doc_id") == i).withColumn("text", F.lit(x))
    store.commit(spark, path, change(3, "new"))
    store.commit(spark, path, change(40, "newer"))
    broken = docs.where("doc_id = 5").withColumn("text", F.expr("if(doc_id = 5, raise_error('no'), text)"))
    with pytest.raises(Exception, match="no"):
        store.commit(spark, path, broken)
    loose = next((tmp_path).rglob("data")) / "loose"
    docs.coalesce(1).write.parquet(str(loose))  # as a commit leaves them that fails before its manifest
    before, want = set(store.files(spark, path, 1)), {(r.doc_id, r.text) for r in store.read(spark, path).collect()}
    gone = before - set(store.files(spark, path, 2)) - set(store.files(spark, path, 3))
    assert store.vacuum(spark, path, keep=2) == (1, len(gone) + 1) and not loose.exists()
    assert store.versions(spark, path) == [2, 3] and {(r.doc_id, r.text) for r in store.read(spark, path).collect()} == want
    assert store.read(spark, path, 2).where("text = 'newer'").isEmpty() and store.read(spark, path, 2).count() == 50
    on_disk = {"data/" + "/".join(p.parts[-2:]) for p in loose.parent.rglob("*.parquet")}
    assert on_disk == set(store.files(spark, path, 2)) | set(store.files(spark, path, 3))
    with pytest.raises(ValueError, match="last"):
        store.vacuum(spark, path, keep=0)
    assert store.commit(spark, path, change(7, "later")) == 4 and store.vacuum(spark, path, keep=1)[0] == 2
    assert store.read(spark, path).where("text in ('new', 'newer', 'later')").count() == 3


def test_clear_removes_own_tables_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    (tmp_path / "lekha" / "another" / "x").mkdir(parents=True)
    assert shared.written(spark.range(3), "three").count() == 3
    assert shared.clear(spark) and [p.name for p in (tmp_path / "lekha").iterdir()] == ["another"]
    assert not shared.clear(spark)
