"""Cases that every operator must stand: repeated and missing ids, seams, giants, ties, and what earlier versions got wrong."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lekha.llm import exact_dedup, langid, ngram_join, packing, pii, sentencepiece_scan, substring_dedup, topk, toxicity, warc
from lekha.llm.batches import text_bytes

SF = "/root/testdata/sf0.001"
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, n string, k string")


def fitted_langid(spark):
    labelled = [(i, "the quick brown fox and the lazy dog" if i % 2 else "der schnelle braune Fuchs und der faule Hund", "en" if i % 2 else "de") for i in range(40)]
    return langid.fit(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))


def test_langid_rows_do_not_bear_on_each_other(spark, monkeypatch):
    model = fitted_langid(spark)
    texts = ["the", "hund", "fox", "und", "", "the lazy", "x", "der faule", "th", "e quick fox and the dog" * 40]
    together = model.counts(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        alone = model.counts(*text_bytes(pa.array([t])))
        assert (together[0][i], together[1][i].tolist()) == (alone[0][0], alone[1][0].tolist())
    monkeypatch.setattr(langid, "PIECE", 7)  # pieces of a row have no seams
    cut = model.counts(*text_bytes(pa.array(texts)))
    assert (cut[0] == together[0]).all() and (cut[1] == together[1]).all()


def test_langid_many_languages():
    sets = {f"l{i:03}": np.array([i * 7919 + 13], np.int64) for i in range(150)}
    model = langid.Filter.of(sets, 16)
    assert len(model.slots) == 3
    for i in (0, 70, 149):
        masks = model.masks(np.array([i * 7919 + 13], np.uint32))
        assert int(masks[i // 64][0]) >> (i % 64) & 1


def test_langid_repeated_rows_and_long_text(spark):
    model = fitted_langid(spark)
    long = "the quick brown fox " * 300_000  # 6 MB
    got = [(r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.predict(docs(spark, [(1, "the fox"), (1, "the fox"), (None, "der Hund"), (2, long)]), model).collect()]
    assert got.count(got[0]) == 2 and {(i, x) for i, x, _ in got} == {(1, "en"), (None, "de"), (2, "en")}


def test_warc_second_write_and_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    page = lambda i, h: spark.createDataFrame([(i, "u", h)], "page_id long, url string, html string")
    warc.write_warc(page(1, "a"), path)
    warc.write_warc(page(2, "b"), path)
    assert {r.page_id for r in warc.page_records(warc.read_warc(spark, path)).collect()} == {1, 2}
    warc.write_warc(page(3, "c"), path, mode="overwrite")
    assert {r.page_id for r in warc.page_records(warc.read_warc(spark, path)).collect()} == {3}


def test_warc_repeated_and_null_ids(spark, tmp_path):
    a, b = "A" * 150, "B" * 220
    rows = [(5, "u", a), (5, "u", b), (3, "u", a), (None, "u", a), (7, "u", b), (5, "u", b)]
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    digest = lambda h: hashlib.sha256(h.encode()).hexdigest()
    got = sorted((tuple(r) for r in warc.page_records(warc.read_warc(spark, path)).collect()), key=repr)
    want = [(5, 150, digest(a), "revisit", 3), (5, 220, digest(b), "response", None), (5, 220, digest(b), "response", None), (3, 150, digest(a), "response", None), (None, 150, digest(a), "response", None), (7, 220, digest(b), "revisit", 5)]
    assert got == sorted(want, key=repr)


def test_warc_paths_mean_the_same_everywhere(spark, tmp_path, monkeypatch):
    conf = spark._jsc.hadoopConfiguration()
    was = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://name:8020")
        assert warc.resolved(spark, "/user/x") == "hdfs://name:8020/user/x"
        conf.set("fs.defaultFS", "file:///")
        assert warc.resolved(spark, "/user/x") == "file:/user/x" and warc.resolved(spark, "s3a://b/x") == "s3a://b/x"
        monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
        with pytest.raises(ValueError, match="share"):
            warc.resolved(spark, "/user/x")
        assert warc.resolved(spark, "file:///shared/x") == "file:///shared/x"
        monkeypatch.undo()
    finally:
        conf.set("fs.defaultFS", was)
    warc.write_warc(spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string"), f"{tmp_path}/bare")
    assert [r.page_id for r in warc.page_records(warc.read_warc(spark, f"{tmp_path}/bare")).collect()] == [1]


def test_warc_hot_page(spark, tmp_path):
    rows = spark.range(6000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 1, F.lit("x" * 200)).otherwise(F.concat(F.lit("y" * 100), (F.col("id") % 1000).cast("string"))).alias("html"))
    warc.write_warc(rows, f"file://{tmp_path}/w")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.page_records(warc.read_warc(spark, f"file://{tmp_path}/w")).collect()}
    first = {}
    for i in range(6000):
        first.setdefault("x" if i % 3 == 1 else i % 1000, i)
    want = {i: first["x" if i % 3 == 1 else i % 1000] for i in range(6000)}
    assert got == {i: ("response", None) if i == f else ("revisit", f) for i, f in want.items()}


class Pieces:
    """A model of a few pieces with fractional scores."""

    PIECES = (("<unk>", 0.0), ("▁", -2.5), ("a", -1.0), ("b", -1.25), ("ab", -2.125), ("ba", -2.375), ("▁a", -3.6), ("aba", -3.0), ("bab", -3.76), ("<0xC3>", 0.0), ("<0xA9>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256) if i not in (0xC3, 0xA9)))

    def __init__(self, **_):
        pass

    def __len__(self):
        return len(self.PIECES)

    def is_control(self, i):
        return False

    is_unused = is_control

    def is_unknown(self, i):
        return i == 0

    def is_byte(self, i):
        return i >= 9

    def id_to_piece(self, i):
        return self.PIECES[i][0]

    def get_score(self, i):
        return self.PIECES[i][1]

    def unk_id(self):
        return 0


def best_by_hand(model, text):
    """Ids of the best segmentation, by trying all last pieces; of equal weights the longest last piece."""
    if not text:
        return []
    x = "▁" + text.replace(" ", "▁")
    score = {model.id_to_piece(i): (model.get_score(i), i) for i in range(len(model)) if not (model.is_unknown(i) or model.is_byte(i) or model.is_control(i) or model.is_unused(i))}
    byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(len(model)) if model.is_byte(i)}
    low, most = min(s for s, _ in score.values()) - 10, max(map(len, score))
    best = [(0.0, [])]
    for j in range(1, len(x) + 1):
        found = None
        for i in range(max(0, j - most), j):
            piece = x[i:j]
            if piece in score:
                w, ids = score[piece][0], [score[piece][1]]
            elif j == i + 1:
                w, ids = low, [byte[b] for b in piece.encode()]
            else:
                continue
            total = best[i][0] + w
            if found is None or total > found[0] + 1e-9:
                found = (total, best[i][1] + ids)
        best.append(found)
    return best[-1][1]


def test_sentencepiece_fractional_scores(monkeypatch):
    monkeypatch.setattr(sentencepiece_scan.sentencepiece, "SentencePieceProcessor", Pieces)
    g, r = sentencepiece_scan.Segmenter("fractions"), random.Random(1)
    texts = ["".join(r.choice("aabb é") for _ in range(r.randrange(30))) for _ in range(300)]
    assert g.encode_rows(pa.array(texts)).to_pylist() == [best_by_hand(Pieces(), t) for t in texts]


def test_sentencepiece_random_lattices():
    import sentencepiece

    model, g, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_scan.Segmenter(PIECES), random.Random(2)
    alphabet = [*"aabcdethe rsn \n.,12", "▁", "☃", "é", "中", "न", "  ", "the ", "ing ", "\t"]
    texts = [None, "", *("".join(r.choice(alphabet) for _ in range(r.choice([1, 3, 10, 60]))) for _ in range(300)), "x" * 100]
    got = g.encode_rows(pa.array(texts))
    assert got.to_pylist() == [best_by_hand(model, t or "") for t in texts]
    assert g.decode_rows(got).to_pylist() == [(t or "").replace("▁", " ") for t in texts]


def test_sentencepiece_tree_and_repeated_giants(spark):
    r = random.Random(3)
    giant = "".join(r.choice("ab cdé the ") for _ in range(1500))
    rows = [(1, giant), (1, giant), (1, giant[::-1]), (None, giant), (2, "short"), (2, "short")]
    g = sentencepiece_scan.Segmenter(PIECES)
    want = sorted((str(i), zlib.crc32(g.encode(t)), True) for i, t in rows)
    got = sentencepiece_scan.summary(docs(spark, rows), PIECES, chunk=40, fan=3).collect()  # three levels of the tree
    assert sorted((str(x.doc_id), x.ids_crc32, x.round_trip) for x in got) == want


def test_ngram_join_repeated_ids_and_a_cloud(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[r.randrange(80)] = f"x{i % 40}"
        rows.append((i // 2, " ".join(copy)))  # ids come twice
    rows += [(None, " ".join(base)), (500, None), (500, "")]
    got = [(x.doc_id, x.n_shingles, x.links, x.component_id) for x in ngram_join.ngram_join(docs(spark, rows), 3, 90, block=20).collect()]
    sets = [(i, frozenset(zip(*[t.split()[k:] for k in range(3)]))) for i, t in rows[:-3]]
    classes = {s for _, s in sets}
    links = {s: sum(1 for o in classes if o != s and 100 * len(s & o) >= 90 * len(s | o)) for s in classes}
    want = [(i, len(s), links[s], 0) for i, s in sets] + [(500, 0, 0, 500)] * 2
    assert all(links.values()) and sorted(got) == sorted(want)


def met_rows(rows, words, percent, buckets, step, part=0.0):
    """What the buckets of the index make of rows (doc_id, text), with a part of all shingles taken as common: (u, v, hot), and the sets."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    sets = ngram_join.shingles(*text_bytes(batch.column("text")), words)
    every = np.unique(np.concatenate(sets))
    common = every[ngram_join.mix(every) < np.uint64(part * 2**63) * np.uint64(2)] if part < 1 else every
    made = pa.Table.from_batches(ngram_join._index(words, percent, buckets, common, step)([batch])).combine_chunks()
    parts = [ngram_join._meet(made.filter(pc.equal(made["bucket"], b))) for b in range(buckets)]
    return [tuple(x.values()) for p in parts for x in p.to_pylist()], {i: frozenset(h.tolist()) for (i, _), h in zip(rows, sets, strict=True)}


def test_ngram_pairs_are_made_once_not_in_each_bucket():
    r = random.Random(11)
    rows = []
    for i in range(300):  # of two near copies each, one word differs
        a = [f"w{r.randrange(10**6)}" for _ in range(300)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join([*a[:150], "x", *a[151:]]))]
    for buckets in (1, 5, 60):
        met, _ = met_rows(rows, 3, 90, buckets, 100)
        assert {(u, v) for u, v, _ in met} == {(2 * i, 2 * i + 1) for i in range(300)} and len(met) <= 7 * 300  # six shingles differ
    crowd = [(i, " ".join([*a[:150], f"x{i}", *a[151:]])) for i in range(400)]
    for step in (10, 500):  # keys that are hot in their bucket alone, and in the step
        assert len(met_rows(crowd, 3, 90, 60, step)[0]) <= 5 * 400


@pytest.mark.parametrize("part", [0.0, 0.1, 0.7, 1.0])  # whichever shingles a sample shows as common
@pytest.mark.parametrize(("words", "percent", "hot", "here"), [(3, 90, 24, 12), (3, 90, 3, 12), (1, 60, 3, 2), (2, 75, 2, 50), (1, 80, 4, 3)])
def test_ngram_index_loses_no_link(words, percent, hot, here, part, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "HOT_HERE", here)
    r = random.Random(words * percent + hot)
    rows = []
    for _ in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([6, 15, 40, 120]))]
        for _ in range(r.choice([1, 2, 9, 30])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                copy[r.randrange(len(copy))] = f"x{r.randrange(40)}"
            rows.append((len(rows), " ".join(copy[r.choice([0, 0, 1]) :])))
    met, sets = met_rows(rows, words, percent, 7, 50, part)
    linked = lambda u, v: 100 * len(sets[u] & sets[v]) >= percent * len(sets[u] | sets[v])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}  # equal sets are one class without the index
    for u, v, always in [*((first.setdefault(x, i), i, True) for i, x in sets.items()), *met]:
        if always or linked(u, v):
            root[find(u)] = find(v)
    lost = [(u, v) for u in range(len(rows)) for v in range(u) if linked(u, v) and find(u) != find(v)]
    assert not lost and any(linked(u, v) for u in range(len(rows)) for v in range(u))


def test_ngram_join_long_text(spark):
    words = [f"w{i}" for i in range(400_000)]  # 2.8 MB
    near = [*words[:-2000], *(f"y{i}" for i in range(2000))]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.links) for x in ngram_join.ngram_join(docs(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:100]))]), 3, 90).collect()}
    assert got == {1: (399_998, 1, 1), 2: (399_998, 1, 1), 3: (98, 3, 0)}


def test_exact_dedup_repeated_missing_and_long(spark):
    long = "ab c" * 1_500_000  # 6 MB
    rows = [(4, long), (2, long + " "), (2, long + "\t"), (7, "x"), (7, "x"), (7, "y"), (None, "x"), (1, None), (9, "")]
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect())
    assert got == sorted([(4, 4, 1, True), (2, 2, 2, True), (2, 2, 2, True), (7, 7, 2, True), (7, 7, 2, True), (7, 7, 1, True), (1, 1, 2, True), (9, 1, 2, False)])


def test_exact_dedup_filter_keeps_what_is_wanted(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    wanted = rows.where("doc_id % 7 = 0")
    left = {r.doc_id for r in exact_dedup.those_wanted(rows, wanted, "doc_id").collect()}
    assert left >= set(range(0, 5000, 7)) and len(left) < 1500


def test_substring_dedup_repeated_ids(spark):
    r = random.Random(6)
    text = "".join(r.choice("abcd ") for _ in range(300))
    rows = [(1, text), (1, text), (0, text[50:250]), (None, text), (2, "short"), (2, None)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed) for x in substring_dedup.remove_repeats(docs(spark, rows)).collect())
    # the first of the repeated rows loses what document 0 holds, the second all
    assert got == [(0, 200, 0), (1, 300, 200), (1, 300, 300), (2, 0, 0), (2, 5, 0)]


def test_packing_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer, encoder, r = Tokenizer.from_file(WORDS), packing.Encoder(WORDS), random.Random(7)
    alphabet = [*"aabcdeSTMRVLrelvdm''''  \n\t1239.,!?-<|>éÉßÿÀñ", "'s", "'re", "'ll", "☃", "×", "ª", "'S", "''", "x" * 70]
    texts = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 40, 300]))) for _ in range(2000)]
    texts += ["word it's " * 300_000, "a" * 3_000, "naïve ☃ " * 1000, None]  # 3 MB, one word, not plain
    got = encoder.encode(*text_bytes(pa.array(texts)))
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_packing_fills_windows_and_stands_repeated_ids(spark):
    rows = [(i // 2, "some words of a text " * (1 + i % 90)) for i in range(400)] + [(None, "x")]
    out = packing.pack(docs(spark, rows), WORDS, capacity=512, block=200).collect()
    sums, tokens = {}, 0
    for x in out:
        sums[x.sequence_id] = sums.get(x.sequence_id, 0) + x.length
        tokens += x.length
    assert max(sums.values()) <= 512 and tokens >= 0.97 * 512 * len(sums) and len({x.doc_id for x in out}) == 200


def test_topk_reads_lists_only_as_far_as_it_must():
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 8)) * 60
    x = np.floor(centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 8)) * 4).astype(np.int64)
    lists = topk.Lists(np.arange(4000), x)
    read = []
    for i in range(0, 400, 20):
        ids, scores, part = lists.search(x[i], i, 20)
        every = x @ x[i]
        want = sorted((-s, j) for j, s in enumerate(every.tolist()) if j != i)[:20]
        assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want
        read.append(part)
    assert np.mean([p for _, p in read]) < 0.9


def test_topk_repeated_missing_and_clashing(spark):
    vectors = {1: [[1.0, 0.0]], 2: [[0.5, 0.5]], 3: [[0.0, 1.0], [0.0, 1.0]], 20: [[1.0, 0.0], [0.0, 2.0], [0.0, 2.0]], None: [[9.0, 9.0]]}
    rows = [(i, v, True, "b", 7) for i, vs in vectors.items() for v in vs]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, query boolean, b string, rank int"))
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 20 = 0"), k=5, rows=2, block=1).orderBy("rank").collect()]
    asked = [tuple(int(64 * x) for x in q) for q in ([1.0, 0.0], [0.0, 2.0])]  # its equal rows are one
    hits = [(-sum(int(64 * x) * y for x, y in zip(c, q)), i) for i, vs in vectors.items() if i not in (20, None) for c in vs for q in asked]
    assert got == [(20, k + 1, i, -s) for k, (s, i) in enumerate(sorted(hits)[:5])]
    none = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(none, none).count() == topk.top_k(v, none).count() == topk.top_k(none, v).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(none, model).count() == 0
    assert packing.pack(none, WORDS).count() == 0
    assert sentencepiece_scan.summary(none, PIECES).count() == 0


def test_toxicity_without_labels_marks_nothing(spark):
    rows = [(1, "you fool", "x", 1), (1, "you fool", "y", 2), (2, None, "z", 3), (None, "", "w", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f0 string, score int")
    model = toxicity.fit(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert sorted((r.doc_id or 0, round(r.score, 9), r.predicted) for r in got) == [(0, toxicity.PRIOR, 0), (1, toxicity.PRIOR, 0), (1, toxicity.PRIOR, 0), (2, toxicity.PRIOR, 0)]
    # many rows of one label alone do decide
    labels = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, "text") for i in range(8)], "doc_id long, text string")
    assert {r.predicted for r in toxicity.score(texts, toxicity.fit(texts, labels)).collect()} == {1}


def test_toxicity_learns_threats_and_stems(spark):
    rows = []
    for i in range(120):
        rows.append((i, ["i will vorgle you", f"such a blumfit{'abcdefgh'[i % 8]}er here", "we will walk today", "a fine day here"][i % 4], int(i % 4 < 2)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table, table)
    assert "vorgle" in model.threats and "blumf" in model.stems
    got = [x.predicted for x in toxicity.score(docs(spark, [(1, "i will vorgle them"), (2, "what a blumfitzor"), (3, "a walk"), (4, None), (4, None), (5, "fine day " * 700_000)]), model).orderBy("doc_id").collect()]
    assert got == [1, 1, 0, 0, 0, 0]


def test_pii_estimates_known_reliabilities():
    r = random.Random(8)
    right = {"check": 0.95, "gazetteer": 0.85, "context": 0.75, "variety": 0.65}
    counts = {}
    for _ in range(40_000):
        y = r.random() < 0.6
        votes = tuple((1 if y else -1) * (1 if r.random() < right[v] else -1) for v in pii.VOTES)
        counts[votes] = counts.get(votes, 0) + 1
    rows = [{"kind": 0, "loose": False, "size": 1, "n": n, **dict(zip(pii.VOTES, votes, strict=True))} for votes, n in sorted(counts.items())]
    model, _ = pii.expectation_maximisation(rows, 200)
    assert abs(model.prior[0] - 0.6) < 0.05
    for v, p in right.items():
        assert abs(model.reliability[v][1][1] - p) < 0.05 and abs(model.reliability[v][0][-1] - p) < 0.05


def test_pii_adds_secrets_that_the_labelers_agree_on(spark):
    r = random.Random(9)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'some words token = "{key()}" and more') for i in range(30)] + [(100 + i, f"mail a{i}bcdefgh@example.com now, id 1234-{i}") for i in range(30)]
    rows += [(300, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"), (301, None)]
    found = {x.doc_id: x for x in pii.find(docs(spark, rows)).collect()}
    assert all(found[i].n_secret == 1 and found[i].spans == "secret:20:60" for i in range(30))
    assert all(found[100 + i].n_email == 1 and found[100 + i].n_added == 0 for i in range(30))
    assert found[300].n_spans == 0 and found[301].n_spans == 0
    masked = {x.doc_id: x.text for x in pii.masked(docs(spark, rows)).collect()}
    assert masked[0] == 'some words token = "<SECRET>" and more' and masked[301] is None


def test_pii_counts_each_kind_by_itself(spark):
    email, ip, card, phone = "x@y.org", "10.20.30.40", "4111 1111 1111 1111", "+1 (456) 555-2186"
    want = {(e, i, c, p): " ; ".join([email] * e + [ip] * i + [card] * c + [phone] * p) for e in range(3) for i in range(3) for c in range(2) for p in range(3)}
    rows = list(enumerate(want.values()))
    found = {x.doc_id: (x.n_email, x.n_ip, x.n_card, x.n_phone) for x in pii.find(docs(spark, [*rows, (len(rows), None)])).collect()}
    assert found == {**dict(enumerate(want)), len(rows): (0, 0, 0, 0)}


def test_pii_masks_giant_texts(spark):
    text = ("é word " * 50 + "a@b.co and 10.20.30.40 ") * 400  # spans over many blocks
    want = re.sub(r"10\.20\.30\.40", "<IP>", text.replace("a@b.co", "<EMAIL>"))
    got = pii.masked(docs(spark, [(1, text), (1, text), (2, "")])).collect()
    assert [x.text for x in got if x.doc_id == 1] == [want, want] and got[0].n == "clash"


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


@pytest.fixture(scope="module")
def chain(spark):
    """The pipeline's stages on sf0.001 with planted copies, and their results."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    base = table.where("length(text) between 400 and 3000").orderBy("doc_id").limit(3).collect()
    planted = [(900_000 + i, f" {r.text}\n", r.lang, "planted", 1) for i, r in enumerate(base)]
    planted += [(910_000 + i, r.text + " zzz", r.lang, "planted", 1) for i, r in enumerate(base)] + [(920_000, "12 34", "en", "planted", 1), (920_001, None, "en", "planted", 1), (920_002, "the and of", "en", "planted", 1)]
    docs_ = table.unionByName(spark.createDataFrame(planted, table.schema))
    results = [docs_]
    for _, stage in corpus_pipeline.STAGES:
        results.append(stage(spark, results[-1], SF).cache())
    return [r.toPandas() for r in results]


def test_pipeline_equals_a_plain_chain(spark, chain):
    from tokenizers import Tokenizer

    given, known, exact, near, private, packed = chain
    text = dict(zip(given.doc_id, given.text, strict=True))
    # language ID: each document by its own counts
    model = langid.fit(spark.createDataFrame(given).where(~langid.held_out()))
    keeps = set()
    for i, t in text.items():
        if t and re.search(r"[^\W\d_]", t):
            _, _, coverage = model.decide(*model.counts(*text_bytes(pa.array([t.lower()]))))
            if coverage[0] >= 0.2:
                keeps.add(i)
    assert set(known.doc_id) == keeps and 920_000 not in keeps and 920_001 not in keeps
    # exact dedup
    first = {}
    for i in sorted(keeps):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i]), i)
    assert set(exact.doc_id) == set(first.values())
    # near copies
    ids, sets = sorted(first.values()), {}
    for i in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text[i]))
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in ids}
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = root[i], root[j]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert set(near.doc_id) == {i for i in ids if root[i] == i}
    # personal data: base spans by regex, the others as found
    masked = dict(zip(private.doc_id, private.text, strict=True))
    spans = {r.doc_id: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in pii.find(spark.createDataFrame(near)).collect()}
    for i in near.doc_id:
        out, at = "", 0
        for k, a, b in sorted(spans[i], key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += text[i][at:a] + f"<{k.upper()}>"
            at = max(at, b)
        assert masked[i] == out + text[i][at:]
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", masked[i])
    # packing
    tokenizer = Tokenizer.from_file(WORDS)
    for i, rows in packed.groupby("doc_id"):
        ids, at = np.array([*tokenizer.encode(masked[i], add_special_tokens=False).ids, 2], "<u4"), 0
        for r in rows.sort_values("start").itertuples():
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert set(packed.doc_id) == set(near.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 4096


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_pipeline_stages_stand_edge_cases(spark, stage):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(7_000_000, None, "en", None, None), (7_000_001, "", None, "s", 0), (7_000_002, "the and of", "en", "s", 1), (7_000_002, "the and of", "en", "s", 1), (7_000_003, "x" * 6000, None, None, 1)]
    both = table.unionByName(spark.createDataFrame(odd, table.schema)).withColumn("candidates", F.lit("clash")).withColumn("spans", F.lit(1))
    out = stage(spark, both, SF)
    assert out.count() > 0 and stage(spark, both.limit(0), SF).count() == 0
    assert "sequence_id" in out.columns or out.columns == both.columns
