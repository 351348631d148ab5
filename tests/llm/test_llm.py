import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lekha.llm import exact_dedup, langid, ngram_join, packing, pii, queries, sentencepiece_scan, substring_dedup, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "\n\t ", "a", "a b", "a  b", "A b\n", "a b", "x" * 3000, "é☃ ñ × ÷ <|endoftext|> it's 12", "word " * 400, "tail\x0b\x0cend", "0" * 50 + " mail a@b.co and a@b.c_x@d.ef"]


def docs(spark, texts, **more):
    rows = [(i, t, "clash", "clash", "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, entries string, keep_id string, n_chars long")


def some_texts(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = list(ODD)
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([4, 9, 30, 120]))]
        out.append(" ".join(base))
        for _ in range(r.choice([1, 3, 30])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append(" ".join(copy))
    return out


def test_exact_dedup(spark):
    texts = some_texts()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, texts), chunk=16).collect()}
    for i, t in enumerate(norm):
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (norm.index(t), norm.count(t), norm.index(t) == i)
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, texts).limit(0)).count() == 0


def test_exact_dedup_tells_collisions_apart(spark):
    texts = ["aa", "ab", "aa", "ac", "ab", "ad"]
    prints = exact_dedup.fingerprints(docs(spark, texts)).withColumns({"f0": F.lit(1).cast("long"), "f1": F.lit(1).cast("long")})
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs(spark, texts), prints=prints).collect()}
    assert got == {0: (0, 2), 1: (1, 2), 2: (0, 2), 3: (3, 1), 4: (1, 2), 5: (5, 1)}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_ngram_join(spark, words, percent, monkeypatch):
    texts = some_texts(words)
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(set(zip(*[w[k:] for k in range(words)])) if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    for block in (500, 4):  # clouds in one block, and in several
        got = {r.doc_id: r for r in ngram_join.ngram_join(docs(spark, texts), words, percent, block=block).collect()}
        assert [got[i].component_id for i in range(len(texts))] == [root(i) for i in range(len(texts))]
        assert [got[i].n_shingles for i in range(len(texts))] == [len(x) for x in sets]
    assert ngram_join.ngram_join(docs(spark, texts).limit(0), words, percent).count() == 0


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_ngram_links_equal_brute_force(spark, words, percent):
    texts = some_texts(words)
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(zip(*[w[k:] for k in range(words)])) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset())
    want = [sum(1 for y in set(sets) if y and y != x and 100 * len(x & y) >= percent * len(x | y)) for x in sets]
    assert max(want) > 4
    for block in (500, 4):  # clouds in one block, and in several
        got = {r.doc_id: r.links for r in ngram_join.ngram_join(docs(spark, texts), words, percent, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_ngram_bitmaps_never_exceed_the_difference():
    r = np.random.default_rng(1)
    for n in (5, 50, 900):
        x = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[n // 4 :], r.integers(0, 1 << 62, n // 3).astype(np.uint64)]))
        assert ngram_join.differing_bits(ngram_join.bitmap(x), ngram_join.bitmap(y)) <= len(np.setxor1d(x, y))


def test_topk(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.25, 0.0, 0.9]) for _ in range(4)]) for i in range(90)]
    rows += [(200, None), (201, [None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (204, []), (205, [1.0, 2.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(tuple(x) for x in topk.top_k(v, v.where("vec_id % 20 = 0"), k=7, rows=20, block=3).collect())
    want = []
    good = {i: [int(np.floor(64 * np.float64(np.float32(x)))) for x in e] for i, e in rows[:90]}
    for q in range(0, 90, 20):
        best = sorted((-sum(a * b for a, b in zip(good[q], e)), i) for i, e in good.items() if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_langid(spark):
    labelled = [(i, "the quick brown fox and the lazy dog" if i % 2 else "der schnelle braune Fuchs und der faule Hund", "en" if i % 2 else "de") for i in range(40)] + [(90, None, "en"), (91, "x", None)]
    model = langid.fit(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.predict(docs(spark, [*ODD, "the lazy fox", "und der Hund"]), model).collect()}
    assert (got[len(ODD)].lang_pred, got[len(ODD) + 1].lang_pred) == ("en", "de")
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 3))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs(spark, []).limit(0), langid.fit(docs(spark, ["a"]).withColumn("lang", F.lit(None).cast("string")))).count() == 0


def test_langid_held_out(spark):
    found = queries.op5_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count() > 0


def test_toxicity(spark):
    rows = [(i, "you are a grobnik today" if i % 2 else "you are a friend today", i % 2) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table, table)
    got = [r.predicted for r in toxicity.score(docs(spark, ["you are a grobnik", "you are a friend", *ODD]), model).orderBy("doc_id").collect()]
    assert got == [1, 0] + [0] * len(ODD)
    g = toxicity.Grammar({"grobnik": 2.0})
    plain, aimed, denied = (g.clause(x) for x in ("grobnik", "you grobnik", "not a grobnik"))
    assert denied < plain < aimed
    assert toxicity.fit(table.limit(0), table.limit(0)).slopes == (0.0, 0.0, 0.0)


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    texts = [*ODD, *["it's a test, we'll see 42 times!! é " * n for n in (1, 7, 60)]]
    rows = packing.pack(docs(spark, texts), WORDS, capacity=64, block=10).collect()
    parts, windows = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(parts[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 64


def test_differencing_is_near_equal():
    r = random.Random(2)
    lengths = [r.randint(1, 400) for _ in range(300)]
    window, sums = packing.difference(lengths, 20)
    assert sums.sum() == sum(lengths) and sums.max() - sums.min() <= 5
    assert np.bincount(packing.windows(lengths, 512), weights=lengths).max() <= 512


def test_pii(spark):
    texts = [*ODD, "call +1 (456) 555-2186 or 4111 1111 1111 1111 at 10.20.30.40", "1.2.3.256 4111111111111112 a@b.c.d@e.f", "☃ é@x.y ip 1.2.3.4.5.6.7.8"]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    got = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    masked = {r.doc_id: r.text for r in pii.masked(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = []
        for kind, p in patterns.items():
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and max(map(int, m[0].split("."))) <= 255, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                    spans.append(f"{kind}:{m.start()}:{m.end()}")
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got[i].spans.split(",") if got[i].spans else [])
        assert spans or got[i].n_added or masked[i] == t
    assert "<PHONE>" in masked[len(ODD)] and "<CARD>" in masked[len(ODD)] and "<IP>" in masked[len(ODD)]
    assert pii.find(docs(spark, texts).limit(0)).count() == 0


def test_pii_prefix_sums(spark):
    row = spark.range(1).select(pii.prefix_sums(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x.cast("int")), 32).alias("s")).first()
    assert row.s == [i * (i + 1) // 2 for i in range(1000)]


def test_substring_dedup(spark):
    r = random.Random(9)
    long = "".join(r.choice("abcd é") for _ in range(900))
    texts = [*ODD, long, long[100:400], "q" + long[50:149] + "z", "r" + long[300:401] + "s", long, "ab" * 300, long[:120] + long[:120]]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert got == want
    assert substring_dedup.remove_repeats(docs(spark, texts).limit(0)).count() == 0


def test_substring_dedup_splits_a_hot_key(spark):
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, edge = noise(80), noise(30)
    texts = [noise(150) + line + noise(150) for _ in range(300)] + [noise(120) + edge + line + noise(120) for _ in range(40)] + [noise(99) + line + "z" * 200] * 2
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b, gone = t.encode(), np.zeros(len(t), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        want[i] = (int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    assert sum(n > 0 for n, _ in want.values()) == 39 + 2
    for hot in (10, 10_000):
        got = {x.doc_id: (x.n_removed, x.kept_sha256) for x in substring_dedup.remove_repeats(docs(spark, texts).repartition(6), hot).collect()}
        assert got == want
    unique = spark.createDataFrame([(i, 200, 0, 50, 7, (noise(50) + line[:50] + noise(50)).encode(), None) for i in range(500)], "doc_id long, place long, near long, far long, key long, bytes binary, bits long")
    assert substring_dedup.dealt(unique, 4, hot=10_000).where("bytes is not null").groupBy("part").count().first()["count"] == 500
    assert substring_dedup.dealt(unique, 4, hot=100).where("bytes is not null").count() == 0


def test_sentencepiece(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor()
    model.LoadFromSerializedProto(open(PIECES, "rb").read() + b"\x12\x02\x18\x01")  # the same pieces, segmented by weight
    g = sentencepiece_scan.Segmenter(PIECES)
    for t in ("Hello world", "the quick brown foxes", "naïve café"):
        assert np.frombuffer(g.encode(t), "<u4").tolist() == model.nbest_encode_as_ids(t, 2)[0]  # the library's exact lattice search
    texts = [*ODD, "x" * 900 + "abc def" * 50, "é☃☃ " * 200]
    whole = {r.doc_id: r for r in sentencepiece_scan.summary(docs(spark, texts), PIECES).collect()}
    cut = {r.doc_id: r for r in sentencepiece_scan.summary(docs(spark, texts), PIECES, chunk=100).collect()}
    assert whole == cut and all(r.round_trip for r in whole.values())
    a, b, c = (np.random.default_rng(k).integers(-99, 0, (4, 4)) for k in range(3))
    assert (sentencepiece_scan.product(sentencepiece_scan.product(a, b), c) == sentencepiece_scan.product(a, sentencepiece_scan.product(b, c))).all()


def test_warc(spark, tmp_path):
    big = "<p>ünï</p>" * 40
    rows = [(1, "http://a/\r\n x", big), (2, None, big), (3, "http://b", None), (4, "http://b", ""), (5, "http://c", "short"), (6, "http://d", "short"), (7, "http://e", big + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    for split in (1 << 24, 120):
        got = {r.page_id: tuple(r)[1:] for r in warc.page_records(warc.read_warc(spark, path, split=split)).collect()}
        assert got == {i: (len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h in rows}
    only = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'").collect()
    assert [(r.record_id, r.http_length, r.payload) for r in only] == [("urn:page:2", len(big.encode()), None)]
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    kept = out.select("doc_id").distinct().count()
    assert 0 < kept < docs.count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
