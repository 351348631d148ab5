"""Periodic runs, SimHash and centroid clustering against brute force, and their cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lekha.llm import centroids, periodic_runs, queries, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, runs int, print string")


def runs_by_hand(words):
    """All runs: for each lag the longest stretches, and of equal stretches the smallest lag."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def numbers(words):
    code = {}
    return np.array([code.setdefault(w, len(code)) for w in words], np.int32)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(1, 260), st.integers(1, 5), st.integers(1, 4)), min_size=1, max_size=6), st.integers(0, 10**6))
def test_runs_like_brute_force(parts, seed):
    rng = random.Random(seed)
    words = []
    for s, period, times, letters in parts:
        block = [random.Random(s + k).randrange(letters) for k in range(period)]
        words += block * times + [rng.randrange(3) for _ in range(rng.randrange(4))]
    rest = [rng.randrange(2) for _ in range(rng.randrange(200))]
    got = periodic_runs.periodic_runs([numbers(words), numbers(rest), numbers([]), numbers(words)])
    want = [runs_by_hand(x) for x in (words, rest, [], words)]
    assert [[tuple(r) for r in g.tolist()] for g in got] == want


@pytest.mark.parametrize("period", [1, 7, 8, 95, 96, 97, 192, 193, 384, 385, 700])
def test_runs_at_the_edges_of_scales(period):
    rng = random.Random(period)
    block = [rng.randrange(10**6) for _ in range(period)]
    for extra in (-1, 0, 1, period):
        n = max(24, 3 * period) + extra
        words = [-1, -2, *itertools.islice(itertools.cycle(block), n), -3, -4]
        assert [tuple(r) for r in periodic_runs.periodic_runs([numbers(words)])[0].tolist()] == runs_by_hand(words)


def test_runs_of_stutters_inside_long_periods():
    block = [*[0] * 60, 1, *[2, 3] * 40, 4, *[0] * 60, 5]  # short runs inside a long one
    assert [tuple(r) for r in periodic_runs.periodic_runs([numbers(block * 4)])[0].tolist()] == runs_by_hand(block * 4)
    assert periodic_runs.periodic_runs([np.zeros(200_000, np.int32)])[0].tolist() == [[0, 200_000, 1]]
    rng = random.Random(5)
    stops = [x for i in range(60) for x in [0] * rng.randrange(30, 90) + [i % 7]]
    assert [tuple(r) for r in periodic_runs.periodic_runs([numbers(stops)])[0].tolist()] == runs_by_hand(stops)


def test_hash_collisions_do_no_harm(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_PRIME", 7)
    rng = random.Random(1)
    block = [rng.randrange(50) for _ in range(130)]
    words = block * 4 + [rng.randrange(50) for _ in range(300)]
    assert [tuple(r) for r in periodic_runs.periodic_runs([numbers(words)])[0].tolist()] == runs_by_hand(words)


def test_collapsed_texts(spark):
    said = "a b c d e f g h\t" * 4 + "end"
    rows = [(1, said), (1, said), (None, said), (2, None), (3, ""), (4, " \n "), (5, "x " * 23), (6, "x " * 24), (7, "a b " * 30)]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.collapse_runs(docs(spark, rows)).collect()), key=repr)
    want = [
        (1, 33, [(0, 32, 8)], "a b c d e f g h end"), (1, 33, [(0, 32, 8)], "a b c d e f g h end"), (None, 33, [(0, 32, 8)], "a b c d e f g h end"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""),
        (5, 23, [], " ".join("x" * 23)), (6, 24, [(0, 24, 1)], "x"), (7, 30, [(0, 30, 1)], "a b")]
    assert got == sorted(want, key=repr)
    assert periodic_runs.collapse_runs(docs(spark, rows).limit(0)).collect() == []


def test_op11_like_brute_force(spark):
    given_rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(given_rows)
    some = 0
    for r in given_rows:
        words = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 3000:
            continue  # brute force takes the square
        runs = runs_by_hand(words)
        dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        some += bool(runs)
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))
        assert got[r.doc_id] == want
    assert some > 3


def print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints, most):
    """Of each position the smallest one reachable."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= most:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clustered_prints(n, seed, flips):
    rng = random.Random(seed)
    heads = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = rng.choice(heads)
        for _ in range(rng.randrange(flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
        heads.append(x if rng.random() < 0.05 else rng.getrandbits(64))
    return sorted(out)


@pytest.mark.parametrize(("most", "hot", "n"), [(2, 50_000, 150), (4, 50_000, 300), (4, 3, 120), (4, 100, 300), (6, 50_000, 150)])
def test_links_join_what_brute_force_joins(spark, most, hot, n):
    prints = clustered_prints(n, most + hot, 9)
    frame = spark.createDataFrame([(signed(p), "clash") for p in prints], "print long, key string")
    found = {tuple(r) for r in simhash.links(frame, most, hot).collect()}
    mask = (1 << 64) - 1
    assert all(u != v and ((u ^ v) & mask).bit_count() <= most for u, v in found)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for u, v in found:
        a, b = find(u & mask), find(v & mask)
        root[max(a, b)] = min(a, b)
    assert [find(p) for p in prints] == [prints[i] for i in components_by_hand(prints, most)]


def test_every_link_has_a_chain():
    rng = random.Random(3)
    for most in (2, 4, 6):
        ring = simhash.Ring(most)
        for _ in range(400):
            a, b = np.array([rng.getrandbits(64)], np.uint64), 0
            for bit in rng.sample(range(64), rng.randrange(most + 1)):
                b |= 1 << bit
            b = a ^ np.uint64(b)
            assert any((ring.entries(a, i) == ring.entries(b, i)).any() and ring.linked(a, b, i)[0] for i in range(ring.n))
    with pytest.raises(ValueError):
        simhash.Ring(3)


def test_over_long_keys_stream_through(spark):
    prints = np.array(sorted(range(40)), np.uint64)
    ring = simhash.Ring(4)
    key = np.repeat(np.array([5, 9], np.int64), [30, 10])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints.view(np.int64)), pa.array(np.zeros(40, np.int8))], names=["key", "print", "start"])
    out = [tuple(r.values()) for part in simhash._links(4, 12)([batch.slice(i, 7) for i in range(0, 40, 7)]) for r in part.to_pylist()]
    assert sorted(u for u, v in out if v is None) == list(range(30))
    assert {u for u, v in out if v is not None} <= set(range(30, 40)) and ring.n == 5


def test_simhash_cases_and_op12(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [
        (9, base), (4, base.upper()), (7, base + " tail"), (2, None), (3, ""), (8, " \t\n"), (5, "one two"), (6, "ONE\ntwo"), (5, "one two"), (None, base), (1, "é É ü"), (10, "é é ü"), (11, base * 300),
        (12, "zero one two three")]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash(docs(spark, rows)).collect())
    rows = sorted((i, t) for i, t in [(i, t or "") for i, t in rows] if i is not None)
    prints = [print_by_hand(t) for _, t in rows]
    assert got == [(i, f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, components_by_hand(prints, 4), strict=True)]
    assert simhash.simhash(docs(spark, [(1, "x")]).limit(0)).collect() == []
    given_rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [print_by_hand(t) for _, t in given_rows]
    got = sorted(tuple(r) for r in queries.op12_simhash(spark, SF).collect())
    assert got == [(i, f"{p:016x}", given_rows[r][0]) for (i, _), p, r in zip(given_rows, prints, components_by_hand(prints, 4), strict=True)]


def clusters_by_hand(rows, k, rounds):
    """rows: (vec_id, vector), in order of their keys."""
    cs = [v for _, v in rows[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(cs)), key=lambda j: (far(v, cs[j]), j))
    for _ in range(rounds):
        of = [near(v) for _, v in rows]
        cs = [[sum(x) // len(x) for x in zip(*(v for (_, v), o in zip(rows, of, strict=True) if o == j), strict=True)] if j in of else cs[j] for j in range(len(cs))]
    of = [near(v) for _, v in rows]
    d = [far(v, cs[o]) for (_, v), o in zip(rows, of, strict=True)]
    return sorted((i, o, x, sum(y for y, p in zip(d, of, strict=True) if p == o), sum(d), cs[o]) for (i, _), o, x in zip(rows, of, d, strict=True))


@pytest.mark.parametrize("spread", [3, 1000, 40_000_000])
def test_clusters_like_brute_force(spark, spread):
    rng = random.Random(spread)
    rows = [(i, [rng.randrange(-spread, spread) for _ in range(5)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(3, rows[3][1])]  # one vector many times, one id twice
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, v array<long>, cluster string")
    key = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    ordered = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    assert sorted(tuple(r) for r in centroids.cluster(frame, key, k=8, rounds=4).collect()) == clusters_by_hand(ordered, 8, 4)
    assert centroids.cluster(frame.limit(0), key).collect() == []
    few = frame.where("vec_id in (1, 2)")
    assert {r.cluster for r in centroids.cluster(few, key).collect()} == {0, 1}


def test_quantised_vectors(spark):
    ok = [0.5, -0.0005]
    rows = [(1, ok), (None, ok), (2, None), (3, [0.5]), (4, [0.5, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, [1e30, 0.0]), (8, [*ok, 1.0])]
    got = centroids.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=2).collect()
    assert [(r.vec_id, r.v) for r in got] == [(1, [512, -1])]
