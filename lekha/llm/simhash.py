"""SimHash near-duplicates by pigeonring filtering.

A fingerprint of 64 bits is a ring of most + 1 segments. If two differ in `most`
bits at the most, some segment begins a chain in which, for each l, the first l
segments differ in no more than l * most / (most + 1) bits together, which is l - 1:
none in the first, one in the first two, and so on round the ring. The index is on
the first two segments of such chains, with each bit of the second left out in turn;
the longer prefixes of the chain are checked on what meets there, and only then all
64 bits.

Equal fingerprints are one class. Within a key of the index only a spanning forest
of its links is passed on: what is already reached is not compared again, so a dense
group costs one comparison a member. A key that a great part of all fingerprints
share is not gathered at all. Each of its fingerprints goes to all words within
most / 2 bits of it instead: two that differ in `most` bits have such a word in
common, and all that have one in common are linked, so its least one stands for them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm.batches import slabs, text_bytes
from lekha.llm.ngram_join import mix
from lekha.operators.graph import connected_components
from lekha.plans.shared import join_groups, written

#: A key with more fingerprints is hot.
HOT = 50_000
#: One in so many fingerprints is looked at to foresee hot keys, and so many keys are foreseen at most. Others that turn out hot are streamed through a task; both ways are exact.
SAMPLE, FORESEEN = 64, 100_000
#: Groups up to this size are compared all with all at once.
SMALL = 12
SEED = 42
U64 = np.uint64


def fingerprints(raw: np.ndarray, offsets: np.ndarray, words: int = 4) -> np.ndarray:
    """Of each row's bytes: the bits that over half of its shingles' hashes have."""
    out = np.zeros(len(offsets) - 1, U64)
    for a, b in slabs(offsets):
        hashes, sizes = [], []
        for i in range(a, b):
            parts = raw[offsets[i] : offsets[i + 1]].tobytes().lower().split()  # bytes know no other letters and blanks than ASCII's
            joined = b" ".join(parts)
            if len(parts) <= words:
                found = [xxhash.xxh64_intdigest(joined, SEED)] if parts else []
            else:
                stop = list(itertools.accumulate(len(p) + 1 for p in parts))
                found = [xxhash.xxh64_intdigest(joined[s : e - 1], SEED) for s, e in zip([0, *stop], stop[words - 1 :], strict=False)]
            hashes += found
            sizes.append(len(found))
        n = np.array(sizes, np.int64)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        first = (np.cumsum(n) - n)[some]
        h = np.array(hashes, U64).astype(">u8").view(np.uint8).reshape(-1, 8)
        counts = np.concatenate([np.add.reduceat(np.unpackbits(h[:, [k]], axis=1), first, axis=0, dtype=np.int64) for k in range(8)], axis=1)
        bits = 2 * counts > n[some][:, None]
        out[a + some] = np.packbits(bits, axis=1).view(">u8").ravel().astype(U64)
    return out


def _prints(words: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(*text_bytes(batch.column("text")), words).view(np.int64))], names=["doc_id", "print"])

    return run


class Ring:
    """The segments of a ring, the keys of its chains, and their budgets."""

    def __init__(self, most: int):
        if most < 2 or most % 2 or most > 8:
            raise ValueError("most must be 2, 4, 6 or 8")
        self.most, self.n = most, most + 1
        edge = [64 * i // self.n for i in range(self.n + 1)]
        bits = [range(edge[i], edge[i + 1]) for i in range(self.n)]
        mask = [sum(1 << b for b in bs) for bs in bits]
        #: Of each start: what is left of the first two segments, a bit of the second left out.
        self.keys = [np.array([mask[i] | (mask[j] & ~(1 << b)) for b in bits[j]], U64) for i, j in ((i, (i + 1) % self.n) for i in range(self.n))]
        self.salts = [mix(np.arange(len(k), dtype=U64) + U64(64 * (i + 1))) for i, k in enumerate(self.keys)]
        #: Of each start and l: the first l segments of the chain.
        self.chains = np.array([[sum(mask[(i + k) % self.n] for k in range(size)) for size in range(self.n + 1)] for i in range(self.n)], U64)

    def entries(self, prints: np.ndarray, start: int) -> np.ndarray:
        """Keys of each fingerprint for the chains from start, a row each."""
        return mix((prints[:, None] & self.keys[start]) ^ self.salts[start])

    def linked(self, a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        """Which pairs are linked, of those whose chain from start stays within its budgets."""
        x = a ^ b
        alive = np.arange(len(x))
        start = np.broadcast_to(start, x.shape)
        for size in range(3, self.n):
            alive = alive[np.bitwise_count(x[alive] & self.chains[start[alive], size]) < size]
        out = np.zeros(len(x), bool)
        out[alive[np.bitwise_count(x[alive]) <= self.most]] = True
        return out

    def forest(self, prints: np.ndarray, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links that span what the links of one key's fingerprints join."""
        out, unseen, todo = [], np.arange(1, len(prints)), [0]
        while len(unseen):
            if not todo:
                todo, unseen = [int(unseen[0])], unseen[1:]
                continue
            at = todo.pop()
            hit = self.linked(prints[unseen], prints[at], start)
            new = unseen[hit]
            if len(new):
                out.append((np.full(len(new), prints[at]), prints[new]))
                todo += new.tolist()
                unseen = unseen[~hit]
        return out

    def balls(self) -> np.ndarray:
        """All words of up to most / 2 bits."""
        sets = itertools.chain.from_iterable(itertools.combinations(range(64), k) for k in range(self.most // 2 + 1))
        return np.array([sum(1 << b for b in s) for s in sets], U64)


def _batch(keys: np.ndarray, prints: np.ndarray, starts: np.ndarray, hot: bool) -> pa.RecordBatch:
    key = pa.array(keys.view(np.int64), mask=np.ones(len(keys), bool) if hot else None)
    return pa.RecordBatch.from_arrays([key, pa.array(prints.view(np.int64)), pa.array(starts.astype(np.int8))], names=["key", "print", "start"])


def _entries(most: int, hot: np.ndarray):
    """(key, print, start) of the chains' beginnings; a print with a hot key (sorted) has a row without a key in its place."""

    def run(batches):
        ring = Ring(most)
        for batch in batches:
            prints = batch.column("print").to_numpy().view(U64)
            caught = np.zeros(len(prints), bool)
            for start in range(ring.n):
                keys = ring.entries(prints, start)
                of = np.repeat(prints, keys.shape[1])
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
                    caught |= is_hot.any(axis=1)
                    keys, of = keys[~is_hot], of[~is_hot.ravel()]
                keys = keys.ravel()
                yield _batch(keys, of, np.full(len(keys), start), False)
            if caught.any():
                found = prints[caught]
                yield _batch(np.zeros(len(found), U64), found, np.zeros(len(found)), True)

    return run


def _pairs(ring: Ring, key: np.ndarray, prints: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole keys, entries in order of key: all of small ones, spanning ones of others."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(first, len(key)))
    small = np.repeat(n <= SMALL, n)
    left = np.repeat(first + n, n)
    every, us, vs = np.arange(len(key)), [np.zeros(0, U64)], [np.zeros(0, U64)]
    for step in range(1, SMALL):  # each with the one that stands step places on
        i = np.flatnonzero(small & (every + step < left))
        i = i[ring.linked(prints[i], prints[i + step], start[i])]
        us.append(prints[i])
        vs.append(prints[i + step])
    for a, k in zip(first[n > SMALL].tolist(), n[n > SMALL].tolist(), strict=True):
        for u, v in ring.forest(prints[a : a + k], int(start[a])):
            us.append(u)
            vs.append(v)
    pairs = np.sort(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _links(most: int, hot: int):
    """(u, v) of entries that come in order of key; the prints of a key with more than `hot` come out as (u, null), as they come."""

    def run(batches):
        ring = Ring(most)
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)]
        overflowing = None

        def told(u, v):
            v = pa.array(v.view(np.int64)) if v is not None else pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), v], names=["u", "v"])

        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("key", "print", "start")]
            if overflowing is not None:
                over = new[0] == overflowing
                yield told(new[1][over], None)
                new = [x[~over] for x in new]
            rest = [np.concatenate(x) for x in zip(rest, new, strict=True)]
            if not len(rest[0]):
                continue
            last = int(np.searchsorted(rest[0], rest[0][-1]))  # the last key may go on
            if last:
                yield told(*_pairs(ring, rest[0][:last], rest[1][:last].view(U64), rest[2][:last]))
                rest = [x[last:] for x in rest]
            if len(rest[0]) > hot:
                overflowing = rest[0][0]
                yield told(rest[1], None)
                rest = [x[:0] for x in rest]
        if len(rest[0]):
            yield told(*_pairs(ring, rest[0], rest[1].view(U64), rest[2]))

    return run


def _balls(most: int):
    def run(batches):
        words = Ring(most).balls()
        for batch in batches:
            whole = batch.column("print").to_numpy().view(U64)
            for at in range(0, len(whole), 256):
                prints = whole[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array((prints[:, None] ^ words).ravel().view(np.int64)), pa.array(np.repeat(prints, len(words)).view(np.int64))], names=["word", "print"])

    return run


def links(prints: DataFrame, most: int = 4, hot: int = HOT) -> DataFrame:
    """(u, v): links that join what all links join, of distinct fingerprints (print), those within `most` bits of each other.

    An empty table gives none. Repeated rows would only cost time.
    """
    kinds = "key bigint, print bigint, start tinyint"
    some = prints.where(F.pmod(F.xxhash64("print", F.lit(7)), F.lit(SAMPLE)) == 0) if hot >= SAMPLE else prints
    least = hot / SAMPLE if hot >= SAMPLE else hot
    counted = some.mapInArrow(_entries(most, np.zeros(0, U64)), kinds).groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > least)
    foreseen = np.sort(np.array([r.key for r in counted.orderBy(F.desc("k"), "key").limit(FORESEEN).collect()], np.int64).view(U64))
    entries = prints.mapInArrow(_entries(most, foreseen), kinds)
    met = entries.where("key is not null").repartition("key").sortWithinPartitions("key").mapInArrow(_links(most, hot), "u bigint, v bigint")
    met = written(met, "met")
    crowded = met.where("v is null").select(F.col("u").alias("print"))
    if len(foreseen):
        crowded = crowded.union(entries.where("key is null").select("print"))
    crowded = written(crowded.distinct(), "crowded")
    found = met.where("v is not null")
    if not crowded.isEmpty():
        # a word has at most as many prints as lie within most / 2 bits of it, so its list is bounded
        words = crowded.mapInArrow(_balls(most), "word bigint, print bigint").groupBy("word").agg(F.min("print").alias("u"), F.collect_set("print").alias("vs")).where(F.size("vs") > 1)
        found = found.union(words.select("u", F.explode("vs").alias("v")).where("u <> v"))
    return found


def simhash(docs: DataFrame, most: int = 4, words: int = 4, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of docs (doc_id, text), a row for each row with a doc_id.

    Letters A-Z count as small, words are what stands between ASCII blanks, and a
    fingerprint has the bits that over half of the text's shingles have in their
    hashes; a text with fewer words is one shingle; null and blank texts have the
    fingerprint zero and link like any other. component_id: the smallest doc_id that
    links of `most` differing bits or fewer reach. Rows that repeat a doc_id have a
    row each, by their own texts. Other columns are not read; an empty table gives
    an empty result.
    """
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    prints = written(rows.mapInArrow(_prints(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print bigint"), "prints")
    classes = written(prints.groupBy("print").agg(F.min("doc_id").alias("head"), F.count("*").alias("k")), "classes")
    joined = connected_components(links(classes.select("print"), most, hot))
    inside = written(classes.join(joined.withColumnRenamed("node", "print"), "print").select("print", "head", "component"), "inside")
    least = written(inside.groupBy("component").agg(F.min("head").alias("least"), F.count("*").alias("n")), "least")
    reached = join_groups(inside.select("print", "component"), least, ["component"], "n", inside.count()).select("print", "least")
    named = written(classes.join(reached, "print", "left").select("print", "k", F.coalesce("least", "head").alias("component_id")), "named")
    out = join_groups(prints, named, ["print"], "k", prints.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
