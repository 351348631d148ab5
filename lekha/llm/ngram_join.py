"""Set-similarity join on word shingles by universe partition and pigeonhole.

Two sets of sizes a <= b link when their Jaccard similarity reaches the threshold
t, which bounds their symmetric difference by H = (a + b) * (1 - t) / (1 + t).
Within a band of sizes the universe of shingles is hashed into segments. If more
segments than H are not empty in both sets, one such segment is the same in both;
with one deletion allowed in each segment, half as many suffice. The index holds
each set's non-empty segments; sets with more empty ones than the allocation
allows add the one-deletion neighbourhoods. What meets in the index is verified
on the whole sets.

Equal sets are one class, which its smallest doc_id stands for. In each bucket
of the index all pairs meet, unless the bucket is hot: then its smallest
document meets the others. Near copies are the same in most segments: an entry carries the
one before it, and documents that are the same there too have met there and are
not paired again. Pairs of buckets that are not hot must pass a bound on the
difference of two small bitmaps. What the pairs join is a cloud, and within a
cloud all sets of near sizes are compared, block by block.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm.batches import slabs, text_bytes
from lekha.llm.ids import by_row
from lekha.operators.graph import connected_components
from lekha.plans.shared import join_groups, written

#: Sizes of a band: from l to l * RATIO.
RATIO = 1.4
#: Sets of a block at most, about, where blocks of a cloud meet; a quarter of it while a cloud has fewer than SPREAD blocks.
BLOCK, SPREAD = 500, 32
#: Index entries of a bucket, about.
BUCKET = 1_000_000
#: A key of more documents than HOT, or of HOT_HERE among those that one step looks at, is hot.
HOT, HOT_HERE = 24, 12
#: Sets from which common shingles are found, about, and how many of these are used at most.
SAMPLE, COMMON = 8_000, 150_000
U64 = np.uint64
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> U64(30))) * _B
    x = (x ^ (x >> U64(27))) * _C
    return x ^ (x >> U64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _A)


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Of each row: the sorted distinct 64-bit hashes of its shingles.

    Words are runs of bytes that are no blanks, with A-Z in lower case. A row with
    fewer words than a shingle has has its whole sequence as one; without words, none.
    """
    out: list[np.ndarray] = []
    for a, b in slabs(offsets):
        x = raw[offsets[a] : offsets[b]]
        edge = offsets[a : b + 1] - offsets[a]
        inside = ~_BLANK[x]
        first = inside.copy()
        if len(x):
            first[1:] &= ~inside[:-1]
            cut = edge[:-1][edge[:-1] < len(x)]
            first[cut] = inside[cut]
        start = np.flatnonzero(first)
        if len(start):
            at = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x)))) if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))])
            power = np.cumprod(np.full(int(at.max()) + 1, _A | U64(1)), dtype=np.uint64)
            value = np.where(inside, _BYTES[_LOWER[x]] * power[at], U64(0))
            word = mix(np.add.reduceat(value, start))
        else:
            word = np.zeros(0, np.uint64)
        row = np.searchsorted(start, edge)
        for i in range(b - a):
            w = word[row[i] : row[i + 1]]
            n = len(w)
            if n >= words:
                h = w[: n - words + 1] * U64(3)
                for k in range(1, words):
                    h = mix(h) + w[k : n - words + 1 + k]
                out.append(np.unique(mix(h)))
            elif n:
                h = np.full(1, n, np.uint64)
                for v in w:
                    h = mix(h * _A + v)
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class Bands:
    """Bands of sizes, and each band's allocation of segments, for a threshold of t percent."""

    def __init__(self, percent: int):
        self.percent = percent
        n = 1  # below this size only equal sets link
        while self.most(n, n + 1) < 1 and self.most(n, n) < 1:
            n += 1
        self.low = [n + 1 if self.most(n, n) < 1 else n]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * max(RATIO, 100 / percent + 0.01)) + 1))

    def most(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    @lru_cache(maxsize=None)
    def allocate(self, band: int) -> tuple[int, int]:
        """Segments, and how many may be empty, at the least cost.

        Each spare segment costs an index entry for each set. A set with more
        empty segments than the spare ones costs its one-deletion neighbourhoods,
        as many as it has shingles.
        """
        low, high = self.low[band], self.low[band + 1] - 1
        most = self.most(high, high)
        best = None
        for z in range(7):
            mean = (most + 1) * np.exp(-low / (most + 1))
            spare = 1 + int(np.ceil(mean + z * np.sqrt(mean)))
            m = most + 1 + spare
            mean = m * np.exp(-low / m)
            k = np.arange(1, spare + 1)
            tail = 1 - np.exp(-mean) * (1 + np.exp(np.cumsum(np.log(mean) - np.log(k))).sum())
            cost = m + max(0.0, tail) * low
            if best is None or cost < best[0]:
                best = (cost, m, spare)
        return best[1], best[2]

    def of(self, n: int) -> list[int]:
        """The bands where a set of n shingles is indexed: its own, and the next if larger partners may lie there."""
        b = int(np.searchsorted(self.low, n, "right")) - 1
        out = [b] if b >= 0 else []
        if b + 1 < len(self.low) - 1 and n * 100 >= self.percent * self.low[b + 1]:
            out.append(b + 1)
        return out

    def entries(self, h: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index entries of a sorted set, in order, and before each another of them, or zero.

        What stands before an entry is that of the last segment with shingles, or the
        whole segment's before one with a deletion: followed back they all end at a zero.

        Common shingles are left out of the segments, which lessens no set's claim:
        the difference of what remains is no larger. A set that loses too many
        segments to this is indexed by its whole segments too.
        """
        out = [np.zeros(1, np.uint64)]  # whole segments, in order
        near: list[tuple[np.ndarray, np.ndarray]] = []  # with a deletion, and the whole ones
        for band in self.of(len(h)):
            most = self.most(self.low[band + 1] - 1, self.low[band + 1] - 1)
            rare = h[common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h] if len(common) else h
            for k, part in enumerate((rare, h)):
                if self._segments(part, band, 2 * band + k, out, near) > most:
                    break
            else:
                out.append(mix(np.array([band], np.uint64) * _C + _A))  # hashed too unevenly: one bucket for all such sets
        whole = np.concatenate(out)
        key, at = np.unique(np.concatenate([whole[1:], *(x for x, _ in near)]), return_index=True)
        return key, np.concatenate([whole[:-1], *(x for _, x in near)])[at]

    def _segments(self, h: np.ndarray, band: int, salt: int, out: list[np.ndarray], near: list[tuple[np.ndarray, np.ndarray]]) -> int:
        """Adds the entries of h's segments; says which differences they are proof against.

        A segment with one shingle is of no use against one without any, so it
        counts once where others count twice.
        """
        if not len(h):
            return 0
        m, spare = self.allocate(band)
        segment = ((h >> U64(32)) * U64(m)) >> U64(32)  # rises with h
        used, first = np.unique(segment, return_index=True)
        spread = mix(h + _C)
        sums = np.add.reduceat(spread, first)
        salts = mix(used * _A + U64(salt))
        out.append(mix(sums ^ salts))
        if m - len(used) > spare:
            n = np.diff(np.append(first, len(h)))
            less, some = np.repeat(sums, n) - spread, np.repeat(n, n) > 1
            near.append((mix(less ^ np.repeat(salts, n))[some], np.repeat(out[-1], n)[some]))
            return 2 * len(used) - int((n == 1).sum())
        return 2 * m


def bitmap(h: np.ndarray) -> bytes:
    """Parities of the shingles that fall on each bit: two sets' bitmaps differ in no more bits than the sets in shingles."""
    bits = min(1 << 15, max(64, 1 << int(2 * len(h)).bit_length()))
    odd = np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Of two bitmaps; the longer is folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def _parts(batches, rows: int):
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _digests(words: int, percent: int):
    """doc_id, the set's size and two sums over it that stand for the set, its index entries' number (about), its bitmap."""

    def run(batches):
        bands = Bands(percent)
        for batch in _parts(batches, 1000):
            sets = shingles(*text_bytes(batch.column("text")), words)
            sums = [(int(h.sum(dtype=np.uint64)), int(mix(h).sum(dtype=np.uint64))) for h in sets]
            d = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            n = [len(h) for h in sets]
            about = [sum(bands.allocate(b)[0] for b in bands.of(k)) for k in n]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(about, pa.int64()), pa.array([bitmap(h) for h in sets], pa.binary())], names=["doc_id", "n", "d0", "d1", "about", "bits"])

    return run


def _runs(key: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries: where each key begins once they are sorted (then by other columns), the order, and each sorted entry's key's begin."""
    order = np.lexsort((*then[::-1], key)) if then else np.argsort(key, kind="stable")
    k = key[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return start, order, np.repeat(start, np.diff(np.append(start, len(k))))


def _index(words: int, percent: int, buckets: int, common: np.ndarray, rows: int = 2000):
    """Rows of two kinds: of some documents, the entries that fall in a bucket (bucket, entries), and hot pairs (u, v).

    A key that HOT_HERE or more of these documents have is hot: its first document
    alone is passed on, marked so, and the others are paired with it. So what a
    bucket gets of a key is a small part of the documents that have it. Entries
    are packed: the documents' ids, then an index into them (2 bytes, the highest
    bit is the mark), 40 bits of the key and 40 of the entry before it each.
    """

    def run(batches):
        bands = Bands(percent)
        for batch in _parts(batches, rows):
            ids = batch.column("doc_id").to_numpy()
            found = [bands.entries(h, common) for h in shingles(*text_bytes(batch.column("text")), words)]
            key, before = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.uint64) for k in (0, 1))
            if not len(key):
                continue
            start, order, head = _runs(key)
            doc = np.repeat(np.arange(len(ids)), [len(x) for x, _ in found])[order]
            n = np.diff(np.append(start, len(key)))
            hot = np.repeat(n >= HOT_HERE, n)
            pairs = np.unique(np.stack([doc[head], doc], axis=1)[hot & (head != np.arange(len(doc)))], axis=0)
            keep = ~hot | (head == np.arange(len(doc)))
            keys, before, doc, hot = key[order][keep], before[order][keep], doc[keep], hot[keep]
            bucket = (keys % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], bucket[by][1:] != bucket[by][:-1]]))
            blobs = []
            for i, j in zip(cut, np.append(cut[1:], len(by)), strict=True):
                used, at = np.unique(doc[by[i:j]], return_inverse=True)
                low = np.concatenate([keys[by[i:j]] // U64(buckets), before[by[i:j]]]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                blobs.append(np.uint16(len(used)).tobytes() + ids[used].astype("<i8").tobytes() + (at + (hot[by[i:j]] << 15)).astype("<u2").tobytes() + low.tobytes())
            m = len(pairs)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([bucket[by][cut], pairs[:, 1] % buckets])), pa.array(blobs + [None] * m, pa.binary()),
                pa.array([None] * len(cut) + ids[pairs[:, 0]].tolist(), pa.int64()), pa.array([None] * len(cut) + ids[pairs[:, 1]].tolist(), pa.int64())],
                names=["bucket", "entries", "u", "v"])

    return run


def _meet(table: pa.Table) -> pa.Table:
    """The pairs of one bucket: of a cold key all pairs, of a hot one (more than HOT documents, or marked) its smallest document and the others.

    A cold pair with the same entry before meets there, so it is left out here. Of
    a hot key's documents with the same entry before, if these are more than HOT,
    one alone is paired: that entry is hot too, which joins them.
    """
    given = table.filter(pc.is_null(table.column("entries")))
    keys, befores, docs, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for blob in table.column("entries").drop_null().to_pylist():
        n = int(np.frombuffer(blob, "<u2", 1)[0])
        ids = np.frombuffer(blob, "<i8", n, 2)
        m = (len(blob) - 2 - 8 * n) // 12
        at = np.frombuffer(blob, "<u2", m, 2 + 8 * n)
        low = np.zeros((2 * m, 8), np.uint8)
        low[:, :5] = np.frombuffer(blob, np.uint8, 10 * m, 2 + 8 * n + 2 * m).reshape(2 * m, 5)
        low = low.view("<u8").ravel().astype(np.uint64)
        keys.append(low[:m])
        befores.append(low[m:])
        docs.append(ids[at & 0x7FFF])
        marks.append(at >= 1 << 15)
    key, before, doc, mark = np.concatenate(keys), np.concatenate(befores), np.concatenate(docs), np.concatenate(marks)
    cold, hot = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    if len(key):
        start, order, head = _runs(key, before, doc)
        doc, before, n = doc[order], before[order], np.diff(np.append(start, len(key)))
        is_hot = (n > HOT) | np.logical_or.reduceat(mark[order], start)
        every, among = np.arange(len(doc)), np.repeat(is_hot, n)
        alike = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (before[1:] != before[:-1])]))
        k = np.diff(np.append(alike, len(doc)))
        joined = (np.repeat(k, k) > HOT) & (before > 0) & (every != np.repeat(alike, k))
        least = np.repeat(np.minimum.reduceat(doc, start), n)
        hot.append(np.stack([least, doc], axis=1)[among & (least != doc) & ~joined])
        left = np.repeat(start + n, n)
        for step in range(1, HOT):  # each with the one that stands step places on
            i = np.flatnonzero(~among & (every + step < left))
            if not len(i):
                break
            i = i[(before[i] == 0) | (before[i] != before[i + step])]
            cold.append(np.stack([doc[i], doc[i + step]], axis=1))
    cold, hot = (np.unique(np.sort(np.concatenate(x), axis=1), axis=0) for x in (cold, hot))
    hot = np.concatenate([hot, np.stack([given.column(c).to_numpy() for c in ("u", "v")], axis=1)])
    u, v = (np.concatenate([cold[:, k], hot[:, k]]) for k in (0, 1))
    return pa.table({"u": pa.array(u), "v": pa.array(v), "hot": pa.array(np.arange(len(u)) >= len(cold))})


def _near(percent: int):
    """Of pairs with their sets' sizes and bitmaps: those that may reach the threshold."""

    def run(batches):
        bands = Bands(percent)
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() for c in ("nu", "nv", "bu", "bv"))
            ok = [min(i, j) * 100 >= percent * max(i, j) and differing_bits(a, b) <= bands.most(i, j) for i, j, a, b in zip(n, m, x, y, strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    return run


def common_shingles(docs: DataFrame, small: DataFrame, words: int) -> np.ndarray:
    """Shingles of three or more of about SAMPLE distinct sets: COMMON at most, sorted.

    Which shingles count as common changes what the index costs, never its result.
    """
    n = small.count()
    chosen = small.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, n))))
    chosen = chosen.where("n > 0").groupBy("n", "d0", "d1").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    sets = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_whole(words), "shingle bigint")
    top = sets.groupBy("shingle").agg(F.count("*").alias("k")).where("k >= 3").orderBy(F.desc("k"), "shingle").limit(COMMON)
    return np.sort(np.array([r.shingle for r in top.collect()], np.int64).view(np.uint64))


def _whole(words: int):
    def run(batches):
        for batch in _parts(batches, 500):
            sets = shingles(*text_bytes(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])

    return run


def _with_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """wanted (doc_id, and long columns) with the documents' sets."""
    columns = [c for c in wanted.columns if c != "doc_id"]

    def run(batches):
        for batch in _parts(batches, 1000):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["doc_id", *columns]), _lists(shingles(*text_bytes(batch.column("text")), words))], names=["doc_id", *columns, "shingles"])

    rows = docs.select("doc_id", "text").join(wanted, "doc_id")
    return rows.mapInArrow(run, ", ".join(["doc_id bigint", *(f"{c} bigint" for c in columns), "shingles array<bigint>"]))


def _split(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    lists = table.column("shingles").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return np.diff(at).astype(np.int64), [flat[at[i] : at[i + 1]] for i in range(len(at) - 1)]


def _linked(percent: int):
    """Of one block, or of two blocks that meet: each document's links there, and the smallest document that they reach."""

    def run(table: pa.Table) -> pa.Table:
        doc, own, one, two = (table.column(c).to_numpy() for c in ("doc_id", "own", "one", "two"))
        size, sets = _split(table)
        ok = np.zeros((len(doc), len(doc)), bool)
        left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
        if len(left) and len(right):
            common = _overlaps([sets[i] for i in left], [sets[i] for i in right])
            total = size[left][:, None] + size[right][None, :]
            met = common * 100 >= (total - common) * percent
            ok[np.ix_(left, right)] = met
            ok[np.ix_(right, left)] = met.T
        np.fill_diagonal(ok, False)
        root = np.full(len(doc), -1)
        for i in np.argsort(doc, kind="stable"):
            if root[i] < 0:
                todo = [i]
                root[i] = i
                while todo:
                    new = np.flatnonzero(ok[todo.pop()] & (root < 0))
                    root[new] = i
                    todo.extend(new.tolist())
        return pa.table({"k": table.column("k"), "doc_id": pa.array(doc), "root": pa.array(doc[root]), "links": pa.array(ok.sum(axis=1).astype(np.int64))})

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set, by products of 0/1 blocks."""
    flat = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    values, number, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1
    keep = n[number] > 1
    row, column = row[keep], shared[number[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int((n > 1).sum()), 4096):
        i, j = np.searchsorted(column, [at, at + 4096])
        block = np.zeros((len(left) + len(right), 4096), np.float32)
        block[row[i:j], column[i:j] - at] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out.astype(np.int64)


def ngram_join(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, links, component_id.

    class_id: the smallest doc_id with the same set. component_id: the smallest
    doc_id reachable by links. links: how many other classes the document's class
    links to. Null, empty and blank texts have no shingles and link with nothing.
    Rows without a doc_id are left out; rows that repeat one have a row each. Other
    columns are not read; an empty table gives an empty result. Sets are compared
    as 64-bit hashes of their shingles: of a billion different shingles about one
    pair in 40 such collections has equal hashes.

    In a cloud each two blocks of near sizes meet once, so that links are exact:
    that is work in the square of a cloud's classes, in tasks of two blocks at most.
    """
    return by_row(docs, lambda rows: _joined(rows, words, percent, block), ("doc_id", "class_id", "component_id"))


def _joined(docs: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    small = written(docs.select("doc_id", "text").mapInArrow(_digests(words, percent), "doc_id bigint, n bigint, d0 bigint, d1 bigint, about bigint, bits binary"), "digests")
    total = small.count()
    heads = written(small.where("n > 0").groupBy("n", "d0", "d1").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("k")).where("k > 1"), "heads")
    classes = join_groups(small.select("doc_id", "n", "d0", "d1"), heads, ["n", "d0", "d1"], "k", total)
    classes = written(classes.select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("k", F.lit(1)).alias("k")), "classes")
    buckets = max(1, -(-(small.agg(F.sum("about")).first()[0] or 0) // BUCKET))
    common = common_shingles(docs, small, words)
    index = docs.select("doc_id", "text").mapInArrow(_index(words, percent, buckets, common), "bucket bigint, entries binary, u bigint, v bigint")
    met = index.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(_meet, "u bigint, v bigint, hot boolean")
    met = written(met.groupBy("u", "v").agg(F.max("hot").alias("hot")), "met")
    own = classes.where("doc_id <> class_id")
    for side, name in (("u", "cu"), ("v", "cv")):  # a hot key's first document stands in many pairs
        sizes = met.groupBy(side).agg(F.count("*").alias("k"))
        sizes = written(own.select(F.col("doc_id").alias(side), F.col("class_id").alias(name)).join(sizes, side), "own")
        met = written(join_groups(met, sizes, [side], "k", met.count()).drop("k"), "met")
    met = met.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"), "hot").where("u <> v")
    met = met.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("hot").alias("hot"))
    one, two = (small.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}")) for c in ("u", "v"))
    near = met.where("not hot").join(one, "u").join(two, "v").mapInArrow(_near(percent), "u bigint, v bigint")
    clouds = connected_components(near.unionByName(met.where("hot").select("u", "v")))
    clouds = written(clouds.select(F.col("node").alias("doc_id"), F.col("component").alias("cloud")), "clouds")
    whole = written(clouds.groupBy("cloud").agg(F.count("*").alias("whole")), "whole")
    clouds = join_groups(clouds, whole, ["cloud"], "whole", clouds.count())
    # in a cloud of several blocks, sets of one size band or of bands side by side may link; each two of their blocks meet once, and each block meets itself
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * 1.000001))
    clouds = written(clouds.join(small.select("doc_id", "n"), "doc_id").select("doc_id", "cloud", F.when(F.col("whole") > block, band).otherwise(0).alias("band")), "banded")
    sizes = written(clouds.groupBy("cloud", "band").agg(F.count("*").alias("k")), "sizes")
    each = F.least(F.lit(block), F.greatest(F.lit(max(1, block // 4)), F.col("k") / SPREAD))
    blocks = sizes.select("cloud", "band", "k", F.ceil(F.col("k") / each).alias("m"))
    for name, step in (("before", 1), ("after", -1)):
        blocks = blocks.join(blocks.select("cloud", (F.col("band") + step).alias("band"), F.col("m").alias(name)), ["cloud", "band"], "left")
    code = lambda step, i: (F.col("band") + step) * (1 << 32) + i
    of = lambda step, m: F.when(m > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), m - 1), lambda i: code(step, i))).otherwise(F.array().cast("array<bigint>"))
    blocks = blocks.select("cloud", "band", "k", "m", F.concat(of(0, F.col("m")), of(-1, F.coalesce("before", F.lit(0))), of(1, F.coalesce("after", F.lit(0)))).alias("others"))
    placed = join_groups(clouds, written(blocks, "blocks"), ["cloud", "band"], "k", clouds.count())
    placed = placed.select("doc_id", "cloud", F.size("others").cast("bigint").alias("k"), code(0, F.pmod(F.xxhash64("doc_id"), F.col("m"))).alias("own"), F.explode("others").alias("other"))
    placed = placed.select("doc_id", "cloud", "k", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    met = _with_sets(docs, placed, words)
    inside = written(met.groupBy("cloud", "one", "two").applyInArrow(_linked(percent), "k bigint, doc_id bigint, root bigint, links bigint"), "inside")
    found = inside.groupBy(F.col("doc_id").alias("class_id")).agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    large = inside.where("k > 1")
    if not large.isEmpty():
        joined = connected_components(large.select(F.col("doc_id").alias("u"), F.col("root").alias("v")).distinct())
        found = found.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root", F.coalesce("component", "root"))
    found = written(found.select("class_id", "root", "links").join(classes.groupBy("class_id").agg(F.count("*").alias("k")), "class_id"), "found")
    out = join_groups(classes.drop("k"), found, ["class_id"], "k", total)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class_id").alias("component_id"))
