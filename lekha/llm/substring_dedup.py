"""Removal of repeated 100-byte strings, by column-wise insertion over contexts.

Inserting one symbol of every whole document a round would take as many passes
over the corpus as the longest document has bytes. So the rounds run over a
collection of short strings instead. In every window of 100 bytes the 50-byte
gram with the least hash is the window's anchor; equal windows have equal
anchors at equal places. The contexts of anchors that occur twice, up to 50
bytes to each side, are that collection. They are dealt by anchor, and in each
part one symbol of each context is inserted a round, from right to left: the
order of all suffixes follows by a stable sort of the new column, their common
prefixes by range minima of the old ones. After each of the last 51 rounds, runs
with common prefixes of 100 bytes are equal windows; all but the first are marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm.batches import slabs, text_bytes
from lekha.llm.ids import by_row
from lekha.llm.ngram_join import mix
from lekha.plans.shared import join_groups, written

WINDOW, GRAM = 100, 50
SPAN = WINDOW - GRAM
U64 = np.uint64
_M = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
#: Anchors of a bucket, and contexts of a part, about.
BUCKET, PART = 500_000, 20_000
#: Contexts of a key from which it is hot: its windows are dealt one by one.
HOT = 2_000
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for k, m in (("up", _M), ("down", _INVERSE)):
            x = np.full(n, m, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of each 50-byte gram, by prefix sums."""
    n = len(x)
    if n < GRAM:
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[x] * up[:n], dtype=np.uint64)])
    return mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])


def anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of each window: the leftmost gram whose hash's high 40 bits are least."""
    w = SPAN + 1
    n = len(h) - w + 1
    if n < 1:
        return np.zeros(0, np.int64)
    key = (h & ~U64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    size = -(-len(h) // w) * w
    block = np.full(size, ~U64(0), np.uint64)
    block[: len(h)] = key
    rows = block.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & U64((1 << 24) - 1)).astype(np.int64)


#: Windows that are looked at together; positions in them have 24 bits.
STRETCH = 1 << 22


def _stretches(x: np.ndarray):
    """Of one text: for stretches of windows, the first window, each window's anchor, and the anchors' hashes."""
    for at in range(0, max(0, len(x) - WINDOW + 1), STRETCH):
        h = gram_hashes(x[at : at + STRETCH + WINDOW - 1])
        a = anchors(h)
        yield at, a + at, h[a]


def _texts(batches, rows: int):
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            batch = whole.slice(i, rows)
            yield (batch, *text_bytes(batch.column("text")))


def _facts(batches):
    for batch, raw, at in _texts(batches, 1000):
        n = np.diff(at)
        sha = [hashlib.sha256(raw[at[i] : at[i + 1]].tobytes()).hexdigest() for i in range(len(n))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(sha)], names=["doc_id", "n_bytes", "sha"])


def _index(buckets: int):
    """Packed anchors by bucket: ids, then an index into them, whether the key occurs again here, the place and the key of each."""

    def run(batches):
        for batch, raw, at in _texts(batches, 1000):
            ids = batch.column("doc_id").to_numpy()
            keys, docs, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(len(ids)):
                for _, a, h in _stretches(raw[at[i] : at[i + 1]]):
                    new = np.concatenate([[True], a[1:] != a[:-1]])
                    keys.append(h[new])
                    places.append(a[new])
                    docs.append(np.full(int(new.sum()), i))
            key, doc, place = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key, doc, place = key[order], doc[order], place[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            again = np.concatenate([~new[1:], [False]])
            mark = again | ~new
            # of a key that occurs again here, one anchor stands for all; the others need no answer
            known = np.flatnonzero(~new)
            key0, doc0, place0, mark0 = key[new], doc[new], place[new], mark[new]
            bucket = (key0 % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], bucket[by][1:] != bucket[by][:-1]]))
            blobs = []
            for i, j in zip(cut, np.append(cut[1:], len(by)), strict=True):
                b = by[i:j]
                used, index = np.unique(doc0[b], return_inverse=True)
                low = (key0[b] // U64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                blobs.append(np.uint16(len(used)).tobytes() + ids[used].astype("<i8").tobytes() + (index + (mark0[b].astype(np.int64) << 15)).astype("<u2").tobytes() + place0[b].astype("<u4").tobytes() + low.tobytes())
            m = [pa.array(bucket[by][cut]), pa.array(blobs, pa.binary()), pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.list_(pa.int64()))]
            if len(known):
                by_doc = known[np.argsort(doc[known], kind="stable")]
                d, first = np.unique(doc[by_doc], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(by_doc)).astype(np.int32)), pa.array(place[by_doc]))
                m = [pa.concat_arrays([x, y]) for x, y in zip(m, [pa.array(ids[d] % buckets), pa.nulls(len(d), pa.binary()), pa.array(ids[d]), lists], strict=True)]
            yield pa.RecordBatch.from_arrays(m, names=["bucket", "blob", "doc_id", "places"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: documents, and the places of their anchors that occur again."""
    given = table.filter(pc.is_null(table.column("blob"))).select(["doc_id", "places"])
    keys, docs, places, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for blob in table.column("blob").drop_null().to_pylist():
        n = int(np.frombuffer(blob, "<u2", 1)[0])
        ids, at = np.frombuffer(blob, "<i8", n, 2), 2 + 8 * n
        m = (len(blob) - at) // 12
        index = np.frombuffer(blob, "<u2", m, at)
        low = np.zeros((m, 8), np.uint8)
        low[:, :6] = np.frombuffer(blob, np.uint8, 6 * m, at + 6 * m).reshape(m, 6)
        keys.append(low.view("<u8").ravel().astype(np.uint64))
        docs.append(ids[index & 0x7FFF])
        marks.append(index >= 1 << 15)
        places.append(np.frombuffer(blob, "<u4", m, at + 2 * m).astype(np.int64))
    key, doc, place, mark = (np.concatenate(x) for x in (keys, docs, places, marks))
    _, number, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero((n[number] > 1) | mark) if len(key) else np.zeros(0, np.int64)
    old = given.column("places").combine_chunks()
    old_doc = given.column("doc_id").combine_chunks().take(pc.list_parent_indices(old)).to_numpy() if given.num_rows else np.zeros(0, np.int64)
    old_place = pc.list_flatten(old).to_numpy() if given.num_rows else np.zeros(0, np.int64)
    return pa.table({"doc_id": pa.array(np.concatenate([doc[hit], old_doc])), "place": pa.array(np.concatenate([place[hit], old_place]))})


def _contexts(batches):
    """Of documents with places: each anchor there that windows have chosen: its key, the windows' extent, and the bytes that they cover.

    Where an equal context stands earlier among these documents, all windows are
    marked at once (bits) and the bytes stay here, so that what meets of a common
    passage is a small part of the documents that hold it.
    """
    for batch, raw, at in _texts(batches, 500):
        ids = batch.column("doc_id").to_numpy()
        out: list[tuple] = []
        for i, places in enumerate(batch.column("places").to_pylist()):
            x = raw[at[i] : at[i + 1]]
            wanted = np.unique(np.array(places, np.int64))
            for begin, a, h in _stretches(x):
                start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                end = np.append(start[1:], len(a)) - 1
                for k in np.flatnonzero(np.isin(a[start], wanted)):
                    p, q, place = int(start[k]) + begin, int(end[k]) + begin, int(a[start[k]])
                    out.append((int(ids[i]), place, place - q, place - p, int(h[start[k]].astype(np.int64)), x[p : q + WINDOW].tobytes()))
        if not out:
            continue
        out.sort()
        first: set[tuple] = set()
        rows = []
        for doc, place, near, far, key, part in out:
            again = (key, near, far, part) in first
            first.add((key, near, far, part))
            rows.append((doc, place, near, far, key, None if again else part, (2 << far) - (1 << near) if again else None))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.int64())], names=["doc_id", "place", "near", "far", "key", "bytes", "bits"])


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high], ends included, for each pair."""
    levels = [values]
    while 2 << len(levels) - 1 <= len(values):
        last, step = levels[-1], 1 << len(levels) - 1
        levels.append(np.minimum(last[:-step], last[step:]))
    length = high - low + 1
    level = np.frexp(length.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k in np.unique(level):
        i = level == k
        out[i] = np.minimum(levels[k][low[i]], levels[k][high[i] - (1 << k) + 1])
    return out


def marked_windows(columns: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Of contexts in order of (document, place): the windows that start earlier too, a bit for each distance of start and anchor.

    columns[c] holds each context's symbol at column c; the anchor is at column
    SPAN, and windows with near <= distance <= far are the context's own.
    """
    n = columns.shape[1]
    order, common = np.arange(n), np.full(n, 0, np.int32)  # suffixes of no symbols: all equal, in any order
    bits = np.zeros(n, np.uint64)
    for c in range(WINDOW + SPAN - 1, -1, -1):
        symbol = columns[c][order]
        moved = np.argsort(symbol, kind="stable")
        same = symbol[moved][1:] == symbol[moved][:-1]
        new = np.zeros(n, np.int32)
        i = np.flatnonzero(same) + 1
        if len(i):
            new[i] = 1 + _range_minima(common, moved[i - 1] + 1, moved[i]) if c < WINDOW + SPAN - 1 else 1
        order, common = order[moved], new
        if c <= SPAN:
            distance = SPAN - c
            run = np.cumsum(common < WINDOW) - 1 if n else common
            own = (near[order] <= distance) & (distance <= far[order])
            first = np.minimum.reduceat(np.where(own, order, n), np.flatnonzero(common < WINDOW))
            again = own & (order > first[run])
            bits[order[again]] |= U64(1) << U64(distance)
    return bits


def _mark(table: pa.Table) -> pa.Table:
    """Of one part: contexts with marked windows."""
    names = ["doc_id", "place", "bits"]
    known = table.filter(pc.is_null(table.column("bytes"))).select(names)
    table = table.filter(pc.is_valid(table.column("bytes")))
    if not table.num_rows:
        return known
    doc, place, near, far = (table.column(c).to_numpy() for c in ("doc_id", "place", "near", "far"))
    by = np.lexsort((place, doc))
    raw = table.column("bytes").to_pylist()
    columns = np.zeros((len(doc), WINDOW + SPAN), np.uint8)
    for i, k in enumerate(by):
        begin = SPAN - int(far[k])
        columns[i, begin : begin + len(raw[k])] = np.frombuffer(raw[k], np.uint8)
    bits = marked_windows(np.ascontiguousarray(columns.T), near[by], far[by])
    some = bits > 0
    found = pa.table([pa.array(doc[by][some]), pa.array(place[by][some]), pa.array(bits[some].view(np.int64))], names=names)
    return pa.concat_tables([found, known.cast(found.schema)])


def _windows(batches):
    """Of contexts of hot keys: each window of its own, with a hash of its key, distance and bytes.

    Where an equal window stands earlier among these contexts, it is marked at once
    (bits), so that what meets of a common window is a small part of its places.
    """
    for batch in batches:
        out = sorted(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "near", "far", "key", "bytes")), strict=True))
        first: set[tuple] = set()
        rows = []
        for doc, place, near, far, key, part in out:
            bits = 0
            for d in range(near, far + 1):
                window = part[far - d : far - d + WINDOW]
                if (key, d, window) in first:
                    bits |= 1 << d
                    continue
                first.add((key, d, window))
                w = hashlib.blake2b(window, digest_size=8, key=key.to_bytes(8, "little", signed=True) + bytes([d]))
                rows.append((doc, place, d, int.from_bytes(w.digest(), "little", signed=True), None))
            if bits:
                rows.append((doc, place, None, None, bits))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "place", "d", "w", "bits"])


def dealt(contexts: DataFrame, parts: int, hot: int = HOT) -> DataFrame:
    """contexts (written) with the part where each is compared.

    Contexts meet by their key. Of a key of hot contexts or more, only windows that
    occur twice go on, each as a context of that window alone, and meet by the
    window's hash; equal windows still meet, so the choice never changes the result.
    """
    keys = contexts.where("bytes is not null").groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") >= hot).select("key")
    by_key = F.xxhash64(F.when(F.col("bytes").isNull(), F.col("doc_id")).otherwise(F.col("key")))
    columns = ["doc_id", "place", "near", "far", "key", "bytes", "bits"]
    keys = written(keys, "hot_keys")
    if keys.isEmpty():
        return contexts.select(*columns, F.pmod(by_key, F.lit(parts)).alias("part"))
    keys = F.broadcast(keys)
    whole = contexts.where("bytes is not null")
    cold = contexts.where("bytes is null").unionByName(whole.join(keys, "key", "left_anti").select(columns))
    cold = cold.select(*columns, F.pmod(by_key, F.lit(parts)).alias("part"))
    split = whole.join(keys, "key", "left_semi").select(columns)
    windows = written(split.mapInArrow(_windows, "doc_id bigint, place bigint, d bigint, w bigint, bits bigint"), "windows")
    # of windows marked above the first stands for all; it goes on if it occurs in other batches
    twice = windows.where("w is not null").groupBy("w").agg(F.count("*").alias("k")).where("k > 1").select("w")
    again = windows.where("w is not null").join(twice, "w", "left_semi").select("doc_id", "place", "d", "w").join(split, ["doc_id", "place"]).where("d between near and far")
    again = again.select("doc_id", "place", F.col("d").alias("near"), F.col("d").alias("far"), "key",
                         F.col("bytes").substr((F.col("far") - F.col("d") + 1).cast("int"), F.lit(WINDOW)).alias("bytes"), F.lit(None).cast("bigint").alias("bits"), F.pmod(F.xxhash64("w"), F.lit(parts)).alias("part"))
    none = F.lit(None).cast("bigint")
    known = windows.where("bits is not null").select("doc_id", "place", none.alias("near"), none.alias("far"), none.alias("key"), F.lit(None).cast("binary").alias("bytes"), "bits", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"))
    return cold.unionByName(again).unionByName(known)


def _removed(batches):
    """Of documents with marks: what goes."""
    for batch, raw, at in _texts(batches, 500):
        rows = []
        for i, marks in enumerate(batch.column("marks").to_pylist()):
            x = raw[at[i] : at[i + 1]]
            edge = np.zeros(len(x) + 1, np.int64)
            place, bits = (np.array([m[k] for m in marks], np.int64) for k in ("place", "bits"))
            for d in range(SPAN + 1):
                p = place[(bits >> d) & 1 == 1] - d
                np.add.at(edge, p, 1)
                np.add.at(edge, p + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((int(gone.sum()), spans, hashlib.sha256(x[~gone].tobytes()).hexdigest()))
        n, spans, sha = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte covered by a 100-byte string that also starts earlier (in a smaller
    doc_id, or before in the same text) goes. A null text is empty; texts shorter
    than 100 bytes stay as they are. A whole copy of an earlier text of 100 bytes
    or more goes entirely and takes no part in the rest. Rows without a doc_id are
    left out; of rows that repeat one, that with the smaller digest of its text
    counts as earlier. Other columns are not read; an empty table gives an empty result.
    """
    return by_row(docs, lambda rows: _removed_from(rows, hot))


def _removed_from(rows: DataFrame, hot: int) -> DataFrame:
    facts = written(rows.mapInArrow(_facts, "doc_id bigint, n_bytes bigint, sha string"), "facts")
    heads = written(facts.where(F.col("n_bytes") >= WINDOW).groupBy("n_bytes", "sha").agg(F.min("doc_id").alias("head"), F.count("*").alias("k")).where("k > 1"), "heads")
    copies = written(join_groups(facts, heads, ["n_bytes", "sha"], "k", facts.count()).where("doc_id <> head").select("doc_id"), "copies")
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // (26 * BUCKET)))
    index = rows.mapInArrow(_index(buckets), "bucket bigint, blob binary, doc_id bigint, places array<bigint>")
    places = index.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(_repeated, "doc_id bigint, place bigint")
    places = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    chosen = written(rows.join(copies, "doc_id", "left_anti").join(places, "doc_id"), "chosen")
    n = chosen.agg(F.sum(F.size("places"))).first()[0] or 0
    contexts = written(chosen.mapInArrow(_contexts, "doc_id bigint, place bigint, near bigint, far bigint, key bigint, bytes binary, bits bigint"), "contexts")
    parts = max(1, -(-n // PART))
    marks = dealt(contexts, parts, hot).repartition(2 * parts, "part").groupBy("part").applyInArrow(_mark, "doc_id bigint, place bigint, bits bigint")
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("place", "bits")).alias("marks"))
    gone = chosen.select("doc_id", "text").join(marks, "doc_id").mapInArrow(_removed, "doc_id bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    out = facts.join(gone, "doc_id", "left").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("doc_id", "n_bytes",
                      F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                      F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
                      F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
