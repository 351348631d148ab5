"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

Every document is tokenized and cut into full windows and a rest. Rests meet in
blocks of bounded size; in a block, partial partitions into k windows are merged,
the two with the largest spread first, the fullest windows of one with the
emptiest of the other, until one near-equal partition is left. Where a window
exceeds the capacity, k rises.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm.batches import slabs, text_bytes
from lekha.llm.wordtable import Places, WordTable
from lekha.plans.shared import written

CAPACITY = 4096
END = 2
#: Rests of a block, about.
BLOCK = 1000
#: Rests longer than this part of the capacity are cut evenly: short pieces fill windows more closely.
SHARES = 4
#: Words whose ids a worker remembers, at most.
MEMORY = 1_000_000
SEGMENT = 1 << 20
#: Longer words go to the tokenizer one by one.
LONGEST = 64

#: In a text whose UTF-8 has only these bytes (ASCII, and the letters of Latin-1
#: less its two signs), NFC changes nothing, lower case is by character, and
#: pre-tokens are runs of one kind of character. Other texts, and those that may
#: hold a special token's string, go to the tokenizer whole.
_PLAIN = np.zeros(256, bool)
_PLAIN[[0x09, 0x0A, 0x0D, *range(0x20, 0x7F), 0xC3, *range(0x80, 0xC0)]] = True
_BLANK, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[0x09, 0x0A, 0x0D, 0x20]] = _BLANK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Merges:
    """Byte-pair merges of many words at once: in each round every word makes its best merge, the leftmost of equals."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; others follow U+00FF in order
        letter = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + "</w>"] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.places = Places(np.array([(vocab[a] << 32) + vocab[b] for a, b in pairs], np.uint64))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        ids = self.inner[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        n, done = np.ones(len(words), np.int64), {}
        rows, matrix = np.zeros(0, np.int64), np.zeros((0, int(size.max())), np.int64)
        for length in range(int(size.max()), 0, -1):
            own = np.flatnonzero(size == length)
            rows = np.concatenate([rows, own])
            matrix = np.concatenate([matrix, ids[(ends[own] - length)[:, None] + np.arange(length)]])
            if length == 1:
                done[length] = rows, matrix
                break
            place = self.places(((matrix[:, :-1] << 32) + matrix[:, 1:]).view(np.uint64))
            best = place.view(np.uint64).argmin(axis=1)  # -1 is the largest; a merge's place is its rank
            found = place[np.arange(len(rows)), best]
            merged = found >= 0
            n[rows[~merged]] = length
            done[length] = rows[~merged], matrix[~merged]
            rows, matrix, best = rows[merged], matrix[merged], best[merged]
            column = np.arange(length - 1)
            after = np.where(column <= best[:, None], matrix[:, :-1], matrix[:, 1:])
            after[np.arange(len(rows)), best] = self.made[found[merged]]
            matrix = after
        begin = np.cumsum(n) - n
        flat = np.empty(int(n.sum()), np.uint32)
        for length, (rows, matrix) in done.items():
            flat[begin[rows][:, None] + np.arange(length)] = matrix
        return n, flat


class Encoder:
    """Ids of texts as arrays of unsigned 32-bit numbers, the tokenizer's own.

    Pre-tokens are cut and lower-cased on the texts' bytes, and the ids of each
    are remembered. New ones are merged many at once, by the tokenizer's merges.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.table = WordTable(self._words, MEMORY)
        self._verify()

    def _verify(self) -> None:
        """The merges must give the tokenizer's ids: compared on strings of its own vocabulary."""
        some = sorted(x.removesuffix("</w>") for x in self.tokenizer.get_vocab() if x.removesuffix("</w>").isascii() and x.removesuffix("</w>").isalpha())[::97]
        n, flat = self._words([x.lower().encode() for x in some])
        if flat.tolist() != self._whole(" ".join(some)).tolist():
            raise ValueError("the tokenizer's merges are not those of words that end with </w>")

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        short = [w for w in words if len(w) <= LONGEST]
        n, flat = self.merges(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        if len(short) == len(words):
            return n, flat
        ids = iter(np.split(flat, np.cumsum(n)[:-1]) if short else [])
        every = [next(ids) if len(w) <= LONGEST else self._whole(w.decode()) for w in words]
        return np.array([len(x) for x in every], np.int64), np.concatenate(every)

    @staticmethod
    def tokens(x: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens start and stop: runs of letters, single digits, runs of signs; 's and its like by themselves; none crosses an edge."""
        kind = _KIND[x]
        start = np.empty(len(x), bool)
        start[:1] = True
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        start[edge[edge < len(x)]] = True
        last = np.append(start[1:], True)
        alone = np.flatnonzero((x == 0x27) & start & last)
        y = np.concatenate([x, np.full(3, 0x20, np.uint8)])
        free = np.append(start, [True] * 3)
        alone = alone[(_KIND[y[alone + 1]] == _LETTER) & ~np.isin(alone + 1, edge)]
        for p in alone.tolist():
            a, b = y[p + 1], y[p + 2]
            reach = 1 if a in b"stmd" else 2 if (a, b) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)) and not free[p + 2] else 0
            if reach:
                start[p + 1] = False
                if p + 1 + reach < len(x):
                    start[p + 1 + reach] = True
        begin = np.flatnonzero(start)
        stop = np.append(begin[1:], len(x))
        some = kind[begin] != _BLANK
        return begin[some], stop[some]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row of UTF-8 bytes."""
        out: list[np.ndarray] = []
        for a, b in slabs(offsets, SEGMENT):
            out += self._slab(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        return out

    def _slab(self, x: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
        if len(edge) == 2 and len(x) > 2 * SEGMENT:
            return [self._giant(x)]
        bad = ~_PLAIN[x]
        after = np.append(x[1:], 0)
        bad |= (x == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (x == 0x3C) & (after == 0x7C)
        odd = np.zeros(len(edge) - 1, bool)
        odd[np.searchsorted(edge, np.flatnonzero(bad), "right") - 1] = True
        low = _LOWER[x]
        capital = (x >= 0x80) & (x < 0x9F) & (np.concatenate([[0], x[:-1]]) == 0xC3)
        low[capital] += 0x20
        begin, stop = self.tokens(low, edge[:-1])
        if odd.any():
            keep = ~odd[np.searchsorted(edge, begin, "right") - 1]
            begin, stop = begin[keep], stop[keep]
        n, ids = self.table.ids(low, begin, stop)
        at = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(begin, edge)]
        return [self._whole(x[edge[i] : edge[i + 1]].tobytes().decode()) if odd[i] else ids[at[i] : at[i + 1]] for i in range(len(edge) - 1)]

    def _giant(self, x: np.ndarray) -> np.ndarray:
        """A giant text in segments that end at blanks, if it is plain."""
        if not _PLAIN[x].all():
            return self._whole(x.tobytes().decode())
        blank, cuts = np.flatnonzero(_KIND[x] == _BLANK), [0]
        while len(x) - cuts[-1] > SEGMENT:
            i = int(np.searchsorted(blank, cuts[-1] + SEGMENT))
            if i == len(blank):
                break
            cuts.append(int(blank[i]))
        parts = [self._slab(x[a:b], np.array([0, b - a])) if b - a <= 2 * SEGMENT else [self._whole(x[a:b].tobytes().decode())] for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True)]
        return np.concatenate([p for part in parts for p in part])


#: A worker's encoders by path: what they remember serves its later tasks too.
_ENCODERS: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int):
    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder, share = _ENCODERS[path], -(-capacity // SHARES)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(*text_bytes(part.column("text"))), strict=True):
                    raw = np.append(ids, np.uint32(END)).astype("<u4").tobytes()
                    n = len(raw) // 4
                    full = n - n % capacity
                    parts = -(-(n - full) // share)
                    cuts = [*range(0, full, capacity), *(full + (n - full) * k // parts for k in range(parts))]
                    out += [(doc, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), n) for s, e in zip(cuts, [*cuts[1:], n], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece; a null text is empty and keeps its end id."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity), schema)


def difference(lengths: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp into k windows: each item's window, and the windows' sums.

    Ties go to the partition that was made first, so the result is one and the same.
    """
    n = len(lengths)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(k, np.int64)
    sums: list[np.ndarray | None] = []
    made: list[tuple[int, int, np.ndarray]] = []
    heap = []
    for i, x in enumerate(lengths):
        s = np.zeros(k, np.int64)
        s[0] = x
        sums.append(s)
        heap.append((-int(x - (s[-1] if k > 1 else x)), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        s = sums[a] + sums[b][::-1]
        order = np.argsort(-s, kind="stable").astype(np.int32)
        sums[a] = sums[b] = None
        sums.append(s[order])
        made.append((a, b, order))
        heapq.heappush(heap, (-int(sums[-1][0] - sums[-1][-1]), len(sums) - 1))
    window = np.zeros(n, np.int64)
    places: dict[int, np.ndarray] = {len(sums) - 1: np.arange(k)}
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = made[node - n]
        at = places.pop(node)
        own, other = np.empty(k, np.int64), np.empty(k, np.int64)
        own[order] = at
        other[k - 1 - order] = at
        places[a], places[b] = own, other
    for i in range(n):
        window[i] = places[i][0]
    total = np.zeros(k, np.int64)
    np.add.at(total, window, np.array(lengths, np.int64))
    return window, total


def windows(lengths: list[int], capacity: int) -> np.ndarray:
    """Windows of items no longer than capacity; their number rises, in steps of 1, 2, 4, ..., while one is exceeded, and is then bisected."""
    low = max(1, -(-sum(lengths) // capacity)) - 1
    step, found = 1, None
    while found is None:
        window, sums = difference(lengths, low + step)
        if sums.max(initial=0) <= capacity:
            found = window, low + step
        else:
            low, step = low + step, min(2 * step, max(1, len(lengths) - low - step))
    while found[1] - low > 1:
        k = (low + found[1]) // 2
        window, sums = difference(lengths, k)
        if sums.max(initial=0) <= capacity:
            found = window, k
        else:
            low = k
    return found[0]


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start"], kind="stable").reset_index(drop=True)
        full = (pdf["length"] >= capacity).to_numpy()
        window = np.zeros(len(pdf), np.int64)
        window[full] = np.arange(full.sum())
        window[~full] = windows(pdf["length"][~full].tolist(), capacity) + full.sum()
        pdf["sequence_id"] = pdf["block"].astype("int64") * (1 << 32) + window
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns=["block"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the id 2, cut every capacity ids. Pieces are dealt
    to blocks by a hash of doc_id and start, so neither a giant document nor a
    hot source fills one block. Repeated rows are packed each on its own; rows
    without a doc_id are left out; other columns are not read; an empty table gives
    an empty result. A sequence's id is its block and its place there.
    """
    cut = written(pieces(docs.where("doc_id is not null"), tokenizer, capacity), "pieces")
    blocks = max(1, -(-cut.count() // block))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(_pack(capacity), schema)
