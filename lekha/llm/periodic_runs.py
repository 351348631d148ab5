"""Runs of words that repeat with a period, by multi-scale minimizers.

A run is a longest stretch of words with smallest period q that is at least LEAST
words and TIMES periods long. Periods up to SCAN are found by scans of each lag. For
those in (Q, 2Q], Q = SCAN, 2 SCAN, ..., stretches of Q / 4 words are hashed, and in
each window of Q / 4 + 1 such stretches the least hashes are marked. Windows that
stand q apart in a run are equal, so their marks are too: two equal marks at a
distance in (Q, 2Q] seed a comparison at that lag, which is extended to both sides.

Stretches inside a run of a period up to a third of their length are never marked:
else a stutter would mark every place. Windows that then have no mark lie inside
such a run, and if all windows of a period did, the run itself would have the
shorter period. Equal marks stand more than a third of a stretch apart, so each has
a bounded number of partners, and the work is linear at each scale.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lekha.llm.batches import slabs, text_bytes

#: A run has so many words, and so many periods, at least.
LEAST, TIMES = 24, 3
#: Longest period that is found by a scan of its own lag; a quarter of it has LEAST words, as the proof above needs.
SCAN = 96
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EIGHT = np.frombuffer(b"\1" * 8, np.uint64)[0]
_PRIME, _BASE = (1 << 31) - 1, 1_103_515_247


def stretches(same: np.ndarray, need: int) -> np.ndarray:
    """(start, stop) of the stretches of True of `need` or more; need is 15 at least."""
    whole = len(same) // 8 * 8
    if not (same[:whole].view(np.uint64) == _EIGHT).any():  # 15 hold eight that are aligned
        return np.zeros((0, 2), np.int64)
    edge = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0)).reshape(-1, 2)
    return edge[edge[:, 1] - edge[:, 0] >= need]


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each window."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


class Prefixes:
    """Polynomial hashes of all prefixes, for comparisons that may err on the side of equality."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.power = np.ones(self.n + 1, np.int64)
        done = 1
        while done <= self.n:
            step = self.power[done - 1] * _BASE % _PRIME
            self.power[done : 2 * done] = self.power[: min(done, self.n + 1 - done)] * step % _PRIME
            done *= 2
        self.sums = np.concatenate([[0], np.cumsum((x.astype(np.int64) + 1) * self.power[:-1] % _PRIME)]) % _PRIME

    def of(self, size: int) -> np.ndarray:
        """The hash of each stretch of a size."""
        return (self.sums[size:] - self.sums[:-size]) % _PRIME * self.power[size:][::-1] % _PRIME

    def equal(self, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
        """Whether the stretches at i <= j are equal."""
        left, right = (self.sums[at + size] - self.sums[at] for at in (i, j))
        return left % _PRIME * self.power[j - i] % _PRIME == right % _PRIME

    def extend(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """How far the words from i < j on, or those before them, are equal."""
        far, step = np.zeros(len(i), np.int64), 1 << max(0, self.n.bit_length() - 1)
        while step:
            a, b = (i + far, j + far) if forward else (i - far - step, j - far - step)
            at = np.flatnonzero((b + step <= self.n) & (a >= 0))
            far[at[self.equal(a[at], b[at], step)]] += step
            step //= 2
        return far


def seeds(x: np.ndarray, hashes: Prefixes, runs: dict[tuple[int, int], int], scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal marks at a distance in (scale, 2 scale]: the first of each, and the distance."""
    size, width = scale // 4, scale // 4 + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(x) < size + width - 1:
        return none
    h = hashes.of(size)
    short = np.array([(s, s + n - size + 1) for (s, n), q in runs.items() if TIMES * q <= size <= n], np.int64).reshape(-1, 2)
    if len(short):
        ends = np.zeros(len(h) + 1, np.int64)
        np.add.at(ends, short[:, 0], 1)
        np.add.at(ends, short[:, 1], -1)
        h[np.cumsum(ends)[:-1] > 0] = _PRIME
    pad = np.full(width - 1, -1, np.int64)
    least = sliding(h, width, np.minimum)
    marks = np.flatnonzero((sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h) & (h < _PRIME))
    at = marks[np.argsort(h[marks], kind="stable")]
    key, first, gaps = h[at], [none[0]], [none[0]]
    for step in itertools.count(1):
        gap = at[step:] - at[:-step]
        near = (key[step:] == key[:-step]) & (gap <= 2 * scale)
        if not near.any():
            return np.concatenate(first), np.concatenate(gaps)
        near &= gap > scale
        first.append(at[:-step][near])
        gaps.append(gap[near])


def periodic_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each text, as numbers of its words: the runs (start, length, period) by start, then period.

    All texts are looked at together; a number of its own ends each, so no run
    crosses from one to the next.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    used = np.arange(len(texts))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs: dict[tuple[int, int], int] = {}
    scale = 0
    while len(used):
        ends = np.cumsum(sizes[used] + 1)
        starts = ends - sizes[used] - 1
        x = np.concatenate([part for i, t in enumerate(used) for part in (texts[t], [-1 - i])]).astype(np.int32)
        if not scale:
            for q in range(1, min(SCAN, int(sizes.max()) // TIMES) + 1):
                for a, b in stretches(x[q:] == x[:-q], max(LEAST, TIMES * q) - q):
                    runs.setdefault((int(a), int(b - a) + q), q)
        else:
            hashes = Prefixes(x + len(used))
            i, lag = seeds(x, hashes, runs, scale)
            begin = i - hashes.extend(i, i + lag, False)
            length = i + lag + hashes.extend(i, i + lag, True) - begin
            ok = length >= TIMES * lag
            for a, n, q in np.unique(np.stack([begin, length, lag], axis=1)[ok], axis=0).tolist():
                for b, c in stretches(x[a + q : a + n] == x[a : a + n - q], (TIMES - 1) * q):  # exact, as hashes may err
                    runs.setdefault((a + int(b), int(c - b) + q), q)
        # only texts that are long enough go on to the next scale, and their runs with them
        scale = 2 * scale if scale else SCAN
        go_on = sizes[used] >= TIMES * (scale + 1)
        moved, to = np.cumsum(np.where(go_on, sizes[used] + 1, 0)) - np.where(go_on, sizes[used] + 1, 0), {}
        for (a, n), q in runs.items():
            i = int(np.searchsorted(starts, a, "right")) - 1
            if go_on[i]:
                to[int(a - starts[i] + moved[i]), n] = q
            else:
                found[used[i]].append((int(a - starts[i]), n, q))
        runs, used = to, used[go_on]
    return [np.array(sorted(f, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3) for f in found]


def _collapsed(batches):
    for batch in batches:
        column = batch.column("text")
        _, offsets = text_bytes(column)
        for a, b in slabs(offsets):
            texts = [_WORD.findall(t or "") for t in column.slice(a, b - a).to_pylist()]
            number: dict[str, int] = {}
            runs = periodic_runs([np.array([number.setdefault(w, len(number)) for w in t], np.int32) for t in texts])
            kept = []
            for words, of in zip(texts, runs, strict=True):
                keep = np.ones(len(words), bool)
                for s, n, q in of.tolist():
                    keep[s + q : s + n] = False
                kept.append(" ".join(itertools.compress(words, keep) if len(of) else words))
            at = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(at), struct), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) of docs (doc_id, text), a row each.

    Words are what stands between blanks (0x20, 0x09 to 0x0D), numbered from 0 and
    compared exactly. collapsed: the words joined by single spaces, without those
    that any run holds after its first period. A null or blank text has no words,
    no runs and an empty collapsed text. Each row is judged by its own text: null
    and repeated doc_ids stay, and an empty table stays empty. Other columns are
    not read. No rows are shuffled; a task holds about a megabyte of texts at a
    time, or one text that is longer, and the work is near linear in it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_collapsed, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
