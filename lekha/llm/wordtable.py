"""Ids of words, remembered by hashes of their bytes and looked up many at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

U64 = np.uint64
_M = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = [mix(np.arange(1, 257, dtype=U64) * U64(m)) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for k, m in (("up", _M), ("down", pow(_M, -1, 1 << 64))):
            x = np.full(n, m, U64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each raw[start:stop], by prefix sums."""
    up, down = powers(len(raw) + 1)
    out = []
    for values in _BYTES:
        sums = np.zeros(len(raw) + 1, U64)
        np.cumsum(values[raw] * up[: len(raw)], dtype=U64, out=sums[1:])
        out.append(mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U64)))
    return out[0], out[1]


class Places:
    """Where each of some distinct 64-bit keys stands, by a table of slots."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.shift = U64(64 - bits)
        slot = self._slot(keys)
        by = np.argsort(slot, kind="stable")
        self.keys, self.place = np.append(keys[by], U64(0)), np.append(by, -1)  # the last one is beyond all slots
        self.first = np.searchsorted(slot[by], np.arange((1 << bits) + 1)).astype(np.int64)
        self.most = int(np.diff(self.first).max(initial=0))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U64(_M) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        at = self.first[slot]
        out = np.where(self.keys[at] == keys, self.place[at], -1)
        for k in range(1, self.most):
            i = np.flatnonzero((out < 0) & (self.first[slot + 1] - at > k))
            out[i] = np.where(self.keys[at[i] + k] == keys[i], self.place[at[i] + k], -1)
        return out.reshape(shape)


class WordTable:
    """compute(words) gives each word's number of ids, and all ids; they are remembered for at most `limit` words.

    Words are told apart by 128 bits of hash.
    """

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.compute, self.limit = compute, limit
        self._clear()

    def _clear(self) -> None:
        self.key, self.check = np.zeros(0, U64), np.zeros(0, U64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.key):
            return np.full(len(key), -1)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[i] == key) & (self.check[i] == check), i, -1)

    def ids(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words raw[start:stop]: how many ids each has, and all ids one after the other."""
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        every, check = hashes(raw, start, stop)
        key, first, back = np.unique(every, return_index=True, return_inverse=True)
        check = check[first]
        place = self._find(key, check)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.key) + len(new) > self.limit:
                self._clear()
                new = np.arange(len(key))
            words = [raw[a:b].tobytes() for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)]
            n, flat = self.compute(words)
            at = len(self.flat) + np.cumsum(n) - n
            where = np.searchsorted(self.key, key[new])
            self.key, self.check = np.insert(self.key, where, key[new]), np.insert(self.check, where, check[new])
            self.at, self.n = np.insert(self.at, where, at), np.insert(self.n, where, n)
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
            place = self._find(key, check)
        place = place[back]
        n = self.n[place]
        ends = np.cumsum(n)
        return n, self.flat[np.repeat(self.at[place] - ends + n, n) + np.arange(ends[-1])]
