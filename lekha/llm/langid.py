"""Language ID with language-bitmask n-gram filters.

Each language has a set of byte n-grams that are typical of it. The sets live
in one bit-sliced Bloom filter: a slot holds one bit for each language, an
n-gram's slots are and-ed, and the result is the mask of all languages whose
set contains it. A document's counts by language, less the false positives to
be expected from the filter's filling, decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lekha.llm.batches import slabs, text_bytes

N = 4
#: Multipliers of the filter's hash functions (odd).
HASHES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Labelled documents, at most about so many, from which the sets are learned.
TRAIN_DOCS = 12_000
#: N-grams of a language, at most.
GRAMS = 60_000
SLOT_BITS = 21
#: Languages in one word of a slot's mask.
WORD = 64
#: Bytes of a giant row that are looked at together.
PIECE = 1 << 22
UND = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32
_LETTER = (_FOLD != 32).astype(np.uint8)


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that starts at each byte, and whether it counts: it starts at a letter or its next byte is one.

    Each row is followed by spaces, so that no n-gram reaches into the next row.
    """
    rows, size = len(offsets) - 1, np.diff(offsets)
    at = np.arange(len(raw)) + np.repeat(np.arange(rows) * (N - 1), size)
    x = np.full(len(raw) + rows * (N - 1) + N, 32, np.uint8)
    x[at] = _FOLD[raw]
    y = x.astype(np.uint32)
    g = y[: len(x) - N]
    for k in range(1, N):
        g = g | y[k : len(x) - N + k] << np.uint32(8 * k)
    letter = _LETTER[x]
    return g[at], (letter[at] | letter[at + 1]).astype(bool)


@dataclass
class Filter:
    """langs: in the order of their bits; slots: masks, an array for every 64 languages; false_rate: of each language."""

    langs: list[str]
    slots: list[np.ndarray]
    false_rate: np.ndarray
    bits: int = SLOT_BITS

    @classmethod
    def of(cls, sets: dict[str, np.ndarray], bits: int = SLOT_BITS) -> Filter:
        langs = sorted(sets)
        kind = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(langs) <= n), np.uint64)
        slots = [np.zeros(1 << bits, kind) for _ in range(0, max(1, len(langs)), WORD)]
        filled = np.zeros(len(langs))
        for k, lang in enumerate(langs):
            of = slots[k // WORD]
            for m in HASHES:
                of[np.unique(_slot(sets[lang].astype(np.uint32), m, bits))] |= kind(1 << k % WORD)
            filled[k] = ((of >> kind(k % WORD)) & kind(1)).mean()
        return cls(langs, slots, filled ** len(HASHES), bits)

    def masks(self, g: np.ndarray) -> list[np.ndarray]:
        """Of each n-gram: the masks of all languages that contain it."""
        places = [_slot(g, m, self.bits) for m in HASHES]
        return [np.bitwise_and.reduce([of[p] for p in places]) for of in self.slots]

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the n-grams that count, and how many each language has; no row bears on another's."""
        n = np.zeros(len(offsets) - 1, np.int64)
        per = np.zeros((len(offsets) - 1, len(self.langs)), np.int64)
        for a, b in slabs(offsets):
            lo, hi = int(offsets[a]), int(offsets[b])
            for at in range(lo, hi, PIECE):  # a giant row in pieces, each with the bytes that its last n-grams need
                end = min(hi, at + PIECE)
                more = min(hi, end + N - 1)
                g, ok = grams(raw[at:more], np.clip(offsets[a : b + 1], at, more) - at)
                g, ok = g[: end - at], ok[: end - at]
                row = np.repeat(np.arange(b - a), np.diff(np.clip(offsets[a : b + 1], at, end)))[ok]
                n[a:b] += np.bincount(row, minlength=b - a)
                masks = self.masks(g[ok])
                for k in range(len(self.langs)):
                    mask = masks[k // WORD]
                    per[a:b, k] += np.bincount(row[(mask >> mask.dtype.type(k % WORD)) & mask.dtype.type(1) != 0], minlength=b - a)
        return n, per

    def decide(self, n: np.ndarray, per: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (ties: the first by name), its share among the languages, its share of the n-grams."""
        if not self.langs or not len(n):
            return [UND] * len(n), np.zeros(len(n)), np.zeros(len(n))
        true = np.clip((per - n[:, None] * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, None)
        best = true.argmax(axis=1)
        top, total = true[np.arange(len(n)), best], true.sum(axis=1)
        langs = [self.langs[b] if k else UND for b, k in zip(best, n, strict=True)]
        return langs, np.where(total > 0, top / np.maximum(total, 1e-9), 0.0), np.where(n > 0, top / np.maximum(n, 1), 0.0).clip(0, 1)


def _slot(g: np.ndarray, m: int, bits: int) -> np.ndarray:
    h = g * np.uint32(m)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)


def _gram_counts(batches):
    for batch in batches:
        raw, at = text_bytes(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            parts = [raw[at[i] : at[i + 1]] for i in np.flatnonzero(langs == lang)]
            g, ok = grams(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]))
            got, n = np.unique(g[ok], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got)), pa.array(got.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def fit(labelled: DataFrame, max_docs: int = TRAIN_DOCS, max_grams: int = GRAMS, bits: int = SLOT_BITS) -> Filter:
    """Learn the sets from (doc_id, text, lang); rows with a null text or lang don't count.

    A sample of about max_docs documents, chosen by a hash of doc_id, is enough.
    An n-gram belongs to each language that has at least 0.3 of its frequency,
    relative to the languages' totals. At most max_grams n-grams of each language
    come to the driver. Nothing to learn from: no languages. Rows that repeat in
    the sample count as often as they occur.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", F.lower("text").alias("text"), "lang")
    total = rows.count()
    if total > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_docs / total))
    counted = rows.mapInArrow(_gram_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n >= 3")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    typical = counted.withColumn("p", share).withColumn("q", F.col("p") / F.sum("p").over(Window.partitionBy("gram"))).where("q >= 0.3")
    top = typical.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= max_grams)
    sets: dict[str, list[int]] = {}
    for r in top.select("lang", "gram").collect():
        sets.setdefault(r.lang, []).append(r.gram)
    return Filter.of({k: np.array(v, np.int64) for k, v in sets.items()}, bits)


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred, score, coverage of every document.

    lang_pred is und, with score 0, where the text is null or has no letter.
    score: the language's share of the corrected counts; coverage: the share of
    the text's n-grams that it has. A row's result depends on its own text alone;
    repeated rows get equal results, and an empty table an empty one. Only doc_id
    and text are read.
    """

    def run(batches):
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            langs, score, coverage = model.decide(*model.counts(raw, at))
            has = batch.column("letter").to_pylist()
            langs = [x if ok else UND for x, ok in zip(langs, has, strict=True)]
            score = np.where(has, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs), pa.array(score), pa.array(np.where(has, coverage, 0.0))], names=["doc_id", "lang_pred", "score", "coverage"])

    rows = docs.select("doc_id", F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, coverage double")


def known(docs: DataFrame, model: Filter, least: float = 0.2) -> DataFrame:
    """The rows of docs, all columns kept, whose text has a letter and a language with at least that coverage."""

    def run(batches):
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            _, _, coverage = model.decide(*model.counts(*text_bytes(pc.utf8_lower(text))))
            yield batch.filter(pc.and_(pc.match_substring_regex(text, r"\p{L}"), pa.array(coverage >= least)))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part
