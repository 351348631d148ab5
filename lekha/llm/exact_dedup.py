"""Exact dedup by composable polynomial fingerprints.

A text's normal form (runs of blanks become one space) is cut into chunks of
bytes. Each chunk yields its polynomial hashes and the powers of the two bases
at its length; those of a whole document follow by length-shifted arithmetic,
h(ab) = h(a) * base^len(b) + h(b), so that a huge document's chunks may be
hashed in any tasks. Documents with equal length and fingerprint are then
compared chunk by chunk with the first document of their group, and those that
differ (a collision) are grouped anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.plans.shared import join_groups, written

#: Two primes below 2**31, and a base for each: products stay below 2**62.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244)
CHUNK = 1 << 18
#: Members of a group that meet one copy of the first document's chunks.
SALT_ROWS = 500
#: Bits of the filter that texts pass before they are shuffled, at most (8 MB), and for each id that is wanted.
FILTER_BITS, BITS_AN_ID = 1 << 26, 32
BLANKS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normal_form(text):
    """The text with each run of blanks as one space; null becomes empty."""
    return F.coalesce(F.regexp_replace(text, BLANKS, " "), F.lit(""))


def _chunks(binary, size: int):
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(binary) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(binary, i * size + 1, F.lit(size)))


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    """base^(n-1), ..., base, 1 modulo prime, by doubling."""
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
        step = step * step % prime
    return out[:n][::-1].copy()


def chunk_hash(chunk: bytes, powers: list[np.ndarray], primes=PRIMES) -> list[int]:
    """The chunk's hash under each base. Bytes count as 1 to 256, so that zero bytes count too."""
    x = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    return [int((x * w[len(w) - len(x):]).sum(dtype=np.uint64) % np.uint64(p)) for w, p in zip(powers, primes, strict=True)]


def _hashes(size: int):
    def run(batches):
        powers = [_powers(size, b, p) for b, p in zip(BASES, PRIMES, strict=True)]
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            h = [chunk_hash(c, powers) for c in chunks]
            lens = [len(c) for c in chunks]
            cols = [batch.column(c) for c in ("doc_id", "chunk_no", "text_sha256", "n_bytes")]
            made = [*([x[k] for x in h] for k in (0, 1)), *([pow(b, n, p) for n in lens] for b, p in zip(BASES, PRIMES, strict=True))]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(x, pa.int64()) for x in made],
                names=["doc_id", "chunk_no", "text_sha256", "n_bytes", "h0", "h1", "w0", "w1"],
            )

    return run


def _combine(k: int):
    """Folds a document's chunks, in order, into its hash under base k."""
    return F.aggregate(
        F.col("parts"), F.lit(0).cast("bigint"),
        lambda acc, x: (acc * x[f"w{k}"] + x[f"h{k}"]) % F.lit(PRIMES[k]),
    )


def fingerprints(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_sha256, n_bytes, f0, f1 of the normal form of every text; a text of one chunk has its chunk's hashes, without a shuffle."""
    norm = docs.select("doc_id", F.encode(normal_form(F.col("text")), "UTF-8").alias("bin"))
    rows = norm.select("doc_id", F.sha2("bin", 256).alias("text_sha256"), F.octet_length("bin").cast("bigint").alias("n_bytes"), F.posexplode(_chunks(F.col("bin"), chunk)).alias("chunk_no", "chunk"))
    hashed = written(rows.mapInArrow(_hashes(chunk), "doc_id bigint, chunk_no int, text_sha256 string, n_bytes bigint, h0 bigint, h1 bigint, w0 bigint, w1 bigint"), "chunks")
    single = hashed.where(F.col("n_bytes") <= chunk).select("doc_id", "text_sha256", "n_bytes", F.col("h0").alias("f0"), F.col("h1").alias("f1"))
    # equal rows of one doc_id have equal chunks, which count once; n says how many rows they are
    cut = hashed.where(F.col("n_bytes") > chunk).groupBy("doc_id", "text_sha256", "n_bytes").agg(
        F.array_sort(F.collect_set(F.struct("chunk_no", "h0", "w0", "h1", "w1"))).alias("parts"), F.count_if(F.col("chunk_no") == 0).cast("int").alias("n"))
    several = cut.select("doc_id", "text_sha256", "n_bytes", _combine(0).alias("f0"), _combine(1).alias("f1"), F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("col")
    return single.unionByName(several)


def those_wanted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows whose key occurs in wanted, and a few more: what a join with wanted need not shuffle is left out.

    A bitmap of the keys' hashes is broadcast, of FILTER_BITS at most; beyond that
    many keys it passes more rows, and the join that follows is exact all the same.
    """
    bits = min(FILTER_BITS, max(1 << 15, 1 << (wanted.count() * BITS_AN_ID).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    maps = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("__bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "__bucket")
    return met.where(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1).select(rows.columns)


def _differing(docs: DataFrame, members: DataFrame, chunk: int) -> DataFrame:
    """(doc_id, text_sha256) of the members whose normal form is not that of keep_id's document.

    members: doc_id, text_sha256, keep_id, keep_sha256, group_size. The first
    document's chunks are repeated once for every SALT_ROWS members, so that no
    task gets a hot group.
    """
    n_salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    is_head = (F.col("doc_id") == F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha256"))
    salted = members.where(~is_head).select("doc_id", "text_sha256", F.col("keep_id").alias("head"), F.col("keep_sha256").alias("head_sha"), F.pmod(F.xxhash64("doc_id"), n_salts).cast("int").alias("salt"), F.lit(0).alias("n_salts"))
    heads = members.where(is_head).select("doc_id", "text_sha256", F.col("keep_id").alias("head"), F.col("keep_sha256").alias("head_sha"), F.lit(None).cast("int").alias("salt"), n_salts.alias("n_salts"))
    wanted = heads.unionByName(salted).distinct()
    binary = F.encode(normal_form(F.col("text")), "UTF-8")
    texts = those_wanted(docs.select("doc_id", "text"), wanted.select("doc_id"), "doc_id").select("doc_id", binary.alias("bin"), F.sha2(binary, 256).alias("text_sha256")).dropDuplicates(["doc_id", "text_sha256"])
    rows = texts.join(wanted, ["doc_id", "text_sha256"]).select("doc_id", "text_sha256", "head", "head_sha", "salt", "n_salts", F.posexplode(_chunks(F.col("bin"), chunk)).alias("chunk_no", "chunk"))
    theirs = rows.where("n_salts > 0").select("head", "head_sha", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"), "chunk_no", F.col("chunk").alias("kept"))
    ours = rows.where("n_salts = 0").drop("n_salts")
    both = ours.join(theirs, ["head", "head_sha", "salt", "chunk_no"], "left")
    return both.where(~F.col("chunk").eqNullSafe(F.col("kept"))).select("doc_id", "text_sha256").distinct()


def exact_dedup(docs: DataFrame, chunk: int = CHUNK, prints: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when their normal forms are; of equal ones the smallest
    doc_id stays. A null text counts as empty, and empty texts equal each other.
    Rows that repeat a doc_id count each; those with its kept text are all kept,
    as ids are what is kept. Rows without a doc_id are left out. Other columns may
    have any name and are not read. An empty table gives an empty result.

    prints: fingerprints() by default, or a table like it (tests pass one that
    collides). Only ids and fingerprints are shuffled for all documents, and
    texts only for the comparison within groups.
    """
    docs = docs.where("doc_id is not null")
    todo = written(prints if prints is not None else fingerprints(docs, chunk), "prints")
    same, done = ["doc_id", "text_sha256"], None
    while True:
        key = ["n_bytes", "f0", "f1"]
        groups = written(todo.groupBy(*key).agg(F.min(F.struct(*same)).alias("first"), F.count("*").alias("group_size")).where("group_size > 1"), "large")
        groups = groups.select(*key, F.col("first.doc_id").alias("keep_id"), F.col("first.text_sha256").alias("keep_sha256"), "group_size")
        grouped = join_groups(todo, groups, key, "group_size", todo.count())
        grouped = written(grouped.withColumns({"keep_id": F.coalesce("keep_id", "doc_id"), "keep_sha256": F.coalesce("keep_sha256", "text_sha256"), "group_size": F.coalesce("group_size", F.lit(1))}), "groups")
        many = grouped.where("group_size > 1").select(*same, "keep_id", "keep_sha256", "group_size")
        differing = written(_differing(docs, many, chunk), "differing")
        if differing.isEmpty():
            done = grouped if done is None else done.unionByName(grouped)
            break
        settled = grouped.join(differing, same, "left_anti")
        done = settled if done is None else done.unionByName(settled)
        todo = written(todo.join(differing, same, "left_semi"), "again")
        done = written(done, "settled")
        sizes = written(done.groupBy("keep_id", "keep_sha256").agg(F.count("*").alias("group_size")), "sizes")
        done = written(join_groups(done.drop("group_size"), sizes, ["keep_id", "keep_sha256"], "group_size", done.count()).select(grouped.columns), "settled")
    return done.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes")
