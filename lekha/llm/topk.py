"""Exact top-k inner products by the threshold algorithm.

Rows are dealt to blocks. In a block every dimension has its list of rows sorted
by that component; a query reads each list from the end that its own component
favours. What the lists' current values could add up to at most bounds all rows
not seen yet, and reading stops when that bound is below the kth score so far.
The blocks' results are merged by score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows, and queries, of a block.
ROWS, QUERIES = 8192, 4096
#: Entries of each list that a query reads first.
DEPTH = 8
#: So many list entries a row, read in all, are taken to have brought up every row.
ALL = 4


class Lists:
    """A block's vectors and its sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, exact = ids[by_id], vectors[by_id]
        most = int(np.abs(exact).max(initial=0)) ** 2 * max(1, exact.shape[1])
        #: Scores are integers below 2**24 or 2**53, which these floats hold exactly.
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        self.x = exact.astype(self.kind)
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows but the query's own, ties to the smaller id."""
        ids, scores, _ = self.search(q, own, k)
        return ids, scores

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
        """As top; and which part of the lists' entries was read, and of the rows scored, until the bound or the lists' ends stopped it."""
        n, d = self.x.shape
        q = q.astype(self.kind)
        high = q > 0
        used = np.flatnonzero(q)
        score = np.empty(n, self.kind)
        seen = np.zeros(n, bool)
        depth = 0
        while True:
            last, depth = depth, min(n, DEPTH if not depth else 4 * depth)
            if not seen.all():
                if depth < n and depth * len(used) < ALL * n:
                    at = np.concatenate([self.order[n - depth : n - last, used[high[used]]].ravel(), self.order[last:depth, used[~high[used]]].ravel()])
                    fresh = np.zeros(n, bool)
                    fresh[at] = True
                    new = np.flatnonzero(fresh & ~seen)
                else:  # all but a few rows come up so far down the lists: score the rest without looking them up
                    new = np.flatnonzero(~seen)
                if 2 * len(new) > n:  # one product is cheaper than to gather most rows
                    score[:] = self.x @ q
                else:
                    score[new] = self.x[new] @ q
                seen[new] = True
            found = np.flatnonzero(seen & (self.ids != own))
            s = score[found]
            kth = np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else None
            ends = np.where(high, self.sorted[n - depth], self.sorted[depth - 1])
            if depth >= n or seen.all() or (kth is not None and kth > ends @ q):
                if kth is not None:
                    found, s = found[s >= kth], s[s >= kth]
                best = np.lexsort((self.ids[found], -s))[:k]
                return self.ids[found[best]], s[best].astype(np.int64), (depth / n, float(seen.mean()))


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        role = np.array(table.column("query").to_pylist(), bool)
        ids = table.column("vec_id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy() if table.num_rows else np.zeros(0, np.int64)
        vectors = flat.reshape(len(ids), -1)
        q_out, v_out, s_out = [], [], []
        if role.any() and not role.all():
            lists = Lists(ids[~role], vectors[~role])
            for own, q in zip(ids[role], vectors[role], strict=True):
                v, s = lists.top(q, own, k)
                q_out.append(np.full(len(v), own))
                v_out.append(v)
                s_out.append(s)
        cat = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": cat(q_out), "vec_id": cat(v_out), "score": cat(s_out)})

    return run


def quantised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v = floor(64 * x) of the vectors with an id and without null or non-finite components."""
    ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & F.coalesce(ok, F.lit(False)))
    return rows.select("vec_id", F.transform(column, lambda x: F.floor(x.cast("double") * 64).cast("bigint")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, rows: int = ROWS, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best vectors but its own, ties to the smaller vec_id.

    vectors and queries: (vec_id, v array<bigint>); a vector meets queries with as
    many dimensions. Fewer than k candidates give fewer rows; no queries or no
    vectors give none. Rows that repeat a vec_id are candidates each. As queries they
    are one query: rows with that id are its own, and what each of them finds is ranked
    together, so a candidate stands there once for each different vector of the
    query (equal rows are one). Other columns are not read. Every block of queries meets every block of
    vectors in a task of bounded size; a block gives k rows a query at most.
    """
    n_rows = max(1, -(-vectors.count() // rows))
    n_queries = max(1, -(-queries.count() // block))
    place = F.xxhash64("vec_id")
    sides = [
        vectors.select("vec_id", "v", F.lit(False).alias("query"), F.pmod(place, F.lit(n_rows)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("a")),
        queries.distinct().select("vec_id", "v", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("b"), F.pmod(place, F.lit(n_queries)).cast("int").alias("a")),
    ]
    met = sides[0].unionByName(sides[1]).withColumn("d", F.size("v")).where("d > 0")
    found = met.groupBy("d", "a", "b").applyInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
