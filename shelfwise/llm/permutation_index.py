"""Operator 6, approximate nearest neighbours: a permutation index.

Every vector is represented by its ``LENGTH`` nearest pivots in order (of ``PIVOTS`` vectors, chosen
on the driver from a sample that is bounded by ``PIVOT_SAMPLE`` times that number).  Blocks of the table post their vectors in
pivot inverted files; a query adds up, over the posts of its own pivots, how much each shared pivot
takes off the footrule distance of the two permutations.  Of every block the nearest by footrule
(``RERANK_SHARE`` of its rows, ``LEAST_RERANK`` at least) are ranked again by exact Euclidean
distance in double precision; ties go to the smaller id.

Queries are the rows whose id is divisible by ``every``; they meet all blocks, in blocks of their own.
A query's candidates are all rows with another id.  Rows that share an id and a vector count once; an
id with several vectors is searched with its least one.  Null ids and vectors that are null, zero,
of another length than most, or hold null or non-finite components take no part.  Of equal vectors
only the k + 1 smallest ids are indexed: no other can be among a query's k nearest, ties going to
smaller ids.  Fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import drawn, written

PIVOTS = 256
PIVOT_SAMPLE = 4
LENGTH = 64                # pivots a permutation names
K = 10
EVERY = 100
BLOCK_ROWS = 4096          # vectors of a block, on average
QUERY_ROWS = 2048          # queries of a block, on average
RERANK_SHARE = 0.15
LEAST_RERANK = 768
SEED = 6


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part, each pair once."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))      # no negative zero
    out = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    size = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return out.where(F.size("v") == (size["n"] if size else 0)).distinct()


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    """At most ``pivots`` different vectors: of ``PIVOT_SAMPLE`` times as many drawn by hash, the first is
    taken and then always the one farthest from those taken, so that a crowd of near copies gets few."""
    some = drawn(rows.select("v").distinct(), F.xxhash64(F.lit(seed), F.col("v")), pivots * PIVOT_SAMPLE)
    x = np.array([r["v"] for r in some], dtype=np.float64)
    taken: list[int] = [0] if len(x) else []
    gap = np.full(len(x), np.inf)
    while len(taken) < min(pivots, len(x)):
        gap = np.minimum(gap, ((x - x[taken[-1]]) ** 2).sum(axis=1))
        taken.append(int(gap.argmax()))
    return x[taken]


def permutations(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest ``length`` pivots of every vector, in order (ties by pivot number)."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)[None]
    return np.argsort(d, axis=1, kind="stable")[:, :length].astype(np.uint16)


class InvertedFiles:
    """For every pivot the vectors of a block that name it, with its rank in their permutations."""

    def __init__(self, perms: np.ndarray, pivots: int):
        self.rows, self.length = perms.shape
        order = np.argsort(perms.ravel(), kind="stable")
        self.who = order // self.length
        self.rank = (order % self.length).astype(np.int32)
        self.first = np.searchsorted(perms.ravel()[order], np.arange(pivots + 1))

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule distance of every row; a pivot that a permutation does not name has rank ``length``."""
        gain = np.zeros(self.rows, np.int32)
        for r, p in enumerate(perm.tolist()):
            a, b = self.first[p], self.first[p + 1]
            gain[self.who[a:b]] += self.length - np.maximum(self.rank[a:b], r)
        return self.length * (self.length + 1) - 2 * gain


def _search(block: pa.Table, queries: pa.Table, pivots: int, length: int, k: int, share: float, least: int) -> pa.Table:
    order = np.argsort(block.column("id").to_numpy(), kind="stable")
    ids = block.column("id").to_numpy()[order]
    x = np.array(block.column("v").to_pylist(), dtype=np.float64)[order]
    perms = np.frombuffer(b"".join(block.column("perm").to_pylist()), np.uint16).reshape(len(ids), length)[order]
    index = InvertedFiles(perms, pivots)
    depth = min(len(ids), max(least, int(np.ceil(share * len(ids)))) + 1)     # one may be the query itself
    out: list[tuple] = []
    for q, v, perm in zip(queries.column("id").to_pylist(), queries.column("v").to_pylist(), queries.column("perm").to_pylist()):
        near = index.footrule(np.frombuffer(perm, np.uint16))
        # Least footrule first and, among equals, smaller ids.
        edge = np.partition(near, depth - 1)[depth - 1]
        sure = np.flatnonzero(near < edge)
        some = np.concatenate([sure, np.flatnonzero(near == edge)[:depth - len(sure)]])
        some = some[ids[some] != q]
        gap = x[some] - np.array(v)
        score = np.sqrt((gap * gap).sum(axis=1))
        for i in np.lexsort((ids[some], score))[:2 * k]:
            out.append((q, int(ids[some[i]]), float(score[i])))
    return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()),
                     "score": pa.array([r[2] for r in out], pa.float64())})


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY,
            pivots: int = PIVOTS, length: int = LENGTH, share: float = RERANK_SHARE, least: int = LEAST_RERANK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every query."""
    all_rows = written(vectors(table, id_col, vector_col), "vectors")
    centres = choose_pivots(all_rows, pivots, seed)
    length = min(length, len(centres))
    copies = Window.partitionBy("v").orderBy("id")
    rows = all_rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                perms = permutations(np.array(part.column("v").to_pylist(), dtype=np.float64), centres, length)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([p.tobytes() for p in perms], pa.binary())], names=["id", "v", "perm"])

    schema = "id long, v array<double>, perm binary"
    index = written(rows.mapInArrow(permute, schema), "permutations")
    asked = all_rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = written(asked.mapInArrow(permute, schema), "queries")
    blocks = max(1, -(-index.count() // BLOCK_ROWS))
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    deal = lambda n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("block", deal(blocks)).withColumn("part", each(parts))
    right = queries.withColumn("part", deal(parts)).withColumn("block", each(blocks))

    def search(block: pa.Table, wanted: pa.Table) -> pa.Table:
        if not block.num_rows or not wanted.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _search(block, wanted, len(centres), length, k, share, least)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(search, "query_id long, vec_id long, score double")
    # An id with several vectors counts by its nearest one.
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
