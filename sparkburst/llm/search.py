"""Exact top-k search by inner product, pruned by segment statistics at several resolutions.

A vector is cut into equal segments; of each the mean and the population deviation are
kept, times the root of the segment's length. For two vectors, the distance between these
statistics is a lower bound of the distance between the vectors; and because the squared
norms are the same in both, the product of the statistics is an upper bound of the inner
product. Splitting a segment only tightens the bound, so a tile of queries and candidates
is tried coarse to fine: a candidate that can't reach a query's k-th best score so far is
out, and the pairs that survive the finest level are computed exactly.

Candidates and queries are dealt into blocks, and every block of candidates meets every
block of queries in some task. A task keeps k results a query, whose last one is the
threshold for all blocks that follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .vectors import finite_vectors, greatest_width, padded_matrix

#: Rows of a block of candidates and of queries, and blocks of one partition of each.
CANDIDATE_BLOCK, QUERY_BLOCK, BLOCKS = 1_024, 256, 8
#: Numbers of segments, coarse to fine.
LEVELS = (1, 4, 16)
#: Integers of this size and more are no longer exact in doubles; scores end at those of 64 bits.
EXACT, LONG = 2.0**53, (1 << 63) - 1
_PAIRS = 65_536


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row the means, then the deviations of its equal segments, times the root of their length."""
    parts = x.reshape(len(x), segments, -1)
    return np.hstack([parts.mean(axis=2), parts.std(axis=2)]) * np.sqrt(max(parts.shape[2], 1))


def _block_rows(width: int, size: int, prefix: str):
    """Blocks of at most ``size`` rows of (rid, vec_id, v): ids, row numbers, the matrix and its statistics as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                ids = part.column("vec_id")
                x = np.floor(256 * padded_matrix(part.column("v"), width))
                parts = [part.column("rid").to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()]
                stats = np.hstack([segment_statistics(x, s) for s in LEVELS])
                yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in (np.concatenate(parts), x, stats)], [prefix + n for n in ("ids", "x", "stats")])

    return run


def _blocks(rows: DataFrame, width: int, size: int, prefix: str) -> DataFrame:
    n = max(1, -(-rows.count() // (size * BLOCKS)))
    return rows.repartition(n).mapInArrow(_block_rows(width, size, prefix), ", ".join(f"{prefix}{n} binary" for n in ("ids", "x", "stats")))


def _products(q: np.ndarray, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs of rows, as integers of 64 bits; larger ones end there."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < EXACT:
        if len(row) * 8 > len(q) * len(x):
            return (q @ x.T)[row, at].astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", q[row[a : a + _PAIRS]], x[at[a : a + _PAIRS]]) for a in range(0, len(row), _PAIRS)] or [np.empty(0)]).astype(np.int64)
    whole = lambda m: [list(map(int, r)) for r in m.tolist()]
    qs, xs = whole(q), whole(x)
    sums = (sum(a * b for a, b in zip(qs[i], xs[j])) for i, j in zip(row.tolist(), at.tolist()))
    return np.array([max(-LONG - 1, min(LONG, s)) for s in sums], np.int64)


def survivors(q_stats: np.ndarray, x_stats: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row) whose product may reach the query's ``least`` at every level."""
    rows, cols = np.arange(len(q_stats)), np.arange(len(x_stats))
    at = 0
    for segments in LEVELS:
        s = slice(at, at + 2 * segments)
        at += 2 * segments
        q, x = q_stats[rows, s], x_stats[cols, s]
        size = np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((x**2).sum(axis=1))[None, :]
        mask = q @ x.T + 1e-9 * size + 1e-6 >= least[rows][:, None]
        held, kept = mask.any(axis=1), mask.any(axis=0)
        rows, cols, mask = rows[held], cols[kept], mask[np.ix_(held, kept)]
    row, col = np.nonzero(mask)
    return rows[row], cols[col]


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of columns (query row, score, id is known, id, row number) the ``k`` first of each query row."""
    row, score, known, ids, rid = found
    order = np.lexsort((rid, ids, -known, ~score, row))  # ~score: descending, without overflow
    row = row[order]
    keep = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    return [c[keep] for c in found]


_FOUND = "q_rid long, query_id long, score long, vec_id long, rid long"


def _search(width: int, k: int):
    """Over pairs of blocks: the ``k`` best of each query among the candidates that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[np.ndarray]] = {}  # of each block of queries the best so far
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_x, q_stats, c_ids, c_x, c_stats = (batch.column(n)[row].as_py() for n in ("q_ids", "q_x", "q_stats", "c_ids", "c_x", "c_stats"))
                q_rid = np.frombuffer(q_ids, np.int64).reshape(3, -1)[0]
                rid, known, ids = np.frombuffer(c_ids, np.int64).reshape(3, -1)
                q, x = np.frombuffer(q_x).reshape(len(q_rid), width), np.frombuffer(c_x).reshape(len(rid), width)
                best = held.get(q_ids) or [np.empty(0, np.int64)] * 5
                least = np.full(len(q_rid), -np.inf)
                place, n = np.unique(best[0], return_counts=True)
                least[place[n == k]] = np.minimum.reduceat(best[1], np.cumsum(n) - n)[n == k] if len(n) else 0
                at, col = survivors(np.frombuffer(q_stats).reshape(len(q), -1), np.frombuffer(c_stats).reshape(len(x), -1), least)
                other = q_rid[at] != rid[col]
                at, col = at[other], col[other]
                new = [at, _products(q, x, at, col), known[col], ids[col], rid[col]]
                held[q_ids] = _best([np.concatenate(c) for c in zip(best, new)], k)
        for q_ids, (at, score, known, ids, rid) in held.items():
            q_rid, _, q_id = np.frombuffer(q_ids, np.int64).reshape(3, -1)
            yield pa.RecordBatch.from_arrays([pa.array(q_rid[at]), pa.array(q_id[at]), pa.array(score), pa.array(ids, mask=known == 0), pa.array(rid)], ["q_rid", "query_id", "score", "vec_id", "rid"])

    return run


def top_products(rows: DataFrame, is_query: F.Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the greatest integer inner product for each query row.

    ``rows`` has (vec_id, embedding); a component x counts as floor(256 x). A query meets
    every row but itself; equal scores go by the smaller vec_id, null ids last. Vectors that
    are null or hold null or non-finite components take no part; shorter vectors count as
    padded with zeros; a vector without components has score 0 with all. Repeated ids are
    rows and queries of their own; scores that need more than 64 bits end at the greatest
    or least of them; further columns are ignored; an empty table gives no rows.
    """
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    kept = materialise(finite_vectors(named, "v").withColumn("rid", F.monotonically_increasing_id()))
    width = -(-max(greatest_width(kept, "v"), 1) // LEVELS[-1]) * LEVELS[-1]
    blocks = lambda df, size, prefix: materialise(_blocks(df.select("rid", "vec_id", "v"), width, size, prefix))
    queries, candidates = blocks(kept.where("is_query"), QUERY_BLOCK, "q_"), blocks(kept, CANDIDATE_BLOCK, "c_")
    pairs = candidates.crossJoin(queries)  # rows are whole blocks
    found = materialise(pairs.mapInArrow(_search(width, k), _FOUND), batch_rows=16)
    order = Window.partitionBy("q_rid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other rows for each row whose vec_id is divisible by 50; cases as in ``top_products``."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
