"""Exact top-k inner products by no-random-access aggregation over blocks.

Vectors are packed into blocks. In a block of candidates, each component has a list of the candidates sorted by their
contribution: for a positive query component the largest values come first, for a negative one the smallest. All lists
are read to the same depth, which doubles. After each round a candidate's score is known to lie between
    lower = sum of contributions read + sum over unread lists of the list's last contribution
    upper = sum of contributions read + sum over unread lists of the list's frontier (the last one read).
For a whole block of queries both come from matrix products, because what has been read depends on the sign of the query
component alone. A candidate whose upper bound is under the k-th best lower bound of every query is an outsider: later rounds
read no more of it. Reading stops when few pairs of query and candidate are left; their final scores are resolved.

A task takes the blocks of its group one after another. The k-th best score that a query has got so far is its bar in the next
block, so after the first blocks the first slice of the lists is mostly all that is read. The groups' answers are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 512
BLOCK = 2048
PER_GROUP = 8


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b, by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def no_random_access(queries: np.ndarray, block: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of a block for each query: (query, candidate, score); ties go to the smaller id.

    own[i, j]: candidate j is query i's own row. least: for each query, a score that candidates must reach.
    """
    n, dims = block.shape
    bar = np.full(len(queries), -np.inf) if least is None else least.astype(float)
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * max(1, dims)
    live = np.arange(n)  # candidates that some query may still take
    alive = ~own
    if n and dims and most < 2**53:
        plus, minus = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        ordered = np.sort(block, axis=0).astype(np.float64)
        depth = max(1, n // 16)
        while depth < n and np.count_nonzero(alive) > 8 * k * len(queries):
            values = block[live].astype(np.float64)
            high, low = ordered[n - depth], ordered[depth - 1]  # frontiers of the lists from the top and from the bottom
            read_high, read_low = values >= high, values <= low
            if len(live) > k:
                lower = plus @ np.where(read_high, values, ordered[0]).T + minus @ np.where(read_low, values, ordered[-1]).T
                lower[own[:, live]] = -np.inf
                bar = np.maximum(bar, np.partition(lower, len(live) - k, axis=1)[:, len(live) - k])
            upper = plus @ np.where(read_high, values, high).T + minus @ np.where(read_low, values, low).T
            alive &= upper >= bar[:, None]
            some = alive.any(axis=0)
            live, alive = live[some], alive[:, some]
            depth = min(n, 2 * depth)
    q, c = np.nonzero(alive)
    if len(q) * 4 > alive.size or most >= 2**53:
        score = exact_products(queries, block[live])[q, c]
    else:
        score = np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 65536]], block[live[c[i : i + 65536]]]) for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0, np.int64)
    enough = score >= bar[q]
    q, c, score = q[enough], live[c[enough]], score[enough]
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    best = place < k
    return q[best], c[best], score[best]


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows (dims, block, ids, places, values): up to `size` vectors of one length in a row, as packed integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, at = TaskContext.get().partitionId(), 0, 0
        held: dict[int, list] = {}

        def row(dims: int) -> pa.RecordBatch:
            nonlocal number
            ids, places, rows = zip(*held.pop(dims), strict=True)
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([dims], pa.int32()), pa.array([(part << 32) + number - 1], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(places, np.int64).tobytes()], pa.binary()), pa.array([np.stack(rows).tobytes()], pa.binary())],
                ["dims", "block", "ids", "places", "values"],
            )

        for batch in batches:
            lists = batch.column(1)
            flat = np.floor(256.0 * lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for i, (key, end) in enumerate(zip(batch.column(0).to_pylist(), ends.tolist(), strict=True)):
                begin = int(ends[i - 1]) if i else 0
                own = held.setdefault(end - begin, [])
                own.append((key, (part << 32) + at, flat[begin:end]))
                at += 1
                if len(own) == size:
                    yield row(end - begin)
        for dims in list(held):
            yield row(dims)

    return vectors.mapInArrow(pack, "dims int, block long, ids binary, places binary, values binary")


def top_k_products(embeddings: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the highest inner product for each query: (query_id, rank, vec_id, score).

    Components count as floor(256 * x). Queries are the rows whose id is divisible by `every`; candidates are all other
    rows of the same length; ties go to the smaller id, fewer than k candidates are all returned. Rows with a null id,
    a null vector, or a null or non-finite component take no part. Rows that repeat an id are rows of their own: each
    is a candidate, and each query row has its own answer, but a row with the query's id counts as the query's own.
    """
    good = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(good)
    queries = rows.where(F.col("id") % every == 0)
    n, n_queries = rows.count(), queries.count()
    n_blocks, n_query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    blocks = _blocks(rows.repartition(n_blocks), BLOCK)
    query_blocks = _blocks(queries.repartition(n_query_blocks), QUERY_BLOCK)
    # the stated queries against all rows, in blocks: a copy of a query block for each group of some PER_GROUP blocks
    groups = max(1, min(-(-n_blocks // PER_GROUP), 4096))
    left = query_blocks.select("dims", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("places").alias("q_places"), F.col("values").alias("q_values"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    right = blocks.withColumn("grp", F.pmod(F.shiftright("block", 32), F.lit(groups)).cast("int"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = None, np.zeros((0, k))  # of the query block before: the k best scores of each query so far
        for batch in batches:
            for i in range(batch.num_rows):
                dims, q_block = batch.column("dims")[i].as_py(), batch.column("q_block")[i].as_py()
                q_ids, q_places, ids = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("q_ids", "q_places", "ids"))
                queries = np.frombuffer(batch.column("q_values")[i].as_py(), np.int64).reshape(len(q_ids), dims)
                block = np.frombuffer(batch.column("values")[i].as_py(), np.int64).reshape(len(ids), dims)
                if last != (dims, q_block):
                    last, best = (dims, q_block), np.full((len(q_ids), k), -np.inf)
                q, c, score = no_random_access(queries, block, ids, q_ids[:, None] == ids[None, :], k, best.min(axis=1))
                here = np.full((len(q_ids), k), -np.inf)
                here[q, np.arange(len(q)) - np.searchsorted(q, q, side="left")] = score
                best = np.sort(np.concatenate([best, here], axis=1), axis=1)[:, -k:]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(q_places[q]), pa.array(ids[c]), pa.array(score)], ["query_id", "place", "vec_id", "score"])

    found = left.join(right, ["dims", "grp"]).select("dims", "q_block", "q_ids", "q_places", "q_values", "ids", "values").mapInArrow(match, "query_id long, place long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "place").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
