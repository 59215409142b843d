"""Exact pairs of near vectors, without comparing all pairs: cells around pivots and the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: At most so many pivots, and rows of a cell in one task.
PIVOTS = 512
HOME, GUESTS = 4096, 16_384


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all of p."""
    squares = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T
    return np.sqrt(np.maximum(squares, 0))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def near_pairs(vectors: DataFrame, radius: float, pivots: int = PIVOTS, home: int = HOME, guests: int = GUESTS) -> DataFrame:
    """(id_1, id_2, distance) of all pairs of rows (id, group, vector) of one group with a Euclidean distance of at most `radius`;
    each pair once, id_1 < id_2. Ids tell rows apart; vectors of a group have one length; null vectors are in no pair.

    The rows nearest to each of a bounded number of pivots (drawn by a hash of the id) are a cell, whose radius is known. A row can
    only be near to rows of cells whose pivot is within `radius` and the cell's radius, so it is a guest in these alone: exact, whatever
    the pivots. Cells and their guests are dealt in blocks of `home` and `guests` rows, so a cell of any size is many tasks. A hash of
    the group is one more coordinate, so most groups lie apart, and groups need no runs of their own. The driver sees a few
    numbers for each pivot.
    """
    rows = vectors.where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    code = F.xxhash64("group", F.size("vector"))
    apart = F.pmod(code, F.lit(64)).cast("double") * (2 * radius)
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    kind = vectors.schema["id"].dataType.simpleString()
    if longest is None:
        return vectors.sparkSession.createDataFrame([], f"id_1 {kind}, id_2 {kind}, distance double")
    padded = F.concat(F.transform("vector", lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("vector")), F.array(apart))
    rows = cut(rows.select("id", padded.alias("vector"), code.alias("code")))
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(pivots, max(1, int(np.sqrt(n))))).select("vector").toArrow()
    centre = vectors.sparkSession.sparkContext.broadcast(_matrix(sample["vector"]))  # at most `pivots` rows
    slack = 1e-5 * (1 + float(np.abs(centre.value).max()))  # of the rounding of distances to pivots

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column(1)), centre.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1))], ["id", "vector", "code", "cell", "d"])

    placed = cut(rows.mapInArrow(at_home, f"id {kind}, vector array<double>, code long, cell int, d double"))
    cells = {r[0]: (r[1], r[2]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("d")).collect()}  # a row for each pivot
    reach = np.full(len(centre.value), -np.inf)
    reach[list(cells)] = [r + radius + slack for _, r in cells.values()]

    def as_guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = np.nonzero(_distances(_matrix(batch.column(1)), centre.value) <= reach)
            # two cells that reach each other compare their rows in the one with the smaller number, as do rows of one cell
            own = batch.column(3).to_numpy()[row]
            row, cell, own = row[own >= cell], cell[own >= cell], own[own >= cell]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(own == cell), *[batch.column(i).take(pa.array(row)) for i in range(3)]], ["cell", "same", "id", "vector", "code"])

    visits = cut(placed.mapInArrow(as_guests, f"cell int, same boolean, id {kind}, vector array<double>, code long"))
    n_guests = {r[0]: r[1] for r in visits.groupBy("cell").count().collect()}  # a row for each pivot
    blocks = [(c, -(-m // home), -(-n_guests.get(c, 0) // guests)) for c, (m, _) in cells.items()]
    sizes = F.broadcast(vectors.sparkSession.createDataFrame(blocks, "cell int, homes int, turns int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.col(c), F.lit(1)) - 1))
    block = lambda c: F.pmod(F.xxhash64("id"), F.greatest(F.col(c), F.lit(1))).cast("int")
    hosts = placed.join(sizes, "cell").select("cell", block("homes").alias("h"), every("turns").alias("g"), F.lit(True).alias("host"), F.lit(False).alias("same"), "id", "vector", "code")
    asked = visits.join(sizes, "cell").select("cell", every("homes").alias("h"), block("turns").alias("g"), F.lit(False).alias("host"), "same", "id", "vector", "code")

    def compare(table: pa.Table) -> pa.Table:
        host = table["host"].to_numpy().astype(bool)
        x = _matrix(table["vector"])
        a, b = np.flatnonzero(host), np.flatnonzero(~host)
        i, j = (np.nonzero(_distances(x[a], x[b]) <= radius + slack) if len(a) and len(b) else (np.zeros(0, np.int64),) * 2)
        i, j = a[i], b[j]
        d = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1)) if len(i) else np.zeros(0)
        code = table["code"].to_numpy()
        near = (d <= radius) & (code[i] == code[j])
        ids, same = table["id"].combine_chunks(), table["same"].to_numpy().astype(bool)
        return pa.table({"a": ids.take(pa.array(i[near])), "b": ids.take(pa.array(j[near])), "d": pa.array(d[near]), "same": pa.array(same[j[near]])})

    met = hosts.union(asked).groupBy("cell", "h", "g").applyInArrow(compare, f"a {kind}, b {kind}, d double, same boolean")
    once = met.where(F.when(F.col("same"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return once.select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2"), F.col("d").alias("distance"))


def best_rows(x: np.ndarray, y: np.ndarray, k: int, strip: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x, the places and products (at twelve decimals) of the k rows of y with the largest products, best first, ties to
    the smaller place. A strip of x is multiplied at once, so that only `strip` x len(y) products are held."""
    k = min(k, len(y))
    order, score = np.zeros((len(x), k), np.int64), np.zeros((len(x), k))
    for i in range(0, len(x) if k else 0, strip):
        own = np.round(x[i : i + strip] @ y.T, 12)
        order[i : i + strip] = np.argsort(-own, axis=1, kind="stable")[:, :k]
        score[i : i + strip] = np.take_along_axis(own, order[i : i + strip], axis=1)
    return order, score


def top_pairs(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, id, score, place) of the k rows with the largest cosine to each query, of the query's own group; ties, at twelve
    decimals, to the smaller id. queries: (query_id, group, vector); rows: (id, group, vector), all vectors of one length; vectors
    without a length are in no pair.

    Every query is scored against every row of its group, so the work is their product; both are dealt in blocks, and each pair of
    blocks is a task that multiplies strips of queries and keeps k rows for each query. So a group of any size is many tasks, and only k rows for
    each query and block are shuffled again.
    """
    kind, of = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    known = lambda df: df.where("vector IS NOT NULL AND exists(vector, x -> x <> 0)").withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
    asked, held = known(queries), known(rows)
    count = lambda df, name: df.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = cut(count(asked, "qs").join(count(held, "rs"), "group"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda i, c: F.pmod(F.xxhash64(i), F.col(c)).cast("int")
    left = asked.join(sizes, "group").select("group", part("query_id", "qs").alias("q"), every("rs").alias("r"), F.col("query_id"), F.lit(None).cast(of).alias("id"), "vector")
    right = held.join(sizes, "group").select("group", every("qs").alias("q"), part("id", "rs").alias("r"), F.lit(None).cast(kind).alias("query_id"), "id", "vector")

    def best(table: pa.Table) -> pa.Table:
        is_query = table["query_id"].is_valid().to_numpy().astype(bool)
        x = _matrix(table["vector"])
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        a, b = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        names = table["id"].combine_chunks()
        b = b[pc.sort_indices(names.take(pa.array(b))).to_numpy()] if len(b) else b  # so that a stable sort breaks ties by id
        order, score = best_rows(x[a], x[b], k)
        i = np.repeat(a, order.shape[1])
        return pa.table({"query_id": table["query_id"].combine_chunks().take(pa.array(i)), "id": names.take(pa.array(b[order.ravel()])), "score": pa.array(score.ravel())})

    found = left.union(right).groupBy("group", "q", "r").applyInArrow(best, f"query_id {kind}, id {of}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)
