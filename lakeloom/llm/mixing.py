"""Mixing sources to target weights by balanced sampling with the cube method.

A source of `source_size` words with the target t takes every document floor(t / source_size) times, and once more with
the remaining probability. Those inclusion probabilities move inside the unit cube along the null space of two
constraints, the number of documents and of words taken, until a document is in or out: with three fractional documents
or more, some direction changes neither total. Blocks of a source's documents are run apart and leave their two
smallest at most; these form the blocks of the next round. The two that a source's last block leaves are the landing
problem: the document count is given up first, then a last document is drawn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

BLOCK = 1000
_NEAR = 1e-9
WORD = r"[^\x20\x09-\x0D]++"


def word_count(text):
    """Longest runs of other characters than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _direction(sizes: np.ndarray) -> np.ndarray | None:
    """The move nearest to "one document alone" that changes neither the number of documents nor their words: of the
    first document, or of the next if all such moves leave it where it is. None if there is no such move."""
    n, scaled = len(sizes), sizes / max(sizes.mean(), 1e-300)
    centred = scaled - scaled.mean()
    spread = float(centred @ centred)
    for i in range(n):
        u = np.full(n, -1.0 / n)
        u[i] += 1.0
        if spread > 1e-12 * n:
            u -= centred * (centred[i] / spread)
        u[np.abs(u) < 1e-12] = 0.0
        if np.abs(u).max() > 1e-9:
            return u
    return None


def fly(sizes: np.ndarray, pi: np.ndarray, random: np.random.Generator, land: bool) -> np.ndarray:
    """Probabilities after the flight, with the documents given largest first; with `land`, all of them are 0 or 1.

    Each move settles the largest fractional document if it can, and spreads what that changes over all others, so the
    documents left for the landing are the smallest ones.
    """
    pi, sizes = np.array(pi, float), np.asarray(sizes, float)
    active = np.flatnonzero((pi > 0) & (pi < 1))
    while len(active):
        own = sizes[active]
        u = _direction(own) if len(active) > 1 else None
        if u is None:
            if not land:
                break
            if len(active) == 2 and own.all():
                u = np.array([1.0, -own[0] / own[1]])
            else:
                u = np.zeros(len(active))
                u[0] = 1.0
        p = pi[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
            down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
        moved = p + u * (up if random.random() * (up + down) < down else -down)
        moved[moved < _NEAR] = 0.0
        moved[moved > 1 - _NEAR] = 1.0
        pi[active] = moved
        active = active[(moved > 0) & (moved < 1)]
    return pi


def source_targets(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of each source: (src, source, source_size, n_docs, target), from rows (source, size).

    Sources in the order of code points, null last, take the weights in turn. The targets add up to `share` of all
    sizes, in proportion to the weights, but none is above `most` times its source's size: what is above is shared
    again by weight. So each is min(most * size, level * weight); the level rises until no source is above. Sources
    are ranked by a range sort and counts of its partitions, so their number isn't bounded by one task or the driver.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ordered = written(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()))
    before, total = [], 0
    for part, n in sorted(tuple(r) for r in ordered.groupBy(F.shiftright("id", 33)).count().collect()):  # a row for each partition
        before.append((part, total - (part << 33)))
        total += n
    places = F.broadcast(docs.sparkSession.createDataFrame(before, "part long, base long"))
    ranked = ordered.join(places, F.shiftright("id", 33) == F.col("part")).withColumn("src", F.col("id") + F.col("base"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    ranked = ranked.select("src", "source", "source_size", "n_docs", weight.alias("weight"))
    cap = F.col("source_size") * F.lit(float(most))
    whole = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        above = cap < F.col("weight") * level
        capped, free = ranked.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        higher = (whole - (capped or 0.0)) / free if free else level
        if higher <= level:
            break
        level = higher
    return ranked.select("src", "source", "source_size", "n_docs", F.least(cap, F.col("weight") * level).alias("target"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows (.., mark, row) with `copy`, the number of the row among those of its mark, 0 for a mark of its own.

    Rows of a mark are numbered inside each partition of `row`, after all of the partitions before, so a mark of many rows
    is in many tasks.
    """
    counts = written(rows.groupBy("mark", F.shiftright("row", 33).alias("part")).count())
    repeated = written(counts.groupBy("mark").agg(F.sum("count").alias("all")).where("all > 1").select("mark"))
    if repeated.isEmpty():
        return rows.drop("row").withColumn("copy", F.lit(0).cast("long"))
    before = Window.partitionBy("mark").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.join(repeated, "mark").select("mark", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("mark", "part").orderBy("row")
    some = rows.select("mark", "row", F.shiftright("row", 33).alias("part")).join(repeated, "mark", "left_semi")
    copies = some.withColumn("at", F.row_number().over(inside) - 1).join(bases, ["mark", "part"]).select("row", (F.col("at") + F.col("base")).alias("copy"))
    return rows.join(copies, "row", "left").drop("row").withColumn("copy", F.coalesce("copy", F.lit(0)).cast("long"))


def _flight(names: list[str], seed: int, turn: int):
    """The flight over one block, as a function of its table."""

    def run(table: pa.Table) -> pa.Table:
        src, block, last = (table[c][0].as_py() for c in ("src", "block", "last"))
        size = table["size"].to_numpy()
        order = np.lexsort((table["copy"].to_numpy(), table["mark"].to_numpy(), -size))
        random = np.random.default_rng([seed, turn, src, block])
        pi = table["pi"].to_numpy()
        out = np.empty(len(size))
        out[order] = fly(size[order], pi[order], random, last)
        return table.select(names).set_column(names.index("pi"), "pi", pa.array(out))

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, keep: tuple[str, ...] = ("doc_id",), source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How often the mix takes each document: (columns of `keep`, size, source_size, target, times, taken).

    size: words of the text (0 for null); taken = times * size. One row for each input row; repeated rows are drawn
    apart. Draws depend on the seed, the source's rank and the sizes, ids and texts in a block alone, so reruns agree however
    the input is partitioned. A document without words is taken 0 times; sources without words have the target 0.
    Blocks are dealt by a hash of the first column of `keep`, the text and, where rows repeat both, the number of the copy;
    so neither null nor repeated ids gather in a block.
    """
    mark = F.xxhash64(keep[0], F.col(text_col), F.col(source_col))
    rows = written(docs.select(*keep, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), mark.alias("mark"), F.monotonically_increasing_id().alias("row")))
    rows = _marked(rows)
    targets = written(source_targets(rows, weights, share, most))
    joined = rows.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(*[F.col(f"d.{c}") for c in keep], "mark", "copy", "size", "src", "source_size", "n_docs", "target")
    rate = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    state = written(joined.withColumn("base", F.floor(rate).cast("int")).withColumn("pi", rate - F.floor(rate)).withColumn("left_over", F.col("n_docs")))
    decided = [state.where("pi = 0")]
    left = state.where("pi > 0")
    names = [c for c in state.columns if c not in ("n_docs", "left_over")]
    left = left.drop("n_docs")
    schema = left.drop("left_over").schema
    turn = 0
    while True:
        n_blocks = F.ceil(F.col("left_over") / BLOCK)
        blocked = left.withColumn("last", n_blocks <= 1).withColumn("block", F.pmod(F.xxhash64("mark", "copy", F.lit(seed + turn)), F.greatest(n_blocks, F.lit(1)))).drop("left_over")

        flown = written(blocked.groupBy("src", "block").applyInArrow(_flight(names, seed, turn), schema))
        decided.append(flown.where("pi IN (0, 1)").select(*names))
        rest = flown.where("pi > 0 AND pi < 1")
        counts = rest.groupBy("src").agg(F.count(F.lit(1)).alias("left_over"))
        turn += 1
        if rest.isEmpty():
            break
        left = written(rest.join(counts, "src").select(*names, "left_over"))
    out = decided[0].select(*names)
    for more in decided[1:]:
        out = out.union(more)
    times = (F.col("base") + F.col("pi").cast("int")).cast("int")
    return out.select(*keep, "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))
