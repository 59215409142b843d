"""Jaccard similarity join of texts on word n-grams, by chosen paths.

Texts with the same n-gram set are one set. Each of RUNS runs samples a token of every set by a min-wise order, so sets
of similarity s choose the same token with probability s; sets with the same choice are a bucket. A bucket of at most
HELD sets (2 MB of signatures) meets in one task, which splits it on further sampled tokens, twice at each depth, until
at most SMALL sets are left or nearly all have the same token; those are compared by brute force. A larger bucket is dealt
into parts of that size, each with the same few sets of the bucket as pivots. Where three quarters of the bucket turn out
to be connected through the pivots, it is as dense as splitting could make it, and the rest is compared with all of it,
block by block. Other large buckets are split on a further token: all sets on one, and in a quarter of the buckets on a
second one too. So a set has 1 / 0.8 further paths on average, as many as a pair at 0.8 needs to keep one.
Comparisons use signatures of COORDINATES min-wise values and a threshold well below the join's, and give candidate edges,
one for each set of a part at most. Each run, depth and branch splits on a token of its own, drawn for its path.

Expected misses of a pair at 0.8: its signatures agree in fewer than LINK coordinates with a probability of 4.2e-6. Ten
first choices all part it with 0.2**10 = 1e-7. Where all its buckets are split inside tasks, a run keeps it with 0.75 at
least, however deep, and all runs part it with 1e-6. Where buckets of over HELD sets are split, a run keeps it with 0.67
after one split, 0.58 after two and 0.5 after three: ten runs miss 1.4e-5, 2e-4 and 1e-3 of such pairs.

Connected candidates then meet with their whole n-gram sets, in blocks for large groups, where every pair is decided
exactly. Pairs are counted where they are found and never become rows: a set has its number of links and one edge to its
part of the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bloom import bloom, in_bloom
from ._common import pieces, scratch, written
from ._text import mix, randoms, shingles, word_hashes
from .components import connected_components

_U = np.uint64
COORDINATES = 64
RUNS = 10
SMALL = 1024
HELD = 8192
DEPTH = 8
PIVOTS = 16
DENSE = 0.75
LINK = 36
BLOCK_SETS = 1024
BLOCK_GRAMS = 1_000_000
_MULTIPLIERS = randoms(COORDINATES, 71)


def gram_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct word k-gram hashes of each text. A text of 1 to k - 1 words has one gram, of all its words."""
    words, offsets = word_hashes(texts)
    hashes, owner, _ = shingles(words, offsets, k)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[first], owner[first]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for i in np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < k)):
        n = int(offsets[i + 1] - offsets[i])
        out[i] = shingles(words[offsets[i] : offsets[i + 1]], np.array([0, n]), n)[0]
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES min-wise values of each (non-empty) set."""
    flat = np.concatenate(sets) if sets else np.zeros(0, _U)
    begins = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), COORDINATES), "<u4")
    for i, m in enumerate(_MULTIPLIERS):
        out[:, i] = np.minimum.reduceat(((flat ^ m) * m) >> _U(32), begins) if len(sets) else 0
    return out


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that are sorted by the keys, as tables of whole groups with the groups' boundaries."""

    def cuts(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(table.num_rows - 1, 0), bool)
        for k in keys:
            x = table[k].to_numpy()
            new |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        at = cuts(held)
        if len(at) > 1:
            yield held.slice(0, int(at[-1])), at
            held = held.slice(int(at[-1]))
    if held is not None and held.num_rows:
        yield held, np.concatenate([cuts(held), [held.num_rows]])


def _near(sig: np.ndarray, front: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which of `rest` agree with one of `front` at least in LINK coordinates."""
    hit = np.zeros(len(rest), bool)
    left = np.arange(len(rest))
    step = max(1, 2**21 // (COORDINATES * len(rest)))
    for i in range(0, len(front), step):
        same = np.count_nonzero(sig[front[i : i + step], None, :] == sig[None, rest[left], :], axis=2)
        found = (same >= LINK).any(axis=0)
        hit[left[found]] = True
        left = left[~found]
        if not len(left):
            break
    return hit


def connect(sig: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Part of each signature, as the number of one of its members. Those that are `known` are one part.

    A part is found from one member on: what is near it, then what is near those and not in the part yet, so a part of
    near copies costs little more than one comparison for each.
    """
    part = np.arange(len(sig))
    left = np.ones(len(sig), bool)
    starts = [np.flatnonzero(known)] if known is not None and known.any() else []
    for front in (*starts, *np.arange(len(sig))[:, None]):
        front = front[left[front]]
        root = front[:1]
        while len(front):
            left[front] = False
            part[front] = root
            rest = np.flatnonzero(left)
            if not len(rest):
                return part
            front = rest[_near(sig, front, rest)]
    return part


def _split(sig: np.ndarray, rows: np.ndarray, random: np.random.Generator, free: np.ndarray) -> Iterator[np.ndarray]:
    """Small or dense groups of rows, by chosen paths of two branches; free: coordinates that no split has used yet."""
    if len(rows) > SMALL and len(free) > 1:
        free = random.permutation(free)
        for branch in range(2):
            value = sig[rows, free[branch]]
            order = np.argsort(value, kind="stable")
            groups = np.split(rows[order], np.flatnonzero(np.diff(value[order])) + 1)
            if max(map(len, groups)) > DENSE * len(rows):
                break
            for group in groups:
                if len(group) > 1:
                    yield from _split(sig, group, random, np.delete(free, branch))
        else:
            return
    yield rows


def _fixed(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _forest(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The smallest member of the component of each of n rows, from edges (a, b) of arrays."""
    up = np.arange(n)
    if not parts:
        return up
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    while True:
        low = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], low)
        np.minimum.at(new, up[b], low)
        new = new[new]
        if (new == up).all():
            return up
        up = new


def _compare(labels: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Connected parts of each group (path, x, y): each set with the smallest guest of its part, or else the smallest set
    (root). With `labels`, every set once with its guest (label; null if none) and signature. Sets marked `main` are
    known to be connected: of those in a part, one tells of it."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in runs_of(batches, ["path", "x", "y"]):
            path, x, y, ids, guest, main = (table[c].to_numpy() for c in ("path", "x", "y", "set_id", "guest", "main"))
            sig = _fixed(table["sig"], "<u4", COORDINATES)
            size = np.diff(at)
            two = at[:-1][size == 2]
            near = two[(sig[two] == sig[two + 1]).sum(axis=1) >= LINK]
            links = [(near, near + 1)]
            for begin, end in zip(at[:-1][size > 2].tolist(), at[1:][size > 2].tolist(), strict=True):
                rows = np.arange(begin, end)
                known = main[rows]
                if known.any() or guest[rows].any():
                    groups: Iterator[np.ndarray] | list[np.ndarray] = [rows]
                else:
                    groups = _split(sig, rows, np.random.default_rng(int(path[begin]) & (2**63 - 1)), np.arange(RUNS, COORDINATES))
                for group in groups:
                    part = group[connect(sig[group], main[group])]
                    apart = part != group
                    links.append((part[apart], group[apart]))
            up = _forest(links, len(ids))
            smallest, least_guest = (np.full(len(ids), np.iinfo(np.int64).max) for _ in range(2))
            np.minimum.at(smallest, up, ids)
            np.minimum.at(least_guest, up[guest], ids[guest])
            linked = (least_guest != np.iinfo(np.int64).max)[up]
            root = np.where(linked, least_guest[up], smallest[up])
            known = np.flatnonzero(main)
            told = np.ones(len(ids), bool)
            told[np.setdiff1d(known, known[np.unique(up[known], return_index=True)[1]])] = False
            edge = (root != ids) & told
            if not labels:
                yield pa.RecordBatch.from_arrays([pa.array(root[edge]), pa.array(ids[edge])], ["root", "set_id"])
                continue
            rows = np.flatnonzero(~guest | ((x == 0) & (y == 0)))
            keep = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(path[rows]), pa.array(ids[rows]), pa.array(root[rows]), pa.array(root[rows], mask=~linked[rows]), table["n"].take(keep).combine_chunks(), table["sig"].take(keep).combine_chunks()],
                ["path", "set_id", "root", "label", "n", "sig"],
            )

    return compare


def _compared(rows: DataFrame, labels: bool = False) -> DataFrame:
    """_compare over rows (path, n, x, y, guest, main, set_id, sig), written."""
    rows = rows.select("path", "n", "x", "y", "guest", "main", "set_id", "sig").repartition("path", "x", "y").sortWithinPartitions("path", "x", "y")
    return written(rows.mapInArrow(_compare(labels), "path long, set_id long, root long, label long, n long, sig binary" if labels else "root long, set_id long"))


def _coordinate(i: int):
    return F.substring("sig", 4 * i + 1, 4)


def _drawn(branch: int):
    """The signature's value at a coordinate that is drawn for the path and branch, another one for each branch. Those of
    the runs' first choices aren't drawn: all sets of a path have one of them in common."""
    left = COORDINATES - RUNS
    at = F.pmod(F.pmod(F.xxhash64("path", F.lit("coordinate")), F.lit(left)) + F.lit(branch * (left // 2)), F.lit(left)) + F.lit(RUNS)
    return F.substring("sig", (at * 4 + 1).cast("int"), F.lit(4))


def _further():
    """The next paths of a set: one, and a second one for all sets of every fourth path."""
    first, second = (F.xxhash64("path", F.lit(j), _drawn(j)) for j in range(2))
    return F.when(F.pmod(F.xxhash64("path", F.lit("branches")), F.lit(4)) == 0, F.array(first, second)).otherwise(F.array(first))


def _part(n, size: int):
    """Of how many parts, and which one of them a set is in."""
    parts = F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")
    return parts, F.pmod(F.xxhash64("set_id", F.lit("part")), parts).cast("int")


def _against(guests: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (path, n, x, y, guest, ...) that bring every guest of a path to every member, in blocks: guests
    (path, n, n_guests, main, set_id, sig), members alike."""
    by_member, member_part = _part(F.col("n"), HELD // 2)
    by_guest, guest_part = _part(F.col("n_guests"), HELD // 2)
    g = guests.withColumn("x", guest_part).withColumn("y", F.explode(F.sequence(F.lit(0), by_member - 1))).withColumn("guest", F.lit(True))
    m = members.withColumn("y", member_part).withColumn("x", F.explode(F.sequence(F.lit(0), by_guest - 1))).withColumn("guest", F.lit(False))
    columns = ["path", "n", "x", "y", "guest", "main", "set_id", "sig"]
    return g.select(*columns).union(m.select(*columns))


def first_paths():
    """The first path of each run."""
    return F.array(*[F.xxhash64(F.lit(r), _coordinate(r)) for r in range(RUNS)])


def candidate_edges(firsts: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between sets (set_id, paths) that connect all pairs whose signatures agree in LINK coordinates, as far
    as a run brings them together. sets: (set_id, sig), with those of `firsts` among them."""
    state = firsts.select("set_id", F.explode("paths").alias("path"))
    zero, no = F.lit(0), F.lit(False)
    edges = []
    for depth in range(DEPTH + 1):
        counts = written(state.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        # counts are of all non-trivial buckets and grow with the sets: a merge join at any size
        members = state.join(counts.hint("merge"), "path")
        if depth == 0:  # later on, the few sets of large buckets have their signatures with them
            members = members.join(sets.hint("merge"), "set_id")
        members = members.select("path", "set_id", "n", "sig")
        more = not counts.where(F.col("n") > HELD).isEmpty()
        if more:
            members = written(members)
        alone = members.select("*", zero.alias("x"), zero.alias("y"), no.alias("guest"), no.alias("main"))
        edges.append(_compared(alone.where(F.col("n") <= HELD)))
        if not more:
            break
        large = members.where(F.col("n") > HELD)
        if depth == DEPTH:  # exact way for what no token splits
            everyone = written(large.withColumn("n_guests", F.col("n")).withColumn("main", no))
            edges.append(_compared(_against(everyone, everyone)))
            break
        parts, part = _part(F.col("n"), HELD // 2)
        pivot = F.pmod(F.xxhash64("set_id", "path"), F.col("n")) < PIVOTS
        dealt = large.withColumn("guest", pivot).withColumn("x", F.explode(F.when(pivot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(part)))).withColumn("y", zero).withColumn("main", no)
        found = _compared(dealt, labels=True)
        edges.append(found)
        sizes = found.groupBy("path", "label").agg(F.count(F.lit(1)).alias("size"))
        main = sizes.groupBy("path").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.col("size"))).alias("main"), F.max(F.when(F.col("label").isNotNull(), F.col("size"))).alias("held"))
        judged = written(found.join(main, "path").select("path", "set_id", "n", "sig", F.coalesce(F.col("label") == F.col("main"), F.lit(False)).alias("inside"), (F.coalesce("held", F.lit(0)) >= DENSE * F.col("n")).alias("dense"), (F.col("n") - F.col("held")).alias("n_guests")))
        rest = judged.where("dense AND n_guests > 0").withColumn("main", F.col("inside"))
        edges.append(_compared(_against(rest.where("NOT inside"), rest)))
        state = written(judged.where("NOT dense").select("set_id", "sig", F.explode(_further()).alias("path")))
        if state.isEmpty():
            break
    out = None
    for more in edges:
        pairs = more.where("root <> set_id").select(F.col("root").alias("a"), F.col("set_id").alias("b"))
        out = pairs if out is None else out.union(pairs)
    return out.distinct()


def _in_blocks(rows: DataFrame, blocks) -> DataFrame:
    """Each row once for every pair (x, y), x <= y, of blocks of its group that has the row's block (column `own`)."""
    rows = rows.withColumn("blocks", blocks.cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set_id", F.lit("block")), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets; the diagonal has no meaning.

    Tokens of one set count for nothing, those of a few sets are counted for each pair, and the others by products of
    0/1 matrices.
    """
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    held = np.diff(np.append(begin, len(flat)))
    out = np.zeros((n, n), np.float32)
    few = min(16, n // 4)
    for c in range(2, few + 1):
        own = owner[begin[held == c][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(i):
                np.add.at(out, (own[:, i], own[:, j]), 1)
    out += out.T
    many = held > max(few, 1)
    token = np.repeat(np.where(many, np.cumsum(many) - 1, -1), held)
    owner, token = owner[token >= 0], token[token >= 0]
    for first in range(0, int(many.sum()), 2048):
        a, b = np.searchsorted(token, [first, first + 2048])
        has = np.zeros((n, min(2048, int(many.sum()) - first)), np.float32)
        has[owner[a:b], token[a:b] - first] = 1
        out += has @ has.T
    return out


def _decide(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact links inside each group: (set_id, links, root, alone), for sets with links."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in runs_of(batches, ["label", "x", "y"]):
            ids, own, x, y, blocks = (table[c].to_numpy() for c in ("set_id", "own", "x", "y", "blocks"))
            grams = [np.frombuffer(g, "<u4") for g in table["grams"].to_pylist()]
            found: list[tuple] = []
            for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                sets = grams[begin:end]
                size = np.array([len(s) for s in sets], np.float32)
                if len(sets) == 2:
                    common = len(np.intersect1d(*sets, assume_unique=True))
                    both = np.array([[size[0], common], [common, size[1]]], np.float32)
                else:
                    both = _overlaps(sets)
                like = both >= (size[:, None] + size[None, :]) * np.float64(least / (1 + least)) - 1e-6
                np.fill_diagonal(like, False)
                if x[begin] != y[begin]:  # pairs inside a block are decided in the block's own group
                    like &= own[begin:end, None] != own[None, begin:end]
                links = like.sum(axis=1)
                if links.any():
                    root = _forest([np.nonzero(like)], len(sets)) if len(sets) < 64 else _roots(like)
                    some = np.flatnonzero(links)
                    found.append((ids[begin + some], links[some], ids[begin + root[some]], np.full(len(some), blocks[begin] == 1)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["set_id", "links", "root", "alone"])

    return decide


def _roots(like: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component of a symmetric 0/1 matrix."""
    root, left = np.arange(len(like)), np.ones(len(like), bool)
    for i in range(len(like)):
        front = np.array([i])
        while len(front) and left[front].any():
            left[front] = False
            root[front] = i
            front = np.flatnonzero(like[front].any(axis=0) & left)
    return root


def jaccard_join(docs: DataFrame, k: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near duplicates of each text: (id, class_id, n_links, n_copies).

    Texts are linked if the Jaccard similarity of their word k-gram sets is at least `least`. class_id: the smallest id
    of the row's connected component; n_links: other sets that the row's set is linked to; n_copies: rows with the same
    set, itself included. A text of fewer than k words has one gram of all its words. One row for each input row; null,
    empty and wordless texts have no set: they are classes of their own, with n_links 0 and n_copies 1 and their own id.
    Rows that repeat an id and text are copies of each other. Null ids are allowed; the class of rows without an id has a
    null class_id.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block, texts in pieces(batch, 1):
                sets = gram_sets(texts, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full])
                rows: list[list] = [[None] * len(texts) for _ in range(4)]
                for j, i in enumerate(full):
                    s = sets[i]
                    rows[0][i] = int(mix(s + _U(3)).sum(dtype=_U).view(np.int64))
                    rows[1][i] = int((mix(s * _U(5)) ^ _U(len(s))).sum(dtype=_U).view(np.int64))
                    rows[2][i] = sig[j].tobytes()
                    rows[3][i] = (s >> _U(32)).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number, number + len(texts))), block.column(0), *(pa.array(x, pa.int64()) for x in rows[:2]), *(pa.array(x, pa.binary()) for x in rows[2:])],
                    ["row", id_col, "digest", "digest2", "sig", "grams"],
                )
                number += len(texts)

    with scratch(docs.sparkSession):
        texts = written(docs.select(id_col, text_col).mapInArrow(prepare, f"row long, `{id_col}` {kind}, digest long, digest2 long, sig binary, grams binary"))
        one = F.struct("row", (F.octet_length("grams") / 4).cast("long").alias("size"), first_paths().alias("paths"))
        copies = texts.where("sig IS NOT NULL").groupBy("digest", "digest2").agg(F.min(one).alias("one"), F.count(F.lit(1)).alias("n_copies"))
        classes = written(copies.select("digest", "digest2", "n_copies", F.col("one.row").alias("set_id"), "one.size", "one.paths"))
        labels = connected_components(candidate_edges(classes.select("set_id", "paths"), texts.select(F.col("row").alias("set_id"), "sig")))
        filters = docs.sparkSession.sparkContext.broadcast(bloom(labels.select(F.col("node").alias("gram"))))  # at most 2**30 bits
        sized = labels.withColumnRenamed("node", "set_id").join(classes.select("set_id", "size"), "set_id")
        totals = sized.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_grams"))
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("n_grams") / BLOCK_GRAMS))
        placed = _in_blocks(sized.join(totals, "label"), blocks).select("label", "x", "y", "own", "blocks", "set_id")

        def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = in_bloom(batch.column(0).to_numpy().view(_U), *filters.value)
                yield batch.take(pa.array(at))

        # grams move twice, to their sets' places and to the groups; the places grow with the sets: a merge join at any size
        some = texts.select(F.col("row").alias("set_id"), "grams").mapInArrow(only, "set_id long, grams binary")
        grouped = some.join(placed.hint("merge"), "set_id")
        decided = written(grouped.repartition("label", "x", "y").sortWithinPartitions("label", "x", "y").mapInArrow(_decide(least), "set_id long, links long, root long, alone boolean"))
        links = decided.groupBy("set_id").agg(F.sum("links").alias("n_links"))
        apart = decided.where("NOT alone AND root <> set_id").select(F.col("set_id").alias("a"), F.col("root").alias("b"))
        roots = decided.where("alone").select("set_id", "root").union(connected_components(apart).select(F.col("node").alias("set_id"), F.col("label").alias("root")))
        of_sets = classes.drop("paths").join(links, "set_id", "left").join(roots, "set_id", "left")
        of_sets = of_sets.select("digest", "digest2", "n_copies", F.coalesce("root", "set_id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        rows = texts.select("row", id_col, "digest", "digest2").join(of_sets, ["digest", "digest2"], "left")
        rows = written(rows.select(id_col, F.coalesce("root", "row").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")), keep=True)
    smallest = rows.groupBy("root").agg(F.min(id_col).alias("class_id"))
    return rows.join(smallest, "root").select(id_col, "class_id", "n_links", "n_copies")
