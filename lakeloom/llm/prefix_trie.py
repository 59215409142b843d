"""The trie of conversations' prefixes, and sums over its subtrees by centroid decomposition.

A node is the set of conversations with the same first d turns. Its key is d with two 64-bit values, each the exclusive or of a hash
of (place, turn) over the d turns: a running value of which partitions can be put together, so no conversation has to be in
one task, whatever its length. Turns enter by SHA-256 digests; texts are never shuffled.

Sums: removing a component's centroid splits the component into the subtrees of the centroid's children and what stays above.
Of a node v, weight(v) is the number of turns that its members have from v on: a sum over v's subtree that needs no rollup. The
centroid is the deepest node with more than half of its component's weight; so no piece has more than half of it, and a few tens of rounds
do, however deep or wide the trie is. A round adds up the values at and under each centroid (component totals), and adds the
total to each node on the path from the centroid to its component's top, whose weight is reduced alike; the path's nodes are the
prefixes of any conversation through the centroid, so they are found by one join. Components of at most `local`
nodes are summed inside tasks, from the deepest node up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import numbered, written

#: Tables of at most so many rows are broadcast; each is counted before.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def turn_table(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, idx, digest, n_bytes) of each turn: idx from 0 in the order of turn, null first, ties by the digest of role and text.

    A null role or text is empty; rows without a conversation id belong to none and are left out; equal rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))
    turns = written(conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")))
    placed = numbered(turns, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")], "at")
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("idx"), "digest", "n_bytes")


def prefix_keys(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, n_bytes, size) of each prefix of each conversation, the empty one (depth 0) included.

    turns: (conv_id, idx, digest, n_bytes), idx from 0 without gaps; conversations: (conv_id, size) with the number of turns.
    """
    hashes = [F.xxhash64(F.lit(k), "digest", "idx") for k in (1, 2)]
    ordered = written(turns.select("conv_id", "idx", "n_bytes", *[h.alias(f"h{k}") for k, h in enumerate(hashes)]).repartitionByRange("conv_id", "idx").withColumn("part", F.spark_partition_id()))
    # what earlier partitions hold of a conversation: for those alone that lie in several, so at most two rows for each partition
    pieces = ordered.groupBy("conv_id", "part").agg(F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"))
    split = ordered.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("conv_id")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.join(split, "conv_id").select("conv_id", "part", *[F.coalesce(F.bit_xor(h).over(earlier), F.lit(0)).alias(f"b_{h}") for h in ("h0", "h1")])
    inside = Window.partitionBy("conv_id", "part").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    keyed = ordered.select("*", *[F.bit_xor(h).over(inside).alias(f"k_{h}") for h in ("h0", "h1")]).join(F.broadcast(before), ["conv_id", "part"], "left")
    k = [F.col(f"k_{h}").bitwiseXOR(F.coalesce(F.col(f"b_{h}"), F.lit(0))) for h in ("h0", "h1")]

    def node(depth: Column, a: Column, b: Column) -> Column:
        return F.struct(depth.cast("long").alias("d"), a.alias("a"), b.alias("b"))

    depth = F.col("idx") + 1
    rows = keyed.select("conv_id", depth.alias("depth"), node(depth, *k).alias("node"), node(F.col("idx"), k[0].bitwiseXOR(F.col("h0")), k[1].bitwiseXOR(F.col("h1"))).alias("parent"), "n_bytes")
    zero = F.lit(0).cast("long")
    roots = conversations.select("conv_id", zero.alias("depth"), node(zero, zero, zero).alias("node"), F.lit(None).cast("struct<d:bigint,a:bigint,b:bigint>").alias("parent"), zero.alias("n_bytes"))
    return rows.unionByName(roots).join(conversations.select("conv_id", "size"), "conv_id")


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """(node, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_bytes, weight) of each node: conv_id is the smallest member."""
    nodes = written(
        prefixes.groupBy("node").agg(
            F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.any_value("n_bytes").alias("n_bytes"), F.sum(F.col("size") - F.col("depth") + 1).alias("weight")
        )
    )
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return counted.join(above, "parent", "left")


def _sum_up(rows: DataFrame, values: list[str]) -> DataFrame:
    """Totals of each node's subtree inside its component, for components that a task holds. rows: node, parent, comp,
    values and what earlier rounds have added (`more_` with the value's name)."""
    names = rows.columns
    sums = [f"sum_{v}" for v in values]

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, below = None, {}
        for batch in batches:
            own = zip(*[batch.column(names.index(v)).to_pylist() for v in values], strict=True)
            totals = []
            for c, node, parent, value in zip(*[batch.column(names.index(x)).to_pylist() for x in ("comp", "node", "parent")], own, strict=True):
                if c != comp:
                    comp, below = c, {}
                total = tuple(map(int.__add__, value, below.pop(tuple(node.values()), (0,) * len(values))))
                totals.append(total)
                if parent is not None:
                    key = tuple(parent.values())
                    below[key] = tuple(map(int.__add__, total, below.get(key, (0,) * len(values))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([t[i] for t in totals], pa.int64()) for i in range(len(values))]], [*names, *sums])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"{s} bigint" for s in sums])
    summed = rows.repartition("comp").sortWithinPartitions("comp", F.col("depth").desc()).mapInArrow(up, schema)
    return summed.select("node", *[(F.col(f"sum_{v}") + F.col(f"more_{v}")).alias(v) for v in values])


def subtree_sums(nodes: DataFrame, prefixes: DataFrame, values: dict[str, Column], local: int = 1000) -> DataFrame:
    """(node, the columns of values): sums over each node's subtree, the node included, by centroid decomposition.

    nodes: as `trie_nodes`; prefixes: (conv_id, depth, node, parent) of all prefixes; values: whole numbers of each node.
    """
    names, more = list(values), [f"more_{v}" for v in values]
    state = ["node", "parent", "depth", "conv_id", "comp", "top", "weight", *names, *more]
    zero = F.lit(0).cast("long")
    top = F.struct(*[zero.alias(x) for x in "dab"])
    live = written(nodes.select("node", "parent", "depth", "conv_id", top.alias("comp"), zero.alias("top"), "weight", *[c.cast("long").alias(v) for v, c in values.items()], *[zero.alias(m) for m in more]))
    paths = prefixes.select(F.col("conv_id").alias("p_conv"), F.col("depth").alias("p_depth"), F.col("node").alias("p_node"), F.col("parent").alias("p_parent"))
    done = []
    while True:
        large = written(live.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("total")).where(F.col("n") > local).select("comp", "total"))
        n_large = large.count()
        side = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
        done.append(_sum_up((live.join(side, "comp", "left_anti") if n_large else live).select(*state), names))
        if not n_large:
            return reduce(DataFrame.unionByName, done)
        heavy = live.join(side, "comp").where(2 * F.col("weight") > F.col("total"))
        found = heavy.groupBy("comp").agg(F.max_by(F.struct("node", "depth", "conv_id", "weight", "top"), "depth").alias("c"))
        centroid = written(found.select("comp", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("node", "depth", "conv_id", "weight", "top")]))
        inside = live.join(_small(centroid), "comp")
        # a node under the centroid belongs to the piece of its ancestor one step under the centroid
        lower, upper = inside.where("depth > c_depth"), inside.where("depth <= c_depth")
        piece = lower.join(paths, (F.col("conv_id") == F.col("p_conv")) & (F.col("c_depth") + 1 == F.col("p_depth")))
        under = F.col("p_parent") == F.col("c_node")
        split = written(
            piece.select(*state, *centroid.drop("comp").columns, under.alias("under"), F.col("p_node").alias("piece")).unionByName(upper.select(*state, *centroid.drop("comp").columns, (F.col("node") == F.col("c_node")).alias("under"), F.col("comp").alias("piece")))
        )
        totals = written(split.where("under").groupBy("comp").agg(F.any_value("c_node").alias("node"), *[F.sum(v).alias(f"t_{v}") for v in names]))
        t_names = [f"t_{v}" for v in names]
        path = centroid.join(totals.select("comp", *t_names), "comp").join(paths, (F.col("c_conv_id") == F.col("p_conv")) & (F.col("p_depth") >= F.col("c_top")) & (F.col("p_depth") < F.col("c_depth")))
        added = path.select(F.col("p_node").alias("node"), F.col("c_weight").alias("t_weight"), *t_names)
        at_centroid = F.col("node") == F.col("c_node")
        done.append(written(split.where(at_centroid).select("comp", *more).join(totals, "comp").select("node", *[(F.col(f"t_{v}") + F.col(f"more_{v}")).alias(v) for v in names])))
        above = split.where(~F.col("under")).select(*state).join(added, "node", "left")
        less = above.select("node", "parent", "depth", "conv_id", "comp", "top", (F.col("weight") - F.coalesce("t_weight", zero)).alias("weight"), *names, *[(F.col(m) + F.coalesce(t, zero)).alias(m) for m, t in zip(more, t_names, strict=True)])
        below = split.where(F.col("under") & ~at_centroid).select("node", "parent", "depth", "conv_id", F.col("piece").alias("comp"), (F.col("c_depth") + 1).alias("top"), "weight", *names, *more)
        live = written(less.unionByName(below))


def prefix_trie(turns: DataFrame, conversations: DataFrame, local: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The trie of conversations, and where each ends.

    turns: (conv_id, idx, digest, n_bytes); conversations: (conv_id, size), also those without a turn. First table: a row for
    each node with conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves (nodes
    without children in its subtree) and saved_bytes (over its subtree, what its members after the first repeat in last turns).
    Second: (node, conv_id), the node of each whole conversation. Without conversations both are empty.
    """
    prefixes = written(prefix_keys(turns, conversations))
    nodes = written(trie_nodes(prefixes))
    values = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_bytes": (F.col("n_convs") - 1) * F.col("n_bytes")}
    sums = subtree_sums(nodes, prefixes, values, local)
    return nodes.join(sums, "node").select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes"), prefixes.where("depth = size").select("node", "conv_id")


def rebuilt(turns: DataFrame, width: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes of rebuilt conversations: the first h turns of conversation c - c % width (all if fewer, none if it
    isn't there), then c's own turns after its first h; h = crc32(c as text) % most."""
    known = written(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    plan = known.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % width).alias("source"))
    sizes = known.select(F.col("conv_id").alias("source"), F.col("n").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    plan = written(plan.join(sizes, "source", "left").select("conv_id", "source", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    own = turns.join(plan, "conv_id").where(F.col("idx") >= F.col("h")).select("conv_id", (F.col("idx") - F.col("h") + F.col("taken")).alias("idx"), "digest", "n_bytes")
    first = turns.where(F.col("idx") < most).withColumnRenamed("conv_id", "source")
    lent = plan.join(first, "source").where(F.col("idx") < F.col("taken")).select("conv_id", "idx", "digest", "n_bytes")
    return own.unionByName(lent), plan.select("conv_id", "size")


def list_digests(members: DataFrame, by: str, item: str, as_name: str) -> DataFrame:
    """(by, as_name): SHA-256 of each group's items as text, ascending by number, joined by commas.

    Items are sorted by ranges, so that a large group lies in many tasks, which join its parts; then a group's
    parts, one for each range, stream through one digest, since SHA-256 is a chain. No task holds a whole group.
    """
    ordered = written(members.select(by, item).repartitionByRange(by, item).withColumn("_part", F.spark_partition_id()))
    parts = ordered.groupBy(by, "_part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.cast("string")), ",").alias("_ids"))
    kind = parts.schema[by].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = chain = None
        for batch in batches:
            names, out = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chain is not None and key == last:
                    chain.update(b"," + ids.encode())
                    continue
                if chain is not None:
                    names.append(last)
                    out.append(chain.hexdigest())
                last, chain = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.column(0).type), pa.array(out, pa.string())], [by, as_name])
        if chain is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], batch.column(0).type), pa.array([chain.hexdigest()])], [by, as_name])

    return parts.repartition(by).sortWithinPartitions(by, "_part").select(by, "_ids").mapInArrow(digest, f"{by} {kind}, {as_name} string")


def conversation_trie(conversations: DataFrame, local: int = 1000) -> DataFrame:
    """The trie of the rebuilt conversations (`rebuilt`), with saved_tokens (UTF-8 bytes) and ends_sha256 of each node: a row for each
    node. An empty table gives no row."""
    turns = written(turn_table(conversations))
    trie, ends = prefix_trie(*rebuilt(turns), local=local)
    digests = list_digests(ends, "node", "conv_id", "ends_sha256")
    return trie.join(digests, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
