"""Feature engineering."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, name, number, value
from ..functions.quantiles import exact_quantiles
from ..functions.ranks import dense_ids


def scale(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """Standard (population deviation), minmax or robust (median, interquartile range) scaling in place; a column
    without spread is divided by 1, nulls stay."""
    quarters = exact_quantiles(df, columns, [0.25, 0.5, 0.75]) if method == "robust" else {}
    if quarters:
        one = {c: (F.lit(None).cast("double"), F.lit(None).cast("double")) if m is None else (F.lit(m), F.lit(b - a)) for c, (a, m, b) in quarters.items()}
        scaled = lambda c: ((number(df, c) - one[c][0]) / F.coalesce(F.nullif(one[c][1], F.lit(0.0)), F.lit(1.0))).alias(c)
        return df.select(*[scaled(c) if c in one else name(c) for c in df.columns])
    parts = {
        "standard": lambda x: (F.avg(x), F.stddev_pop(x)),
        "minmax": lambda x: (F.min(x), F.max(x) - F.min(x)),
        "robust": lambda x: (F.avg(x), F.stddev_pop(x)),  # of no columns
    }[method]
    stats = df.agg(*[e.alias(f"{k}{i}") for i, c in enumerate(columns) for k, e in zip(("mid", "spread"), parts(number(df, c)), strict=True)])
    at = {c: i for i, c in enumerate(columns)}
    one = lambda c: ((number(df, c) - F.col(f"mid{at[c]}")) / F.coalesce(F.nullif(F.col(f"spread{at[c]}"), F.lit(0.0)), F.lit(1.0))).alias(c)
    return df.crossJoin(F.broadcast(stats)).select(*[one(c) if c in at else name(c) for c in df.columns])  # one row of statistics


def one_hot(df: DataFrame, columns: list[str], drop_original: bool = True, most: int = 1000) -> DataFrame:
    """A 0/1 column `column_value` for each value in order; null is a category of its own, `column_nan`. A column of
    over `most` values raises: its values would be too many columns."""
    added = []
    for c in columns:
        found = df.select(name(c).cast("string").alias("v")).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{c} has over {most} values")
        values = sorted(r.v for r in found if r.v is not None)
        added += [F.when(name(c).cast("string") == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for v in values]
        added += [name(c).isNull().cast("double").alias(f"{c}_nan")] if any(r.v is None for r in found) else []
    kept = [name(c) for c in df.columns if not (drop_original and c in columns)]
    return df.select(*kept, *added)


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `column_encoded`: the 0-based place of the value among the distinct ones in order; null is the text 'nan'.
    Numeric columns are skipped."""
    out = df
    for c in columns:
        if c in categorical_columns(df):
            values = df.select(F.coalesce(name(c).cast("string"), F.lit("nan")).alias("_value")).distinct()
            codes = dense_ids(values, "_value", f"{c}_encoded")
            out = out.join(codes, F.coalesce(name(c).cast("string"), F.lit("nan")) == F.col("_value"), "left").drop("_value")
    return out


def frequency_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `column_freq`: the share of the value among known values; null stays null."""
    out = df
    for c in columns:
        known = df.select(name(c).alias("_value")).where("_value IS NOT NULL")
        total = known.agg(F.count(F.lit(1)).alias("_total"))
        freq = known.groupBy("_value").agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(total)).select("_value", (F.col("_n") / F.col("_total")).alias(f"{c}_freq"))
        out = out.join(freq, name(c) == F.col("_value"), "left").drop("_value")
    return out


def target_encode(df: DataFrame, columns: list[str], target: str, min_samples_leaf: int = 1, smoothing: float = 1.0) -> DataFrame:
    """Adds `column_target_enc`: the mean target of the value, drawn to the overall mean for rare values."""
    out = df
    prior = df.agg(F.avg(number(df, target)).alias("_prior"))
    for c in columns:
        stats = df.groupBy(name(c).alias("_value")).agg(F.count(number(df, target)).alias("_n"), F.avg(number(df, target)).alias("_mean"))
        weight = 1 / (1 + F.exp(-(F.col("_n") - min_samples_leaf) / F.lit(float(smoothing))))
        table = stats.crossJoin(F.broadcast(prior)).select("_value", F.coalesce(F.col("_prior") * (1 - weight) + F.col("_mean") * weight, F.col("_prior")).alias(f"{c}_target_enc"))
        out = out.join(table, name(c).eqNullSafe(F.col("_value")), "left").drop("_value")
    return out


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False, bias: bool = False) -> DataFrame:
    """Adds the products of up to `degree` of the columns, by degree, named `a^2`, `a b`; the columns stay once."""
    choose = combinations if interaction_only else combinations_with_replacement
    added = [F.lit(1.0).alias("1")] if bias else []
    for d in range(2, degree + 1):
        for group in choose(columns, d):
            product = F.lit(1.0)
            for c in group:
                product = product * number(df, c)
            powers = {c: group.count(c) for c in group}
            added.append(product.alias(" ".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())))
    return df.select("*", *added)


def combine(df: DataFrame, columns: list[str], method: str = "multiplication", most: int = 2) -> DataFrame:
    """Adds `a * b` or `a + b` for every group of 2 to `most` columns; a null counts as 1 or 0."""
    added = []
    for size in range(2, most + 1):
        for group in combinations(columns, size):
            times = method == "multiplication"
            total = F.lit(1.0 if times else 0.0)
            for c in group:
                x = F.coalesce(number(df, c), F.lit(1.0 if times else 0.0))
                total = total * x if times else total + x
            added.append(total.alias((" * " if times else " + ").join(group)))
    return df.select("*", *added)


def table_vectors(profiles: DataFrame, types: list[str], size: int) -> DataFrame:
    """(table_id, vector): the mean embedding of a table's columns of each type, types side by side, zeros where none.

    profiles: (table_id, data_type, embedding of `size` numbers)."""
    means = profiles.where("embedding IS NOT NULL").select("table_id", "data_type", F.posexplode("embedding").alias("at", "x")).groupBy("table_id", "data_type", "at").agg(F.avg("x").alias("x"))
    by_type = means.groupBy("table_id", "data_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    maps = by_type.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("data_type", "v"))).alias("m"))
    zero = F.array_repeat(F.lit(0.0), size)
    vectors = maps.select("table_id", F.concat(*[F.coalesce(F.try_element_at("m", F.lit(t)), zero) for t in types]).alias("vector"))
    everyone = profiles.select("table_id").distinct()
    return everyone.join(vectors, "table_id", "left").select("table_id", F.coalesce("vector", F.array_repeat(F.lit(0.0), size * len(types))).alias("vector"))


def padded_vector(data_type, vector, types: list[str], size: int):
    """A column's vector in the block of its type, zeros elsewhere."""
    blocks = [F.when(data_type == t, vector).otherwise(F.array_repeat(F.lit(0.0), size)) for t in types]
    return F.concat(*blocks)


def known_values(df: DataFrame, c: str) -> DataFrame:
    return df.select(value(df, c).alias("value")).where("value IS NOT NULL")


# What a path of so many parts names.
NODE_TYPES = {1: "source", 2: "dataset", 3: "table", 4: "column"}


def typed_edges(triples: DataFrame) -> DataFrame:
    """(s_type, p_id, o_type, s_id, o_id) of distinct complete triples (s, p, o): types by the number of path parts, dense
    ids of the entities of each type and of the relations, in order."""
    kind = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NODE_TYPES.items() for x in kv]), F.size(F.split(c, "/"))), F.lit("other"))
    t = triples.select("s", "p", "o").dropna().dropDuplicates().select("s", "p", "o", kind("s").alias("s_type"), kind("o").alias("o_type"))
    nodes = t.select(F.col("s").alias("node"), F.col("s_type").alias("type")).union(t.select("o", "o_type")).distinct()
    ids = None
    for x in [*NODE_TYPES.values(), "other"]:
        own = dense_ids(nodes.where(F.col("type") == x).select("node"), "node", "id").withColumn("type", F.lit(x))
        ids = own if ids is None else ids.unionByName(own)
    relations = dense_ids(t.select("p").distinct(), "p", "p_id")
    s_ids = ids.select(F.col("node").alias("s"), F.col("type").alias("s_type"), F.col("id").alias("s_id"))
    o_ids = ids.select(F.col("node").alias("o"), F.col("type").alias("o_type"), F.col("id").alias("o_id"))
    return t.join(s_ids, ["s", "s_type"]).join(o_ids, ["o", "o_type"]).join(relations, "p").select("s_type", "p_id", "o_type", "s_id", "o_id")
