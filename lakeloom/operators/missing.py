"""Missing data and cleaning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import column_table, name, numeric_columns, rounded, value
from ..functions.quantiles import exact_quantiles
from ..functions.ranks import numbered
from ..sources.shared import cut

# Cells that count as missing in the repair tool.
NA_TOKENS = ["none", "n/a", "na", "NaN", "nan", "missing", "?", "", " "]


def _nulls(c):
    return F.count_if(c.isNull())


def overall_missing_rate(df: DataFrame) -> DataFrame:
    """(missing_rate): missing cells over all cells; 0 for an empty table."""
    cells = F.count(F.lit(1)) * len(df.columns)
    total = sum((F.count_if(value(df, c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.coalesce(rounded(F.try_divide(total.cast("double"), cells)), F.lit(0.0)).alias("missing_rate"))


def missing_rates(df: DataFrame) -> DataFrame:
    """(position, column, n_missing, rate) of every column."""
    out = column_table(df, df.columns, n_missing=_nulls, n=lambda c: F.count(F.lit(1)))
    return out.select("position", "column", "n_missing", F.coalesce(F.try_divide(F.col("n_missing").cast("double"), "n"), F.lit(0.0)).alias("rate"))


def column_missing_distribution(df: DataFrame, bins: tuple[float, ...] = (0, 0.1, 0.3, 0.5, 1)) -> DataFrame:
    """(bin, lower, upper, column_share): share of columns whose missing rate is in [lower, upper); the last bin is closed."""
    rates = missing_rates(df)
    spark = df.sparkSession
    edges = spark.createDataFrame([(i, float(a), float(b), i == len(bins) - 2) for i, (a, b) in enumerate(zip(bins[:-1], bins[1:], strict=True))], "bin int, lower double, upper double, closed boolean")
    inside = (F.col("rate") >= F.col("lower")) & ((F.col("rate") < F.col("upper")) | (F.col("closed") & (F.col("rate") <= F.col("upper"))))
    return edges.join(rates, inside, "left").groupBy("bin", "lower", "upper").agg(rounded(F.count("column") / F.lit(float(max(1, len(df.columns))))).alias("column_share"))


def row_completeness(df: DataFrame) -> DataFrame:
    """(complete_share, any_missing_share, mostly_missing_share) of rows; mostly: over half of the cells."""
    n = sum((value(df, c).isNull().cast("int") for c in df.columns), F.lit(0))
    rows = F.count(F.lit(1)).cast("double")
    part = lambda cond: F.coalesce(rounded(F.try_divide(F.count_if(cond), rows)), F.lit(0.0))
    return df.agg(part(n == 0).alias("complete_share"), part(n > 0).alias("any_missing_share"), part(n > len(df.columns) / 2).alias("mostly_missing_share"))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(mode_0, mode_1, ..): each column's most frequent known value, the smallest of ties, in one row; null without a known value and
    for nested types and bytes.

    Values become rows and are counted by (column, value), in every task before the shuffle too; then each count of a column keeps its
    smallest value, and the largest count wins. So no task holds a column's values, and one pass does for all columns.
    """
    plain = {i: c for i, c in enumerate(columns) if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))}
    lanes = [F.when(value(df, c).isNotNull(), F.struct(F.lit(i).alias("at"), value(df, c).cast("string").alias("text"))) for i, c in plain.items()]
    cells = df.select(F.inline(F.array_compact(F.array(*lanes)))) if lanes else df.select(F.lit(0).alias("at"), F.lit("").alias("text"))
    counts = cells.groupBy("at", "text").agg(F.count(F.lit(1)).alias("n"))
    typed = lambda i: F.when(F.col("at") == i, F.col("text").cast(df.schema[columns[i]].dataType))
    least = counts.groupBy("at", "n").agg(F.lit(0), *[F.min(typed(i)).alias(f"x{i}") for i in plain])
    return least.agg(F.lit(0).alias("_"), *[(F.max_by(f"x{i}", F.when(F.col("at") == i, F.col("n"))) if i in plain else F.lit(None).cast(df.schema[c].dataType)).alias(f"mode_{i}") for i, c in enumerate(columns)]).drop("_")


def fill_missing(df: DataFrame, columns: list[str], method: str = "auto", constant=None) -> DataFrame:
    """Fill missing cells: mean, median, mode (smallest of ties), constant; auto is mean for numbers, else mode."""
    numeric = set(numeric_columns(df))

    medians = exact_quantiles(df, [c for c in columns if c in numeric], [0.5]) if method == "median" else {}

    how = {c: ("mean" if c in numeric else "mode") if method == "auto" else method for c in columns}
    modal = [c for c in columns if how[c] == "mode"]

    def fill(c: str):
        return {"mean": F.avg(value(df, c)) if c in numeric else F.lit(None), "median": F.lit(medians[c][0]).cast("double") if c in medians else F.lit(None), "mode": F.lit(None), "constant": F.lit(constant)}[how[c]]

    fills = df.agg(F.lit(0), *[fill(c).alias(f"fill_{i}") for i, c in enumerate(columns) if how[c] != "mode"])
    if modal:
        fills = fills.crossJoin(modes(df, modal).withColumnsRenamed({f"mode_{i}": f"fill_{columns.index(c)}" for i, c in enumerate(modal)}))  # one row each
    at = {c: i for i, c in enumerate(columns)}
    return df.crossJoin(F.broadcast(fills)).select(*[F.coalesce(value(df, c), F.col(f"fill_{at[c]}")).alias(c) if c in at else name(c) for c in df.columns])  # one row of fills


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """Columns with fewer missing cells than int(threshold * rows). With `columns`, only those are judged and the
    output's columns are in alphabetical order."""
    judged = columns or df.columns
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(value(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(judged)]).first()
    dropped = {c for i, c in enumerate(judged) if not counts[f"m{i}"] < int(threshold * counts["n"])}
    kept = [c for c in df.columns if c not in dropped]
    return df.select(*[name(c) for c in (sorted(kept) if columns else kept)])


def tokens_to_null(df: DataFrame, tokens: list[str] = NA_TOKENS) -> DataFrame:
    """String cells that are one of the tokens as a whole become null."""
    return df.select(*[F.when(~name(f.name).isin(tokens), name(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else name(f.name) for f in df.schema.fields])


def needs_cleaning(df: DataFrame, tokens: list[str] = NA_TOKENS) -> DataFrame:
    """(column, n_missing) of columns with missing cells, tokens counted, most first."""
    return missing_rates(tokens_to_null(df, tokens)).where("n_missing > 0").select("column", "n_missing").orderBy(F.col("n_missing").desc(), "column")


def clean_fill(df: DataFrame) -> DataFrame:
    """Strings get 'x' and numbers their mean, or 0 where the table has a string column."""
    texts = any(isinstance(f.dataType, T.StringType) for f in df.schema.fields)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    numbers = numeric_columns(df)
    out = fill_missing(df, strings, "constant", "x") if strings else df
    return fill_missing(out, numbers, "constant", 0) if texts and numbers else fill_missing(out, numbers, "mean") if numbers else out


def interpolate(df: DataFrame, columns: list[str], order: str, partition: list[str] | None = None, run: int = 100_000, linear: bool = True) -> DataFrame:
    """Linear interpolation down the rows between the nearest known values, the nearest known one at the ends; or, if not
    linear, the next known value of any type, and the last one at the end. Without
    `partition` the rows, told apart by `order`, are numbered by a range sort and dealt in runs of `run` rows; each run gets
    the nearest known values before and after it from a table of a row for each run."""
    cell = number_or_null if linear else value
    known = {c: F.when(value(df, c).isNotNull(), F.struct(F.col("_n").alias("n"), cell(df, c).alias("x"))) for c in columns}
    if partition:
        out = df.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(order)))
    else:
        rows = numbered(df, [order], "_n").withColumn("_run", F.expr(f"int(_n div {run})"))
        ends = rows.groupBy("_run").agg(*[e for i, c in enumerate(columns) for e in (F.max(known[c]).alias(f"_last{i}"), F.min(known[c]).alias(f"_first{i}"))])
        over_runs = Window.orderBy("_run")  # a row for each run
        earlier, later = over_runs.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.col("_run").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = cut(ends.select("_run", *[e for i in range(len(columns)) for e in (F.last(f"_last{i}", True).over(earlier).alias(f"_before{i}"), F.last(f"_first{i}", True).over(later).alias(f"_after{i}"))]))
        # a task for each run: by their packed size, many runs of like rows would be one task, which holds and sorts them all
        out = rows.join(carried, "_run").repartitionById(max(1, carried.count()), F.col("_run"))
    whole = Window.partitionBy(*(partition or ["_run"]))
    # from the end backward: a frame that is open at its end would be gone through anew for each row
    back, ahead = (whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0) for order in ("_n", F.col("_n").desc()))
    for i, c in enumerate(columns):
        before = F.coalesce(F.last(known[c], True).over(back), *([] if partition else [F.col(f"_before{i}")]))
        after = F.coalesce(F.last(known[c], True).over(ahead), *([] if partition else [F.col(f"_after{i}")]))
        out = out.withColumns({f"_b{i}": before, f"_a{i}": after})
    for i, c in enumerate(columns):
        x0, x1, n0, n1 = (F.col(f"{side}.{part}") for part in ("x", "n") for side in (f"_b{i}", f"_a{i}"))
        between = [x0 + (x1 - x0) * F.try_divide((F.col("_n") - n0).cast("double"), n1 - n0), x0, x1] if linear else [x1, x0]
        out = out.withColumn(c, F.coalesce(cell(df, c), *between))
    return out.select(*[name(c) for c in df.columns])


def interpolate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing cells of the columns (all) from their row's other cells, in the order of the columns. With a string column among
    them, all become strings and a missing one takes the nearest known one before it. Otherwise it is interpolated linearly between the known
    ones around it, and takes the last known one where none comes after. What no known cell comes before stays missing."""
    columns = columns or df.columns
    texts = any(isinstance(df.schema[c].dataType, T.StringType) for c in columns)
    cells = F.array(*[value(df, c).cast("string" if texts else "double") for c in columns])
    known = F.filter(F.transform(cells, lambda x, i: F.struct(i.alias("n"), x.alias("x"))), lambda s: s["x"].isNotNull())

    def whole(row):
        def cell(x, i):
            last = F.try_element_at(F.filter(row["known"], lambda s: s["n"] < i), F.lit(-1))
            if texts:
                return F.coalesce(x, last["x"])
            after = F.try_element_at(F.filter(row["known"], lambda s: s["n"] > i), F.lit(1))
            return F.coalesce(x, last["x"] + (after["x"] - last["x"]) * (i - last["n"]) / (after["n"] - last["n"]), last["x"])

        return F.transform(row["cells"], cell)

    filled = F.transform(F.array(F.struct(cells.alias("cells"), known.alias("known"))), whole)[0]  # so that known is found once a row
    others = [c for c in df.columns if c not in columns]
    rows = df.select(*[name(c) for c in others], filled.alias("_filled"))
    return rows.select(*[F.get("_filled", F.lit(columns.index(c))).alias(c) if c in columns else name(c) for c in df.columns])


def clean_interpolate(df: DataFrame, order: str) -> DataFrame:
    """Missing cells from their row (`interpolate_rows`), then down each column by the order column, which tells rows apart: backward
    and then forward, which leaves a cell missing only in a column without a known one, so further rounds change nothing. Numbers are
    interpolated linearly, strings take the next known cell, or the last one at the end. The order column stays as it is."""
    columns = [c for c in df.columns if c != order]
    rows = interpolate_rows(df, columns)
    return interpolate(rows, columns, order, linear=not any(isinstance(f.dataType, T.StringType) for f in rows.schema.fields if f.name in columns))


def number_or_null(df: DataFrame, c: str):
    return value(df, c).cast("double")


def remove_duplicates(df: DataFrame, columns: list[str] | None = None, keep: str | bool = "first", order: str | None = None) -> DataFrame:
    """keep first or last by the order column, or none of what repeats (False); without an order, any one."""
    keys = columns or df.columns
    if keep is False:
        return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")
    if order is None:
        return df.dropDuplicates(keys)
    by = F.col(order).asc() if keep == "first" else F.col(order).desc()
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_n = 1").drop("_n")


def unary_transform(df: DataFrame, columns: list[str], kind: str, label: str | None = None) -> DataFrame:
    """log or sqrt of x + |min| + 0.0001, or x squared, for numeric columns but the label."""
    chosen = [c for c in columns if c in numeric_columns(df) and (c != label or kind == "square")]
    lows = df.agg(*[F.min(number_or_null(df, c)).alias(f"low_{i}") for i, c in enumerate(chosen)])
    at = {c: i for i, c in enumerate(chosen)}

    def new(c: str):
        if c not in at:
            return name(c)
        x = number_or_null(df, c)
        shifted = x + F.abs(F.col(f"low_{at[c]}")) + 1e-4
        return {"log": F.log(shifted), "sqrt": F.sqrt(shifted), "square": x * x}[kind].alias(c)

    return df.crossJoin(F.broadcast(lows)).select(*[new(c) for c in df.columns])  # one row of minima


def missing_pattern(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(pattern, tests, significant_share): COMPLETE without missing cells; else Mann-Whitney tests (normal approximation,
    ties corrected) of every other numeric column between the rows where a column is missing and where it isn't. Under a
    tenth significant: MCAR, under half: MAR, else MNAR; UNKNOWN without a test. A column is tested with at least 5
    missing and 10 known cells. With fewer than two numeric columns the deviation of the columns' missing rates decides,
    at 0.1 and 0.3."""
    from .correlation import average_ranks

    numbers = numeric_columns(df)
    rates = {r["column"]: (r.n_missing, r.rate) for r in missing_rates(df).collect()}
    gaps = [c for c, (n, _) in rates.items() if n]
    spark = df.sparkSession

    def told(pattern: str, tests: int = 0, share: float = 0.0) -> DataFrame:
        return spark.createDataFrame([(pattern, tests, round(share, 4))], "pattern string, tests int, significant_share double")

    if not gaps:
        return told("COMPLETE")
    if len(numbers) < 2:
        values = [r for _, r in rates.values()]
        mean = sum(values) / len(values)
        sd = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) if len(values) > 1 else 0.0
        return told("MCAR" if sd < 0.1 else "MAR" if sd < 0.3 else "MNAR")
    tests = significant = 0
    for v in numbers:
        others = [c for c in gaps if c != v]
        if not others:
            continue
        ranks = average_ranks(df, v)
        ties = F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt"))
        rows = df.select(number_or_null(df, v).alias("value"), *[value(df, c).isNull().alias(f"gap{i}") for i, c in enumerate(others)]).where("value IS NOT NULL")
        got = rows.join(ranks.select("value", "rank"), "value").agg(F.count(F.lit(1)).alias("n"), *[x for i in range(len(others)) for x in (F.count_if(f"gap{i}").alias(f"n{i}"), F.sum(F.when(F.col(f"gap{i}"), F.col("rank"))).alias(f"r{i}"))]).first()
        tied = ranks.agg(ties).first()[0] or 0.0
        for i, c in enumerate(others):
            n, n1 = got["n"], got[f"n{i}"]
            n2 = n - n1
            if rates[c][0] < 5 or n1 < 1 or n2 < 10:
                continue
            u = got[f"r{i}"] - n1 * (n1 + 1) / 2
            var = n1 * n2 / 12 * ((n + 1) - tied / (n * (n - 1)))
            if var > 0:
                z = max(0.0, abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var)
                tests += 1
                significant += math.erfc(z / math.sqrt(2)) < alpha
    if not tests:
        return told("UNKNOWN")
    share = significant / tests
    return told("MCAR" if share < 0.1 else "MAR" if share < 0.5 else "MNAR", tests, share)


def impute_most_frequent(df: DataFrame) -> DataFrame:
    """Every missing cell gets its column's most frequent value, the smallest of ties."""
    return fill_missing(df, df.columns, "mode")


def impute_nearest(df: DataFrame, columns: list[str], key: str, k: int = 5, rows: int = 2048) -> DataFrame:
    """Missing numbers get the mean of the k nearest of all rows that know them, ties to the smaller key. Distance: over the
    columns known in both rows, scaled up for the others; a cell stays missing where no row has one. Keys tell rows apart.

    Rows with equal cells have equal fills, and a donor's own cell in the missing column is no part of the distance. So equal rows with gaps
    are one, and of donors of a column that are equal in the others only the k with the smallest keys can be among the nearest:
    exact, and the work is the number of different gaps times that of different donors. Both are dealt in blocks of about `rows`;
    each pair of blocks is a task that keeps k donors for each gap, and these are ranked again.
    """
    x = F.array(*[number_or_null(df, c) for c in columns])
    cells = df.select(F.col(key).alias("_key"), x.alias("_x"))
    gap, knows = F.exists("_x", lambda v: v.isNull()), F.exists("_x", lambda v: v.isNotNull())
    places = lambda known: F.filter(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.get("_x", i).isNotNull() == known)
    gaps = cut(cells.where(gap & knows).select("_x").distinct().withColumn("_id", F.monotonically_increasing_id()))
    asked = gaps.select("_id", "_x", F.explode(places(False)).alias("_at"))
    count = lambda side: {r["_at"]: r["count"] for r in side.groupBy("_at").count().collect()}  # noqa: E731  a row for each column
    n_gaps = count(asked)
    known = cells.where(knows).select("_key", "_x", F.explode(places(True)).alias("_at")).where(F.col("_at").isin(*n_gaps))
    others = known.select("_at", "_key", F.get("_x", F.col("_at")).alias("_value"), F.transform("_x", lambda v, i: F.when(i != F.col("_at"), v)).alias("_x"))
    first = F.row_number().over(Window.partitionBy("_at", "_x").orderBy("_key", "_value"))
    donors = cut(others.where(knows).withColumn("_n", first).where(F.col("_n") <= k).drop("_n"))

    def dealt(sizes, *by):
        n = F.get(F.array(*[F.lit(max(1, -(-sizes.get(i, 0) // rows))) for i in range(len(columns))]), F.col("_at"))
        return F.pmod(F.xxhash64(*by), n).cast("int"), F.explode(F.sequence(F.lit(0), n - 1))

    (gap_block, every_gap), (donor_block, every_donor) = dealt(n_gaps, "_id"), dealt(count(donors), "_key", "_x")
    asked = asked.select("_id", "_at", "_x", gap_block.alias("_g"), every_donor.alias("_d"))
    dealers = donors.select("_key", "_at", "_x", "_value", every_gap.alias("_g"), donor_block.alias("_d"))
    fields = [("_id", T.LongType()), ("_at", T.IntegerType()), ("_donor", df.schema[key].dataType), ("_distance", T.DoubleType()), ("_value", T.DoubleType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n, _ in fields})
        right = right.sort_values("_key", kind="stable")
        a, b = (np.array([list(v) for v in side["_x"]], dtype=float) for side in (left, right))
        squares, used = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            step = a[:, j, None] - b[None, :, j]
            met = ~np.isnan(step)
            squares += np.where(met, step * step, 0.0)
            used += met
        distance = np.where(used > 0, squares * (a.shape[1] / np.maximum(used, 1)), np.inf)
        near = np.argsort(distance, axis=1, kind="stable")[:, :k]
        at, to = np.repeat(np.arange(len(a)), near.shape[1]), near.ravel()
        found = pd.DataFrame({"_id": left["_id"].to_numpy()[at], "_at": left["_at"].to_numpy()[at], "_donor": right["_key"].to_numpy()[to], "_distance": distance[at, to], "_value": right["_value"].to_numpy()[to]})
        return found[np.isfinite(found["_distance"])]

    near = asked.groupBy("_at", "_g", "_d").cogroup(dealers.groupBy("_at", "_g", "_d")).applyInPandas(best, schema)
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_at").orderBy("_distance", "_donor"))).where(F.col("_n") <= k)
    fills = ranked.groupBy("_id").agg(*[F.avg(F.when(F.col("_at") == i, F.col("_value"))).alias(f"_fill{i}") for i in range(len(columns))])
    at = {c: i for i, c in enumerate(columns)}
    filled = df.withColumn("_x", x).join(gaps.join(fills, "_id"), "_x", "left")
    return filled.select(*[F.coalesce(number_or_null(df, c), F.col(f"_fill{at[c]}")).alias(c) if c in at else name(c) for c in df.columns])


def impute_iterative(df: DataFrame, columns: list[str], rounds: int = 3, ridge: float = 1e-3) -> DataFrame:
    """Missing numbers get a ridge regression's prediction from the other columns: means first, then `rounds` rounds."""
    marks = {c: f"_gap{i}" for i, c in enumerate(columns)}
    marked = df.withColumns({m: value(df, c).isNull() for c, m in marks.items()})
    out = fill_missing(marked, columns, "mean")
    gaps = df.agg(*[F.count_if(value(df, c).isNull()).alias(c) for c in columns]).first()
    for _ in range(rounds):
        for c in columns:
            others = [o for o in columns if o != c]
            if not gaps[c] or not others:
                continue
            rows = VectorAssembler(inputCols=others, outputCol="_features").transform(out)
            model = LinearRegression(featuresCol="_features", labelCol=c, predictionCol="_guess", regParam=ridge).fit(rows.where(~F.col(marks[c])))
            out = model.transform(rows).withColumn(c, F.when(F.col(marks[c]), F.col("_guess")).otherwise(F.col(c))).select(*marked.columns)
    return out.select(*df.columns)
