"""Correlation structure of numeric columns, from moment sums and average ranks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, number, numeric_columns, rounded, share
from ..functions.ranks import numbered
from ..sources.shared import cut


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where all the columns are known, as doubles."""
    return df.select(*[number(df, c).alias(c) for c in columns]).dropna()


def pair_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x, y, r) for all pairs of columns in order, over rows where both are known; r is null if one is constant."""
    columns = columns or numeric_columns(df)
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    wide = df.agg(*[correlation(number(df, a), number(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, cnt, rank): the average rank of each distinct value. Counts are summed before a range sort of the distinct
    values, which is written once; what each partition holds is added up apart, so no task sorts all values."""
    return _ranked(df.select(number(df, column).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("cnt")))


def _ranked(counts: DataFrame) -> DataFrame:
    """(value, cnt, rank) of distinct values with their counts."""
    parts = cut(counts.orderBy("value").withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    before, total = [], 0
    for part, n in sorted(tuple(r) for r in parts.groupBy("_part").agg(F.sum("cnt")).collect()):  # a row for each partition
        before.append((part, total))
        total += n
    base = counts.sparkSession.createDataFrame(before, "_part int, _base long")
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("before", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    return local.join(F.broadcast(base), "_part").select("value", "cnt", (F.col("_base") + F.col("before") + (F.col("cnt") + 1) / 2).alias("rank"))


#: Rank tables of at most so many distinct values are broadcast; each is counted before.
BROADCAST_RANKS = 100_000


def with_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(r0, r1, ..): the columns' average ranks in each row, null where the value is missing. Each column is ranked once."""
    out = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        ranks = cut(average_ranks(df, c).select(F.col("value").alias(f"v{i}"), F.col("rank").alias(f"r{i}")))
        out = out.join(F.broadcast(ranks) if ranks.count() <= BROADCAST_RANKS else ranks, f"v{i}", "left")
    return out.select(*[f"r{i}" for i in range(len(columns))])


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(x, y, rho) of pairs of columns, each over the rows where both are known. Columns without missing cells share one ranking
    and all their pairs one pass; other pairs are ranked over their own rows."""
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, rho double")
    columns = sorted({c for p in pairs for c in p}, key=df.columns.index)
    gaps = df.agg(*[F.count_if(number(df, c).isNull()).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    whole = [c for i, c in enumerate(columns) if not gaps[f"g{i}"]]
    shared = [p for p in pairs if p[0] in whole and p[1] in whole]
    tables = []
    for own, ranked in [(shared, with_ranks(df, whole))] * bool(shared) + [([p], with_ranks(df.where(number(df, p[0]).isNotNull() & number(df, p[1]).isNotNull()), list(p))) for p in pairs if p not in shared]:
        at = {c: f"r{i}" for i, c in enumerate(whole if own is shared else own[0])}
        wide = ranked.agg(*[correlation(F.col(at[x]), F.col(at[y])).alias(f"c{i}") for i, (x, y) in enumerate(own)])
        tables.append(wide.select(F.inline(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("rho")) for i, (x, y) in enumerate(own)]))))
    return reduce(DataFrame.union, tables)


def spearman_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, rho) over rows where both are known."""
    return spearman_pairs(df, [(x, y)])


def spearman_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x, y, rho) for all pairs, pairwise complete."""
    return spearman_pairs(df, list(combinations(columns or numeric_columns(df), 2)))


def weighted_inversions(values: np.ndarray, weights: np.ndarray) -> float:
    """Sum of weights[i] * weights[j] over i < j with values[i] > values[j]. By the bits of the values, highest first: where two
    values share all higher bits, and the earlier has the bit and the later has not, they are inverted."""
    total, v, w = 0.0, np.asarray(values, np.int64), np.asarray(weights, np.float64)
    for bit in range(int(v.max(initial=0)).bit_length() - 1, -1, -1):
        one = (v >> bit & 1).astype(bool)
        above = np.cumsum(np.where(one, w, 0.0))
        group = v >> (bit + 1)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        start = np.repeat((above - np.where(one, w, 0.0))[first], np.diff(np.append(first, len(v))))
        total += float(((above - start) * w)[~one].sum())
        turn = np.argsort(v >> bit, kind="stable")
        v, w = v[turn], w[turn]
    return total


def kendall_pair(df: DataFrame, x: str, y: str, blocks: int = 1000, least: int = 1 << 16) -> DataFrame:
    """(x, y, tau): Kendall's tau-b over rows where both are known; null where one is constant.

    Equal pairs of values are counted first, so no value is hot. The distinct pairs are numbered by (x, y) and by (y, x); a pair of
    them is discordant if the two orders disagree and both values differ, which strict inversions of the second number along the
    first count: ties never invert. Both orders are cut in at most `blocks` blocks of `least` pairs or more. Two pairs in one block
    of either order are counted inside it, and those in different blocks of both by the histogram of blocks, of at most blocks x blocks
    cells. A task holds one block, or the histogram.
    """
    return _kendall(_pair_counts(df, x, y), blocks, least).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "tau")


def _pair_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, w): how often each pair of known values is met."""
    return df.select(number(df, x).alias("x"), number(df, y).alias("y")).dropna().groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))


def _spearman(counts: DataFrame) -> DataFrame:
    """(rho) of counted pairs; null where one is constant. Ranks are taken from their mean, which is known, so that no large sums cancel."""
    mean = counts.agg(((F.sum("w") + 1) / 2).alias("mean"))
    out = counts
    for c in ("x", "y"):
        ranks = cut(_ranked(counts.groupBy(F.col(c).alias("value")).agg(F.sum("w").alias("cnt"))).select(F.col("value").alias(c), F.col("rank").alias(f"r{c}")))
        out = out.join(F.broadcast(ranks) if ranks.count() <= BROADCAST_RANKS else ranks, c)
    a, b = (F.col(f"r{c}") - F.col("mean") for c in ("x", "y"))
    sums = out.crossJoin(F.broadcast(mean)).agg(*[F.sum(F.col("w") * u * v).alias(n) for n, u, v in (("ab", a, b), ("aa", a, a), ("bb", b, b))])  # one row of the mean
    return sums.select(F.try_divide("ab", F.nullif(F.sqrt("aa") * F.sqrt("bb"), F.lit(0.0))).alias("rho"))


def _kendall(counts: DataFrame, blocks: int = 1000, least: int = 1 << 16) -> DataFrame:
    """(tau) of counted pairs, as kendall_pair says."""
    by_x = numbered(counts, ["x", "y"], "i")
    placed = cut(numbered(by_x, ["y", "x"], "j").select("x", "y", "w", "i", "j"))
    size = max(least, -(-placed.count() // blocks))
    dealt = placed.select("w", "i", "j", F.expr(f"i div {size}").alias("p"), F.expr(f"j div {size}").alias("q"))

    def inside(along: str, key: str):
        def count(table: pa.Table) -> pa.Table:
            order = np.argsort(table["i"].to_numpy(), kind="stable")
            values = table[key].to_numpy()[order]
            return pa.table({"d": [weighted_inversions(values - values.min(), table["w"].to_numpy()[order])]})

        return dealt.groupBy(along).applyInArrow(count, "d double")

    def across(table: pa.Table) -> pa.Table:
        p, q, w = (table[c].to_numpy() for c in ("p", "q", "w"))
        order = np.lexsort((q, p))  # cells of one block of the first order ascend, so they aren't inverted
        return pa.table({"d": [weighted_inversions(q[order], w[order])]})

    cells = dealt.groupBy("p", "q").agg(F.sum("w").alias("w"))
    discordant = inside("p", "q").union(inside("q", "j")).union(cells.withColumn("all", F.lit("all")).groupBy("all").applyInArrow(across, "d double")).agg(F.sum("d").alias("d"))
    pairs_of = lambda t, n: t.agg(F.coalesce(F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2), F.lit(0.0)).alias("t"))
    ties = [pairs_of(placed.groupBy(c).agg(F.sum("w").alias("w")), "w").withColumnRenamed("t", f"t_{c}") for c in ("x", "y")]
    tied = placed.agg(F.sum("w").cast("double").alias("n"), F.sum(F.col("w").cast("double") * (F.col("w") - 1) / 2).alias("t_xy"))
    wide = reduce(DataFrame.crossJoin, [tied, *ties, discordant])  # of one row each
    n0 = F.col("n") * (F.col("n") - 1) / 2
    tau = (n0 - F.col("t_x") - F.col("t_y") + F.col("t_xy") - 2 * F.col("d")) / F.nullif(F.sqrt(n0 - F.col("t_x")) * F.sqrt(n0 - F.col("t_y")), F.lit(0.0))
    return wide.select(tau.alias("tau"))


def correlation_strength(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(weak_share, moderate_share, strong_share) of pairs by |rho|: under 0.3, under 0.7, or more."""
    r = spearman_table(df, columns).where("rho IS NOT NULL").select(F.abs("rho").alias("r"))
    return r.agg(share(F.col("r") < 0.3).alias("weak_share"), share((F.col("r") >= 0.3) & (F.col("r") < 0.7)).alias("moderate_share"), share(F.col("r") >= 0.7).alias("strong_share"))


def redundant_pairs(df: DataFrame, threshold: float = 0.9, columns: list[str] | None = None) -> DataFrame:
    """(x, y, rho) of pairs with |rho| of at least the threshold."""
    return spearman_table(df, columns).where(F.abs("rho") >= threshold)


def synergy_unsupervised(df: DataFrame, columns: list[str] | None = None, most: int = 10) -> DataFrame:
    """(synergistic_interaction_ratio, numerical_numerical, categorical_numerical, categorical_categorical): of the first
    `most` pairs of numeric columns, in order, the share whose Pearson and Spearman correlations differ by over 0.2, and
    the mix of all pairs of columns by type. Pairs of fewer than 10 complete rows don't count among the first."""
    columns = columns or numeric_columns(df)
    pairs = list(combinations(columns, 2))
    tried = min(most, len(pairs))
    known = df.agg(F.lit(0), *[F.count_if(number(df, a).isNotNull() & number(df, b).isNotNull()).alias(f"n{i}") for i, (a, b) in enumerate(pairs)]).first()
    named = [p for i, p in enumerate(pairs) if known[f"n{i}"] >= 10][:tried]
    wide = df.agg(F.lit(0).alias("none"), *[correlation(number(df, a), number(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(named)])
    pearson = wide.select(F.explode(F.array(F.struct(F.lit("").alias("x"), F.lit("").alias("y"), F.lit(None).cast("double").alias("r")), *[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(named)])).alias("p")).select("p.*")
    spearman = spearman_pairs(df, named)
    n, m = len(columns), len(df.columns)
    c, total = m - n, m * (m - 1) // 2
    mix = {"numerical_numerical": n * (n - 1) // 2, "categorical_numerical": n * c, "categorical_categorical": c * (c - 1) // 2}
    far = F.count_if(F.abs(F.col("r") - F.col("rho")) > 0.2)
    return pearson.join(spearman, ["x", "y"], "left").agg(
        (rounded(far / F.lit(tried)) if tried else F.lit(0.0)).alias("synergistic_interaction_ratio"), *[F.lit(round(v / total, 4) if total else 0.0).alias(k) for k, v in mix.items()]
    )


def interaction_potential(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(interaction_potential): 1 - mean |r| over complete rows; 0 for fewer than 10 of them."""
    columns = columns or numeric_columns(df)
    rows = complete_rows(df, columns)
    pairs = list(combinations(columns, 2))
    wide = rows.agg(F.count(F.lit(1)).alias("n"), *[F.abs(correlation(F.col(f"`{a}`"), F.col(f"`{b}`"))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    known = F.filter(F.array(*[F.col(f"r{i}") for i in range(len(pairs))]), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    return wide.select(F.when(F.col("n") < 10, 0.0).otherwise(F.coalesce(rounded(1 - mean), F.lit(0.0))).alias("interaction_potential"))


def correlation_select(df: DataFrame, target: str, threshold: float = 0.5, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """(column, r) of numeric columns with |r| to the target over the threshold, strongest first. method: pearson,
    spearman or kendall (tau-b), each over the rows where both are known."""
    return correlation_selects(df, target, threshold, columns, [method]).orderBy(F.abs("r").desc(), "column").select("column", "r")


def correlation_selects(df: DataFrame, target: str, threshold: float = 0.5, columns: list[str] | None = None, methods: list[str] | None = None) -> DataFrame:
    """(method, column, r) as of correlation_select, by each of the methods, all three if not given. The pairs of a column and the target are
    counted once for all methods by ranks, and ranked and joined as distinct pairs, not as rows."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    methods = methods or ["pearson", "spearman", "kendall"]
    for m in methods:
        if m not in ("pearson", "spearman", "kendall"):
            raise ValueError(f"method must be pearson, spearman or kendall, not {m}")
    tables = [df.sparkSession.createDataFrame([], "method string, column string, r double")]
    if "pearson" in methods and columns:
        wide = df.agg(*[correlation(number(df, c), number(df, target)).alias(f"r{i}") for i, c in enumerate(columns)])
        tables.append(wide.select(F.inline(F.array(*[F.struct(F.lit("pearson").alias("method"), F.lit(c).alias("column"), F.col(f"r{i}").alias("r")) for i, c in enumerate(columns)]))))
    for c in columns if set(methods) & {"spearman", "kendall"} else []:
        counts = cut(_pair_counts(df, c, target))
        tables += [f(counts).toDF("r").select(F.lit(m).alias("method"), F.lit(c).alias("column"), "r") for m, f in (("spearman", _spearman), ("kendall", _kendall)) if m in methods]
    return reduce(DataFrame.union, tables).where(F.abs("r") > threshold)


def matrix(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """The Pearson matrix over complete rows, and their number: p x p numbers, whatever the rows."""
    rows = complete_rows(df, columns)
    pairs = list(combinations(range(len(columns)), 2))
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[correlation(F.col(f"`{columns[a]}`"), F.col(f"`{columns[b]}`")).alias(f"r{a}_{b}") for a, b in pairs]).first()
    out = np.eye(len(columns))
    for a, b in pairs:
        r = got[f"r{a}_{b}"]
        out[a, b] = out[b, a] = np.nan if r is None else r
    return out, got["n"]


def vif(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, vif): diagonal of the inverse correlation matrix; infinite where the matrix is singular."""
    columns = columns or numeric_columns(df)
    r, _ = matrix(df, columns)
    try:
        values = np.diag(np.linalg.inv(r)) if np.isfinite(r).all() and np.linalg.cond(r) < 1e12 else np.full(len(columns), np.inf)
    except np.linalg.LinAlgError:
        values = np.full(len(columns), np.inf)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, values, strict=True)], "column string, vif double")


def conditional_dependencies(df: DataFrame, columns: list[str] | None = None, most: int = 5, threshold: float = 0.3) -> DataFrame:
    """(mean_partial_r, has_dependencies): mean |r_xy.z| over the triples of the first `most` columns."""
    columns = (columns or numeric_columns(df))[:most]
    r, n = matrix(df, columns)
    found = []
    for x, y, z in ((a, b, c) for a, b in combinations(range(len(columns)), 2) for c in range(len(columns)) if c not in (a, b)):
        low = (1 - r[x, z] ** 2) * (1 - r[y, z] ** 2)
        if np.isfinite(low) and low > 1e-12:
            found.append(abs((r[x, y] - r[x, z] * r[y, z]) / np.sqrt(low)))
    mean = round(float(np.mean(found)), 4) if found else 0.0
    return df.sparkSession.createDataFrame([(mean, mean > threshold)], "mean_partial_r double, has_dependencies boolean")


def signal_to_noise(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(signal_to_noise): variance of the first two principal components over that of the next three, at most 10; 2.5
    where it isn't defined."""
    columns = columns or numeric_columns(df)
    r, n = matrix(df, columns)
    value = 2.5
    if len(columns) >= 2 and n > 1 and np.isfinite(r).all():
        e = np.sort(np.linalg.eigvalsh(r))[::-1]
        value = min(10.0, float(e[:2].sum() / max(e[2:5].sum(), 0.001)))
    return df.sparkSession.createDataFrame([(round(value, 4),)], "signal_to_noise double")


def correlation_clusters(df: DataFrame, threshold: float = 0.7, columns: list[str] | None = None) -> DataFrame:
    """(n_clusters, largest_share): average linkage on 1 - |r|, cut at 1 - threshold, over the p columns. With an
    undefined correlation every column is a cluster."""
    columns = columns or numeric_columns(df)
    r, _ = matrix(df, columns)
    groups = [[i] for i in range(len(columns))]
    if np.isfinite(r).all():
        d = 1 - np.abs(r)
        while len(groups) > 1:
            gap, a, b = min((float(np.mean(d[np.ix_(groups[a], groups[b])])), a, b) for a, b in combinations(range(len(groups)), 2))
            if gap > 1 - threshold:
                break
            groups[a] += groups.pop(b)
    largest = max(map(len, groups), default=0) / max(1, len(columns))
    return df.sparkSession.createDataFrame([(len(groups), round(largest, 4))], "n_clusters int, largest_share double")


def variance_select(df: DataFrame, threshold: float, columns: list[str] | None = None) -> DataFrame:
    """(column, variance) of numeric columns with a population variance over the threshold, largest first."""
    columns = columns or numeric_columns(df)
    wide = df.agg(*[F.var_pop(number(df, c)).alias(f"v{i}") for i, c in enumerate(columns)])
    table = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)])).alias("p")).select("p.*")
    return table.where(F.col("variance") > threshold).orderBy(F.col("variance").desc(), "column")
