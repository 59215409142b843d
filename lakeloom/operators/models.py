"""Target relations and models, with pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import correlation, name, number, numeric_columns, rounded, value
from ..functions.ranks import numbered
from ..sources.shared import cut
from .correlation import matrix


def _lorenz(scores: DataFrame, k: str = "score") -> DataFrame:
    """(high_share of scores over 5 times their mean, concentration: mean gap of the Lorenz curve), of at most a row a column."""
    values = sorted(r[0] for r in scores.select(k).where(f"{k} IS NOT NULL").collect())
    total, n = sum(values), len(values)
    gap = sum((i + 1) / n - sum(values[: i + 1]) / total for i in range(n)) / n if total else 0.0
    high = sum(v > 5 * total / n for v in values) / n if n else 0.0
    return scores.sparkSession.createDataFrame([(round(high, 4), round(gap, 4))], "high_share double, concentration double")


def anova_f(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(column, score): F statistic of each numeric column between the classes of the target, missing cells as the mean."""
    means = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)])
    filled = df.where(name(target).isNotNull()).crossJoin(F.broadcast(means)).select(name(target).alias("t"), *[F.coalesce(number(df, c), F.col(f"m{i}")).alias(f"x{i}") for i, c in enumerate(columns)])  # one row of means
    per = filled.groupBy("t").agg(F.count(F.lit(1)).alias("n"), *[x for i in range(len(columns)) for x in (F.sum(f"x{i}").alias(f"s{i}"), F.sum(F.col(f"x{i}") ** 2).alias(f"q{i}"))])
    n, k = F.sum("n"), F.count(F.lit(1))

    def f(i: int):
        between = F.sum(F.col(f"s{i}") ** 2 / F.col("n")) - F.sum(f"s{i}") ** 2 / n
        within = F.sum(f"q{i}") - F.sum(F.col(f"s{i}") ** 2 / F.col("n"))
        return F.try_divide(between / F.nullif(k - 1, F.lit(0)), F.nullif(within / F.nullif(n - k, F.lit(0)), F.lit(0.0)))

    wide = per.agg(*[f(i).alias(f"f{i}") for i in range(len(columns))])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("score")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def regression_f(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(column, score): F statistic of a straight line from each column, missing cells as its mean, to the target. If the
    target has missing cells, the statistic isn't defined: the score is |r| over the rows with both, 0 where that isn't defined."""
    cells = df.select(number(df, target).alias("y"), *[number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    means = cells.agg(F.count_if(F.col("y").isNull()).alias("gaps"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(columns))])
    rows = cells.crossJoin(F.broadcast(means)).select("gaps", "y", *[x for i in range(len(columns)) for x in (F.col(f"x{i}"), F.coalesce(f"x{i}", f"m{i}").alias(f"f{i}"))])  # one row of means
    wide = rows.agg(F.max("gaps").alias("gaps"), F.count(F.lit(1)).alias("n"), *[x for i in range(len(columns)) for x in (correlation(F.col(f"f{i}"), F.col("y")).alias(f"r{i}"), correlation(F.col(f"x{i}"), F.col("y")).alias(f"p{i}"))])
    line = lambda i: F.try_divide(F.col(f"r{i}") ** 2, F.nullif(1 - F.col(f"r{i}") ** 2, F.lit(0.0))) * (F.col("n") - 2)
    score = lambda i: F.when(F.col("gaps") > 0, F.coalesce(F.abs(F.col(f"p{i}")), F.lit(0.0))).otherwise(line(i))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), score(i).alias("score")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def anova_importance(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    return _lorenz(anova_f(df, target, columns))


def regression_importance(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    return _lorenz(regression_f(df, target, columns))


def cat_num_interaction(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """(category, number, score): spread of the group means around the overall mean, over the groups' mean variance, at most
    1; groups of one row are left out; the first 3 by 3 columns, 5 pairs at most."""
    out = None
    for c, x in [(c, x) for c in categories[:3] for x in numbers[:3]][:5]:
        groups = df.groupBy(name(c)).agg(F.avg(number(df, x)).alias("m"), F.var_samp(number(df, x)).alias("v")).where("v IS NOT NULL")
        overall = df.agg(F.avg(number(df, x)).alias("mu"))
        one = groups.crossJoin(F.broadcast(overall)).agg(F.least(F.lit(1.0), F.coalesce(rounded(F.try_divide(F.sum((F.col("m") - F.col("mu")) ** 2), F.nullif(F.avg("v"), F.lit(0.0)))), F.lit(0.0))).alias("score"))
        row = one.select(F.lit(c).alias("category"), F.lit(x).alias("number"), "score")
        out = row if out is None else out.union(row)
    return out


def confounder_strength(df: DataFrame, target: str, treatment: str, others: list[str]) -> DataFrame:
    """(confounder_strength): |r| less |partial r given the others|, in 0 to 1; 0 for fewer than 30 complete rows."""
    r, n = matrix(df, [target, treatment, *others])
    value = 0.0
    if n >= 30 and np.isfinite(r).all() and np.linalg.cond(r) < 1e12:
        p = np.linalg.inv(r)
        value = float(np.clip(abs(r[0, 1]) - abs(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1])), 0, 1))
    return df.sparkSession.createDataFrame([(round(value, 4),)], "confounder_strength double")


def _vectors(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    rows = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(columns)], number(df, target).alias("label")).dropna()
    return VectorAssembler(inputCols=[f"x{i}" for i in range(len(columns))], outputCol="features").transform(rows).select("features", "label")


def _is_class(df: DataFrame, target: str, most: int = 10) -> bool:
    return df.select(number(df, target)).where(number(df, target).isNotNull()).distinct().limit(most + 1).count() <= most


def nonlinearity(df: DataFrame, target: str, columns: list[str], seed: int = 42) -> DataFrame:
    """(nonlinearity): how much better a tree of depth 5 fits than a linear model, in 0 to 1, on the training rows."""
    data = _vectors(df, columns, target)
    if _is_class(df, target):
        models, score = (LogisticRegression(), DecisionTreeClassifier(maxDepth=5, seed=seed)), MulticlassClassificationEvaluator(metricName="accuracy")
    else:
        models, score = (LinearRegression(), DecisionTreeRegressor(maxDepth=5, seed=seed)), RegressionEvaluator(metricName="r2")
    linear, tree = (score.evaluate(m.fit(data).transform(data)) for m in models)
    value = (1.0 if tree > 0.5 else 0.0) if linear <= 0 else min(1.0, max(0.0, (tree - linear) / linear))
    return df.sparkSession.createDataFrame([(round(value, 4),)], "nonlinearity double")


# One-hot columns that a tree is grown over at most; see encoded_importances.
MOST_INDICATORS = 200_000


def _label(df: DataFrame, target: str) -> tuple[Column, bool]:
    """The class or number of the target, null for a row without one, and whether it is a class: at most ten distinct values.
    A text of more values has no label."""
    x = value(df, target)
    found = sorted(r[0] for r in df.select(x.alias("x")).where("x IS NOT NULL").distinct().limit(11).collect())  # eleven values at most
    if len(found) > 10:
        return number(df, target) if target in numeric_columns(df) else F.lit(None).cast("double"), False
    code = F.lit(None).cast("double")
    for i, v in enumerate(found):
        code = F.when(x == F.lit(v), float(i)).otherwise(code)
    return code, True


def _indicators(df: DataFrame, label: Column, numbers: list[str], categories: list[str]) -> tuple[DataFrame, PipelineModel | None, list[str]]:
    """Rows with a label (`label`, numbers n0, n1, .. with missing cells as the mean, categories c0, c1, ..), the model that makes
    `features` of them, and the source column of each feature: the numbers, then for each category column an indicator of each value
    but the first in order. The vectors are sparse. No row or no feature gives no model and no sources.

    The values of the category columns reach the driver, so callers count them first.
    """
    rows = df.select(label.alias("label"), *[number(df, c).alias(f"n{i}") for i, c in enumerate(numbers)], *[name(c).cast("string").alias(f"c{i}") for i, c in enumerate(categories)]).where("label IS NOT NULL")
    means = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.avg(f"n{i}"), F.lit(0.0)).alias(f"n{i}") for i in range(len(numbers))], *[F.count(f"c{i}").alias(f"c{i}") for i in range(len(categories))]).first().asDict()
    if not means["rows"]:
        return rows, None, []
    rows = rows.fillna({f"n{i}": means[f"n{i}"] for i in range(len(numbers))}) if numbers else rows
    inputs, sources, stages = [f"n{i}" for i in range(len(numbers))], list(numbers), []
    for i, c in enumerate(categories):
        if not means[f"c{i}"]:
            continue  # nothing but missing cells
        index = StringIndexer(inputCol=f"c{i}", outputCol=f"i{i}", handleInvalid="keep", stringOrderType="alphabetAsc").fit(rows)
        kept = list(range(1, len(index.labels)))
        if kept:
            stages += [index, OneHotEncoder(inputCol=f"i{i}", outputCol=f"h{i}", handleInvalid="error"), VectorSlicer(inputCol=f"h{i}", outputCol=f"v{i}", indices=kept)]
            inputs.append(f"v{i}")
            sources += [c] * len(kept)
    if not inputs:
        return rows, None, []
    return rows, Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features")]).fit(rows), sources


def _grown(data: DataFrame, classes: bool, trees: int, depth: int, seed: int) -> np.ndarray:
    kinds = {(True, True): DecisionTreeClassifier, (True, False): RandomForestClassifier, (False, True): DecisionTreeRegressor, (False, False): RandomForestRegressor}
    model = kinds[classes, trees == 1](maxDepth=depth, seed=seed, **({} if trees == 1 else {"numTrees": trees}))
    return model.fit(data).featureImportances.toArray()


# A forest over at most so many rows is grown over the rows; see _forest.
FEW_ROWS = 1_000_000
# Distinct rows of features times trees that a task of _drawn holds sums of, 16 bytes each: 100,000 for 50 trees.
MOST_SUMS = 5_000_000


def _drawn(rows: DataFrame, cells: DataFrame, n: int, keys: list[str], trees: int, seed: int) -> DataFrame:
    """The n numbered cells that any tree drew, with `drawn`: for each tree how many of a cell's rows its bootstrap draws, then for each
    tree the sum of their labels. A tree draws each row a Poisson number of times with mean 1, as the forest of pyspark.ml does: that is
    a Poisson number of draws with the rows at hand as its mean, each of any of them. One pass over the rows; a task holds the sums of all cells."""
    known = cells.select("cell", *[F.col(k).alias(f"k_{k}") for k in keys])
    at = rows.join(F.broadcast(known), reduce(and_, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])).select("cell", "label")

    def table(cell: np.ndarray, sums: np.ndarray) -> pa.Table:
        return pa.table({"block": cell // 256, "cell": cell, "drawn": pa.ListArray.from_arrays(np.arange(len(cell) + 1, dtype=np.int32) * (2 * trees), np.ascontiguousarray(sums).reshape(-1))})

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums, held, size = np.zeros((2 * trees, n)), [], 0

        def add() -> None:
            cell, label = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            for t in range(trees):
                of = rng.integers(0, size, rng.poisson(size))
                sums[t] += np.bincount(cell[of], minlength=n)
                sums[trees + t] += np.bincount(cell[of], weights=label[of], minlength=n)

        for batch in batches:
            held.append((batch["cell"].to_numpy(), batch["label"].to_numpy()))
            size += batch.num_rows
            if size >= 1 << 18:
                add()
                held, size = [], 0
        if size:
            add()
        some = np.flatnonzero(sums[:trees].any(axis=0))
        for first in range(0, len(some), 4096):
            part = some[first : first + 4096]
            yield from table(part, sums[:, part].T).to_batches()

    def whole(block: pa.Table) -> pa.Table:
        cell, drawn = block["cell"].to_numpy(), block["drawn"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * trees)
        of, at = np.unique(cell, return_inverse=True)
        sums = np.zeros((len(of), 2 * trees))
        np.add.at(sums, at, drawn)
        return table(of, sums)

    kind = "block long, cell long, drawn array<double>"
    return cells.join(at.mapInArrow(draw, kind).groupBy("block").applyInArrow(whole, kind).select("cell", "drawn"), "cell")


def _forest(rows: DataFrame, model: PipelineModel, classes: bool, trees: int, depth: int, seed: int) -> np.ndarray:
    """Importances of a forest over the rows.

    The forest of pyspark.ml keeps a number for each row and tree and updates a node of each tree by each row. But rows with the
    same features (of classes: and label) go the same way in any tree, so a tree needs only how many of them it drew and their mean
    label: what labels differ by inside such a cell is in no split's gain. If the rows are many and the cells few, each tree's draws are summed
    by cell in one pass over the rows, and the trees are grown over weighted cells.
    """
    keys = [c for c in rows.columns if classes or c != "label"]
    cells = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")))
    n, total = cells.agg(F.count(F.lit(1)), F.sum("rows")).first()
    if total <= FEW_ROWS or n * trees > MOST_SUMS:
        return _grown(model.transform(rows).select("features", "label"), classes, trees, depth, seed)
    cells = cut(numbered(cells.drop("rows"), keys, "cell"))
    data = cut(model.transform(_drawn(rows, cells, n, keys, trees, seed)).select("features", "drawn", *["label"] * classes)).coalesce(4).persist()
    kind, subset = (RandomForestClassifier, "sqrt") if classes else (RandomForestRegressor, "onethird")  # what a forest of many trees takes

    def grow(t: int) -> np.ndarray:
        weight, label = F.col("drawn")[t], F.col("label") if classes else F.col("drawn")[trees + t] / F.col("drawn")[t]
        own = data.where(weight > 0).select("features", label.alias("label"), weight.alias("weight"))
        tree = kind(maxDepth=depth, seed=seed + t, numTrees=1, bootstrap=False, featureSubsetStrategy=subset, weightCol="weight")
        return tree.fit(own).featureImportances.toArray()

    try:
        with ThreadPool(4) as pool:
            found = np.sum(pool.map(inheritable_thread_target(rows.sparkSession)(grow), range(trees)), axis=0)
    finally:
        data.unpersist()
    return found / found.sum() if found.any() else found


def _distinct(df: DataFrame, columns: list[str]) -> list[int]:
    return list(df.agg(*[F.count_distinct(name(c)) for c in columns], F.lit(0)).first())[: len(columns)]


def encoded_importances(df: DataFrame, target: str, numbers: list[str], categories: list[str], trees: int = 1, depth: int = 5, seed: int = 42) -> DataFrame:
    """(column, feature, importance): importances of a tree or forest over the numbers and one-hot categories, `feature` counting
    a column's features from 0 (the categories' values from the second one on). Their sum by column is the column's importance.

    Rows without a target are left out; missing numbers are the mean, missing categories no indicator. A target of at most ten
    values is a class. No row if there is no row, no feature, or a text target of more values. Over MOST_INDICATORS values of all
    categories are an error: such columns are keys, which no model over their indicators can use.
    """
    if (n := sum(_distinct(df, categories))) > MOST_INDICATORS:
        raise ValueError(f"{n} values of {categories} are too many for indicators")
    label, classes = _label(df, target)
    rows, model, sources = _indicators(df, label, numbers, categories)
    grown = [] if model is None else _forest(rows, model, classes, trees, depth, seed) if trees > 1 else _grown(model.transform(rows).select("features", "label"), classes, 1, depth, seed)
    found: list[tuple[str, int, float]] = []
    place: dict[str, int] = {}
    for c, v in zip(sources, grown, strict=True):
        found.append((c, place.setdefault(c, 0), float(v)))
        place[c] += 1
    return df.sparkSession.createDataFrame(found, "column string, feature int, importance double")


def tree_importances(df: DataFrame, target: str, columns: list[str], trees: int = 1, seed: int = 42) -> DataFrame:
    """(column, importance) of a tree, or forest, of depth 5 over numbers; missing cells are the mean, rows without a target
    are left out; all 0 where nothing can be split."""
    found = encoded_importances(df, target, columns, [], trees, 5, seed)
    order = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "place int, column string")
    return order.join(found, "column", "left").orderBy("place").select("column", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def interaction_effects(df: DataFrame, target: str, columns: list[str], seed: int = 42) -> DataFrame:
    """(complex_interaction_ratio): 1 less twice the concentration of a tree's importances, at least 0: 1 where they are spread
    evenly. 0 for fewer than two columns; 1 if no column is of any importance."""
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([(0.0,)], "complex_interaction_ratio double")
    concentration = _lorenz(tree_importances(df, target, columns, 1, seed), "importance")
    return concentration.select(F.bround(F.greatest(F.lit(0.0), 1 - F.col("concentration") / 0.5), 4).alias("complex_interaction_ratio"))


def recursive_elimination(df: DataFrame, target: str, columns: list[str], keep: int, estimator: str = "auto", step: int = 1) -> DataFrame:
    """(column): the `keep` columns left after dropping the `step` weakest again and again: smallest coefficient, or importance."""
    left = list(columns)
    kind = estimator if estimator != "auto" else "logistic" if _is_class(df, target) else "linear"
    while len(left) > keep:
        if kind in ("linear", "logistic"):
            model = (LinearRegression() if kind == "linear" else LogisticRegression()).fit(_vectors(df, left, target))
            weight = np.abs(model.coefficients.toArray() if kind == "linear" else model.coefficientMatrix.toArray()).reshape(-1, len(left)).max(axis=0)
        else:
            weight = np.array([r.importance for r in tree_importances(df, target, left, 50).collect()])
        for i in sorted(np.argsort(weight, kind="stable")[: min(step, len(left) - keep)], reverse=True):
            left.pop(i)
    return df.sparkSession.createDataFrame([(c,) for c in left], "column string")


def principal_components(df: DataFrame, columns: list[str], n: int | float) -> DataFrame:
    """The rows with PC1, PC2 ...: n components, or as many as hold the share n of the variance. Columns are scaled by
    their population deviation; the largest loading of a component is positive. Rows with missing cells are left out."""
    r, _ = matrix(df, columns)
    values, vectors = np.linalg.eigh(r)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    count = n if isinstance(n, int) else int(np.searchsorted(np.cumsum(values) / values.sum(), n - 1e-12) + 1)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(columns))])
    rows = df.dropna(subset=columns)
    stats = rows.agg(*[x for i, c in enumerate(columns) for x in (F.avg(number(df, c)).alias(f"m{i}"), F.stddev_pop(number(df, c)).alias(f"s{i}"))])
    scaled = [(number(df, c) - F.col(f"m{i}")) / F.coalesce(F.nullif(F.col(f"s{i}"), F.lit(0.0)), F.lit(1.0)) for i, c in enumerate(columns)]
    parts = [sum((x * float(vectors[i, k]) for i, x in enumerate(scaled)), F.lit(0.0)).alias(f"PC{k + 1}") for k in range(count)]
    return rows.crossJoin(F.broadcast(stats)).select(*[name(c) for c in df.columns if c not in columns], *parts)  # one row of statistics


def select_model(df: DataFrame, target: str, columns: list[str], task: str, models: list[str] | None = None, folds: int = 5, seed: int = 42) -> DataFrame:
    """(model, score): validation score of each model after a grid search on 80 % of the rows, best first: accuracy, or
    minus the mean squared error. Models: logistic, linear, tree, forest, boosting (two classes or regression), svm."""
    classes = task != "regression"
    grids = {
        "logistic": (LogisticRegression(), {"regParam": [0.01, 0.1]}), "svm": (LinearSVC(), {"regParam": [0.01, 0.1]}), "linear": (LinearRegression(), {"regParam": [0.0, 0.1]}),
        "tree": ((DecisionTreeClassifier if classes else DecisionTreeRegressor)(seed=seed), {"maxDepth": [3, 5]}),
        "forest": ((RandomForestClassifier if classes else RandomForestRegressor)(seed=seed, numTrees=20), {"maxDepth": [3, 5]}),
        "boosting": ((GBTClassifier if classes else GBTRegressor)(seed=seed, maxIter=10), {"maxDepth": [2, 3]}),
    }
    usual = {"binary": ["logistic", "tree", "forest", "boosting", "svm"], "multiclass": ["logistic", "tree", "forest"], "regression": ["linear", "tree", "forest", "boosting"]}[task]
    train, test = _vectors(df, columns, target).randomSplit([0.8, 0.2], seed)
    metric = MulticlassClassificationEvaluator(metricName="accuracy") if classes else RegressionEvaluator(metricName="mse")
    found = []
    for m in models or usual:
        model, grid = grids[m]
        params = ParamGridBuilder()
        for k, v in grid.items():
            params = params.addGrid(model.getParam(k), v)
        fitted = CrossValidator(estimator=Pipeline(stages=[model]), estimatorParamMaps=params.build(), evaluator=metric, numFolds=folds, seed=seed, parallelism=4).fit(train)
        found.append((m, float(metric.evaluate(fitted.transform(test))) * (1 if classes else -1)))
    return df.sparkSession.createDataFrame(sorted(found, key=lambda x: -x[1]), "model string, score double")


def probabilities(predicted: DataFrame, column: str = "probability"):
    return vector_to_array(predicted[column])


def all_numeric_but(df: DataFrame, target: str) -> list[str]:
    return [c for c in numeric_columns(df) if c != target]


def synergy(df: DataFrame, target: str, columns: list[str], categories: list[str] | None = None, seed: int = 42) -> DataFrame:
    """(synergy): 1 - the variation of a forest's importances over the columns and the one-hot categories, at least 0; 0.3 for fewer
    than 20 rows and where no forest can be grown."""
    small = df.sparkSession.createDataFrame([(0.3,)], "synergy double")
    if df.limit(20).count() < 20:
        return small
    table = encoded_importances(df, target, columns, categories or [], 50, 5, seed)
    spread = F.coalesce(F.try_divide(F.stddev_pop("importance"), F.nullif(F.avg("importance"), F.lit(0.0))), F.lit(1.0))
    return table.agg(F.when(F.count("importance") == 0, 0.3).otherwise(F.bround(1 - F.least(F.lit(1.0), spread), 4)).alias("synergy"))


def high_cardinality(df: DataFrame, columns: list[str], least: int = 20) -> DataFrame:
    """(high_share, impact): share of the columns with at least `least` distinct values, and the variance of their shares of
    distinct values."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(name(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    rows = wide.select("n", F.explode(F.array(*[F.col(f"d{i}") for i in range(len(columns))])).alias("d"))
    ratio = F.when(F.col("d") >= least, F.try_divide(F.col("d").cast("double"), F.col("n")))
    return rows.agg(F.bround(F.count_if(F.col("d") >= least) / F.count(F.lit(1)), 4).alias("high_share"), F.coalesce(F.bround(F.var_pop(ratio), 4), F.lit(0.0)).alias("impact"))


def _splits(df: DataFrame, label: Column, classes: bool, columns: list[str]) -> tuple[int, bool]:
    """The number of known values of the columns in rows with a label, and whether a tree over their indicators can split these rows: whether
    the mean label (of classes: the share of one) where a column has some value, or misses it, is another than in all rows.
    Differences within 1e-8 of the deviation are of rounding."""
    known = df.where(label.isNotNull())
    labels = [(label == float(k)).cast("double") for k in range(10)] if classes else [label]
    whole = known.agg(*[f(y).alias(f"{n}{k}") for k, y in enumerate(labels) for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg), ("sd", F.stddev_pop))]).first()
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), name(c).cast("string").alias("value")) for i, c in enumerate(columns)]))
    means = known.select(cells.alias("cell"), *[y.alias(f"y{k}") for k, y in enumerate(labels)]).groupBy("cell").agg(*[F.avg(f"y{k}").alias(f"y{k}") for k in range(len(labels))])
    other = F.lit(False)
    for k in range(len(labels)):
        if whole[f"low{k}"] != whole[f"high{k}"]:
            other = other | (F.abs(F.col(f"y{k}") - whole[f"mean{k}"]) > 1e-8 * whole[f"sd{k}"])
    found = means.agg(F.count("cell.value").alias("n"), F.bool_or(other).alias("split")).first()
    return found["n"], bool(found["split"])


def high_cardinality_impact(df: DataFrame, target: str, columns: list[str], least: int = 20, most: int = 5) -> DataFrame:
    """(high_share, impact): share of the columns with at least `least` distinct values; ten times the mean importance, at most 1, of the
    indicators of the first `most` such columns, missing cells with one of their own, in a tree. No such column, or a
    text target of over ten values, gives the default 0.3; the surveyed tool reads `most` columns.

    A tree's importances sum to 1 or, where nothing can be split, to 0. So their mean needs no tree, only the number of the indicators and
    whether one splits the rows, which a mean for each value tells: exact for any number of values, in one aggregation.
    """
    distinct = _distinct(df, columns)
    high = [c for c, d in zip(columns, distinct, strict=True) if d >= least]
    label, classes = _label(df, target)
    impact = 0.3
    if high:
        n, split = _splits(df, label, classes, high[:most])
        impact = 0.3 if not n else min(1.0, 10 / n) if split else 0.0
    share = len(high) / len(columns) if columns else 0.0
    return df.sparkSession.createDataFrame([(round(share, 4), round(impact if columns else 0.0, 4))], "high_share double, impact double")


def dataset_complexity(df: DataFrame, target: str | None = None) -> DataFrame:
    """(dimensionality, sparsity_patterns, noise_level), one row of structs: rows for each feature (the target is one) and interaction potential;
    shares of zero-dominated and sparse columns; signal to noise and uncertainty. A table without rows has 0, but a signal of
    2.5 and an uncertainty of 0.1."""
    from .correlation import interaction_potential, signal_to_noise
    from .distributions import samples_per_feature, sparsity, uncertainty

    def whole(dimensionality: list, patterns: list, noise: list) -> list:
        return [F.struct(*dimensionality).alias("dimensionality"), F.struct(*patterns).alias("sparsity_patterns"), F.struct(*noise).alias("noise_level")]

    names = [["samples_per_feature", "interaction_potential"], ["zero_dominated_share", "sparse_share"], ["signal_to_noise", "uncertainty"]]
    if df.isEmpty():
        one = df.sparkSession.range(1)
        return one.select(*whole(*[[F.lit(2.5 if n == "signal_to_noise" else 0.1 if n == "uncertainty" else 0.0).alias(n) for n in group] for group in names]))
    parts = [samples_per_feature(df), interaction_potential(df), sparsity(df), signal_to_noise(df), uncertainty(df, target)]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.select(*whole(*names))
