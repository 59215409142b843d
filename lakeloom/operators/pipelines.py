"""Analytics over recorded pipelines.

Tables: pipelines(pipeline_id, title, author, votes, written_on, score, dataset_id), calls(pipeline_id, call_type,
component), tags(pipeline_id, tag), params(pipeline_id, component, parameter, value), statements(pipeline_id, n, phase, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import library_of, library_prefixes, module_of
from ..functions.metric import top_pairs


def pipelines_info(pipelines: DataFrame, author: str | None = None) -> DataFrame:
    """Pipelines with a score, by votes."""
    out = pipelines.where("score IS NOT NULL")
    return (out.where(F.col("author") == author) if author is not None else out).orderBy(F.col("votes").desc(), "pipeline_id")


def most_recent_pipeline(pipelines: DataFrame, dataset: str) -> DataFrame:
    return pipelines.where(F.col("dataset_id") == dataset).orderBy(F.col("written_on").desc(), "pipeline_id").limit(1)


def top_k_pipelines(pipelines: DataFrame, k: int) -> DataFrame:
    """The k best-scored pipelines of every dataset; ties by id."""
    w = Window.partitionBy("dataset_id").orderBy(F.col("score").desc(), "pipeline_id")
    return pipelines.where("score IS NOT NULL").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("dataset_id", "place", "pipeline_id", "score")


def library_usage(calls: DataFrame, k: int) -> DataFrame:
    """(library, n_pipelines, share): distinct pipelines for each library, share of the sum over all, top k."""
    used = calls.select("pipeline_id", library_of(F.col("component")).alias("library")).where("library IS NOT NULL")
    counts = used.groupBy("library").agg(F.count_distinct("pipeline_id").alias("n_pipelines"))
    total = counts.agg(F.sum("n_pipelines").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("library", "n_pipelines", F.bround(F.col("n_pipelines") / F.col("total"), 4).alias("share")).orderBy(F.col("n_pipelines").desc(), "library").limit(k)


def top_modules(calls: DataFrame, pattern: str, k: int, without: str | None = None) -> DataFrame:
    """(module, n): calls by module for components that match, top k. Ties by name."""
    hit = calls.where(F.col("component").rlike(f"(?i){pattern}"))
    if without:
        hit = hit.where(~F.col("component").rlike(f"(?i){without}"))
    counts = hit.select(module_of(F.col("component")).alias("module")).where("module IS NOT NULL").groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "module").limit(k)


# Tasks and the part of a component's name that tells of them.
TASK_WORDS = {"classification": "classifi", "clustering": "cluster", "visualization": "plot", "regression": "regress"}


def task_libraries(calls: DataFrame, task: str, k: int) -> DataFrame:
    """(library, module, pipeline_id) of calls whose component tells of the task, each once, of the k libraries that most
    pipelines call for it; ties by name."""
    hit = calls.where(F.col("component").rlike(f"(?i){TASK_WORDS[task]}")).select(library_of(F.col("component")).alias("library"), module_of(F.col("component")).alias("module"), "pipeline_id").where("library IS NOT NULL").distinct()
    top = hit.groupBy("library").agg(F.count_distinct("pipeline_id").alias("n")).orderBy(F.col("n").desc(), "library").limit(k)
    return hit.join(top.select("library"), "library", "left_semi")


def tagged_pipelines(pipelines: DataFrame, tags: DataFrame, pattern: str = "deep learning") -> DataFrame:
    """Pipelines with a tag that matches, each once, by score."""
    return pipelines.join(tags.where(F.col("tag").rlike(f"(?i){pattern}")).select("pipeline_id"), "pipeline_id", "left_semi").orderBy(F.col("score").desc(), "pipeline_id")


def transformations(calls: DataFrame, reads: DataFrame, pipelines: DataFrame, pattern: str = "preprocessing") -> DataFrame:
    """(transformation, pipeline_id, table_name, dataset_id): components that match, called by pipelines that read the
    table; reads: (pipeline_id, table_name)."""
    used = calls.where(F.col("component").rlike(f"(?i){pattern}")).select("pipeline_id", F.col("component").alias("transformation")).distinct()
    return used.join(reads.select("pipeline_id", "table_name").distinct(), "pipeline_id").join(pipelines.select("pipeline_id", "dataset_id"), "pipeline_id").select("transformation", "pipeline_id", "table_name", "dataset_id")


def pipeline_count(pipelines: DataFrame) -> DataFrame:
    return pipelines.agg(F.count_distinct("pipeline_id").alias("n_pipelines"))


def insight_code(insight_statements: DataFrame, statements: DataFrame, insight) -> DataFrame:
    """(n, text): the statements of an insight, in order. insight_statements: (insight_id, pipeline_id, n)."""
    own = insight_statements.where(F.col("insight_id") == insight).select("pipeline_id", "n").distinct()
    return statements.join(own, ["pipeline_id", "n"]).select("n", "text").orderBy("n")


def insights_for_cases(cases: DataFrame, pipelines: DataFrame, insights: DataFrame, k: int = 3) -> DataFrame:
    """(dataset_id, place, pipeline_id, insights): the k best pipelines of each case (dataset_id) with their sorted insight
    ids; a pipeline without insights has none."""
    best = top_k_pipelines(pipelines.join(cases.select("dataset_id").distinct(), "dataset_id", "left_semi"), k)
    own = insights.groupBy("pipeline_id").agg(F.sort_array(F.collect_set("insight_id")).alias("insights"))
    return best.join(own, "pipeline_id", "left").select("dataset_id", "place", "pipeline_id", "insights")


def pipelines_calling(calls: DataFrame, components: list[str]) -> DataFrame:
    """(pipeline_id) of pipelines that call all the components."""
    return calls.where(F.col("component").isin(components)).groupBy("pipeline_id").agg(F.count_distinct("component").alias("n")).where(F.col("n") == len(set(components))).select("pipeline_id")


def search_components(calls: DataFrame, pipelines: DataFrame, dataset: str, components: DataFrame) -> DataFrame:
    """(pipeline_id, component): which of the listed components the dataset's pipelines call."""
    return calls.join(components, "component", "left_semi").join(pipelines.where(F.col("dataset_id") == dataset).select("pipeline_id"), "pipeline_id", "left_semi").select("pipeline_id", "component").distinct()


def hyperparameters(calls: DataFrame, params: DataFrame, component: str) -> DataFrame:
    """(pipeline_id, parameter, value) given to the component."""
    used = calls.where(F.col("component") == component).select("pipeline_id", "component").distinct()
    return params.join(used, ["pipeline_id", "component"], "left_semi").select("pipeline_id", "parameter", "value").distinct()


def pipelines_by_tag(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count_distinct("pipeline_id").alias("n_pipelines"))


def task_totals(tags: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """(task, n): tags that match each task's pattern; a pipeline may count in several."""
    wide = tags.agg(*[F.count_if(F.col("tag").rlike(f"(?i){p}")).alias(t) for t, p in tasks.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("n")) for t in tasks])).alias("r")).select("r.*")


def phase_blocks(statements: DataFrame, shown: int = 2, signs: int = 200) -> DataFrame:
    """(pipeline_id, block, phase, first_n, last_n, size, statements, snippets): runs of statements of one phase whose numbers follow each
    other; block numbers count from 1 in a pipeline. statements: the run as s3-s7, or s3; snippets: (n, text) of its first and last `shown`
    statements, each once, in order, with the first `signs` characters of their texts. Numbers are distinct in a pipeline."""
    w = Window.partitionBy("pipeline_id").orderBy("n")
    follows = F.lag("phase").over(w).eqNullSafe(F.col("phase")) & F.coalesce(F.lag("n").over(w) + 1 == F.col("n"), F.lit(False))
    blocks = statements.withColumn("start", F.when(follows, 0).otherwise(1)).withColumn("block", F.sum("start").over(w))
    inside = Window.partitionBy("pipeline_id", "block")
    placed = blocks.withColumn("ahead", F.row_number().over(inside.orderBy("n"))).withColumn("after", F.row_number().over(inside.orderBy(F.desc("n"))))
    sample = F.when((F.col("ahead") <= shown) | (F.col("after") <= shown), F.struct("n", F.substring("text", 1, signs).alias("text")))
    whole = placed.groupBy("pipeline_id", "block").agg(
        F.first("phase").alias("phase"), F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list(sample)).alias("snippets"),
    )
    ends = F.transform(F.array_distinct(F.array("first_n", "last_n")), lambda n: F.concat(F.lit("s"), n.cast("string")))
    return whole.select("pipeline_id", "block", "phase", "first_n", "last_n", "size", F.array_join(ends, "-").alias("statements"), "snippets")


def library_edges(calls: DataFrame) -> DataFrame:
    """(parent, child) edges of the trees of all dotted components, each once."""
    paths = calls.select(library_prefixes(F.col("component")).alias("p"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.element_at("p", i).alias("parent"), F.element_at("p", i + 1).alias("child")))
    return paths.where(F.size("p") > 1).select(F.explode(pairs).alias("e")).select("e.*").distinct()


_DOTTED = r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$"


def import_edges(sources: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, library), each once: what a Python source text imports, with all its parents; `from a.b import c` imports a.b.c.

    Several names, `as`, names in brackets over lines, lines carried on by a backslash, several statements a line and comments are
    understood. Of `import *` the module counts; relative imports name no library and are left out, as is what isn't a dotted name.
    Statements inside texts in quotes are taken for imports too. A null text imports nothing.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), r"\\\r?\n", " "), r"#[^\r\n]*", "")
    named = lambda c: F.transform(F.split(F.regexp_replace(c, r"[()]", " "), ","), lambda n: F.regexp_replace(F.regexp_replace(n, r"^\s+|\s+$", ""), r"\s+as\s+\w+$", ""))
    every = r"(?md)(?:^|;)[ \t]*"
    plain = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(every + r"import[ \t]+([^\r\n;]+)"), F.lit(1)), named))
    of = every + r"from[ \t]+([\w.]+)[ \t]+import[ \t]*(\([^)]*\)|[^\r\n;(]+)"
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(of), F.lit(i)).alias(k) for i, k in ((1, "m"), (2, "n"))])
    below = F.flatten(F.transform(parts, lambda p: F.transform(named(p["n"]), lambda n: F.when(n == "*", p["m"]).otherwise(F.concat(p["m"], F.lit("."), n)))))
    paths = F.array_distinct(F.filter(F.concat(plain, below), lambda p: p.rlike(_DOTTED)))
    prefixes = F.array_distinct(F.flatten(F.transform(paths, library_prefixes)))
    return sources.select(id_col, F.explode(prefixes).alias("library")).distinct()


def kernel_rollup(versions: DataFrame, scores: DataFrame, tags: DataFrame) -> DataFrame:
    """The latest version of each kernel with its best score and its tags: scores and tags are grouped before the joins."""
    w = Window.partitionBy("kernel_id").orderBy(F.col("version_id").desc())
    latest = versions.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    best = scores.groupBy("version_id").agg(F.max("score").alias("best_score"))
    names = tags.groupBy("kernel_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))
    return latest.join(best, "version_id", "left").join(names, "kernel_id", "left")


# The languages of scripts and notebooks in Python.
PYTHON_LANGUAGES = (2, 9)


def notebook_rollup(tables: dict[str, DataFrame], languages: tuple[int, ...] = PYTHON_LANGUAGES, sources: list[str] | None = None) -> DataFrame:
    """(kernel_version_id, kernel_id, title, creation_date, data_source, author, kernel_name, votes, tags, score): the current version of each
    kernel in one of the languages that reads a source, with the largest of its sources' names, its tags in order and its best score.

    tables: versions(id, kernel_id, title, creation_date, author_id, language_id), kernels(id, name, votes, current_version_id),
    languages(id), version_sources(version_id, source_id), sources(id, name), users(id, name), kernel_tags(kernel_id, tag_id), tags(id,
    name), submissions(version_id, score). A kernel without tags or scores keeps null there; one without a known author, language or
    source is left out. With `sources`, only these sources' names count.

    What fans out (sources, tags, scores) is grouped before the joins, so no join multiplies rows, and the filter by
    language and current version comes first, so the groups are joined to the rows that stay alone.
    """
    t = tables
    kernels = t["kernels"].select(F.col("id").alias("kernel_id"), F.col("name").alias("kernel_name"), "votes", F.col("current_version_id").alias("kernel_version_id"))
    wanted = t["versions"].where(F.col("language_id").isin(*languages)).select(F.col("id").alias("kernel_version_id"), "kernel_id", "title", "creation_date", "author_id", "language_id")
    current = wanted.join(kernels, ["kernel_id", "kernel_version_id"]).join(t["languages"].select(F.col("id").alias("language_id")), "language_id", "left_semi")
    named = t["sources"].where(F.col("name").isin(*sources)) if sources else t["sources"]
    read = t["version_sources"].join(named.select(F.col("id").alias("source_id"), "name"), "source_id").groupBy(F.col("version_id").alias("kernel_version_id")).agg(F.max("name").alias("data_source"))
    users = t["users"].select(F.col("id").alias("author_id"), F.col("name").alias("author"))
    tags = t["kernel_tags"].join(t["tags"].select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy("kernel_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("tags"))
    best = t["submissions"].groupBy(F.col("version_id").alias("kernel_version_id")).agg(F.max("score").alias("score"))
    whole = current.join(read, "kernel_version_id").join(users, "author_id").join(tags, "kernel_id", "left").join(best, "kernel_version_id", "left")
    return whole.select("kernel_version_id", "kernel_id", "title", "creation_date", "data_source", "author", "kernel_name", "votes", "tags", "score")


def insights_of(insights: DataFrame, spans: DataFrame) -> DataFrame:
    """Insights with the phases they span, in order."""
    phases = spans.groupBy("insight_id").agg(F.array_join(F.sort_array(F.collect_set("phase")), ",").alias("phases"))
    return insights.join(phases, "insight_id", "left")


def flatten_insights(pipelines: DataFrame, by_phase: str, across: str) -> DataFrame:
    """(pipeline_id, phase, insight_id) of a map phase -> ids and of a list of ids over several phases; empty ids are dropped."""
    single = pipelines.select("pipeline_id", F.explode(by_phase).alias("phase", "ids")).select("pipeline_id", "phase", F.explode("ids").alias("insight_id"))
    cross = pipelines.select("pipeline_id", F.lit("cross").alias("phase"), F.explode(across).alias("insight_id"))
    return single.union(cross).where("insight_id <> ''")


def weighted_top_k(base: DataFrame, insight: DataFrame, w_base: float, w_insight: float, k: int) -> DataFrame:
    """(id, score): the k best sums of both weighted scores; a missing one is 0."""
    both = base.join(insight, "id", "full").select("id", (w_base * F.coalesce("base", F.lit(0.0)) + w_insight * F.coalesce("insight", F.lit(0.0))).alias("score"))
    return both.orderBy(F.col("score").desc(), "id").limit(k)


def recall_rerank(base: DataFrame, insight: DataFrame, k: int) -> DataFrame:
    """(id, base, insight): the max(10, 3k) best by base, of these the k best by insight, then base."""
    recalled = base.orderBy(F.col("base").desc(), "id").limit(max(10, 3 * k))
    return recalled.join(insight, "id", "left").fillna(0.0, ["insight"]).orderBy(F.col("insight").desc(), F.col("base").desc(), "id").limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column, x_norm: Column | None = None, y_norm: Column | None = None) -> Column:
    """Cosine of two arrays; null if one has no length. Where rows are in many pairs, give their norms, sqrt(dot(x, x))."""
    norms = [F.sqrt(dot(a, a)) if n is None else n for a, n in ((x, x_norm), (y, y_norm))]
    return F.try_divide(dot(x, y), F.nullif(norms[0] * norms[1], F.lit(0.0)))


def l2_score(x: Column, y: Column) -> Column:
    """1 - Euclidean distance, three decimals."""
    return F.bround(1 - F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0).cast("double"), lambda s, v: s + v.cast("double"))), 3)


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, score): the k rows with the largest cosine to the query vector; ties to the smaller id."""
    q = F.array(*[F.lit(float(v)) for v in query])
    return vectors.select(id_col, cosine(F.col(vector_col), q).alias("score")).where("score IS NOT NULL").orderBy(F.col("score").desc(), id_col).limit(k)


def nearest_to_all(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, place): the k rows (id, vector) with the largest cosine to each query (query_id, vector), but the row
    of the query's own id; ties to the smaller id. In blocks, as `top_pairs`."""
    one = F.lit("all").alias("group")
    found = top_pairs(queries.select("query_id", one, "vector"), vectors.select("id", one, "vector"), k + 1).where("query_id <> id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return found.withColumn("place", place).where(F.col("place") <= k)
