"""Further registered queries: vectors in blocks, joint charts, paths by columns, cleaning along rows, the rollup of notebooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import missing as C
from ..operators import pipelines as P
from ..operators import time_space as Z
from .queries import LABEL_EDGES, query, rounded, schema

_COS = "round_even(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12)"


@query(f"""SELECT query_id, id, round_even(score, 4) AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place
FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)) WHERE place <= 5""")
def v2_nearest(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(P.nearest_to_all(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows, 5), 4, "score")


@query("""WITH k AS (SELECT l_quantity AS x, l_discount AS y, l_extendedprice AS z, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice) AS n FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_extendedprice IS NOT NULL QUALIFY n <= 1000)
SELECT round_even(-corr(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), abs(a.z - b.z)), 4) AS spatial_correlation FROM k a JOIN k b ON a.n < b.n""")
def x4_spatial_correlation(t):
    return Z.spatial_correlation(t.lineitem, "l_quantity", "l_discount", "l_extendedprice", ["l_orderkey", "l_linenumber"])


# ---- charts: lines of orders are what was drawn together, tables asked about are sevenths of the embeddings

_CHARTS = """o AS (SELECT DISTINCT l_orderkey AS eda_id, l_partkey AS column_id, CASE WHEN l_orderkey % 2 = 0 THEN 'bivariate' ELSE 'multivariate' END AS analysis_type, CASE WHEN l_orderkey % 3 = 0 THEN 'scatter' WHEN l_orderkey % 11 = 0 THEN 'heatmap' ELSE 'line' END AS chart_type FROM lineitem WHERE l_partkey IN (SELECT vec_id FROM embeddings)),
c AS (SELECT vec_id AS column_id, label AS data_type, embedding::DOUBLE[] AS v FROM embeddings), own AS (SELECT vec_id % 7 AS query_table, 'c' || vec_id AS name, label AS data_type, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 = 0),
m AS (SELECT vec_id % 7 AS query_table, 'c' || vec_id AS main_column, vec_id + 1 AS similar_id FROM embeddings WHERE vec_id % 10 = 0)"""


def _charts(t):
    line = t.lineitem.join(t.embeddings.select(F.col("vec_id").alias("l_partkey")), "l_partkey", "left_semi")
    order = F.col("l_orderkey")
    operations = line.select(
        order.alias("eda_id"), F.col("l_partkey").alias("column_id"), F.when(order % 2 == 0, "bivariate").otherwise("multivariate").alias("analysis_type"),
        F.when(order % 3 == 0, "scatter").when(order % 11 == 0, "heatmap").otherwise("line").alias("chart_type"),
    )
    tenth = t.embeddings.where("vec_id % 10 = 0").select((F.col("vec_id") % 7).alias("query_table"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("name"), F.col("label").alias("data_type"), F.col("embedding").alias("vector"), F.col("vec_id"))
    mains = tenth.select("query_table", F.col("name").alias("main_column"), (F.col("vec_id") + 1).alias("similar_id"))
    columns = t.embeddings.select(F.col("vec_id").alias("column_id"), F.col("label").alias("data_type"), F.col("embedding").alias("vector"))
    return K.recommend_joint_charts(mains, operations, columns, tenth.drop("vec_id"))


@query(f"""WITH {_CHARTS}, p AS (SELECT m.query_table, main_column, a.eda_id, b.column_id AS partner_id, a.analysis_type, a.chart_type FROM m JOIN o a ON a.column_id = similar_id JOIN o b ON b.eda_id = a.eda_id AND b.column_id <> similar_id WHERE a.analysis_type = 'bivariate'),
r AS (SELECT p.*, name, row_number() OVER (PARTITION BY p.query_table, main_column, eda_id, partner_id ORDER BY -list_cosine_similarity(c.v, own.v), name) AS n FROM p JOIN c ON c.column_id = partner_id JOIN own ON own.query_table = p.query_table AND own.data_type = c.data_type AND name <> main_column)
SELECT query_table, main_column, eda_id, partner_id, analysis_type, chart_type, list_sort([main_column, name]) AS chart_columns FROM r WHERE n = 1""")
def q12_charts_of_two(t):
    return _charts(t).where("analysis_type = 'bivariate'")


@query()
def q12_charts_of_many(t):
    return _charts(t).where("analysis_type = 'multivariate'")


_STEPS = f"WITH {LABEL_EDGES}, s AS (SELECT t1 AS src, t2 AS dst, column_id_1 AS a, column_id_2 AS b, certainty AS c FROM label_edges UNION ALL SELECT t2, t1, column_id_2, column_id_1, certainty FROM label_edges)"


@query(f"""{_STEPS} SELECT x.src AS t0, x.dst AS t1, y.dst AS t2, z.dst AS t3, x.a AS a0, x.b AS b0, y.a AS a1, y.b AS b1, z.a AS a2, z.b AS b2, round_even(x.c * y.c * z.c, 4) AS certainty
FROM s x JOIN s y ON y.src = x.dst JOIN s z ON z.src = y.dst WHERE x.src = 'lake/tpch/orders' AND z.dst = 'lake/tpch/supplier'""")
def q8_column_paths(t):
    columns = schema(t)
    paths = K.join_paths(K.label_similarity(columns, 0.75, "^[a-z]+_"), columns, "lake/tpch/orders", "lake/tpch/supplier", 3, "label")
    steps = [F.get("steps", F.lit(i))[x].alias(f"{x}{i}") for i in range(3) for x in "ab"]
    return rounded(paths.select("t0", "t1", "t2", "t3", *steps, "certainty"), 4, "certainty")


# Equal (l_orderkey, l_linenumber) may be several lines, so a line's place is in the order of all its cells.
_PLACED = """p AS (SELECT l_quantity AS q, nullif(l_discount, 0.05) AS d, nullif(l_tax, 0.0) AS t, CASE WHEN l_quantity > 3 THEN l_extendedprice END AS e,
row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS n FROM lineitem)"""


def _along(i: int, cells: list[str]) -> str:
    """The i-th cell of a row, interpolated along the row."""
    before = "coalesce(" + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {{'n': {j}, 'x': {c}::DOUBLE}} END" for j, c in reversed([*enumerate(cells)][:i])) + ", NULL)" if i else "NULL::STRUCT(n INT, x DOUBLE)"
    after = "coalesce(" + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {{'n': {j}, 'x': {c}::DOUBLE}} END" for j, c in [*enumerate(cells)][i + 1 :]) + ", NULL)" if i + 1 < len(cells) else "NULL::STRUCT(n INT, x DOUBLE)"
    return f"coalesce({cells[i]}::DOUBLE, ({before}).x + (({after}).x - ({before}).x) * ({i} - ({before}).n) / (({after}).n - ({before}).n), ({before}).x) AS {cells[i]}"


_CELLS = ["d", "q", "t", "e"]


def _down(c: str) -> str:
    return f"""last_value({c} IGNORE NULLS) OVER b AS {c}0, last_value(CASE WHEN {c} IS NOT NULL THEN n END IGNORE NULLS) OVER b AS {c}n0, first_value({c} IGNORE NULLS) OVER a AS {c}1, first_value(CASE WHEN {c} IS NOT NULL THEN n END IGNORE NULLS) OVER a AS {c}n1"""


@query(f"""WITH {_PLACED}, r AS (SELECT n, {", ".join(_along(i, _CELLS) for i in range(len(_CELLS)))} FROM p), s AS (SELECT *, {", ".join(map(_down, _CELLS))} FROM r
WINDOW b AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT n, {", ".join(f"round_even(coalesce({c}, {c}0 + ({c}1 - {c}0) * (n - {c}n0) / nullif({c}n1 - {c}n0, 0), {c}0, {c}1), 6) AS {c}" for c in _CELLS)} FROM s""")
def c9_clean_interpolate(t):
    from ..functions.ranks import numbered

    by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = numbered(t.lineitem.select(*by), by, "n")
    cells = rows.select(F.nullif("l_discount", F.lit(0.05)).alias("d"), F.col("l_quantity").alias("q"), F.nullif("l_tax", F.lit(0.0)).alias("t"), F.when(F.col("l_quantity") > 3, F.col("l_extendedprice")).alias("e"), "n")
    return rounded(C.clean_interpolate(cells, "n"), 6, *_CELLS)


# ---- the rollup of notebooks, over nine tables in its roles


@query("""WITH kv AS (SELECT o_orderkey AS id, o_custkey AS kernel_id, o_orderpriority AS title, o_orderdate AS creation_date, o_custkey % 40 AS author_id, o_orderkey % 12 AS language_id FROM orders),
k AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS votes, v.id AS current_version_id FROM customer JOIN (SELECT kernel_id, max(id) AS id FROM kv GROUP BY 1) v ON v.kernel_id = c_custkey)
SELECT kv.id AS kernel_version_id, kv.kernel_id, any_value(kv.title) AS title, any_value(kv.creation_date) AS creation_date, max(p.p_name) AS data_source, max(u.s_name) AS author, max(k.name) AS kernel_name, max(k.votes) AS votes, string_agg(DISTINCT n.n_name, ',' ORDER BY n.n_name) AS tags, max(s.l_extendedprice) AS score
FROM kv JOIN k ON kv.kernel_id = k.id AND kv.id = k.current_version_id JOIN region kl ON kv.language_id = kl.r_regionkey JOIN lineitem ks ON ks.l_orderkey = kv.id JOIN part p ON p.p_partkey = ks.l_partkey JOIN supplier u ON u.s_suppkey = kv.author_id
LEFT JOIN (SELECT DISTINCT user_id, event_id % 25 AS tag FROM events) kt ON kt.user_id = k.id LEFT JOIN nation n ON n.n_nationkey = kt.tag LEFT JOIN lineitem s ON s.l_orderkey = kv.id AND s.l_quantity > 10
WHERE kv.language_id IN (1, 2) GROUP BY 1, 2""")
def p16_notebook_rollup(t):
    key = F.col
    versions = t.orders.select(key("o_orderkey").alias("id"), key("o_custkey").alias("kernel_id"), key("o_orderpriority").alias("title"), key("o_orderdate").alias("creation_date"), (key("o_custkey") % 40).alias("author_id"), (key("o_orderkey") % 12).alias("language_id"))
    current = versions.groupBy(key("kernel_id").alias("c_custkey")).agg(F.max("id").alias("current_version_id"))
    return P.notebook_rollup(
        {
            "versions": versions,
            "kernels": t.customer.join(current, "c_custkey").select(key("c_custkey").alias("id"), key("c_name").alias("name"), key("c_nationkey").alias("votes"), "current_version_id"),
            "languages": t.region.select(key("r_regionkey").alias("id")),
            "version_sources": t.lineitem.select(key("l_orderkey").alias("version_id"), key("l_partkey").alias("source_id")),
            "sources": t.part.select(key("p_partkey").alias("id"), key("p_name").alias("name")),
            "users": t.supplier.select(key("s_suppkey").alias("id"), key("s_name").alias("name")),
            "kernel_tags": t.events.select(key("user_id").alias("kernel_id"), (key("event_id") % 25).alias("tag_id")),
            "tags": t.nation.select(key("n_nationkey").alias("id"), key("n_name").alias("name")),
            "submissions": t.lineitem.where("l_quantity > 10").select(key("l_orderkey").alias("version_id"), key("l_extendedprice").alias("score")),
        },
        languages=(1, 2),
    )
