"""Case folders, CSV columns, profile tables, vector stores and triple exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut

# Folders that may hold a case's tables, first ones first; and cells that profiling reads as missing.
CASE_FOLDERS = ["case", "rawdata", "raw_data", "data"]
READ_NA = ["", " ", "?", "-", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "#N/A", "<NA>"]


def list_case_tables(spark: SparkSession, root: str) -> DataFrame:
    """(case, path, length) of the non-empty CSV files of each case folder under the root: of the first of CASE_FOLDERS
    that has any, else of all folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root).select("path", "length").where("length > 0")
    below = F.regexp_extract("path", f"{root.rstrip('/').rpartition(':')[2]}/([^/]+)/(.*)$", 1)
    folder = F.regexp_extract("path", f"{root.rstrip('/').rpartition(':')[2]}/[^/]+/(?:([^/]+)/)?", 1)
    priority = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in CASE_FOLDERS]), folder), F.lit(0).cast("long")), F.lit(len(CASE_FOLDERS) + 1))
    ranked = files.select(below.alias("case"), "path", "length", priority.alias("priority")).where("case <> ''")
    best = ranked.withColumn("best", F.min("priority").over(Window.partitionBy("case")))
    return best.where("priority = best").select("case", "path", "length")


def read_table(spark: SparkSession, path: str, na_values: list[str] = READ_NA, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file, read once: cells of na_values are null; columns whose known cells are all numbers become long or
    double. Malformed rows are kept in `_corrupt_record` where there are any."""
    raw = spark.read.option("header", "true").option("mode", "PERMISSIVE").option("encoding", encoding).option("multiLine", "true").option("escape", '"').csv(path)
    known = lambda c: F.when(~F.col(f"`{c}`").isin(na_values), F.col(f"`{c}`"))
    checks = raw.agg(
        *[x for i, c in enumerate(raw.columns) for x in (F.count(known(c)).alias(f"n{i}"), F.count(known(c).try_cast("long")).alias(f"l{i}"), F.count(known(c).try_cast("double")).alias(f"d{i}"))]
    ).first()

    def kind(i: int) -> str:
        n = checks[f"n{i}"]
        return "string" if not n or checks[f"d{i}"] < n else "long" if checks[f"l{i}"] == n else "double"

    return raw.select(*[known(c).try_cast(kind(i)).alias(c) for i, c in enumerate(raw.columns)])


def read_case_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of whole text files; bytes that aren't UTF-8 are read as Latin-1."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"))


def write_profiles(profiles: DataFrame, path: str, kind: str = "parquet") -> None:
    """Column profiles in folders by data type, with the md5 of the column id as a key."""
    profiles.withColumn("key", F.md5("column_id")).write.partitionBy("data_type").format(kind).save(path)


def load_profiles(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(kind).load(path)


def skip_existing(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows whose key's md5 isn't in old(key_md5)."""
    return new.withColumn("key_md5", F.md5(key)).join(old.select("key_md5"), "key_md5", "left_anti").drop("key_md5")


def upsert_vectors(new: DataFrame, old: DataFrame, id_col: str = "id") -> DataFrame:
    """old and those rows of new, one for each id, that it lacks."""
    return old.unionByName(new.dropDuplicates([id_col]).join(old.select(id_col), id_col, "left_anti").select(*old.columns))


def copy_holdout(vectors: DataFrame, test: DataFrame, key: str = "dataset_name") -> DataFrame:
    """The vector table without the test datasets."""
    return vectors.join(test.select(key).distinct(), key, "left_anti")


def _literal(c: Column) -> Column:
    out = c
    for sign, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(sign), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _iri(c: str) -> Column:
    return F.concat(F.lit("<"), F.col(c), F.lit(">"))


def _object() -> Column:
    """The object o of a triple by its o_type: iris in brackets, numbers typed and rounded to three decimals, texts escaped."""
    double = F.col("o").try_cast("double")
    number = F.when(F.isnan(double), F.lit('"NaN"^^<http://www.w3.org/2001/XMLSchema#double>')).when(F.abs(double) == float("inf"), F.concat(F.lit('"'), F.when(double > 0, "INF").otherwise("-INF"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#double>'))).otherwise(F.bround(double, 3).cast("string"))
    return F.when(F.col("o_type") == "iri", _iri("o")).when(F.col("o_type") == "number", number).otherwise(_literal(F.col("o")))


def triple_lines(triples: DataFrame) -> DataFrame:
    """(line) of triples (s, p, o, o_type, certainty); a certainty makes the triple the quoted subject of a second statement."""
    plain = F.concat_ws(" ", _iri("s"), _iri("p"), _object())
    scored = F.concat(F.lit("<< "), plain, F.lit(" >> <withCertainty> "), F.bround("certainty", 3).cast("string"), F.lit(" ."))
    lines = F.when(F.col("certainty").isNull(), F.array(F.concat(plain, F.lit(" .")))).otherwise(F.array(F.concat(plain, F.lit(" .")), scored))
    return triples.select(F.explode(lines).alias("line"))


def turtle_blocks(triples: DataFrame, most: int = 1000) -> DataFrame:
    """(block) of the distinct triples (s, p, o, o_type) without nulls: a subject's predicates, each with its objects, as one
    Turtle block in the order of the signs. A subject of over `most` triples gets several blocks, so no group is unbounded.

    Subjects of at most `most` rows, repeats included, need no count of their distinct triples: these meet in the set of a subject, in
    one exchange. Rows are counted by the subjects' hashes, which take little room; only subjects of a hash with more rows are counted and dealt.
    """
    many = cut(triples.dropna(subset=["s", "p", "o"]).groupBy(F.xxhash64("s").alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("h"))
    rows = triples.select("s", "p", _object().alias("o")).dropna()
    if many.isEmpty():
        return _blocks(rows, "s")
    hashed = rows.withColumn("h", F.xxhash64("s"))
    distinct = hashed.join(many, "h", "left_semi").drop("h").distinct()
    sizes = distinct.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / most).alias("n"))
    dealt = distinct.join(sizes, "s").withColumn("part", F.pmod(F.xxhash64("p", "o"), "n"))
    return _blocks(hashed.join(many, "h", "left_anti"), "s").union(_blocks(dealt, "s", "part"))


def _blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """(block) of each group of rows (s, p, o): one set of a group's pairs, whose objects are then listed by predicate."""
    pairs = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("p", "o"))).alias("pairs"))
    objects = lambda p: F.array_join(F.transform(F.filter("pairs", lambda x: x.p == p), lambda x: x.o), ", ")
    said = F.transform(F.array_distinct("pairs.p"), lambda p: F.concat(F.lit("<"), p, F.lit("> "), objects(p)))
    return pairs.select(F.concat(_iri("s"), F.lit(" "), F.array_join(F.sort_array(said), " ;\n\t"), F.lit(" .")).alias("block"))


def pipeline_triples(pipelines: DataFrame, calls: DataFrame) -> DataFrame:
    """(s, p, o, o_type) of pipelines (pipeline_id, dataset_id, score) and calls (pipeline_id, component): the data set that a
    pipeline is part of, the libraries it calls, and its score unless that is 0 or null."""
    s = lambda: F.concat(F.lit("pipeline/"), F.col("pipeline_id").cast("string")).alias("s")
    said = lambda df, p, o, kind: df.select(s(), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_type"))
    scored = pipelines.where("score <> 0")
    library = F.split_part("component", F.lit("."), F.lit(1))
    return said(scored, "hasScore", F.col("score"), "number").union(said(pipelines, "isPartOf", F.col("dataset_id"), "iri")).union(said(calls, "callsLibrary", library, "iri"))


def export_triples(triples: DataFrame, path: str) -> None:
    triple_lines(triples).write.text(path)


def graph_of_file(lines: DataFrame) -> DataFrame:
    """(path, graph): the parent path of the first statement uri of each file, of rows (path, n, line)."""
    uri = F.regexp_extract("line", r"<([^>]+)/s\d+>", 1)
    return lines.withColumn("uri", uri).where("uri <> ''").groupBy("path").agg(F.min_by("uri", "n").alias("graph"))


def read_database(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, columns: list[str] | None = None, where: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A table of a relational database, read by `partitions` tasks, each with its range of the whole-number column `key`; rows outside
    of `bounds` (found by a query if not given), and those without a key, are read by the first and last. Columns and the filter go to the database.
    """
    chosen = ", ".join(columns) if columns else "*"
    source = f"(SELECT {chosen} FROM {table}{f' WHERE {where}' if where else ''}) t"
    reader = spark.read.format("jdbc").options(url=url, **(options or {}))
    if key is None:
        return reader.option("dbtable", source).load()
    if bounds is None:
        low, high = reader.option("dbtable", f"(SELECT min({key}) AS low, max({key}) AS high FROM {table}{f' WHERE {where}' if where else ''}) b").load().first()
        if low is None:
            return reader.option("dbtable", source).load()
        bounds = (int(low), int(high) + 1)
    return reader.option("dbtable", source).options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)).load()
