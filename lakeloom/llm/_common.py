"""Shared folders, written intermediate tables and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the shared one that the session names in spark.checkpoint.dir.

    Only a local session without that setting (a test) gets a temporary folder; elsewhere the setting is needed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lakeloom-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/lakeloom-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """Tables that `written` makes inside are removed at the end; those with `keep` belong to what is around it."""
    folder = shared_dir(spark)
    token = _SCRATCH.set((*_SCRATCH.get(), folder))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of tables, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """df as a table written in the shared folder: lineage ends there, and losing executors costs nothing."""
    folders = _SCRATCH.get()[:-1] if keep else _SCRATCH.get()
    path = f"{folders[-1]}/{uuid.uuid4().hex}" if folders else shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let rows with texts reach Python in batches of `most` bytes, where the session has a larger bound (64 MB by default): a task
    holds a batch several times, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if now.rstrip("b").isdigit() and not 0 < int(now.rstrip("b")) <= most:
        spark.conf.set(key, f"{most}b")


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def pieces(batch: pa.RecordBatch, text: int, most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about `most` bytes of text each, with their texts; null is the empty text."""
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= most or i + 1 == len(sizes):
            part = batch.slice(start, i + 1 - start)
            yield part, [x or "" for x in part.column(text).to_pylist()]
            start, total = i + 1, 0


def numbered(df: DataFrame, by: list, as_name: str) -> DataFrame:
    """df, which needs no ties in `by` broken, with the 0-based place of each row in that order, in a column `as_name`.

    The sorted rows are written once, so that what was numbered stays so. The driver sees one count for each partition.
    """
    ordered = written(df.orderBy(*by).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before, total = [], 0
    for p, n in sorted(tuple(r) for r in ordered.groupBy(part).count().collect()):
        before.append((p, total - (p << 33)))
        total += n
    base = df.sparkSession.createDataFrame(before, "_part long, _base long")  # a row for each partition
    return ordered.join(F.broadcast(base), part == F.col("_part")).select(*df.columns, (F.col("_id") + F.col("_base")).alias(as_name))


def sampled(docs: DataFrame, share: float, purpose: str) -> DataFrame:
    """About a share of the rows of docs, drawn row by row: rows with equal ids, or none, are drawn apart, and reruns over the same
    files agree. The draw is by 63 bits of a hash of the row's file and its place there."""
    if share >= 1:
        return docs
    key = free_name("_key", docs.columns)
    return keyed(docs, key).where(F.shiftrightunsigned(F.xxhash64(key, F.lit(purpose)), 1) < int(share * 2**63)).drop(key)


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns of docs, dots and quotes in their names included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def free_name(name: str, *taken: list[str]) -> str:
    """name, or name with underscores before it, unlike all the names taken (letter case aside)."""
    used = {t.lower() for names in taken for t in names}
    while name.lower() in used:
        name = f"_{name}"
    return name


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a key of each row in a column `name`: its file and its place there. Rows of no file are written to one first."""
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select("*", F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias(name))
    except AnalysisException:
        return keyed(written(docs, keep=True), name)
