"""Dense places of distinct values, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def dense_ids(values: DataFrame, column: str, as_name: str) -> DataFrame:
    """values (column) with the 0-based place of each row in the column's order: a range sort, numbers inside its
    partitions, and the partitions' sizes, of which the driver sees one each. Give distinct values."""
    return numbered(values.select(column), [column], as_name)


def numbered(df: DataFrame, by: list[str], as_name: str) -> DataFrame:
    """df with the 0-based place of each row in the order of `by`, which must tell rows apart.

    The range sort is written once to the checkpoint folder, so a task that is repeated can't number its rows otherwise.
    """
    ordered = cut(df.orderBy(*by).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before, total = [], 0
    for p, n in sorted(tuple(r) for r in ordered.groupBy(part).count().collect()):
        before.append((p, total - (p << 33)))
        total += n
    base = df.sparkSession.createDataFrame(before, "_part long, _base long")
    return ordered.join(F.broadcast(base), part == F.col("_part")).select(*df.columns, (F.col("_id") + F.col("_base")).alias(as_name))
