"""Bloom filters of 64-bit hashes, built by Spark, and exact removal of rows with their help."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import columns_of, written
from ._text import mix

_U = np.uint64
MOST_BITS = 1 << 30


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(hashes + _U(i + 1)) & _U(bits - 1)) for i in range(4)]


def bloom(grams: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of the column `gram`, 64 bits or more for each up to MOST_BITS in all: number of bits, and its words."""
    n = grams.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (64 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(batch.column(0).to_numpy().view(_U), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int64)), pa.array((_U(1) << (at & _U(63))).view(np.int64))], ["word", "bit"])

    found = grams.select("gram").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, _U)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(_U)
    return bits, words


def in_bloom(hashes: np.ndarray, bits: int, words: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filter has."""
    at = np.arange(len(hashes))
    for i in range(4):
        place = mix(hashes[at] + _U(i + 1)) & _U(bits - 1)
        at = at[(words[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)]
    return at


def without(docs: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose `key` (no nulls) isn't in `rejected`, a table of distinct keys; decided exactly.

    Rows that a Bloom filter of the rejected keys doesn't have are kept as they are. Of the others, the keys alone are
    joined with `rejected`; those that the filter has wrongly, a few in a million, are joined to their rows again. So next
    to no row with its other columns is shuffled, as long as the rejected keys are under some 10 ** 8; beyond that, the filter
    fills up and more rows take the second way, with the same result.
    """
    hashed = F.xxhash64(key)
    filters = docs.sparkSession.sparkContext.broadcast(bloom(rejected.select(hashed.alias("gram"))))

    @F.arrow_udf("boolean")
    def has(hashes: pa.Array) -> pa.Array:
        out = np.zeros(len(hashes), bool)
        out[in_bloom(hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(_U), *filters.value)] = True
        return pa.array(out)

    wrongly = written(docs.select(key).where(has(hashed)).join(rejected.select(key), key, "left_anti"), keep=True)
    return docs.where(~has(hashed)).union(docs.where(has(hashed)).join(wrongly, key, "left_semi").select(*columns_of(docs)))
