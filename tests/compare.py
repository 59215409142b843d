"""Rows of a query and of its SQL, and whether they agree."""

import decimal
import math

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(path: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return db


def plain(v, nested: bool = False):
    """A value in a form that shows all that must agree: in lists the sign of a zero too."""
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x, True) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x, True)) for k, x in v.items())
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else repr(v) if nested else v
    if isinstance(v, (int, np.integer)):
        return int(v)
    return v if isinstance(v, str) else str(v)


def same(a, b) -> bool:
    """Equal values; computed floats may differ by rounding in their last places."""
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


def rows(table) -> tuple[list[str], list[tuple]]:
    """Column names in order and sorted rows of an Arrow table."""
    names = sorted(table.column_names)
    columns = [table.column(c).to_pylist() for c in names]
    key = lambda r: [(f"{x:.6g}" if isinstance(x, float) else repr(x)) for x in r]
    # what isn't a float comes first in the order, so that rounding doesn't decide it
    return names, sorted((tuple(plain(v) for v in r) for r in zip(*columns, strict=True)), key=lambda r: ([repr(x) for x in r if not isinstance(x, float)], key(r)))


def differences(got, want) -> list[tuple]:
    """Pairs of rows that don't agree, of tables with the same columns."""
    return [(a, b) for a, b in zip(got, want, strict=False) if not all(map(same, a, b))]
