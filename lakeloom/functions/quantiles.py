"""Exact quantiles of columns by repeated narrowing, without sorting a column or gathering its values in one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import number


#: A bracket with at most so many distinct values is finished in one aggregation.
LEFT = 20_000


def exact_quantiles(df: DataFrame, columns: list[str], fractions: list[float], accuracy: int = 10_000, left: int = LEFT) -> dict[str, list[float | None]]:
    """Quantiles of each column's known values, interpolated between neighbours; None for a column without values.

    Each wanted place has a bracket of values around it. A scan for approximate quantiles inside the brackets and one for
    exact counts narrow all brackets at once, about accuracy / 4 times, until each has about `left` distinct values at most;
    a last scan takes the exact places. So a task holds as much for a table of any size, and the number of scans grows
    with its logarithm: three for some 10 ** 7 distinct values, five for 10 ** 11. The driver gets a few numbers for each column.
    """
    if not columns:
        return {}
    spots = [(i, j) for i in range(len(columns)) for j in range(len(fractions))]
    x = [number(df, c) for c in columns]
    low, high = dict.fromkeys(spots, -math.inf), dict.fromkeys(spots, math.inf)
    margin = 2.0 / accuracy

    def inside(s: tuple[int, int]):
        return (x[s[0]] >= F.lit(low[s])) & (x[s[0]] <= F.lit(high[s]))

    def around(some: list[tuple[int, int]]) -> DataFrame:
        """The rows that are in one of these brackets, so that costly aggregates see no others."""
        return df.where(reduce(Column.__or__, [inside(s) for s in some]))

    def count(some: list[tuple[int, int]]) -> dict[str, int]:
        """Rows below and inside of each bracket and, of one that holds over `left` rows, about how many distinct values."""
        got = df.agg(*[e for s in some for e in (F.count_if(x[s[0]] < F.lit(low[s])).alias(f"b{s}"), F.count_if(inside(s)).alias(f"m{s}"))]).first().asDict()
        many = [s for s in some if low[s] < high[s] and got[f"m{s}"] > left]
        got |= {f"d{s}": got[f"m{s}"] for s in some}
        if many:
            got |= around(many).agg(*[F.approx_count_distinct(F.when(inside(s), x[s[0]]), 0.1).alias(f"d{s}") for s in many]).first().asDict()
        return got

    # the first scan: all columns as a whole, whose brackets are shared by the fractions
    cuts = sorted({min(1.0, max(0.0, f + t * margin)) for f in fractions for t in (-1, 1)})
    first = df.agg(*[e for i in range(len(columns)) for e in (F.count(x[i]).alias(f"n{i}"), F.percentile_approx(x[i], cuts, accuracy).alias(f"c{i}"))]).first()
    n = {s: first[f"n{s[0]}"] for s in spots}
    place = {(i, j): fractions[j] * (n[i, j] - 1) for i, j in spots}
    below, many, distinct = dict.fromkeys(spots, 0), dict(n), {}
    out: dict[str, list[float | None]] = {c: [None] * len(fractions) for c in columns}
    open_spots = [s for s in spots if n[s]]
    new = {(i, j): tuple(dict(zip(cuts, first[f"c{i}"], strict=True)).get(f, e) for f, e in ((fractions[j] - margin, -math.inf), (fractions[j] + margin, math.inf))) for i, j in open_spots}
    while True:
        old = {s: (low[s], high[s]) for s in open_spots}
        for s in open_spots:
            low[s], high[s] = new[s]
        got = count(open_spots) if open_spots else {}
        again = []
        for s in open_spots:
            b, m = got[f"b{s}"], got[f"m{s}"]
            if math.floor(place[s]) < b or math.ceil(place[s]) >= b + m:  # the estimate was off
                low[s], high[s] = old[s]
                again.append(s)
            else:
                below[s], many[s], distinct[s] = b, m, got[f"d{s}"]
        wide = [s for s in open_spots if s in again or (low[s] < high[s] and distinct[s] > left)]
        if not wide:
            break
        local = {s: sorted({max(0.0, (math.floor(place[s]) - below[s]) / max(1, many[s] - 1) - margin * (1 + 9 * (s in again))), min(1.0, (math.ceil(place[s]) - below[s]) / max(1, many[s] - 1) + margin * (1 + 9 * (s in again)))}) for s in wide}
        near = around(wide).agg(*[F.percentile_approx(F.when(inside(s), x[s[0]]), local[s], accuracy).alias(f"c{s}") for s in wide]).first()
        new = {s: (low[s], high[s]) for s in open_spots}
        for s in wide:
            cut = near[f"c{s}"]
            new[s] = (cut[0] if local[s][0] > 0 else low[s], cut[-1] if local[s][-1] < 1 else high[s])
            if new[s] == (low[s], high[s]):  # no narrower: split in the middle, whose side the counts tell
                new[s] = _half(df, x[s[0]], low[s], high[s], below[s], place[s])
        open_spots = wide
    exact = {}
    for s in spots:
        if n[s]:
            if low[s] == high[s]:
                out[columns[s[0]]][s[1]] = float(low[s])
            else:
                exact[s] = min(1.0, (place[s] - below[s]) / max(1, many[s] - 1))
    if exact:
        found = around(list(exact)).agg(*[F.percentile(F.when(inside(s), x[s[0]]), f).alias(f"q{s}") for s, f in exact.items()]).first()
        for s in exact:
            out[columns[s[0]]][s[1]] = found[f"q{s}"]
    return out


def _half(df: DataFrame, x: Column, low: float, high: float, below: int, place: float) -> tuple[float, float]:
    """The part of a bracket that holds a place and its upper neighbour: up to the middle value, or from it on."""
    ends = df.agg(F.min(F.when((x >= F.lit(low)) & (x <= F.lit(high)), x)), F.max(F.when((x >= F.lit(low)) & (x <= F.lit(high)), x))).first()
    middle = ends[0] + (ends[1] - ends[0]) / 2
    under, above = df.agg(F.max(F.when((x >= F.lit(low)) & (x <= F.lit(middle)), x)), F.min(F.when((x > F.lit(middle)) & (x <= F.lit(high)), x))).first()
    upto = df.agg(F.count_if(x <= F.lit(under))).first()[0]
    if math.ceil(place) < upto:
        return ends[0], under
    return (above, ends[1]) if math.floor(place) >= upto else (under, above)
