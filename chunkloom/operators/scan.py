"""Running totals and row numbers over one ordered group that may be larger than any task.

A plain ``Window.partitionBy(doc).orderBy(position)`` puts a whole document into one task. Here the
order is first cut into ranges of bounded size (``position div size``): the window runs inside each
range, the totals of the ranges run through the same step with coarser ranges, and each range adds
the total of the ranges before it. The results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 4096  # positions per range
COARSER = 4096  # ranges per coarser range

Agg = tuple[str, Column]  # ("sum" | "max" | "min", value)


def ranges_of(position: Column | str, size: int = RANGE_ROWS) -> list[Column]:
    """Fine and coarse range numbers of an integer position."""
    p = F.col(position) if isinstance(position, str) else position
    fine = F.floor(p.cast("bigint") / size)
    return [fine, F.floor(fine / COARSER)]


def latest(order: Sequence[str], value: Column) -> Agg:
    """The value of the last row, in order, where it is not null; read it with ``latest_value``."""
    return "max", F.when(value.isNotNull(), F.struct(*order, value.alias("value")))


def latest_value(name: str) -> Column:
    return F.col(name)["value"]


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    if kind == "max":
        return F.when(a.isNull() | (b > a), b).otherwise(a)
    return F.when(a.isNull() | (b < a), b).otherwise(a)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: dict[str, Agg],
    ranges: Sequence[Sequence[Column]] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Add one column per aggregate over the rows before each row (and the row itself if ``inclusive``).

    ``ranges`` lists, from fine to coarse, the columns that number the ranges of the order; each
    coarser list must follow from the finer one. With no ranges the plain window is used.
    """
    frame_end = 0 if inclusive else -1
    if not ranges:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
        return df.withColumns({n: _finish(kind, _AGG[kind](v).over(w)) for n, (kind, v) in aggs.items()})

    depth = len(ranges)
    fine = [f"__r{depth}_{i}" for i in range(len(ranges[0]))]
    values = {f"__v_{n}": v for n, (_, v) in aggs.items()}
    base = df.withColumns(dict(zip(fine, ranges[0])) | values)
    coarser = [[f"__c{depth}_{level}_{i}" for i in range(len(cols))] for level, cols in enumerate(ranges[1:])]
    coarse_cols = {n: c for names, cols in zip(coarser, ranges[1:]) for n, c in zip(names, cols)}
    if coarse_cols:
        base = base.withColumns(coarse_cols)

    w = Window.partitionBy(*keys, *fine).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    local = base.withColumns({n: _AGG[kind](F.col(f"__v_{n}")).over(w) for n, (kind, _) in aggs.items()})

    totals = base.groupBy(*keys, *fine, *coarse_cols).agg(
        *[_AGG[kind](F.col(f"__v_{n}")).alias(f"__t_{n}") for n, (kind, _) in aggs.items()]
    )
    before = running(
        totals,
        keys,
        fine,
        {f"__b_{n}": (kind, F.col(f"__t_{n}")) for n, (kind, _) in aggs.items()},
        [[F.col(n) for n in names] for names in coarser],
        inclusive=False,
    ).select(*keys, *fine, *[f"__b_{n}" for n in aggs])

    joined = local.join(before, [*keys, *fine], "left")
    out = joined.withColumns({n: _combine(kind, F.col(n), F.col(f"__b_{n}")) for n, (kind, _) in aggs.items()})
    return out.select(*df.columns, *aggs)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, ranges: Sequence[Sequence[Column]]
) -> DataFrame:
    """Add the 1-based row number of each row within its keys, in an order that has no ties."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, ranges)


def page_ranges(page: str, position: str, size: int = RANGE_ROWS) -> list[list[Column]]:
    """Ranges for the order (page, position): per page and position range, then per run of pages."""
    return [[F.col(page), ranges_of(position, size)[0]], [ranges_of(page, size)[0]]]


def position_ranges(position: str, size: int = RANGE_ROWS) -> list[list[Column]]:
    """Ranges for an order by one integer position."""
    fine, coarse = ranges_of(position, size)
    return [[fine], [coarse]]


def _finish(kind: str, value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) if kind == "sum" else value


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def first_match(conditions: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """Nested ``when`` from an ordered list of (condition, value)."""
    return reduce(lambda rest, cv: F.when(cv[0], cv[1]).otherwise(rest), reversed(list(conditions)), default)
