"""Running sums within groups of any size, in two levels.

A window over a whole group runs in one task.  Here a group's rows are cut into
ranges of their integer places; each range is summed up, combined before the
shuffle, the sums of the ranges before are added up, and only then each range has
its own window, in a task of its own.  Ranges are summed up in the same way, until
a group has few of them, so no window holds more than ``SPAN`` rows of places
that do not repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN, LEVELS = 4096, 2
RANGE = "__range"


def ranged(rows: DataFrame, place: str, span: int = SPAN) -> DataFrame:
    """``rows`` with the range that their place lies in."""
    return rows.withColumn(RANGE, F.floor(F.col(place) / span))


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``; null keys meet null keys."""
    other = right.select(*(F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    return left.join(other, met, "left").drop(*(f"__r{i}" for i in range(len(keys))))


def before(rows: DataFrame, keys: list[str], place: str, sums: dict[str, Column], span: int = SPAN, levels: int = LEVELS) -> DataFrame:
    """``rows`` with, under each name, the sum over the group's rows with a smaller place; 0 for the first.

    Places are whole numbers from 0 on.  Rows of one place do not count for one
    another.  Nulls count nothing.  Null keys are one group.
    """
    parts = {f"__part_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    cut = ranged(rows, place, span).withColumns(parts)
    own = Window.partitionBy(*keys, RANGE).orderBy(place).rangeBetween(Window.unboundedPreceding, -1)
    within = cut.withColumns({f"__own_{n}": F.coalesce(F.sum(f"__part_{n}").over(own), F.lit(0)) for n in sums})
    totals = cut.groupBy(*keys, RANGE).agg(*(F.sum(f"__part_{n}").alias(f"__sum_{n}") for n in sums))
    if levels > 1:
        offsets = before(totals.withColumnRenamed(RANGE, "__place"), keys, "__place", {f"__off_{n}": F.col(f"__sum_{n}") for n in sums}, span, levels - 1).withColumnRenamed("__place", RANGE)
    else:
        upto = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.withColumns({f"__off_{n}": F.coalesce(F.sum(f"__sum_{n}").over(upto), F.lit(0)) for n in sums})
    out = joined(within, offsets.select(*keys, RANGE, *(f"__off_{n}" for n in sums)), [*keys, RANGE])
    return out.select(*rows.columns, *((F.col(f"__own_{n}") + F.col(f"__off_{n}")).alias(n) for n in sums))
