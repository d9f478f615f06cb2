"""Latency statistics: nearest-rank percentiles, verdicts, rates and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators import selection


def statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, nearest-rank p50, p95 and p99, max and mean for each key; NaN and null values do not count.

    No task holds a group's values, however large it is (``selection``).
    """
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    got = selection.ranked(known, keys, value, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    kind = rows.schema[value].dataType
    same = lambda old, new: F.col(old).cast(kind).alias(new)
    return got.select(*keys, "n", same("least", "min_ms"), *(same(p, p) for p in ("p50_ms", "p95_ms", "p99_ms")), same("greatest", "max_ms"), F.round("mean", 6).alias("mean_ms"))


def verdict(measured: Column, target: Column, strict: bool = False) -> Column:
    """PASS or FAIL against a target; null where there is none."""
    met = measured < target if strict else measured <= target
    return F.when(target.isNotNull(), F.when(met, "PASS").otherwise("FAIL"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Whole percent of lookups that hit; null without lookups."""
    return F.round(hits * 100 / F.nullif(hits + misses, F.lit(0))).cast("long")


def cost_ratio(tiled: Column, whole: Column) -> Column:
    return tiled / F.greatest(whole, F.lit(0.001))


def render_counters(log: DataFrame, keys: list[str], outcome: str = "outcome") -> DataFrame:
    """How many of each outcome a log of requests holds, for each key."""
    names = ("rendered", "superseded", "shed", "failed", "coalesced", "queued", "inflight")
    return log.groupBy(*keys).agg(*(F.count_if(F.col(outcome) == n).alias(n) for n in names))
