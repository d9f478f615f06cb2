"""Exact order statistics of groups of any size, by distributed selection.

A group's values are not gathered.  For each wanted rank the range of values that
holds it is cut into ``CUTS`` parts, the parts are counted (combined before the
shuffle), and the part in which the rank falls becomes the range.  Its ends are the
least and the greatest value seen in it, so ranges shrink whatever the values
are; every other round cuts on a logarithmic scale, which takes apart values of
very different sizes.  Once a range holds ``FEW`` rows at most, or one value only,
the rank is read off.  Groups of ``FEW`` rows at most go there at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.shared import kept

CUTS, FEW = 4096, 10_000
ROUNDS = 200
#: The greatest finite number.
MOST = 1.7976931348623157e308


def _finite(x: Column) -> Column:
    return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), x))


def _scaled(x: Column) -> Column:
    """A scale on which equal factors are equally far apart, in the same order; no logarithm is below -745."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 746))


def _part(value: Column, low: Column, high: Column, logarithmic: bool) -> Column:
    """The part of the range that a value lies in; larger values never lie in earlier parts."""
    v, a, b = (_scaled(_finite(x)) if logarithmic else _finite(x) for x in (value, low, high))
    # halves, so that the difference of the largest numbers stays finite
    share = (v / 2 - a / 2) / (b / 2 - a / 2)
    return F.when(value >= high, F.lit(CUTS)).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * CUTS), F.lit(CUTS))).cast("int")


def ranked(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], few: int = FEW) -> DataFrame:
    """keys, n, least, greatest, mean, and under each name the value at nearest rank: the least one with that share of the rows at or below it.

    ``rows`` hold numbers that are neither null nor NaN.  Null keys are one
    group; infinite values have their place at the ends; without rows there is no group.
    """
    names = [f"k{i}" for i in range(len(keys))]
    given = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).cast("double").alias("v"))
    given = given.withColumn("group", F.xxhash64(F.lit(0), *names))  # null keys join, too
    whole = kept(given.groupBy("group", *names).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean")), "groups")
    same = lambda a, b: reduce(Column.__and__, [F.col(f"{a}.group") == F.col(f"{b}.group"), *(F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names)])

    small = whole.where(F.col("n") <= few).alias("w")
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY v)")
    done = [given.alias("g").join(small, same("g", "w"), "left_semi").groupBy("group", *names).agg(*(at(q).alias(a) for a, q in shares.items()))]

    large = whole.where(F.col("n") > few)
    if not large.isEmpty():
        wanted = F.explode(F.map_from_arrays(F.array(*(F.lit(a) for a in shares)), F.array(*(F.lit(float(q)) for q in shares.values())))).alias("name", "share")
        targets = large.select("group", *names, "n", "low", "high", wanted)
        targets = targets.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("share"))).cast("long")).drop("share")
        settled = []
        for turn in range(ROUNDS):
            open_ = (F.col("n") > few) & (F.col("low") < F.col("high"))
            settled.append(targets.where(~open_))
            active = targets.where(open_)
            if active.isEmpty():
                break
            met = given.alias("g").join(active.alias("t"), same("g", "t") & F.col("g.v").between(F.col("t.low"), F.col("t.high")))
            parts = met.select("t.group", *(F.col(f"t.{n}").alias(n) for n in names), "t.name", "t.rank", "g.v", _part(F.col("g.v"), F.col("t.low"), F.col("t.high"), turn % 2 == 1).alias("part"))
            parts = parts.groupBy("group", *names, "name", "rank", "part").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            upto = F.sum("n").over(Window.partitionBy("group", *names, "name").orderBy("part"))  # at most CUTS + 1 rows each
            held = parts.withColumn("upto", upto).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
            targets = kept(held.select("group", *names, "n", "low", "high", "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "targets")
        else:
            raise RuntimeError("ranges did not settle")
        ends = reduce(DataFrame.unionByName, settled)
        met = given.alias("g").join(ends.where("low < high").alias("t"), same("g", "t") & F.col("g.v").between(F.col("t.low"), F.col("t.high")))
        near = met.groupBy(*(F.col(f"t.{n}").alias(n) for n in ("group", *names, "name", "rank"))).agg(F.sort_array(F.collect_list("g.v")).alias("values"))  # at most ``few`` each
        found = near.select("group", *names, "name", F.element_at("values", F.col("rank").cast("int")).alias("v")).unionByName(ends.where("low = high").select("group", *names, "name", F.col("low").alias("v")))
        done.append(found.groupBy("group", *names).agg(*(F.max(F.when(F.col("name") == a, F.col("v"))).alias(a) for a in shares)))
    found = reduce(DataFrame.unionByName, done)
    both = whole.alias("w").join(found.alias("f"), same("w", "f"))
    return both.select(*(F.col(f"w.{n}").alias(k) for n, k in zip(names, keys, strict=True)), "w.n", F.col("w.low").alias("least"), F.col("w.high").alias("greatest"), "w.mean", *(f"f.{a}" for a in shares))
