"""Scroll motion: velocity, prefetch order, bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill import functions as fn
from leafmill.operators.sequential import carried

SMOOTHING = 0.6


def velocity(samples: DataFrame, key: str, time: str, offset: str, tie: str) -> DataFrame:
    """Exponentially smoothed velocity of each key's samples, in units a second.

    A sample within a millisecond of the last one used is dropped and does not
    move it, so this follows the samples one by one and is no window over neighbours.
    Samples without a time or an offset do not count.
    """

    def begin():
        last: dict[str, float | None] = {"at": None, "offset": None}
        speed = 0.0

        def step(at, tie, offset):
            nonlocal speed
            if last["at"] is not None:
                gap = at - last["at"]
                if gap < 1:
                    return ()
                speed = speed * SMOOTHING + (offset - last["offset"]) / gap * 1000 * (1 - SMOOTHING)
            last.update(at=at, offset=offset)
            return ()

        return step, lambda: [(speed,)]

    at = F.unix_micros(F.col(time).cast("timestamp")) / 1000.0
    rows = samples.select(key, at.alias("__at"), F.col(tie).alias("__tie"), F.col(offset).cast("double").alias("__offset"))
    known = rows.where("__at IS NOT NULL AND __offset IS NOT NULL")
    return carried(known, [key], ["__at", "__tie"], begin, {"velocity": "double"})


def prefetch(visible: Column, speed: Column, pages: Column) -> Column:
    """Pages to fetch, in order: those ahead and then the one behind, or both sides when idle."""
    first, last, way, reach = F.array_min(visible), F.array_max(visible), fn.direction(speed), fn.prefetch_reach(speed)
    ahead = F.concat(F.transform(F.sequence(F.lit(1), reach), lambda k: last + k), F.array(first - 1))
    back = F.concat(F.transform(F.sequence(F.lit(1), reach), lambda k: first - k), F.array(last + 1))
    wanted = F.when(way == 1, ahead).when(way == -1, back).otherwise(F.array(last + 1, first - 1))
    kept = F.array_except(F.array_distinct(F.filter(wanted, lambda p: (p >= 0) & (p < pages))), visible)
    return F.when(F.size(visible) > 0, kept).otherwise(F.array().cast("array<int>"))


def last_of_burst(rows: DataFrame, key: str, time: str, tie: str, seconds: float) -> DataFrame:
    """Rows that no other of their key follows within so many seconds."""
    following = F.lead(time).over(Window.partitionBy(key).orderBy(time, tie))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return rows.withColumn("__next", following).where(F.col("__next").isNull() | (micros(F.col("__next")) - micros(F.col(time)) >= int(seconds * 1e6))).drop("__next")


def polled(rows: DataFrame, key: str, time: str, tie: str, seconds: int) -> DataFrame:
    """What a poll every so many seconds sees of each key: the last row since the poll before.

    ``poll`` numbers the polls from the epoch on; polls that find nothing new have no row.
    """
    poll = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000)) + 1
    rest = [c for c in rows.columns if c not in (key, time, tie)]
    last = rows.groupBy(key, poll.cast("long").alias("poll")).agg(F.max(F.struct(time, tie, *rest)).alias("row"))
    return last.select(key, "poll", "row.*")
