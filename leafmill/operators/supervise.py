"""Supervision rules: loads, placement, strikes, heartbeats, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIKES = 2


def loads(workers: DataFrame, documents: DataFrame, worker: str) -> DataFrame:
    """Documents on each worker; the count is taken before the join, so no hot worker is shuffled row by row."""
    counts = documents.groupBy(worker).agg(F.count("*").alias("load"))
    return workers.join(counts, worker, "left").select(worker, F.coalesce("load", F.lit(0)).alias("load"))


def place(workers: DataFrame, pool: str) -> DataFrame:
    """The least loaded worker of each pool, then the lowest; an active one only if there is no other."""
    chosen = workers.groupBy(pool).agg(F.min(F.struct("active", "load", "worker")).alias("x"))
    return chosen.select(pool, "x.worker", "x.load")


def strikes(deaths: DataFrame, residents: DataFrame, keys: list[str], document: str) -> DataFrame:
    """A strike for each death while resident."""
    struck = residents.join(deaths.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    return struck.groupBy(document).agg(F.sum("n").alias("strikes")).withColumn("quarantined", F.col("strikes") >= STRIKES)


def heartbeats(beats: DataFrame, key: str, time: str, tie: str, exited: Column, slow: float, hung: float) -> DataFrame:
    """Seconds of silence after each beat and the health they tell."""
    order = Window.partitionBy(key).orderBy(time, tie)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    silence = (micros(F.lead(time).over(order)) - micros(F.col(time))) / 1e6
    timed = beats.withColumn("silence", silence)
    quiet = F.col("silence")
    return timed.withColumn("health", F.when(exited, "Dead").when(quiet.isNull() | (quiet <= slow), "Alive").when(quiet > hung, "Hung").otherwise("Slow"))


def consecutive_failures(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Failures with their number since the last success."""
    runs = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("__failed", failed).withColumn("__island", F.sum((~F.col("__failed")).cast("int")).over(runs))
    counted = marked.where("__failed").withColumn("failures", F.row_number().over(Window.partitionBy(key, "__island").orderBy(*order)).cast("long"))
    return counted.drop("__failed", "__island")


def replies(requests: DataFrame, answers: DataFrame, key: str, time: str, number: str, within: str) -> DataFrame:
    """Each request with the first answer of its key that follows in time.

    Both sides go through one window by key, so there is no join whose size
    depends on how many answers are near.
    """
    kept = lambda df, kind: df.select(key, time, number, F.lit(kind).alias("kind"))
    both = kept(requests, 0).unionByName(kept(answers, 1))
    # backwards in time, so that the frame only grows
    after = Window.partitionBy(key).orderBy(F.desc(time), F.desc(number)).rowsBetween(Window.unboundedPreceding, -1)
    answer = F.last(F.when(F.col("kind") == 1, F.struct(F.col(time).alias("t"), F.col(number).alias("n"))), ignorenulls=True).over(after)
    timed = both.withColumn("answer", answer).where("kind = 0")
    in_time = F.col("answer.t") <= F.col(time) + F.expr(f"INTERVAL {within}")
    reply = F.when(in_time, F.col("answer.n"))
    return timed.select(F.col(number).alias("request"), reply.alias("reply"), F.when(reply.isNull(), "Unresponsive").otherwise("Answered").alias("state"))
