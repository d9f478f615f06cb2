"""Streaming twins of the stateful rules; each agrees with its batch operator on what has arrived in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def gated(requests: DataFrame) -> DataFrame:
    """Stale flags of requests (user_id, event_id, generation, exempt) against the epoch of their document so far.

    The epoch never goes back; a batch is taken in the order of event_id.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values("event_id")
        epochs = rows["generation"].cummax().clip(lower=epoch)
        state.update((int(epochs.iloc[-1]),))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "epoch": epochs, "stale": ~rows["exempt"] & (rows["generation"] < epochs)})

    out = "user_id long, event_id long, epoch long, stale boolean"
    return requests.groupBy("user_id").applyInPandasWithState(run, out, "epoch long", "append", GroupStateTimeout.NoTimeout)


def lru(accesses: DataFrame, budget: int, least: int = 0) -> DataFrame:
    """Outcomes of accesses (cache, seq, key, bytes); the state holds what a cache's budget holds."""
    from leafmill.operators.schedule import Lru

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = Lru(budget, least)
        if state.exists:
            keys, sizes, cache.evictions = state.get
            for k, s in zip(keys, sizes, strict=True):
                cache.held[k] = s
                cache.bytes += s
        rows = pd.concat(list(batches)).sort_values("seq")
        done = [(cache.access(k, int(s)), cache.evictions, len(cache.held), cache.bytes) for k, s in zip(rows["key"], rows["bytes"], strict=True)]
        state.update((list(cache.held), list(cache.held.values()), cache.evictions))
        outcome, evictions, entries, held = zip(*done, strict=True)
        yield pd.DataFrame({"cache": rows["cache"], "seq": rows["seq"], "outcome": outcome, "evictions": evictions, "entries": entries, "held": held})

    out, kept = "cache long, seq long, outcome string, evictions long, entries long, held long", "keys array<string>, sizes array<long>, evictions long"
    return accesses.groupBy("cache").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)


def strikes(deaths: DataFrame) -> DataFrame:
    """Strikes of each document so far and whether two have quarantined it."""
    return deaths.groupBy("document").agg(F.count("*").alias("strikes")).withColumn("quarantined", F.col("strikes") >= 2)


def debounced(rows: DataFrame, key: str, time: str, value: str, silence: str, late: str) -> DataFrame:
    """The last value of each burst, once its silence and the allowed lateness have passed; of equal times, the greatest value."""
    burst = F.session_window(time, silence)
    return rows.withWatermark(time, late).groupBy(key, burst).agg(F.max_by(value, F.struct(time, value)).alias(value), F.max(time).alias(time)).drop("session_window")


def frames(rows: DataFrame, key: str, time: str, value: str, width: str, late: str) -> DataFrame:
    """At most one draw for each frame: its last value, of equal times the greatest."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.max_by(value, F.struct(time, value)).alias(value), F.count("*").alias("merged")).select(F.col("w.start").alias("frame"), key, value, "merged")


def claimed(requests: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first request of each key within the lateness; later ones join it."""
    return requests.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def answered(requests: DataFrame, replies: DataFrame, within: str, late: str) -> DataFrame:
    """Requests (id, sent) with their reply (id, got) in time, or without one when the time is over."""
    asked = requests.withWatermark("sent", late)
    got = replies.withColumnRenamed("id", "reply_id").withWatermark("got", late)
    met = F.expr(f"reply_id = id AND got >= sent AND got <= sent + INTERVAL {within}")
    return asked.join(got, met, "left_outer").select("id", "sent", "got", F.when(F.col("reply_id").isNull(), "Unresponsive").otherwise("Answered").alias("state"))


def heartbeats(beats: DataFrame, hung_ms: int) -> DataFrame:
    """A row for each worker that has been silent too long, by processing time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"worker": [key[0]], "last": [last], "health": ["Hung"]})
            return
        last = max(int(b["seq"].max()) for b in batches)
        state.update((last,))
        state.setTimeoutDuration(hung_ms)

    return beats.groupBy("worker").applyInPandasWithState(run, "worker long, last long, health string", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def polled(rows: DataFrame, every: str = "2 seconds"):
    """A writer that looks at ``rows`` at each poll and takes what is new."""
    return rows.writeStream.trigger(processingTime=every)


def indexed(changes: DataFrame, root: str, key: str):
    """A writer that keeps a full-text index up to date with a stream of changes (key, before, after).

    A document that comes in has no text before, one that goes has none after.  Of
    several changes of a document in a batch the given one before the first and after
    the last would be needed, so a batch must hold each document once.  A batch that
    is repeated after a failure finds its segment written and adds nothing.
    """
    from leafmill.operators.fulltext import FullTextIndex

    def take(batch: DataFrame, number: int) -> None:
        old = batch.where("before IS NOT NULL").select(key, F.col("before").alias("text"))
        new = batch.where("after IS NOT NULL").select(key, F.col("after").alias("text"))
        FullTextIndex(batch.sparkSession, root).apply(number + 1, old, new, key, "text")

    return changes.writeStream.foreachBatch(take)
