"""Request scheduling: stale gates, coalescing, dispatch, shedding, caches, rings."""

from __future__ import annotations

import heapq
import math
from collections import OrderedDict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import prefix
from leafmill.operators.sequential import carried, nothing_more

CAPACITY = 512


def gated(requests: DataFrame, document: str, generation: str, order: list[str], exempt: Column) -> DataFrame:
    """Each request with its document's running epoch and whether an older generation makes it stale."""
    running = Window.partitionBy(document).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = requests.withColumn("epoch", F.max(generation).over(running))
    return seen.withColumn("stale", ~exempt & (F.col(generation) < F.col("epoch")))


def coalesced(requests: DataFrame, keys: list[str], time: str, number: str, seconds: float) -> DataFrame:
    """Each request with the one that renders it: the first of its key, until that one has taken so long.

    A joiner does not prolong the render it joins, so leaders follow one another.
    """
    span = int(seconds * 1e6)

    def begin():
        led = {"at": None, "number": None}

        def step(at, number):
            if led["at"] is None or (at is not None and at - led["at"] >= span):
                led.update(at=at, number=number)
            return [(number, led["number"])]

        return step, nothing_more

    rows = requests.select(*keys, F.unix_micros(F.col(time).cast("timestamp")).alias("__at"), F.col(number).cast("long").alias("__number"))
    return carried(rows, keys, ["__at", "__number"], begin, {"number": "long", "leader": "long"})


def dispatched(requests: DataFrame, queue: str, capacity: int = CAPACITY) -> DataFrame:
    """Order of dispatch in each queue, and which requests are shed: the oldest of the lowest priority beyond the capacity.

    ``seq`` counts arrivals from 0.  A place is the requests of other priorities that
    go first, which are counted, and those of the same one that came before, which
    is a running sum in two levels: no task holds a queue.
    """
    classes = requests.groupBy(queue, "priority").agg(F.count("*").alias("__many"))
    # one row for each priority of a queue
    every, lower = Window.partitionBy(queue), Window.partitionBy(queue).orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy(queue).orderBy(F.desc("priority")).rowsBetween(Window.unboundedPreceding, -1)
    over = F.sum("__many").over(every) - capacity - F.coalesce(F.sum("__many").over(lower), F.lit(0))
    classes = classes.withColumn("__shed", F.greatest(F.lit(0), F.least(F.col("__many"), over)))
    classes = classes.withColumn("__first", F.coalesce(F.sum(F.col("__many") - F.col("__shed")).over(higher), F.lit(0))).drop("__many")
    placed = prefix.joined(prefix.before(requests, [queue, "priority"], "seq", {"__own": F.lit(1)}), classes, [queue, "priority"])
    shed = placed.withColumn("shed", F.col("__own") < F.col("__shed"))
    nth = (F.col("__first") + F.col("__own") - F.col("__shed") + 1).cast("int")
    return shed.withColumn("nth", F.when(~F.col("shed"), nth)).drop("__own", "__shed", "__first")


class Lru:
    """A cache with a budget of bytes."""

    def __init__(self, budget: int, least: int = 0):
        self.budget, self.least, self.bytes, self.evictions = budget, least, 0, 0
        self.held: OrderedDict = OrderedDict()

    def access(self, key, size: int) -> str:
        """hit, stored or refused; a hit refreshes, an insert may evict the oldest."""
        if key in self.held and self.held[key] == size:
            self.held.move_to_end(key)
            return "hit"
        if size > self.budget and not self.least:
            return "refused"
        self.bytes -= self.held.pop(key, 0)
        self.held[key] = size
        self.bytes += size
        while self.bytes > self.budget and len(self.held) > self.least:
            self.bytes -= self.held.popitem(last=False)[1]
            self.evictions += 1
        return "stored"


def lru(accesses: DataFrame, cache: str, budget: int, least: int = 0) -> DataFrame:
    """The outcome of each access (cache, seq, key, bytes) with evictions and bytes after it; caches are independent."""

    def begin():
        state = Lru(budget, least)

        def step(seq, key, size):
            outcome = state.access(key, size)
            return [(seq, outcome, state.evictions, len(state.held), state.bytes)]

        return step, nothing_more

    rows = accesses.select(cache, "seq", "key", F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"))
    return carried(rows, [cache], ["seq"], begin, {"seq": "long", "outcome": "string", "evictions": "long", "entries": "long", "held": "long"})


def ring(claims: DataFrame, name: str, slots: int) -> DataFrame:
    """What each claim (ring, seq, generation, free) gets: a free slot in turn, else the ready slot of the lowest generation.

    A row with ``free`` gives back the slot that was claimed longest ago.
    """

    def begin():
        ready: OrderedDict[int, int] = OrderedDict()
        turn = 0

        def step(seq, generation, free):
            nonlocal turn
            if free:
                slot = next(iter(ready), -1)
                ready.pop(slot, None)
                return [(seq, slot, "freed" if slot >= 0 else "empty")]
            empty = next((s for s in ((turn + k) % slots for k in range(slots)) if s not in ready), None)
            slot = min(ready, key=lambda s: (ready[s], s)) if empty is None else empty
            ready.pop(slot, None)
            ready[slot] = generation
            turn = (slot + 1) % slots
            return [(seq, slot, "reclaimed" if empty is None else "claimed")]

        return step, nothing_more

    rows = claims.select(name, "seq", F.coalesce(F.col("generation").cast("long"), F.lit(0)).alias("generation"), "free")
    return carried(rows, [name], ["seq"], begin, {"seq": "long", "slot": "int", "state": "string"})


def workers(jobs: DataFrame, pool: str, width: int) -> DataFrame:
    """When each job (pool, seq, arrival, priority, took) starts and on which worker: highest priority first, one job each.

    No job starts before it arrives; only the idle workers and the waiting jobs are held.
    """

    def begin():
        idle, waiting = [(0.0, w) for w in range(width)], []
        now = 0.0

        def start(before: float):
            while waiting and max(idle[0][0], now) < before:
                free, worker = heapq.heappop(idle)
                _, seq, took = heapq.heappop(waiting)
                at = max(free, now)
                heapq.heappush(idle, (at + took, worker))
                yield seq, at, worker

        def step(arrival, seq, priority, took):
            nonlocal now
            began = list(start(arrival))
            now = arrival
            heapq.heappush(waiting, (-priority, seq, took))
            return began

        return step, lambda: start(math.inf)

    rows = jobs.select(pool, "arrival", "seq", "priority", "took")
    return carried(rows, [pool], ["arrival", "seq"], begin, {"seq": "long", "start": "double", "worker": "int"})


def shed_on_arrival(jobs: DataFrame, queue: str, capacity: int = CAPACITY, every: int = 1) -> DataFrame:
    """What becomes of each job (queue, seq, priority): served, shed or still queued at the end, and after how many arrivals.

    A job that arrives at a full queue pushes out the oldest of the lowest
    priority there, itself included; after every so many arrivals the oldest of
    the highest priority is served.
    """

    def begin():
        waiting: dict[int, deque] = {}
        held = arrived = 0

        def first(choose):
            """The oldest of a priority, which goes."""
            nonlocal held
            priority = choose(waiting)
            seq = waiting[priority].popleft()
            if not waiting[priority]:
                del waiting[priority]
            held -= 1
            return seq

        def step(seq, priority):
            nonlocal held, arrived
            waiting.setdefault(priority, deque()).append(seq)
            held, arrived = held + 1, arrived + 1
            shed = [(first(min), "shed", arrived)] if held > capacity else []
            return shed + [(first(max), "served", arrived)] if arrived % every == 0 and held else shed

        return step, lambda: ((seq, "queued", None) for seqs in waiting.values() for seq in seqs)

    return carried(jobs.select(queue, "seq", "priority"), [queue], ["seq"], begin, {"seq": "long", "outcome": "string", "after": "long"})
