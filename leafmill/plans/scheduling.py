"""Scheduling rules over the event stream.

Derivations: an event is a tile request of its user (the document); its type
gives kind and priority, event_id modulo 7 its generation, its day the queue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import relations, schedule
from leafmill.plans import query, table

_PRIORITY = "CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'signup' THEN 0 WHEN 'purchase' THEN 2 ELSE 2 END"
_GATE = """SELECT *, event_id % 7 AS generation, max(event_id % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM events"""
_OUTCOME = "CASE WHEN event_type <> 'view' AND generation < epoch THEN 'Superseded' WHEN event_type = 'error' THEN 'WorkerDown' WHEN value < 1 THEN 'Missing' WHEN value > 300 THEN 'SlotGone' WHEN event_type = 'signup' THEN 'BadUri' ELSE 'Served' END"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("generation", F.col("event_id") % 7)


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.gated(requests(spark, sf_dir), "user_id", "generation", ["ts", "event_id"], F.col("event_type") == "view")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    outcome = F.when(F.col("stale"), "Superseded").when(kind == "error", "WorkerDown").when(value < 1, "Missing").when(value > 300, "SlotGone").when(kind == "signup", "BadUri").otherwise("Served")
    return gate(spark, sf_dir).withColumn("outcome", outcome)


@query(f"SELECT event_id, user_id, generation, epoch, event_type <> 'view' AND generation < epoch AS stale FROM ({_GATE})")
def generation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests older than their document's epoch are stale, previews (views) never."""
    return gate(spark, sf_dir).select("event_id", "user_id", "generation", "epoch", "stale")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT user_id, event_type, event_id, r, t AS lead_t, event_id AS leader FROM e WHERE r = 1
UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.r, CASE WHEN e.t - f.lead_t >= 14400000000 THEN e.t ELSE f.lead_t END, CASE WHEN e.t - f.lead_t >= 14400000000 THEN e.event_id ELSE f.leader END
FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.r = f.r + 1)
SELECT event_id, leader, event_id <> leader AS joined FROM f""")
def coalesce_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the key of one in flight (4 hours) join it."""
    got = schedule.coalesced(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 4 * 3600.0)
    return got.select(F.col("number").alias("event_id"), "leader", (F.col("number") != F.col("leader")).alias("joined"))


@query(f"""WITH q AS (SELECT event_id, ts::DATE AS day, {_PRIORITY} AS priority FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY priority, event_id) <= count(*) OVER (PARTITION BY day) - 200 AS shed FROM q)
SELECT event_id, day::VARCHAR AS day, priority, shed, CASE WHEN NOT shed THEN row_number() OVER (PARTITION BY day, shed ORDER BY priority DESC, event_id) END AS nth FROM s""")
def dispatch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of dispatch by priority and arrival, after shedding what a queue of 200 cannot hold."""
    kind = F.col("event_type")
    q = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("seq"), F.to_date("ts").cast("string").alias("day"), F.when(kind == "view", 1).when(kind == "signup", 0).otherwise(2).alias("priority"))
    return schedule.dispatched(q, "day", 200).select("event_id", "day", "priority", "shed", F.col("nth").cast("long").alias("nth"))


@query(f"SELECT {_OUTCOME} AS outcome, count(*) AS n, CASE {_OUTCOME} WHEN 'Served' THEN 200 WHEN 'BadUri' THEN 400 WHEN 'Missing' THEN 404 WHEN 'Superseded' THEN 409 WHEN 'SlotGone' THEN 410 ELSE 503 END AS status FROM ({_GATE}) GROUP BY 1, 3")
def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all requests with their status codes."""
    status = F.when(F.col("outcome") == "Served", 200).when(F.col("outcome") == "BadUri", 400).when(F.col("outcome") == "Missing", 404).when(F.col("outcome") == "Superseded", 409).when(F.col("outcome") == "SlotGone", 410).otherwise(503)
    return outcomes(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n")).withColumn("status", status)


@query(f"""SELECT event_id, outcome, nth FROM (SELECT event_id, outcome, row_number() OVER (PARTITION BY user_id, outcome ORDER BY ts, event_id) AS nth, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total FROM (SELECT *, {_OUTCOME} AS outcome FROM ({_GATE}))) WHERE nth <= 3 OR total % 20 = 0""")
def outcome_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What gets logged: the first three of each outcome of a user and each twentieth request (W08, P17); the sampling is the feature."""
    order = [F.col("ts"), F.col("event_id")]
    nth = relations.numbered(outcomes(spark, sf_dir), ["user_id", "outcome"], order)
    total = nth.withColumn("total", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    return total.where("nth <= 3 OR total % 20 = 0").select("event_id", "outcome", F.col("nth").cast("long").alias("nth"))


@query(f"""SELECT user_id, count(*) AS requested, count(*) FILTER (o = 'Superseded') AS dropped, count(*) FILTER (o = 'Served') AS rendered, count(*) FILTER (o NOT IN ('Superseded', 'Served')) AS failed FROM (SELECT *, {_OUTCOME} AS o FROM ({_GATE})) GROUP BY 1""")
def render_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested, dropped, rendered and failed of each document."""
    o = F.col("outcome")
    return outcomes(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("requested"), F.count_if(o == "Superseded").alias("dropped"), F.count_if(o == "Served").alias("rendered"), F.count_if(~o.isin("Superseded", "Served")).alias("failed")
    )


_KINDS = {"library_load": "FileUnavailable", "library_already_loaded": "EngineFault", "file_not_readable": "FileUnavailable", "password_required": "PasswordRequired", "password_wrong": "PasswordWrong", "corrupt": "Corrupt", "page_out_of_range": "BadRequest", "bad_tile_size": "BadRequest", "bad_source_rect": "BadRequest", "buffer_too_small": "BadRequest", "engine_panic": "EngineFault", "cancelled": "Timeout", "engine": "Corrupt"}  # fixed values


@query(f"""WITH k(i, name, kind) AS (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_KINDS.items()))}) SELECT kind, count(*) AS n FROM events JOIN k ON i = event_id % {len(_KINDS)} GROUP BY 1""")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen errors to their kinds."""
    names = F.array(*(F.lit(x) for x in _KINDS))
    kinds = F.create_map(*(F.lit(x) for p in _KINDS.items() for x in p))
    name = F.get(names, (F.col("event_id") % len(_KINDS)).cast("int"))
    return table(spark, sf_dir, "events").groupBy(F.element_at(kinds, name).alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 100) SELECT e.event_id, c.user_id IS NOT NULL AS hit FROM events e LEFT JOIN c USING (user_id, event_type)""")
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose key the cache holds, and the others."""
    e = table(spark, sf_dir, "events")
    held = e.where("value > 100").select("user_id", "event_type").distinct().withColumn("held", F.lit(True))
    return e.join(held, ["user_id", "event_type"], "left").select("event_id", F.coalesce("held", F.lit(False)).alias("hit"))


@query("""WITH k AS (SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN user_id || '/preview' ELSE user_id || '/scale/' || (event_id % 5) || '/' || event_type END AS key FROM events)
SELECT event_id, key, contains(key, '/3/') OR ends_with(key, '/preview') AS kept, user_id <> 7 AS remembered, user_id <> 7 OR ends_with(key, '/preview') AS trimmed FROM k""")
def cache_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys kept on a change of scale, after forgetting a document and after trimming it."""
    user = F.col("user_id").cast("string")
    key = F.when(F.col("event_type") == "view", F.concat(user, F.lit("/preview"))).otherwise(F.concat(user, F.lit("/scale/"), (F.col("event_id") % 5).cast("string"), F.lit("/"), "event_type"))
    preview = F.endswith(F.col("key"), F.lit("/preview"))
    return table(spark, sf_dir, "events").withColumn("key", key).select("event_id", "key", (F.contains(F.col("key"), F.lit("/3/")) | preview).alias("kept"), (F.col("user_id") != 7).alias("remembered"), ((F.col("user_id") != 7) | preview).alias("trimmed"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.round(F.col("value") * 1000).cast("long")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.concat_ws("/", "event_type", F.col("event_id") % 3).alias("key"), size.alias("bytes"))


def _lru(least: int) -> str:
    """A cache as a fold over each user's accesses; lists hold keys and sizes, the oldest first."""
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, event_type || '/' || (event_id % 3) AS key, round(value * 1000)::BIGINT AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT user_id, 0::BIGINT AS r, 0::BIGINT AS seq, ''::VARCHAR AS outcome, 0::BIGINT AS evictions, []::VARCHAR[] AS ks, []::BIGINT[] AS bs FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, r, seq, outcome, evictions + CASE WHEN outcome = 'stored' THEN cut ELSE 0 END, CASE WHEN outcome = 'refused' THEN ks ELSE k2[cut + 1:] END, CASE WHEN outcome = 'refused' THEN bs ELSE b2[cut + 1:] END
FROM (SELECT *, CASE WHEN outcome <> 'stored' THEN 0 ELSE coalesce(list_min(list_filter(range(0, greatest(len(b2) - {least}, 0) + 1), lambda c: coalesce(list_sum(b2[c + 1:]), 0) <= 150000)), len(b2) - {least}) END AS cut
FROM (SELECT *, list_append(CASE WHEN p > 0 THEN list_concat(ks[1:p - 1], ks[p + 1:]) ELSE ks END, key) AS k2, list_append(CASE WHEN p > 0 THEN list_concat(bs[1:p - 1], bs[p + 1:]) ELSE bs END, bytes) AS b2,
CASE WHEN p > 0 AND bs[p] = bytes THEN 'hit' WHEN bytes > 150000 AND {least} = 0 THEN 'refused' ELSE 'stored' END AS outcome
FROM (SELECT e.user_id, e.r, e.seq, e.key, e.bytes, f.evictions, f.ks, f.bs, coalesce(list_position(f.ks, e.key), 0) AS p FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1))))
SELECT user_id, seq, outcome, evictions::BIGINT AS evictions, len(ks) AS entries, coalesce(list_sum(bs), 0)::BIGINT AS held FROM f WHERE r > 0"""


@query(_lru(0))
def lru_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of 150 kB for each user; what is larger is refused."""
    return schedule.lru(accesses(spark, sf_dir), "user_id", 150_000)


@query(_lru(1))
def lru_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that always keeps one entry."""
    return schedule.lru(accesses(spark, sf_dir), "user_id", 150_000, least=1)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, event_id % 7 AS g, event_type = 'purchase' AS free, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT user_id, 0::BIGINT AS r, 0::BIGINT AS seq, 0::BIGINT AS slot, ''::VARCHAR AS state, []::BIGINT[] AS ss, []::BIGINT[] AS gs, 0::BIGINT AS turn FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, r, seq, slot, state, CASE WHEN free THEN rest_s ELSE list_append(rest_s, slot) END, CASE WHEN free THEN rest_g ELSE list_append(rest_g, g) END, CASE WHEN free THEN turn ELSE (slot + 1) % 4 END
FROM (SELECT *, CASE WHEN p > 0 THEN list_concat(ss[1:p - 1], ss[p + 1:]) ELSE ss END AS rest_s, CASE WHEN p > 0 THEN list_concat(gs[1:p - 1], gs[p + 1:]) ELSE gs END AS rest_g
FROM (SELECT *, coalesce(list_position(ss, slot), 0) AS p
FROM (SELECT *, CASE WHEN free THEN coalesce(ss[1], -1) WHEN len(empty) > 0 THEN empty[1] ELSE list_min(list_transform(range(1, len(ss) + 1), lambda i: gs[i] * 10 + ss[i])) % 10 END AS slot,
CASE WHEN free THEN CASE WHEN len(ss) > 0 THEN 'freed' ELSE 'empty' END WHEN len(empty) > 0 THEN 'claimed' ELSE 'reclaimed' END AS state
FROM (SELECT e.user_id, e.r, e.seq, e.g, e.free, f.ss, f.gs, f.turn, list_filter([f.turn % 4, (f.turn + 1) % 4, (f.turn + 2) % 4, (f.turn + 3) % 4], lambda s: NOT list_contains(f.ss, s)) AS empty
FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)))))
SELECT user_id, seq, slot::INT AS slot, state FROM f WHERE r > 0""")
def ring_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of four slots: purchases give a slot back, all other events claim one."""
    claims = requests(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), "generation", (F.col("event_type") == "purchase").alias("free"))
    return schedule.ring(claims, "user_id", 4)


@query("""WITH RECURSIVE j AS (SELECT user_id, list({'at': epoch_us(ts) / 1e6::DOUBLE, 'p': CASE event_type WHEN 'view' THEN -1 WHEN 'signup' THEN 0 ELSE -2 END, 's': event_id, 'took': value * 600} ORDER BY ts, event_id) AS todo FROM events GROUP BY user_id),
f AS (SELECT user_id, todo, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0::BIGINT AS seq, 0.0::DOUBLE AS start, -1 AS worker FROM j
UNION ALL SELECT user_id, list_filter(todo, lambda x: x.s <> seq), CASE worker WHEN 0 THEN start + took ELSE w0 END, CASE worker WHEN 1 THEN start + took ELSE w1 END, seq, start, worker
FROM (SELECT user_id, todo, w0, w1, start, worker, best.s AS seq, best.took AS took
FROM (SELECT *, list_sort(list_transform(list_filter(todo, lambda x: x.at <= start), lambda x: {'p': x.p, 's': x.s, 'took': x.took}))[1] AS best
FROM (SELECT user_id, todo, w0, w1, greatest(least(w0, w1), todo[1].at) AS start, CASE WHEN w0 <= w1 THEN 0 ELSE 1 END AS worker FROM f WHERE len(todo) > 0))))
SELECT user_id, seq, start, worker::INT AS worker FROM f WHERE worker >= 0""")
def dispatch_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of jobs on two workers for each user, by priority."""
    kind = F.col("event_type")
    jobs = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrival"), F.when(kind == "view", 1).when(kind == "signup", 0).otherwise(2).alias("priority"), (F.col("value") * 600).alias("took"))
    return schedule.workers(jobs, "user_id", 2)


@query("""SELECT slot, arg_min(event_id, (generation, event_id)) AS event_id, min(generation) AS generation FROM (SELECT *, event_id % 7 AS generation, user_id % 4 AS slot FROM events WHERE event_type <> 'error') GROUP BY slot""")
def reclaim_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the lowest generation of each slot, the first on ties."""
    ready = requests(spark, sf_dir).where("event_type <> 'error'").withColumn("slot", F.col("user_id") % 4)
    return ready.groupBy("slot").agg(F.min(F.struct("generation", "event_id")).alias("x")).select("slot", "x.event_id", "x.generation")


@query("""SELECT f.range::INT AS frame, count(p.p_partkey) AS pages, count(p.p_partkey) = 0 AS white FROM range(0, 240) f LEFT JOIN (SELECT p_partkey, p_partkey * 900.0::DOUBLE AS y, p_partkey * 900.0::DOUBLE + 600 + 8 * p_size - 200 AS bottom FROM part) p
ON p.bottom >= f.range * 2500 / 60.0::DOUBLE AND p.y <= f.range * 2500 / 60.0::DOUBLE + 80 GROUP BY 1""")
def scroll_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """240 frames at 2500 px/s over a strip of pages 900 px apart: pages on each frame, and white ones."""
    frames = spark.range(240).select(F.col("id").cast("int").alias("frame"), (F.col("id") * 2500 / 60.0).alias("top"))
    strip = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 900.0).alias("y"), (F.col("p_partkey") * 900.0 + 600 + 8 * F.col("p_size") - 200).alias("bottom"))
    # a view of 80 px meets pages that start in its band of 900 px or one of its neighbours
    cut = strip.withColumn("band", F.floor(F.col("y") / 900))
    asked = frames.withColumn("band", F.explode(F.sequence(F.floor(F.col("top") / 900) - 2, F.floor((F.col("top") + 80) / 900))))
    met = asked.join(cut, "band").where((F.col("bottom") >= F.col("top")) & (F.col("y") <= F.col("top") + 80)).groupBy("frame").agg(F.count("*").alias("pages"))
    return frames.join(met, "frame", "left").select("frame", F.coalesce("pages", F.lit(0)).alias("pages"), F.col("pages").isNull().alias("white"))
