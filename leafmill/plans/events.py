"""Statistics, motion and supervision over the event stream.

Derivations: an event's ``value`` is a latency in ms or a scroll offset, its
user a document or worker, its type an outcome, its day a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill import functions as fn
from leafmill.operators import motion, stats, supervise
from leafmill.plans import query, table

_STATS = """count(*) AS n, min(value) AS min_ms, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms,
 quantile_disc(value, 0.99) AS p99_ms, max(value) AS max_ms, round(avg(value), 6) AS mean_ms"""


@query(f"""SELECT *, CASE WHEN target_ms IS NOT NULL THEN CASE WHEN p95_ms <= target_ms THEN 'PASS' ELSE 'FAIL' END END AS verdict
FROM (SELECT event_type, {_STATS}, CASE event_type WHEN 'click' THEN 60.0::DOUBLE WHEN 'error' THEN 50.0::DOUBLE WHEN 'purchase' THEN 400.0::DOUBLE WHEN 'signup' THEN 40.0::DOUBLE END AS target_ms
FROM events GROUP BY event_type)""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the value of each event type with a verdict on p95."""
    got = stats.statistics(table(spark, sf_dir, "events"), ["event_type"], "value")
    target = F.create_map(*(F.lit(x) for p in (("click", 60.0), ("error", 50.0), ("purchase", 400.0), ("signup", 40.0)) for x in p))
    got = got.withColumn("target_ms", F.try_element_at(target, F.col("event_type")))
    return got.withColumn("verdict", stats.verdict(F.col("p95_ms"), F.col("target_ms")))


@query(f"SELECT event_id, {_STATS} FROM events WHERE event_type = 'signup' GROUP BY event_id")
def singleton_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of single measurements."""
    return stats.statistics(table(spark, sf_dir, "events").where("event_type = 'signup'"), ["event_id"], "value")


@query("""SELECT user_id, hits, misses, CASE WHEN hits + misses > 0 THEN round(hits * 100.0::DOUBLE / (hits + misses))::BIGINT END AS hit_rate, bytes, round(bytes / 1048576.0::DOUBLE)::BIGINT AS megabytes
FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses, sum((value * 100000)::BIGINT)::BIGINT AS bytes FROM events GROUP BY user_id)""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses, hit rate and bytes of each user."""
    got = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"), F.sum(F.round(F.col("value") * 100000).cast("long")).alias("bytes")
    )
    return got.select("user_id", "hits", "misses", stats.hit_rate(F.col("hits"), F.col("misses")).alias("hit_rate"), "bytes", F.round(F.col("bytes") / 1048576).cast("long").alias("megabytes"))


@query("""SELECT day, n, errors, n - coalesce(lag(n) OVER (ORDER BY day), 0) AS delta, greatest(errors - coalesce(lag(errors) OVER (ORDER BY day), 0), 0) AS growth
FROM (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)""")
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each day against the day before, and a difference that stops at zero."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    before = lambda c: F.coalesce(F.lag(c).over(Window.orderBy("day")), F.lit(0))  # noqa: E731  one row for each day
    return days.select("day", "n", "errors", (F.col("n") - before("n")).alias("delta"), F.greatest(F.col("errors") - before("errors"), F.lit(0)).alias("growth"))


@query("""WITH t AS (SELECT event_type, avg(value) AS a, quantile_disc(value, 0.5) AS m FROM events GROUP BY 1)
SELECT event_type, round(a / greatest(m, 0.001), 6) AS ratio, (SELECT sum(n_chars) // greatest(count(*), 1) FROM documents)::BIGINT AS chars_each, round(a * 500, 4) AS projected FROM t""")
def cost_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cost ratio with a floor, characters a page by whole division, a projection to 500 pages."""
    each = table(spark, sf_dir, "documents").agg(F.expr("sum(n_chars) div greatest(count(*), 1)").alias("chars_each"))
    got = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("a"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("m"))
    return got.join(F.broadcast(each)).select("event_type", F.round(stats.cost_ratio(F.col("a"), F.col("m")), 6).alias("ratio"), F.col("chars_each"), F.round(F.col("a") * 500, 4).alias("projected"))  # one row


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1000.0::DOUBLE AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT user_id, r, value AS o, t, 0.0::DOUBLE AS v FROM e WHERE r = 1
 UNION ALL SELECT e.user_id, e.r, CASE WHEN e.t - f.t < 1 THEN f.o ELSE e.value END, CASE WHEN e.t - f.t < 1 THEN f.t ELSE e.t END,
 CASE WHEN e.t - f.t < 1 THEN f.v ELSE 0.6 * f.v + 0.4 * ((e.value - f.o) / (e.t - f.t) * 1000) END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, round(v * 1e6, 6) AS velocity, CASE WHEN v * 1e6 > 40 THEN 1 WHEN v * 1e6 < -40 THEN -1 ELSE 0 END AS direction
FROM (SELECT user_id, arg_max(v, r) AS v FROM f GROUP BY user_id)""")
def ema_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed scroll velocity of each user in units of 1e-6, and its direction."""
    got = motion.velocity(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id")
    scaled = F.col("velocity") * 1e6
    return got.select("user_id", F.round(scaled, 6).alias("velocity"), fn.direction(scaled).alias("direction"))


@query("""WITH b AS (SELECT user_id, (min(event_id) % 40)::INT AS first, (min(event_id) % 40 + 2)::INT AS last, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS v FROM events GROUP BY user_id),
p AS (SELECT *, 4 * v AS vel, least(8, greatest(1, floor(abs(4 * v) / 400 + 0.5)))::INT AS reach FROM b),
c AS (
 SELECT user_id, last + k AS page, k AS rank FROM p, range(1, 9) t(k) WHERE vel > 40 AND k <= reach
 UNION ALL SELECT user_id, first - 1, 100 FROM p WHERE vel > 40
 UNION ALL SELECT user_id, first - k, k FROM p, range(1, 9) t(k) WHERE vel < -40 AND k <= reach
 UNION ALL SELECT user_id, last + 1, 100 FROM p WHERE vel < -40
 UNION ALL SELECT user_id, last + 1, 1 FROM p WHERE vel BETWEEN -40 AND 40
 UNION ALL SELECT user_id, first - 1, 2 FROM p WHERE vel BETWEEN -40 AND 40)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY rank) - 1)::INT AS pos, page::INT AS page FROM c WHERE page BETWEEN 0 AND 41""")
def prefetch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to fetch in order, from the visible range and the velocity."""
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(
        (F.min("event_id") % 40).cast("int").alias("first"), (F.max_by("value", F.struct("ts", "event_id")) - F.min_by("value", F.struct("ts", "event_id"))).alias("v")
    )
    visible = seen.select("user_id", F.sequence("first", F.col("first") + 2).alias("visible"), (F.col("v") * 4).alias("velocity"))
    pages = motion.prefetch(F.col("visible"), F.col("velocity"), F.lit(42))
    return visible.select("user_id", F.posexplode(pages).alias("pos", "page"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 1200 * 1000000::BIGINT""")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each burst; a burst ends with 1200 s of silence (T14, scaled from ms)."""
    return motion.last_of_burst(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 1200.0).select("user_id", "event_id", "value")


@query("""SELECT frame, user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS merged FROM (SELECT *, time_bucket(INTERVAL 16 MINUTE, ts, TIMESTAMP '1970-01-01') AS frame FROM events) GROUP BY 1, 2""")
def frame_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one draw for each frame of 16 minutes (T16, scaled from ms)."""
    framed = table(spark, sf_dir, "events").groupBy(F.window("ts", "16 minutes").alias("w"), "user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("merged"))
    return framed.select(F.col("w.start").alias("frame"), "user_id", "event_id", "merged")


@query("""SELECT user_id, event_id, silence, CASE WHEN event_type = 'error' THEN 'Dead' WHEN silence IS NULL OR silence <= 6000 THEN 'Alive' WHEN silence > 60000 THEN 'Hung' ELSE 'Slow' END AS health
FROM (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000000.0::DOUBLE AS silence FROM events)""")
def heartbeat_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of each worker after each beat, by the silence that follows, in scaled seconds."""
    return supervise.heartbeats(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error", 6000.0, 60000.0).select("user_id", "event_id", "silence", "health")


@query("""WITH i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, island, event_type = 'error' ORDER BY ts, event_id) AS n FROM i WHERE event_type = 'error')
SELECT user_id, event_id, n AS failures, least(250 * power(2, least(n, 8)), 30000)::BIGINT AS wait_ms FROM f""")
def restart_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive failures, reset by a success, and the wait before the next start."""
    got = supervise.consecutive_failures(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return got.select("user_id", "event_id", "failures", fn.backoff_ms(F.col("failures")).alias("wait_ms"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day FROM events WHERE event_type = 'error'), r AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'view')
SELECT r.user_id, count(*) AS strikes, count(*) >= 2 AS quarantined FROM r JOIN d USING (user_id, day) GROUP BY 1""")
def poison_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strike for each document that is resident (viewed that day) when its worker dies (an error); two quarantine it."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    deaths, residents = e.where("event_type = 'error'").select("user_id", "day"), e.where("event_type = 'view'").select("user_id", "day").distinct()
    return supervise.strikes(deaths, residents, ["user_id", "day"], "user_id")


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, min(ts) AS died FROM events WHERE event_type = 'error' GROUP BY 1, 2), s AS (SELECT user_id, count(*) AS strikes FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT d.user_id, d.day, e.event_id, s.strikes >= 2 AS quarantined FROM d JOIN events e ON e.user_id = d.user_id AND e.ts::DATE = d.day AND e.ts < d.died AND e.event_type = 'view' JOIN s ON s.user_id = d.user_id""")
def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents open when a worker first died on a day, each with its quarantine flag."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    died = e.where("event_type = 'error'").groupBy("user_id", "day").agg(F.min("ts").alias("died"))
    struck = e.where("event_type = 'error'").groupBy("user_id").agg((F.count("*") >= 2).alias("quarantined"))
    return e.where("event_type = 'view'").join(died, ["user_id", "day"]).where("ts < died").join(struck, "user_id").select("user_id", "day", "event_id", "quarantined")


@query("""SELECT s.s_suppkey AS worker, count(l.l_orderkey) AS load FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY 1""")
def worker_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (line items) on each worker (supplier), workers without any included."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("worker"))
    workers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"))
    return supervise.loads(workers, items, "worker")


@query("""WITH l AS (SELECT s.s_nationkey AS pool, s.s_suppkey AS worker, count(i.l_orderkey) AS load FROM supplier s LEFT JOIN lineitem i ON i.l_suppkey = s.s_suppkey GROUP BY 1, 2),
a AS (SELECT *, worker = max(worker) OVER (PARTITION BY pool) AS active FROM l)
SELECT pool, worker, load FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY active::INT, load, worker) AS r FROM a) WHERE r = 1""")
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each pool (nation) the least loaded worker, the active one (highest key) only if it is alone."""
    workers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pool"), F.col("s_suppkey").alias("worker"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("worker"))
    load = supervise.loads(workers.select("worker"), items, "worker").join(workers, "worker")
    active = load.withColumn("active", F.col("worker") == F.max("worker").over(Window.partitionBy("pool")))
    return supervise.place(active, "pool")


@query("""SELECT a.event_id AS request, b.event_id AS reply, CASE WHEN b.event_id IS NULL THEN 'Unresponsive' ELSE 'Answered' END AS state
FROM (SELECT * FROM events WHERE event_type = 'click') a LEFT JOIN LATERAL (SELECT event_id FROM events b WHERE b.event_type = 'view' AND b.user_id = a.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR ORDER BY b.ts LIMIT 1) b ON true""")
def response_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request (click) with the first reply (view) of its user within 6 hours."""
    e = table(spark, sf_dir, "events")
    return supervise.replies(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "ts", "event_id", "6 hours")
