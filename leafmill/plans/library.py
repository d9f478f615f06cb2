"""More of the store, the supervisor and the queue over the given tables.

Derivations: customers and their names are files and paths; an event's user
modulo 64 is its slot, and event_id modulo 7 its epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill import functions as fn
from leafmill.operators import containers as container_ops
from leafmill.operators import motion, outline, relations, schedule, selection, stats
from leafmill.plans import query, table
from leafmill.plans.geometry import _PAGES, pages
from leafmill.plans.scheduling import _GATE, _lru, accesses, gate


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("\\library\\"), F.col("c_name"), F.lit(".pdf"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fn.normal_path(path).alias("path"), F.sha2(fn.normal_path(path), 256).alias("path_hash"), (F.col("c_custkey") % 5 == 0).alias("pinned"), F.col("c_nationkey").alias("nation"))


@query("SELECT c_custkey AS id, '/library/' || c_name || '.pdf' AS path, c_custkey % 5 = 0 AS pinned FROM customer WHERE c_name = 'Customer#000000042'")
def find_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of one path, found by the hash of its normal form."""
    return relations.find(library(spark, sf_dir), "\\library/Customer#000000042.pdf").select("id", "path", "pinned")


@query("SELECT c_custkey AS id, c_name || '.pdf' AS name, c_custkey % 3 > 0 AS available FROM customer")
def recent_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of known files, and whether a listing still has them."""
    files = library(spark, sf_dir)
    listing = files.where("id % 3 > 0").select("path")
    return relations.available(files, listing).select("id", fn.base_name(F.col("path")).alias("name"), "available")


@query("SELECT o_orderkey AS seq, o_custkey % 500 AS page FROM orders WHERE o_custkey % 4 > 0")
def outline_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline entries that lead to a page."""
    page = F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") % 500)
    return outline.enabled(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), page.alias("page")), "page")


@query("""SELECT user_id AS file_id, sha256(event_id::VARCHAR) AS base_hash, event_type AS ops, event_id AS updated FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def drafts_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last draft of each file, whatever it was based on."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), "ts", F.col("event_id").alias("updated"), F.sha2(F.col("event_id").cast("string"), 256).alias("base_hash"), F.col("event_type").alias("ops"))
    return relations.latest(log, ["file_id"], ["ts", "updated"]).select("file_id", "base_hash", "ops", "updated")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 2 = 0 ELSE c_custkey % 5 = 0 END AS pinned FROM customer")
def pin_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins set by id; files that no update names keep theirs."""
    files = library(spark, sf_dir)
    return relations.pinned(files, files.where("id % 7 = 0").select("id", (F.col("id") % 2 == 0).alias("pinned")), "id").select("id", "pinned")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(sha256(doc_id::VARCHAR)) END AS hash FROM documents""")
def hash_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of 32 bytes; shorter and longer slices are none."""
    digest = F.unhex(F.sha2(F.col("doc_id").cast("string"), 256))
    kind = F.col("doc_id") % 3
    raw = F.when(kind == 0, digest).when(kind == 1, F.substring(digest, 1, 8)).otherwise(F.concat(digest, digest))
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(fn.whole_hash(raw)).alias("hash"))


@query("SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1)::INT AS page, l_quantity::DOUBLE AS size FROM lineitem")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's list of sizes, taken apart again with each one's index."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("size")))).alias("sizes"))
    return lists.select("l_orderkey", F.posexplode("sizes.size").alias("page", "size"))


@query(f"""SELECT p.doc, page, CASE WHEN p_partkey % 5 = 0 THEN 612.0 ELSE width END::DOUBLE AS width, CASE WHEN p_partkey % 5 = 0 THEN 792.0 ELSE height END::DOUBLE AS height FROM ({_PAGES}) p""")
def page_size_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from the fast scan, and page by page from the slow one where that has none."""
    every = pages(spark, sf_dir)
    fast = every.where("p_partkey % 5 > 0").select("doc", "page", "width", "height")
    slow = every.select("doc", "page", F.lit(612.0).alias("width_slow"), F.lit(792.0).alias("height_slow"))
    return slow.join(fast, ["doc", "page"], "left").select("doc", "page", F.coalesce("width", "width_slow").alias("width"), F.coalesce("height", "height_slow").alias("height"))


@query(f"""WITH e AS (SELECT event_id, 'Brand#' || (1 + user_id % 25) AS doc, (event_id % 120)::INT AS page FROM events) SELECT event_id, e.doc, e.page, p.height FROM e LEFT JOIN ({_PAGES}) p USING (doc, page)""")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each asked page by its index, null beyond the last."""
    asked = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Brand#"), 1 + F.col("user_id") % 25).alias("doc"), (F.col("event_id") % 120).cast("int").alias("page"))
    return asked.join(pages(spark, sf_dir).select("doc", "page", "height"), ["doc", "page"], "left").select("event_id", "doc", "page", "height")


@query("""WITH s AS (SELECT user_id % 64 AS slot, max(event_id % 7) AS epoch, arg_max(event_type, event_id) AS state FROM events WHERE user_id % 64 <> 9 GROUP BY 1)
SELECT event_id, user_id % 64 AS slot, CASE WHEN s.epoch IS NULL THEN 'NoSlot' WHEN s.epoch <> event_id % 7 THEN 'Stale' WHEN s.state <> 'view' THEN 'WrongState' ELSE 'Acquired' END AS outcome FROM events LEFT JOIN s ON s.slot = user_id % 64""")
def ring_acquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers of slots by (slot, epoch): another epoch is stale."""
    refs = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 64).alias("slot"), (F.col("event_id") % 7).alias("epoch"), "event_type")
    slots = refs.where("slot <> 9").groupBy("slot").agg(F.max("epoch").alias("epoch"), F.max_by("event_type", "event_id").alias("state"))
    return relations.acquired(refs, slots, "slot", "epoch", "state", "view").select("event_id", "slot", "outcome")


@query("""SELECT c_custkey AS worker, CASE WHEN c_nationkey % 5 = 0 THEN 'NoHandshake' WHEN c_nationkey % 5 = 3 THEN 'Accepted' ELSE 'ProtocolMismatch' END AS greeting FROM customer""")
def protocol_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers whose first message names the expected protocol."""
    protocol = F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey") % 5)
    return relations.greeted(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("worker"), protocol.alias("protocol")), "protocol", 3).select("worker", "greeting")


@query("""SELECT user_id, epoch_us(ts) // 7200000000 + 1 AS poll, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 7200000000 ORDER BY ts DESC, event_id DESC) = 1""")
def status_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a poll every two hours sees of each user."""
    return motion.polled(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", 7200).select("user_id", "poll", "event_id", "event_type")


@query("""SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000.0::DOUBLE AS ms, epoch(ts) < epoch(now()) AS past FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds since a user's event before, and whether it lies before now."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", fn.elapsed_ms(before, F.col("ts")).alias("ms"), (F.unix_seconds(F.col("ts").cast("timestamp")) < fn.unix_now()).alias("past"))


@query("""SELECT event_type, count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95 FROM (SELECT event_type, value AS v FROM events WHERE event_id % 17 > 0) GROUP BY 1""")
def ordered_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of values of which some are no numbers; those have no place in the order."""
    value = F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    known = table(spark, sf_dir, "events").select("event_type", value.alias("v")).where(~F.isnan("v"))
    return selection.ranked(known, ["event_type"], "v", {"p50": 0.5, "p95": 0.95}).select("event_type", "n", "p50", "p95")


@query("""WITH t AS (SELECT [r_regionkey] AS path, 0 AS depth, r_name AS title FROM region UNION ALL SELECT [n_regionkey, n_nationkey], 1, n_name FROM nation
UNION ALL SELECT [n_regionkey, n_nationkey, c_custkey], 2, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT depth, title, array_to_string(path, '/') AS path FROM (SELECT * FROM t ORDER BY path LIMIT 1000)""")
def outline_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand nodes of a tree in preorder; the cap on nodes is the feature."""
    from leafmill.plans.store import outline_links

    flat = outline.preorder(outline.flatten(outline_links(spark, sf_dir), levels=3), 1000)
    return flat.select("depth", "title", F.array_join(F.transform("path", lambda k: k.cast("string")), "/").alias("path"))


@query(f"""SELECT user_id, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome <> 'hit') AS misses, max(evictions) AS evictions, arg_max(entries, seq) AS entries, arg_max(held, seq) AS bytes, 150000::BIGINT AS budget FROM ({_lru(0)}) GROUP BY 1""")
def cache_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses, evictions, entries, bytes and budget of each cache."""
    log = schedule.lru(accesses(spark, sf_dir), "user_id", 150_000)
    return log.groupBy("user_id").agg(
        F.count_if(F.col("outcome") == "hit").alias("hits"), F.count_if(F.col("outcome") != "hit").alias("misses"), F.max("evictions").alias("evictions"),
        F.max_by("entries", "seq").alias("entries"), F.max_by("held", "seq").alias("bytes"), F.lit(150_000).cast("long").alias("budget"),
    )


@query(f"""WITH o AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type <> 'view' AND generation < epoch THEN 'superseded' WHEN event_id % 29 = 0 THEN 'shed' WHEN event_id % 23 = 0 THEN 'coalesced'
WHEN ts::DATE = (SELECT max(ts)::DATE FROM events) THEN CASE WHEN event_type = 'click' THEN 'inflight' ELSE 'queued' END ELSE 'rendered' END AS outcome FROM ({_GATE}))
SELECT user_id, {", ".join(f"count(*) FILTER (outcome = '{n}') AS {n}" for n in ("rendered", "superseded", "shed", "failed", "coalesced", "queued", "inflight"))} FROM o GROUP BY 1""")
def render_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of each document; what came on the last day is queued or in flight."""
    held = gate(spark, sf_dir).withColumn("day", F.to_date("ts"))
    last = held.agg(F.max("day").alias("last"))  # one row
    kind, number = F.col("event_type"), F.col("event_id")
    outcome = F.when(kind == "error", "failed").when(F.col("stale"), "superseded").when(number % 29 == 0, "shed").when(number % 23 == 0, "coalesced")
    outcome = outcome.when(F.col("day") == F.col("last"), F.when(kind == "click", "inflight").otherwise("queued")).otherwise("rendered")
    return stats.render_counters(held.join(F.broadcast(last)).withColumn("outcome", outcome), ["user_id"])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 0 ELSE 2 END * 1000000000000::BIGINT + event_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT user_id, 0::BIGINT AS r, NULL::BIGINT AS shed, NULL::BIGINT AS served, []::BIGINT[] AS q FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, r, shed, served, list_filter(q, lambda j: j IS DISTINCT FROM served)
FROM (SELECT user_id, r, shed, q, CASE WHEN r % 2 = 0 THEN list_min(list_filter(q, lambda j: j // 1000000000000 = list_max(q) // 1000000000000)) END AS served
FROM (SELECT user_id, r, shed, list_filter(q, lambda j: j IS DISTINCT FROM shed) AS q
FROM (SELECT user_id, r, q, CASE WHEN len(q) > 3 THEN list_min(q) END AS shed
FROM (SELECT e.user_id, e.r, list_append(f.q, e.job) AS q FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)))))
SELECT e.user_id, e.seq, CASE WHEN s.r IS NOT NULL THEN 'shed' WHEN v.r IS NOT NULL THEN 'served' ELSE 'queued' END AS outcome, coalesce(s.r, v.r) AS after
FROM e LEFT JOIN f s ON s.user_id = e.user_id AND s.shed = e.job LEFT JOIN f v ON v.user_id = e.user_id AND v.served = e.job""")
def arrival_shedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues of three for each user, one served after every second arrival: what is shed as jobs arrive."""
    kind = F.col("event_type")
    jobs = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.when(kind == "view", 1).when(kind == "signup", 0).otherwise(2).alias("priority"))
    return schedule.shed_on_arrival(jobs, "user_id", 3, 2)


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS nth, coalesce(text, '') AS message FROM conversations""")
def frame_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as one stream of frames, and the messages read from it."""
    from leafmill import sources

    said = sources.framed(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")), "text")
    streams = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.hex("frame").alias("hex")))).alias("turns"))
    streams = streams.select(F.col("conv_id").cast("string").alias("path"), F.unhex(F.array_join("turns.hex", "")).alias("raw"))
    return sources.frames(streams, "raw").select(F.col("path").cast("long").alias("conv_id"), "nth", F.col("message").cast("string").alias("message"))


@query()
def file_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes of the folder's tables, sorted (S06, S24); its times differ on each machine."""
    from leafmill import sources

    return sources.stamps(spark, sf_dir, "*.parquet").select(fn.base_name(F.col("path")).alias("name"), "size").orderBy("name")


@query("SELECT event_id, event_type AS level, ts::DATE::VARCHAR AS date FROM events")
def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows as JSON with the day that names their folder, read back."""
    from leafmill import sources

    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("level"), "ts")
    lines = sources.log_lines(rows).select("date", F.from_json("line", "event_id long, level string").alias("row"))
    return lines.select("row.event_id", "row.level", F.col("date").cast("string").alias("date"))


@query("""SELECT event_id, event_type AS level, value, ts::DATE::VARCHAR AS day FROM events WHERE ts::DATE > (SELECT max(ts::DATE) FROM events) - 10""")
def log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten days of a log that took its rows in batches, one of them twice, and rotated (S22, S23); the retention is the feature."""
    from leafmill.sources import logs, shared

    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("level"), "value", "ts")
    sink = logs.LogSink(spark, shared.new_folder(spark, "log"), rows.schema, days=10)
    for batch in (0, 1, 2, 1):
        sink.write(rows.where(F.col("event_id") % 3 == batch), batch)
    sink.rotate()
    return sink.read().select("event_id", "level", "value", "day")


_CONTAINERS = """SELECT p_brand AS doc, any_value(CASE WHEN n % 25 < 18 THEN 0 ELSE n % 25 - 17 END)::INT AS code, any_value(n % 2 = 0) AS password,
 list(CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE 600 + p_size END ORDER BY p_partkey) AS listed, list(CASE WHEN p_partkey % 21 = 10 THEN NULL ELSE 600 + p_size END ORDER BY p_partkey) AS own
FROM (SELECT *, substr(p_brand, 7)::INT AS n FROM part) GROUP BY p_brand"""


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as stored documents and their parts as pages: some directories have gaps, some bodies no box, some documents do not open."""
    n = F.substring("p_brand", 7, 9).cast("int")
    tall = (600 + F.col("p_size")).cast("string")
    entry = F.when(F.col("p_partkey") % 7 == 3, "damaged").otherwise(F.concat(F.lit("612 x "), tall))
    body = F.when(F.col("p_partkey") % 21 == 10, "<< /Type /Page >>").otherwise(F.concat(F.lit("<< /Type /Page /MediaBox [ 10 5 622 "), (605 + F.col("p_size")).cast("string"), F.lit(" ] >>")))
    page = F.sort_array(F.collect_list(F.struct("p_partkey", entry.alias("entry"), body.alias("body"))))
    made = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("doc")).agg(F.first(n).alias("n"), page.alias("pages"))
    code = F.when(F.col("n") % 25 < 18, 0).otherwise(F.col("n") % 25 - 17)
    return made.select("doc", code.alias("code"), (F.col("n") % 2 == 0).alias("password"), F.array_join("pages.entry", ";").alias("directory"), F.col("pages.body").alias("bodies"), F.size("pages").alias("n_bodies"))


@query(f"""WITH c AS ({_CONTAINERS}), p AS (SELECT doc, unnest(listed) AS a, unnest(own) AS b, unnest(range(len(own))) AS page FROM c WHERE code = 0)
SELECT doc, page::INT AS page, CASE WHEN coalesce(a, b) IS NOT NULL THEN 612.0 END::DOUBLE AS width, coalesce(a, b)::DOUBLE AS height, CASE WHEN coalesce(a, b) IS NULL THEN 'Corrupt' END AS error FROM p
UNION ALL SELECT doc, NULL, NULL, NULL, CASE code WHEN 2 THEN 'FileUnavailable' WHEN 4 THEN CASE WHEN password THEN 'PasswordWrong' ELSE 'PasswordRequired' END ELSE 'Corrupt' END FROM c WHERE code <> 0""")
def container_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sizes from stored directories, from bodies where those have gaps, and errors by kind."""
    from leafmill.sources import shared

    return container_ops.page_sizes(shared.kept(containers(spark, sf_dir), "containers"))
