"""Store semantics over the given tables.

Derivations: users are files, their events the log of openings; documents and
labels are files and their children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import functions as fn
from leafmill.operators import outline, relations, uri
from leafmill.plans import query, table
from leafmill.sources import migrations, shared

_MODES = ("single", "horizontal", "dual", "dual_cover")
_FILES = "SELECT user_id AS id, max(ts) FILTER (event_type <> 'error') AS last_opened, bool_or(event_type = 'purchase' AND value > 200) AS pinned FROM events GROUP BY 1"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_opened"), F.max((F.col("event_type") == "purchase") & (F.col("value") > 200)).alias("pinned"))


@query(f"SELECT * FROM ({_FILES}) WHERE last_opened IS NOT NULL ORDER BY pinned DESC, last_opened DESC, id LIMIT 20")
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty files, pinned ones first, then the last opened (D11, O01); the limit is the feature."""
    return relations.recent(files(spark, sf_dir), 20)


@query("""SELECT user_id, min(event_id) AS id, arg_max(value, (ts, event_id)) AS size, floor(epoch(max(ts)))::BIGINT AS mtime, bool_or(event_type = 'purchase') AS pinned FROM events GROUP BY user_id""")
def touch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each opening refreshes a file's stamp; the first id and the pin stay."""
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    got = relations.touched(log, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")
    return got.select("user_id", "id", F.col("row.value").alias("size"), F.unix_seconds(F.col("row.ts").cast("timestamp")).alias("mtime"), "pinned")


@query("""SELECT user_id, (event_id % 500)::INT AS page, value AS scroll_y, CASE WHEN event_type = 'view' THEN 'dual' WHEN event_type = 'click' THEN 'horizontal' WHEN event_type = 'purchase' THEN 'dual_cover' ELSE 'single' END AS view_mode, (event_id % 4)::INT AS rotation
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def reading_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each file; unknown view modes fall back."""
    raw = F.when(F.col("event_type") == "view", "dual").when(F.col("event_type") == "click", "horizontal").when(F.col("event_type") == "purchase", "dual_cover").otherwise(F.col("event_type"))
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", raw.alias("mode"))
    got = relations.latest(log, ["user_id"], ["ts", "event_id"])
    return got.select("user_id", (F.col("event_id") % 500).cast("int").alias("page"), F.col("value").alias("scroll_y"), fn.one_of(F.col("mode"), _MODES, "single").alias("view_mode"), (F.col("event_id") % 4).cast("int").alias("rotation"))


@query("""SELECT event_type AS key, user_id, arg_max(value::VARCHAR, (ts, event_id)) AS value FROM (SELECT event_type, user_id, ts, event_id, event_id AS value FROM events) GROUP BY 1, 2""")
def prefs_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each preference."""
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "user_id", "ts", "event_id", F.col("event_id").cast("string").alias("value"))
    return relations.latest(log, ["key", "user_id"], ["ts", "event_id"]).select("key", "user_id", "value")


@query("""WITH t AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'plenty' WHEN 'click' THEN ' ' || json_extract_string(props, '$.k') || ' ' WHEN 'signup' THEN json_extract_string(props, '$.k') || '.5' WHEN 'view' THEN '-' || json_extract_string(props, '$.k') ELSE json_extract_string(props, '$.k') END AS raw FROM events)
SELECT event_id, CASE WHEN regexp_full_match(trim(raw), '[+]?[0-9]+') THEN try_cast(trim(raw) AS BIGINT) END AS value FROM t""")
def prefs_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant whole numbers: trimmed, else null."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    raw = F.when(kind == "error", "plenty").when(kind == "click", F.concat(F.lit(" "), k, F.lit(" "))).when(kind == "signup", F.concat(k, F.lit(".5"))).when(kind == "view", F.concat(F.lit("-"), k)).otherwise(k)
    return table(spark, sf_dir, "events").select("event_id", fn.tolerant_int(raw).alias("value"))


@query("""SELECT d.doc_id, NOT coalesce(d.n_chars = p.size AND d.doc_id = p.mtime, false) AS changed FROM documents d
LEFT JOIN (SELECT page_id AS doc_id, CASE WHEN page_id < 100 THEN n END AS size, page_id AS mtime FROM pages JOIN (SELECT doc_id AS page_id, n_chars AS n FROM documents) USING (page_id)) p USING (doc_id)""")
def has_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is changed if its page is unknown, has no size or another stamp (P02); pages past 100 have none."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    known = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")).join(d.select("doc_id", "size"), "doc_id")
    known = known.select("doc_id", F.when(F.col("doc_id") < 100, F.col("size")).alias("size"), F.col("doc_id").alias("mtime"))
    return relations.changed(d, known, "doc_id", ["size", "mtime"])


@query("""SELECT l.doc_id, CASE WHEN sha256(d.text) = sha256(CASE WHEN l.toxic = 1 THEN d.text || '!' ELSE d.text END) THEN l.quality END AS ops FROM labels l JOIN documents d USING (doc_id)""")
def draft_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft (label) is withheld, not deleted, when its base hash is not the file's."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = table(spark, sf_dir, "labels").join(d, "doc_id")
    base = F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)
    return both.select("doc_id", F.when(F.sha2("text", 256) == base, F.col("quality")).alias("ops"))


@query("SELECT doc_id, quality, toxic FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'de')")
def cascade_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels left when the German documents go."""
    gone = table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id")
    return relations.without(table(spark, sf_dir, "labels"), gone, "doc_id").select("doc_id", "quality", "toxic")


@query("""SELECT event_id, CASE WHEN event_id % 6 > 3 THEN 'rotation' WHEN event_id % 5 > 3 THEN 'panel' WHEN value < 1 THEN 'size' END AS violation FROM events WHERE event_id % 6 > 3 OR event_id % 5 > 3 OR value < 1""")
def check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a CHECK refuses, with the first one they break."""
    rows = table(spark, sf_dir, "events")
    checks = {"rotation": (F.col("event_id") % 6).between(0, 3), "panel": (F.col("event_id") % 5).between(0, 3), "size": F.col("value") >= 1}
    return relations.violations(rows, checks).select("event_id", "violation")


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the hash of their content."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(r"""WITH u AS (SELECT page_id, replace(url, '/', '\') AS path FROM pages) SELECT page_id, replace(path, '\', '/') AS path, sha256(replace(path, '\', '/')) AS hash, sha256(lower(replace(path, '\', '/'))) AS folded,
coalesce(nullif(split_part(replace(path, '\', '/'), '/', -1), ''), replace(path, '\', '/')) AS name FROM u""")
def path_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with slashes one way, their identity with and without case, and base names."""
    path = F.replace(F.col("url"), F.lit("/"), F.lit("\\"))
    plain = fn.normal_path(path)
    return table(spark, sf_dir, "pages").select("page_id", plain.alias("path"), F.sha2(plain, 256).alias("hash"), F.sha2(fn.normal_path(path, True), 256).alias("folded"), fn.base_name(plain).alias("name"))


def outline_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as nodes with their parents."""
    key = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    return (
        r.select(key("r", F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("seq"), F.col("r_name").alias("title"))
        .unionByName(n.select(key("n", F.col("n_nationkey")).alias("id"), key("r", F.col("n_regionkey")).alias("parent"), F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("title")))
        .unionByName(c.select(key("c", F.col("c_custkey")).alias("id"), key("n", F.col("c_nationkey")).alias("parent"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("title")))
    )


@query("""SELECT r_regionkey AS seq, 0 AS depth, r_name AS title, r_regionkey::VARCHAR AS path FROM region
UNION ALL SELECT n_nationkey, 1, n_name, n_regionkey || '/' || n_nationkey FROM nation
UNION ALL SELECT c_custkey, 2, c_name, n_regionkey || '/' || n_nationkey || '/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def outline_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-level tree from parent links to rows with depth and path."""
    return outline.flatten(outline_links(spark, sf_dir), levels=3).select("seq", "depth", "title", F.array_join(F.transform("path", lambda k: k.cast("string")), "/").alias("path"))


_URI = """CASE event_id % 8 WHEN 0 THEN 'doc://' WHEN 1 THEN 'http://doc.localhost/' WHEN 2 THEN 'doc://localhost/' WHEN 3 THEN 'doc:///' WHEN 4 THEN 'file:///' ELSE 'doc://' END
|| CASE WHEN event_id % 11 = 5 THEN 'page' ELSE 'tile' END || '/' || user_id || '/' || CASE WHEN event_id % 13 = 7 THEN '0x10' ELSE (event_id % 40)::VARCHAR END || '/' || (event_id % 5) || '/' || (event_id % 70 * 1000) || '/2/1/' || CASE event_id % 3 WHEN 0 THEN 'sharp' WHEN 1 THEN 'preview' ELSE 'fast' END
|| CASE WHEN event_id % 17 = 3 THEN '/more' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN '?g=' || event_id || '&p=' || (event_id % 4) ELSE '' END || CASE WHEN event_id % 19 = 2 THEN '#x' ELSE '' END"""


def uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_URI.replace("::VARCHAR", "").replace("(event_id % 40)", "cast(event_id % 40 AS STRING)")).alias("uri"))


@query(f"""WITH u AS (SELECT event_id, {_URI} AS uri FROM events),
c AS (SELECT event_id, uri, regexp_extract(uri, '^(?:doc://(?:localhost/)?|https?://doc[.]localhost/)/?([^?#]*)', 1) AS body, split_part(CASE WHEN contains(uri, '?') THEN substr(uri, strpos(uri, '?') + 1) ELSE '' END, '#', 1) AS q,
 regexp_matches(uri, '^(doc://|https?://doc[.]localhost/)') AS scheme FROM u),
s AS (SELECT *, string_split(body, '/') AS p FROM c),
f AS (SELECT *, scheme AND len(p) = 8 AND p[1] = 'tile' AND regexp_full_match(p[2] || '/' || p[3] || '/' || p[4] || '/' || p[5] || '/' || p[6] || '/' || p[7], '[0-9]+(/[0-9]+){{5}}') AND p[8] IN ('sharp', 'preview', 'fast') AS shaped FROM s)
SELECT event_id, CASE WHEN NOT shaped THEN 'BadUri' WHEN p[4]::INT > 3 THEN 'BadRotation' WHEN p[5]::INT NOT BETWEEN 1 AND 64000 THEN 'BadScale' ELSE 'Ok' END AS state,
CASE WHEN shaped AND p[4]::INT <= 3 AND p[5]::INT BETWEEN 1 AND 64000 THEN body END AS tile_key,
coalesce(try_cast(regexp_extract(q, '(?:^|&)g=([0-9]+)(?:&|$)', 1) AS BIGINT), 0) AS generation, coalesce(try_cast(regexp_extract(q, '(?:^|&)p=([0-9]+)(?:&|$)', 1) AS BIGINT), 2) AS priority FROM f""")
def uri_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile addresses in four spellings, and bad ones."""
    return uri.parsed(uris(spark, sf_dir), "uri").select("event_id", "state", "tile_key", "generation", "priority")


@query("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def anti_missing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose labels are not loaded."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("""SELECT p.p_partkey, CASE WHEN s.s_suppkey IS NULL THEN 'UnknownDocument' ELSE 'Found' END AS state, s.s_nationkey AS worker, coalesce(s.s_nationkey % 4, 0)::INT AS rotation FROM part p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey""")
def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to workers; a miss is an unknown document, a missing rotation is 0."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_nationkey")
    got = table(spark, sf_dir, "part").select("p_partkey").join(s, "p_partkey", "left")
    return got.select("p_partkey", F.when(F.col("s_nationkey").isNull(), "UnknownDocument").otherwise("Found").alias("state"), F.col("s_nationkey").alias("worker"), F.coalesce(F.col("s_nationkey") % 4, F.lit(0)).cast("int").alias("rotation"))


@query("""SELECT n_nationkey AS cores, greatest(2, least(8, n_nationkey // 2))::INT AS pool, least(250 * power(2, least(n_nationkey, 8)), 30000)::BIGINT AS wait_ms,
(ceil((64 + n_nationkey * 64) / 64.0) * 64)::BIGINT + n_nationkey::BIGINT * 1048576 AS ring,
CASE WHEN n_nationkey % 3 = 0 THEN 2048 WHEN n_nationkey % 3 = 1 THEN CASE WHEN n_nationkey * 10 BETWEEN 64 AND 16384 THEN n_nationkey * 10 ELSE 2048 END ELSE 512 END::BIGINT AS budget FROM nation""")
def pool_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool size, backoff, ring size and cache budget."""
    n = F.col("n_nationkey")
    setting = F.when(n % 3 == 0, F.lit("99999")).when(n % 3 == 1, (n * 10).cast("string")).otherwise(F.lit("many"))
    return table(spark, sf_dir, "nation").select(n.alias("cores"), fn.pool_size(n).alias("pool"), fn.backoff_ms(n).alias("wait_ms"), fn.ring_bytes(n).alias("ring"), fn.cache_budget_mb(setting, F.lit("512")).alias("budget"))


@query("""SELECT r_regionkey, '{"kind":"' || r_name || '","page":' || r_regionkey || '}' AS payload, r_regionkey AS page, r_name || ' v1.' || r_regionkey AS title, (r_regionkey * 3) || ':' || r_name || ':' || r_regionkey % 4 AS signature, round(r_regionkey / 255.0::DOUBLE, 9) AS red FROM region""")
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads to JSON and back, assembled titles and signatures, colours."""
    r = table(spark, sf_dir, "region").withColumn("payload", F.to_json(F.struct(F.col("r_name").alias("kind"), F.col("r_regionkey").alias("page"))))
    return r.select(
        "r_regionkey",
        "payload",
        F.from_json("payload", "kind string, page int")["page"].alias("page"),
        F.format_string("%s v1.%d", "r_name", "r_regionkey").alias("title"),
        F.concat_ws(":", F.col("r_regionkey") * 3, "r_name", F.col("r_regionkey") % 4).alias("signature"),
        F.round(F.col("r_regionkey") / 255.0, 9).alias("red"),
    )


@query("""SELECT o_orderkey, (list_position(list_sort(o), 1) IS NULL)::BOOLEAN AS none, len(o)::INT AS n FROM (SELECT o_orderkey, list_distinct(list_value(o_orderkey % 7, o_custkey % 7, 3)) AS o FROM orders)""")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered distinct and subset tests on arrays."""
    o = F.array_distinct(F.array(F.col("o_orderkey") % 7, F.col("o_custkey") % 7, F.lit(3).cast("long")))
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.size(F.array_except(F.array(F.lit(1).cast("long")), o)) > 0).alias("none"), F.size(o).alias("n"))


#: An order is a node under the order before, and its lines are nodes under it; forty orders make a branch, which is deeper than an
#: outline may be. Some orders also stand under a line of their own, which is a cycle.
_LINKS = """SELECT o_orderkey // 40 % 2 AS doc, o_orderkey * 8 AS id, CASE WHEN o_orderkey % 40 > 0 THEN o_orderkey * 8 - 8 END AS parent, 0 AS seq FROM orders
UNION ALL SELECT DISTINCT l_orderkey // 40 % 2, l_orderkey * 8 + l_linenumber, l_orderkey * 8, l_linenumber::BIGINT FROM lineitem
UNION ALL SELECT o_orderkey // 40 % 2, o_orderkey * 8, o_orderkey * 8 + 1, 9 FROM orders WHERE o_orderkey % 10 = 7"""


def tangled_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("o"), F.col("l_linenumber").cast("long").alias("n")).distinct()
    node = lambda rows, at, parent, seq: rows.select((F.floor(F.col("o") / 40) % 2).alias("doc"), (F.col("o") * 8 + at).alias("id"), parent.alias("parent"), seq.cast("long").alias("seq"))
    orders = node(order, F.lit(0), F.when(F.col("o") % 40 > 0, F.col("o") * 8 - 8), F.lit(0))
    return orders.unionByName(node(line, F.col("n"), F.col("o") * 8, F.col("n"))).unionByName(node(order.where("o % 10 = 7"), F.lit(0), F.col("o") * 8 + 1, F.lit(9)))


@query(f"""WITH RECURSIVE links AS MATERIALIZED ({_LINKS}), walk AS (SELECT doc, id, 0 AS depth, [id] AS seen, [seq, id] AS path FROM links WHERE parent IS NULL
UNION ALL SELECT l.doc, l.id, w.depth + 1, list_append(w.seen, l.id), w.path || [l.seq, l.id] FROM walk w JOIN links l ON l.doc = w.doc AND l.parent = w.id WHERE w.depth < 31 AND NOT list_contains(w.seen, l.id))
SELECT doc, nth, depth, id FROM (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY path) - 1)::INT AS nth, depth, id FROM walk) WHERE nth < 20000""")
def outline_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines with cycles, too many levels and too many nodes, in preorder; the caps are part of an outline."""
    return outline.walked(tangled_links(spark, sf_dir))


@query("""WITH files AS (SELECT user_id AS id, 'lib/' || user_id % 40 AS path, max(event_id) AS last_opened, bool_or(event_type = 'purchase' AND value > 300) AS pinned FROM events GROUP BY user_id),
f AS (SELECT sha256(path) AS path_hash, max(pinned) OVER (PARTITION BY path) AS pinned, id, path, last_opened FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY last_opened DESC, id DESC) = 1),
s AS (SELECT user_id, (event_id % 300)::INT AS page, CASE WHEN event_id % 3 > 0 THEN event_id % 5 / 2.0 ELSE 1.0 END::DOUBLE AS zoom, CASE WHEN event_id % 6 > 3 THEN 0 ELSE event_id % 6 END::INT AS rotation FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT id, path, path_hash, last_opened, pinned, page, zoom, rotation FROM f JOIN s ON user_id = id""")
def migrated_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of version 0 made from the events, brought to the newest version step by step and read back."""
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("lib\\"), (F.col("user_id") % 40).cast("string"))
    files = e.groupBy(F.col("user_id").alias("id"), path.alias("path")).agg(F.max("event_id").alias("last_opened"), F.max((F.col("event_type") == "purchase") & (F.col("value") > 300)).alias("pinned"))
    zoom = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 5 / 2.0)
    openings = e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"), (F.col("event_id") % 300).cast("int").alias("page"), zoom.alias("zoom"), (F.col("event_id") % 6).cast("int").alias("rotation"))
    store = migrations.Store(spark, shared.new_folder(spark, "store"))
    store.commit(0, {"files": files.withColumn("note", F.lit("")), "openings": openings})
    store.migrate(migrations.CHAIN)
    now = store.tables()
    both = now["files"].join(now["reading_state"], F.col("id") == F.col("file_id"))
    return both.select("id", fn.normal_path(F.col("path")).alias("path"), "path_hash", "last_opened", "pinned", "page", "zoom", "rotation")


@query("""WITH p AS (SELECT 'u' || user_id AS key, arg_max(CASE event_type WHEN 'error' THEN 'plenty' WHEN 'click' THEN ' ' || event_id || ' ' WHEN 'signup' THEN event_id || '.5' ELSE event_id::VARCHAR END, event_id) AS value FROM events GROUP BY user_id)
SELECT c_custkey, value AS setting, coalesce(CASE WHEN regexp_full_match(trim(value), '[+]?[0-9]+') THEN try_cast(trim(value) AS BIGINT) END, 2048) AS number FROM customer LEFT JOIN p ON key = 'u' || c_custkey""")
def prefs_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last setting by key, as text and as a number with a default."""
    kind, text = F.col("event_type"), F.col("event_id").cast("string")
    value = F.when(kind == "error", "plenty").when(kind == "click", F.concat(F.lit(" "), text, F.lit(" "))).when(kind == "signup", F.concat(text, F.lit(".5"))).otherwise(text)
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), "event_id", value.alias("value"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("key"))
    return relations.settings(relations.latest(log, ["key"], ["event_id"]), asked, "key", "value", 2048).select("c_custkey", "setting", "number")


@query("""WITH h AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS held FROM lineitem GROUP BY 1)
SELECT o_orderkey, NOT list_contains(list_transform(range(1, o_custkey % 4 + 1), lambda x: coalesce(list_contains(held, x), false)), false) AS complete FROM orders LEFT JOIN h ON l_orderkey = o_orderkey""")
def all_lines_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose first lines, as many as are wanted, are all there."""
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_linenumber").cast("long")).alias("held"))  # seven line numbers at most
    wanted = F.filter(F.sequence(F.lit(0).cast("long"), F.col("o_custkey") % 4), lambda x: x > 0)
    return table(spark, sf_dir, "orders").join(held, "o_orderkey", "left").select("o_orderkey", relations.all_held(wanted, F.col("held")).alias("complete"))
