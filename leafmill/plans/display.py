"""Display lists, tile maps and bitmaps over parts, order lines and documents.

Derivations: an order's lines are the operations of a display list; a
document's image is 4 x 2 BGRA pixels made of its id's hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import functions as fn
from leafmill.operators import display, tiles
from leafmill.plans import query, table
from leafmill.plans.geometry import _PAGES, pages


@query(f"""WITH p AS (SELECT *, (p_partkey % 4)::INT AS q, (p_partkey % 7) * 10.0::DOUBLE AS l, 200.0::DOUBLE + p_partkey % 300 AS t FROM ({_PAGES})),
s AS (SELECT *, 256 / 100.0::DOUBLE AS sx, 512 / 150.0::DOUBLE AS sy FROM p)
SELECT doc, page, q AS rotation, round(CASE q WHEN 0 THEN sx WHEN 2 THEN -sx ELSE 0 END, 6)::DOUBLE AS a, round(CASE q WHEN 1 THEN sy WHEN 3 THEN -sy ELSE 0 END, 6)::DOUBLE AS b,
round(CASE q WHEN 1 THEN -sx WHEN 3 THEN sx ELSE 0 END, 6)::DOUBLE AS c, round(CASE q WHEN 0 THEN sy WHEN 2 THEN -sy ELSE 0 END, 6)::DOUBLE AS d,
round((CASE q WHEN 1 THEN height WHEN 2 THEN width ELSE 0 END - l) * sx, 6) AS e, round((t - CASE q WHEN 0 THEN height WHEN 1 THEN width ELSE 0 END) * sy, 6) AS f FROM s""")
def tile_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map from each page to a tile's pixels under its rotation."""
    left, top = (F.col("p_partkey") % 7) * 10.0, 200.0 + F.col("p_partkey") % 300
    m = display.tile_map(left, top, left + 100, top - 150, F.lit(256), F.lit(512), F.col("width"), F.col("height"), F.col("p_partkey"))
    # adding zero makes minus zero plain
    return pages(spark, sf_dir).select("doc", "page", fn.quarter(F.col("p_partkey")).alias("rotation"), *((F.round(v, 6) + 0.0).alias(k) for k, v in m.items()))


@query(f"""WITH p AS (SELECT *, (p_partkey % 4)::INT AS q FROM ({_PAGES}))
SELECT doc, page, CASE q WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN width - 110 ELSE height - 220 END::DOUBLE AS left, CASE q WHEN 0 THEN 20 WHEN 1 THEN width - 110 WHEN 2 THEN height - 220 ELSE 10 END::DOUBLE AS bottom,
CASE q WHEN 0 THEN 110 WHEN 1 THEN 220 WHEN 2 THEN width - 10 ELSE height - 20 END::DOUBLE AS right, CASE q WHEN 0 THEN 220 WHEN 1 THEN width - 10 WHEN 2 THEN height - 20 ELSE 110 END::DOUBLE AS top FROM p""")
def turned_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle of each page under its rotation."""
    rect = display.turned_rect(F.lit(10.0), F.lit(20.0), F.lit(110.0), F.lit(220.0), F.col("width"), F.col("height"), F.col("p_partkey"))
    return pages(spark, sf_dir).select("doc", "page", *(v.alias(k) for k, v in zip(("left", "bottom", "right", "top"), rect, strict=True)))


@query("""WITH d AS (SELECT o_orderkey, (o_custkey % 13 - 6) * 45 AS deg, (o_orderkey % 8)::INT AS more FROM orders), r AS (SELECT *, (((deg % 360) + 360) % 360) // 90 AS q FROM d)
SELECT o_orderkey, q::INT AS turns, ((q + more) % 4)::INT AS added, q IN (1, 3) AS swaps FROM r""")
def rotation_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter turns from degrees, added up, and whether they swap the sides."""
    turns, more = fn.quarter_of_degrees((F.col("o_custkey") % 13 - 6) * 45), F.col("o_orderkey") % 8
    return table(spark, sf_dir, "orders").select("o_orderkey", turns.alias("turns"), fn.quarter(turns + more).alias("added"), turns.isin(1, 3).alias("swaps"))


_OPS = ("push_clip", "push_transform", "pop_clip", "pop_transform", "draw")
_SIGNS = "CASE WHEN l_linenumber = n AND l_partkey % 3 > 0 THEN CASE first WHEN 0 THEN ')' ELSE ']' END WHEN l_linenumber = 1 THEN CASE first WHEN 0 THEN '(' ELSE '[' END WHEN l_partkey % 11 = 0 THEN ')' ELSE '' END"


@query(f"""WITH l AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, l_orderkey % 2 AS first FROM lineitem), s AS (SELECT l_orderkey, string_agg({_SIGNS}, '' ORDER BY l_linenumber, l_partkey) AS s FROM l GROUP BY 1)
SELECT l_orderkey, replace(replace(replace(replace(replace(replace(replace(replace(s, '()', ''), '[]', ''), '()', ''), '[]', ''), '()', ''), '[]', ''), '()', ''), '[]', '') = '' AS balanced FROM s""")
def balanced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the levels of each display list close as they were opened."""
    lines = table(spark, sf_dir, "lineitem")
    sizes = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    held, clip, number = lines.join(sizes, "l_orderkey"), F.col("l_orderkey") % 2 == 0, F.col("l_linenumber")
    op = (
        F.when((number == F.col("n")) & (F.col("l_partkey") % 3 > 0), F.when(clip, "pop_clip").otherwise("pop_transform"))
        .when(number == 1, F.when(clip, "push_clip").otherwise("push_transform"))
        .when(F.col("l_partkey") % 11 == 0, "pop_clip")
        .otherwise("draw")
    )
    # an order has seven lines at most
    ops = held.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", op.alias("op")))).alias("ops"))
    return ops.select("l_orderkey", display.balanced(F.col("ops.op")).alias("balanced"))


@query("""WITH r AS (SELECT o_orderkey, (o_orderkey % 50)::INT AS l, (o_orderkey % 30)::INT AS b, (o_orderkey % 50 + o_custkey % 60)::INT AS r, (o_orderkey % 30 + o_custkey % 40)::INT AS t FROM orders)
SELECT o_orderkey, 'M ' || l || ' ' || b || ' L ' || r || ' ' || b || ' L ' || r || ' ' || t || ' L ' || l || ' ' || t || ' Z' AS path FROM r""")
def rect_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles as outlines."""
    left, bottom = F.col("o_orderkey") % 50, F.col("o_orderkey") % 30
    path = display.rect_path(*(x.cast("double") for x in (left, bottom, left + F.col("o_custkey") % 60, bottom + F.col("o_custkey") % 40)))
    said = F.transform(path, lambda p: F.concat_ws(" ", p["cmd"], p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(said, " ").alias("path"))


_IMAGE = "translate(upper(sha256(doc_id::VARCHAR)), '01234567', 'FFFFFFFF')"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = F.translate(F.upper(F.sha2(F.col("doc_id").cast("string"), 256)), "01234567", "FFFFFFFF")
    return table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.concat(white, F.lit("AABBCCDD"))).alias("pixels"))


@query(f"SELECT doc_id, regexp_replace({_IMAGE}, '(..)(..)(..)(..)', '\\3\\2\\1\\4', 'g') AS rgba FROM documents")
def swizzled_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The used bytes of each image, from BGRA to RGBA."""
    used = display.used_bytes(F.col("pixels"), F.lit(16), F.lit(2))
    return images(spark, sf_dir).select("doc_id", F.hex(display.swizzled(used)).alias("rgba"))


@query(f"""WITH p AS (SELECT doc_id, {_IMAGE} AS h, unnest(range(8))::INT AS px FROM documents),
i AS (SELECT doc_id, (px // 4) * 2 + (px % 4) // 2 AS quadrant, substr(h, px * 8 + 1, 2) < 'FA' OR substr(h, px * 8 + 3, 2) < 'FA' OR substr(h, px * 8 + 5, 2) < 'FA' AS ink FROM p),
q AS (SELECT doc_id, quadrant, count(*) FILTER (ink) AS ink FROM i GROUP BY 1, 2)
SELECT doc_id, sum(ink) / 8.0::DOUBLE AS ink, arg_max(quadrant, (ink, -quadrant))::INT AS quadrant FROM q GROUP BY 1""")
def ink_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of inked pixels of each image and its fullest quadrant."""
    return display.ink(images(spark, sf_dir), "doc_id", "pixels", F.lit(4), F.lit(2)).withColumn("quadrant", F.col("quadrant").cast("int"))


_ENUMS = {"blend": ("Normal", "Multiply", "Screen", "Darken", "Lighten"), "cap": ("Butt", "Round", "Square"), "join": ("Miter", "Round", "Bevel"), "fill": ("NonZero", "EvenOdd")}  # fixed values


def _enum_sql(name: str, code: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_ENUMS[name]))
    return f"CASE {code} {arms} ELSE '{_ENUMS[name][0]}' END AS {name}"


@query(f"""SELECT p_partkey, round(p_partkey % 256 / 255.0::DOUBLE, 9) AS red, round(p_size * 5 % 256 / 255.0::DOUBLE, 9) AS green, round((p_partkey * 7) % 256 / 255.0::DOUBLE, 9) AS blue,
{", ".join(_enum_sql(k, f"p_partkey % {len(v) + 2}") for k, v in _ENUMS.items())} FROM part""")
def paint_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as fractions, and the names of blend modes, caps, joins and fill rules; unknown ones are the first."""
    key = F.col("p_partkey")
    named = (fn.named(key % (len(v) + 2), v).alias(k) for k, v in _ENUMS.items())
    red, green, blue = fn.rgb(key % 256, F.col("p_size") * 5 % 256, (key * 7) % 256)
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(v, 9).alias(k) for k, v in (("red", red), ("green", green), ("blue", blue))), *named)


@query(f"""WITH p AS (SELECT * FROM ({_PAGES})), g AS (SELECT doc, page, unnest(range(0, ceil(height / 400)::INT))::INT AS row, width FROM p), t AS (SELECT doc, page, row, unnest(range(0, ceil(width / 400)::INT))::INT AS col FROM g)
SELECT doc, page, string_agg(row || ':' || col, ' ' ORDER BY row, col) AS tiles FROM t GROUP BY 1, 2""")
def tile_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of each page in the order in which they are asked for, row by row."""
    places = tiles.row_major(F.ceil(F.col("height") / 400).cast("int"), F.ceil(F.col("width") / 400).cast("int"))
    return pages(spark, sf_dir).select("doc", "page", F.array_join(F.transform(places, lambda t: F.concat_ws(":", t["row"], t["col"])), " ").alias("tiles"))
