"""Layout, visibility, tiles and maps over the parts table.

Derivations: a brand is a document, its parts in key order are its pages, 612
points wide and 600 + 8 * size high; a view's offset is an event's value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill import functions as fn
from leafmill.operators import layout, tiles
from leafmill.plans import query, table

_PAGES = "SELECT p_brand AS doc, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS page, 612.0::DOUBLE AS width, 600.0::DOUBLE + 8 * p_size AS height, p_partkey FROM part"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), number.alias("page"), F.lit(612.0).alias("width"), (F.lit(600.0) + 8 * F.col("p_size")).alias("height"), "p_partkey")


def _vertical(row: str) -> str:
    return f"""WITH p AS ({_PAGES}), s AS (SELECT doc, page, width AS w, height AS h, {row} AS row FROM p),
r AS (SELECT doc, row, greatest(sum(w + 16) - 16, 0) AS rw, max(h) AS tall FROM s GROUP BY 1, 2),
c AS (SELECT *, greatest(max(rw) OVER (PARTITION BY doc), 1000) AS content, 24 + coalesce(sum(tall + 16) OVER (PARTITION BY doc ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM r),
l AS (SELECT s.doc, s.page, s.row, (content - rw) / 2 + coalesce(sum(s.w + 16) OVER (PARTITION BY s.doc, s.row ORDER BY s.page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, y, s.w, s.h, y AS row_start, y + tall AS row_end FROM s JOIN c USING (doc, row))"""


_OUT = ["doc", "page", "row", "x", "y", "w", "h", "row_start", "row_end"]
_SQL_ROWS = {"single": "page", "dual": "(page // 2)::INT", "dual_cover": "((page + 1) // 2)::INT"}


@query(f"{_vertical('page')} SELECT * FROM l")
def layout_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page a row."""
    return layout.layout(pages(spark, sf_dir), "doc", "single", 1000.0).select(*_OUT)


@query(f"{_vertical(_SQL_ROWS['dual'])} SELECT * FROM l")
def layout_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages a row."""
    return layout.layout(pages(spark, sf_dir), "doc", "dual", 1000.0).select(*_OUT)


@query(f"{_vertical(_SQL_ROWS['dual_cover'])} SELECT * FROM l")
def layout_dual_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages a row after a cover."""
    return layout.layout(pages(spark, sf_dir), "doc", "dual_cover", 1000.0).select(*_OUT)


@query(f"""WITH p AS ({_PAGES}), l AS (SELECT doc, page, page AS row, 24 + coalesce(sum(width + 16) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x,
24 + (max(height) OVER (PARTITION BY doc) - height) / 2 AS y, width AS w, height AS h FROM p) SELECT *, x AS row_start, x + w AS row_end FROM l""")
def layout_horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages side by side, centred on a line."""
    return layout.layout(pages(spark, sf_dir), "doc", "horizontal", 1000.0).select(*_OUT)


@query(f"{_vertical('page')} SELECT doc, greatest(max(w), 1000)::DOUBLE AS width, greatest(max(row_end) + 24, 1) AS height FROM l GROUP BY doc")
def layout_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height of whole documents."""
    return layout.extent(layout.layout(pages(spark, sf_dir), "doc", "single", 1000.0), "doc", "single", 1000.0)


_VIEWS = "SELECT event_id, 'Brand#' || (1 + user_id % 25) AS doc, value * 20 AS top, 900.0::DOUBLE AS view_height FROM events"


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Brand#"), 1 + F.col("user_id") % 25).alias("doc"), (F.col("value") * 20).alias("top"), F.lit(900.0).alias("view_height"))


_MET = f"{_vertical('page')}, v AS ({_VIEWS}), m AS (SELECT * FROM v JOIN l USING (doc) WHERE row_end >= top - 200 AND row_start <= top + view_height + 200)"


@query(f"{_MET} SELECT event_id, doc, page FROM m")
def visible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages within a margin of 200 of each view."""
    placed = layout.layout(pages(spark, sf_dir), "doc", "single", 1000.0).select(*_OUT)
    return layout.visible(placed, views(spark, sf_dir), "doc", 200.0).select("event_id", "doc", "page")


@query(f"{_MET} SELECT event_id, doc, coalesce(p, 0)::INT AS page FROM v LEFT JOIN (SELECT event_id, arg_max(page, (greatest(0, least(y + h, top + view_height) - greatest(y, top)) * w, -page)) AS p FROM m GROUP BY 1) USING (event_id)")
def dominant_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that fills most of each view, 0 where none does."""
    placed = layout.layout(pages(spark, sf_dir), "doc", "single", 1000.0).select(*_OUT)
    asked = views(spark, sf_dir)
    best = layout.dominant(layout.visible(placed, asked, "doc", 200.0), ["event_id"])
    return asked.join(best, "event_id", "left").select("event_id", "doc", F.coalesce("page", F.lit(0)).alias("page"))


@query(f"{_vertical('page')}, v AS ({_VIEWS}) SELECT event_id, min(page) AS page FROM v JOIN l USING (doc) WHERE row_end >= top GROUP BY event_id")
def first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row that ends at or after each view's offset."""
    placed = layout.layout(pages(spark, sf_dir), "doc", "single", 1000.0)
    return layout.first_at(placed, views(spark, sf_dir), "doc").select("event_id", "page")


@query(f"{_vertical('page')} SELECT doc, page, greatest(0, y - 24)::DOUBLE AS scroll, y + h - 100 AS target FROM l")
def scroll_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to scroll for each page, and for a destination 100 points above its bottom."""
    placed = layout.layout(pages(spark, sf_dir), "doc", "single", 1000.0)
    return placed.select("doc", "page", F.greatest(F.lit(0.0), F.col("y") - layout.PADDING).alias("scroll"), (F.col("y") + F.col("h") - 100).alias("target"))


_ZOOM = "(0.25 + 0.35 * (p_partkey % 8))"
_GRID = f"""WITH p AS ({_PAGES}), k AS (SELECT *, greatest(1, least(64000, floor({_ZOOM} * 1000 + 0.5)))::BIGINT AS scale_key FROM p),
s AS (SELECT *, greatest(1, floor(width * (scale_key / 1000.0::DOUBLE) + 0.5))::BIGINT AS page_w, greatest(1, floor(height * (scale_key / 1000.0::DOUBLE) + 0.5))::BIGINT AS page_h FROM k),
t AS (SELECT *, unnest(range(0, ceil(page_h / 512.0)::INT))::INT AS row FROM s), u AS (SELECT *, unnest(range(0, ceil(page_w / 512.0)::INT))::INT AS col FROM t),
g AS (SELECT *, least(512, page_w - col * 512)::BIGINT AS px_w, least(512, page_h - row * 512)::BIGINT AS px_h FROM u)"""


@query(f"""{_GRID} SELECT doc, page, scale_key, col, row, px_w, px_h, round(col * 512 * (width / page_w), 6) AS left, round(height - row * 512 * (height / page_h), 6) AS top,
round((col * 512 + px_w) * (width / page_w), 6) AS right, round(height - (row * 512 + px_h) * (height / page_h), 6) AS bottom FROM g""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles of all pages at a zoom that depends on the page."""
    made = tiles.grid(pages(spark, sf_dir), 0.25 + 0.35 * (F.col("p_partkey") % 8))
    return made.select("doc", "page", "scale_key", "col", "row", "px_w", "px_h", *(F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom")))


_TURN = """CASE q WHEN 1 THEN {y} WHEN 2 THEN width - {x} WHEN 3 THEN height - {y} ELSE {x} END"""


@query(f"""WITH p AS (SELECT *, ((p_partkey % 9 - 4) % 4 + 4) % 4 AS q FROM ({_PAGES})) SELECT doc, page, q::INT AS rotation, CASE WHEN q IN (1, 3) THEN height ELSE width END AS shown_w, CASE WHEN q IN (1, 3) THEN width ELSE height END AS shown_h,
CASE q WHEN 1 THEN 20.0 WHEN 2 THEN width - 10 WHEN 3 THEN height - 20 ELSE 10.0 END::DOUBLE AS x, CASE q WHEN 1 THEN width - 10 WHEN 2 THEN height - 20 WHEN 3 THEN 10.0 ELSE 20.0 END::DOUBLE AS y FROM p""")
def display_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised rotation, displayed size and a turned point of each page."""
    turns = F.col("p_partkey") % 9 - 4
    w, h = fn.displayed(F.col("width"), F.col("height"), turns)
    x, y = tiles.turned_point(F.lit(10.0), F.lit(20.0), F.col("width"), F.col("height"), turns)
    return pages(spark, sf_dir).select("doc", "page", fn.quarter(turns).alias("rotation"), w.alias("shown_w"), h.alias("shown_h"), x.cast("double").alias("x"), y.cast("double").alias("y"))


@query("""WITH m AS (SELECT p_partkey, 1.0 + p_size / 10.0::DOUBLE AS s, (p_partkey % 7)::DOUBLE AS t FROM part)
SELECT p_partkey, round(s * 3 + t, 6) AS x, round(s * 4 - t, 6) AS y, round(s * s, 6) AS det, round((s * 3 + t - t) / s, 6) AS back_x, round((s * 4 - t + t) / s, 6) AS back_y,
CASE WHEN abs(p_partkey % 5) >= 1e-6 THEN round(1.0 / (p_partkey % 5), 6) END AS shrunk FROM m""")
def matrix_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale then translate, determinant, inverse and a singular map."""
    s, t, zero, one = 1 + F.col("p_size") / 10.0, (F.col("p_partkey") % 7).cast("double"), F.lit(0.0), F.lit(1.0)
    scale = {"a": s, "b": zero, "c": zero, "d": s, "e": zero, "f": zero}
    move = {"a": one, "b": zero, "c": zero, "d": one, "e": t, "f": -t}
    both = tiles.compose(scale, move)
    x, y = tiles.applied(both, F.lit(3.0), F.lit(4.0))
    bx, by = tiles.applied(tiles.inverse(both), x, y)
    flat = tiles.inverse({"a": (F.col("p_partkey") % 5).cast("double"), "b": zero, "c": zero, "d": one, "e": zero, "f": zero})
    named = {"x": x, "y": y, "det": tiles.determinant(both), "back_x": bx, "back_y": by, "shrunk": flat["a"]}
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(v, 6).alias(k) for k, v in named.items()))


@query("""WITH r AS (SELECT o_orderkey, (o_orderkey % 50)::DOUBLE AS l, (o_orderkey % 30)::DOUBLE AS b, (o_custkey % 60)::DOUBLE AS r, (o_custkey % 40)::DOUBLE AS t FROM orders)
SELECT o_orderkey, r > l AND t > b AS valid, 20 BETWEEN l AND r AND 15 BETWEEN b AND t AS holds, l < 40 AND r > 10 AND b < 30 AND t > 5 AS meets,
least(l, 10) AS union_left, least(b, 5) AS union_bottom, greatest(r, 40) AS union_right, greatest(t, 30) AS union_top, r - l + 4 AS inflated_w FROM r""")
def rect_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity, inclusive containment, strict meeting, hull and inflated width of rectangles."""
    left, bottom = (F.col("o_orderkey") % 50).cast("double"), (F.col("o_orderkey") % 30).cast("double")
    right, top = (F.col("o_custkey") % 60).cast("double"), (F.col("o_custkey") % 40).cast("double")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        fn.valid_rect(left, bottom, right, top).alias("valid"),
        (F.lit(20.0).between(left, right) & F.lit(15.0).between(bottom, top)).alias("holds"),
        ((left < 40) & (right > 10) & (bottom < 30) & (top > 5)).alias("meets"),
        F.least(left, F.lit(10.0)).alias("union_left"),
        F.least(bottom, F.lit(5.0)).alias("union_bottom"),
        F.greatest(right, F.lit(40.0)).alias("union_right"),
        F.greatest(top, F.lit(30.0)).alias("union_top"),
        (right - left + 4).alias("inflated_w"),
    )


@query("""SELECT p_type AS shape, min(p_size)::DOUBLE AS left, min(p_retailprice) AS bottom, max(p_size)::DOUBLE AS right, max(p_retailprice) AS top FROM part WHERE p_size > 2 GROUP BY 1""")
def control_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding box of each outline's points; closing commands (sizes 1 and 2) carry none."""
    points = table(spark, sf_dir, "part").where("p_size > 2")
    return points.groupBy(F.col("p_type").alias("shape")).agg(F.min(F.col("p_size").cast("double")).alias("left"), F.min("p_retailprice").alias("bottom"), F.max(F.col("p_size").cast("double")).alias("right"), F.max("p_retailprice").alias("top"))


@query("""WITH z AS (SELECT p_partkey, p_size, p_size / 3.0::DOUBLE - 1 AS zoom FROM part), l(rung) AS (VALUES (0.1), (0.25), (0.5), (1.0), (2.0), (4.0), (8.0), (16.0))
SELECT p_partkey, greatest(0.1, least(16.0, zoom))::DOUBLE AS clamped, round(exp(-(p_size - 25) / 400.0::DOUBLE), 9) AS wheel, round((p_size + 100) * 2 - 100.0::DOUBLE, 6) AS scroll,
(SELECT coalesce(min(rung) FILTER (rung > zoom + 1e-6), max(rung)) FROM l)::DOUBLE AS next_rung, (SELECT coalesce(max(rung) FILTER (rung < zoom - 1e-6), min(rung)) FROM l)::DOUBLE AS prev_rung,
round(greatest(1000.0 - 64, 64) / 612.0::DOUBLE, 9) AS fit_width, round(least((1000.0 - 64) / 612.0::DOUBLE, (800.0 - 64) / (600.0::DOUBLE + 8 * p_size)), 9) AS fit_page,
greatest(1, least(512, round(612 * (greatest(16, least(512, p_size * 20)) / (600.0::DOUBLE + 8 * p_size)))))::BIGINT AS preview FROM z""")
def zoom_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped zoom, wheel factor, anchored scroll, ladder rungs, fits and preview sizes."""
    zoom, size = F.col("p_size") / 3.0 - 1, F.col("p_size")
    rungs = F.array(*(F.lit(x) for x in (0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)))
    above, below = F.array_min(F.filter(rungs, lambda r: r > zoom + 1e-6)), F.array_max(F.filter(rungs, lambda r: r < zoom - 1e-6))
    height = F.lit(600.0) + 8 * size
    room = F.greatest(F.lit(1000.0 - 64), F.lit(64.0))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        fn.clamp_zoom(zoom).alias("clamped"),
        F.round(fn.wheel_factor(size - 25), 9).alias("wheel"),
        F.round(fn.zoom_scroll(size.cast("double"), F.lit(100.0), F.lit(2.0)), 6).alias("scroll"),
        F.coalesce(above, F.array_max(rungs)).alias("next_rung"),
        F.coalesce(below, F.array_min(rungs)).alias("prev_rung"),
        F.round(fn.fit_scale(F.lit(612.0), room), 9).alias("fit_width"),
        F.round(F.least(fn.fit_scale(F.lit(612.0), room), fn.fit_scale(height, F.lit(800.0 - 64))), 9).alias("fit_page"),
        fn.preview_side(size * 20, height, F.lit(612.0)).alias("preview"),
    )


@query("""SELECT o_orderkey, CASE WHEN page >= 20 THEN 'PageOutOfRange' WHEN w <= 0 OR h <= 0 THEN 'EmptyTile' WHEN w > 8192 OR h > 8192 THEN 'TooLarge' ELSE 'Ok' END AS outcome
FROM (SELECT o_orderkey, o_custkey % 23 AS page, o_orderkey % 9000 - 20 AS w, (o_orderkey * 7) % 9000 - 20 AS h FROM orders)""")
def tile_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals of tile requests by page and size."""
    page, w, h = F.col("o_custkey") % 23, F.col("o_orderkey") % 9000 - 20, (F.col("o_orderkey") * 7) % 9000 - 20
    outcome = F.when(page >= 20, "PageOutOfRange").when((w <= 0) | (h <= 0), "EmptyTile").when((w > 8192) | (h > 8192), "TooLarge").otherwise("Ok")
    return table(spark, sf_dir, "orders").select("o_orderkey", outcome.alias("outcome"))


@query("""SELECT o_orderkey, greatest(0, floor(top / 200) - 2)::INT AS first, least(500, ceil((top + 700) / 200) + 2)::INT AS last FROM (SELECT o_orderkey, (o_orderkey % 90000)::DOUBLE AS top FROM orders)""")
def thumbnail_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a strip of 200-pixel thumbnails that a view needs, two more on each side."""
    top = (F.col("o_orderkey") % 90000).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.greatest(F.lit(0), F.floor(top / 200) - 2).cast("int").alias("first"), F.least(F.lit(500), F.ceil((top + 700) / 200) + 2).cast("int").alias("last"))


@query("""WITH r AS (SELECT o_orderkey, (o_orderkey % 100)::DOUBLE AS l, 792.0 - o_orderkey % 50 AS t FROM orders) SELECT o_orderkey, round(l * 1.5, 6) AS px_x, round((792 - t) * 1.5, 6) AS px_y, round(l * 1.5 / 1.5, 6) AS pdf_x, round(792 - (792 - t) * 1.5 / 1.5, 6)::DOUBLE AS pdf_y FROM (SELECT o_orderkey, l, t::DOUBLE AS t FROM r)""")
def device_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page points to pixels and back, with the axis turned over."""
    left, top, k = (F.col("o_orderkey") % 100).cast("double"), F.lit(792.0) - F.col("o_orderkey") % 50, 1.5
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(left * k, 6).alias("px_x"), F.round((792 - top) * k, 6).alias("px_y"), F.round(left * k / k, 6).alias("pdf_x"), F.round(792 - (792 - top) * k / k, 6).alias("pdf_y"))
