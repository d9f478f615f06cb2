"""Page layout as running sums over a document's pages, and visibility as interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import prefix

GAP, PADDING = 16.0, 24.0
MODES = ("single", "horizontal", "dual", "dual_cover")
BAND = 4096.0


def row_of(page: Column, mode: str) -> Column:
    """The row that a page stands in."""
    if mode == "dual":
        return F.floor(page / 2).cast("int")
    if mode == "dual_cover":
        return F.floor((page + 1) / 2).cast("int")
    return page.cast("int")


def layout(pages: DataFrame, document: str, mode: str, viewport: float, gap: float = GAP, padding: float = PADDING) -> DataFrame:
    """x, y, w, h, row, row_start and row_end of each page of each document.

    ``pages`` has the document, ``page`` from 0, ``width`` and ``height`` as
    displayed and zoomed.  Places come from two-level running sums, so that the
    pages of one document are spread over tasks, too: only a document's ranges of
    rows meet, and its greatest width and height.
    """
    sized = pages.withColumn("w", F.greatest(F.lit(1.0), F.col("width"))).withColumn("h", F.greatest(F.lit(1.0), F.col("height"))).withColumn("row", row_of(F.col("page"), mode))
    if mode == "horizontal":
        across = prefix.before(sized, [document], "page", {"x": F.col("w") + gap})
        most = sized.groupBy(document).agg(F.max("h").alias("__most"))
        placed = prefix.joined(across, most, [document]).withColumn("x", padding + F.col("x")).withColumn("y", padding + (F.col("__most") - F.col("h")) / 2).drop("__most")
        return placed.withColumn("row_start", F.col("x")).withColumn("row_end", F.col("x") + F.col("w"))
    inner = Window.partitionBy(document, "row")  # two pages at most
    rows = sized.withColumn("row_width", F.greatest(F.sum(F.col("w") + gap).over(inner) - gap, F.lit(0.0))).withColumn("tallest", F.max("h").over(inner))
    left = F.coalesce(F.sum(F.col("w") + gap).over(inner.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # only a row's first page adds the row's height to the running sum
    first = F.col("page") == F.min("page").over(inner)
    rows = rows.withColumn("x", left).withColumn("step", F.when(first, F.col("tallest") + gap).otherwise(0.0))
    widest = sized.groupBy(document, "row").agg(F.greatest(F.sum(F.col("w") + gap) - gap, F.lit(0.0)).alias("width")).groupBy(document).agg(F.greatest(F.max("width"), F.lit(float(viewport))).alias("content"))
    placed = prefix.joined(prefix.before(rows, [document], "row", {"y": F.col("step")}), widest, [document])
    placed = placed.withColumn("y", padding + F.col("y")).withColumn("x", (F.col("content") - F.col("row_width")) / 2 + F.col("x"))
    return placed.withColumn("row_start", F.col("y")).withColumn("row_end", F.col("y") + F.col("tallest"))


def extent(placed: DataFrame, document: str, mode: str, viewport: float, padding: float = PADDING) -> DataFrame:
    """Width and height of each laid-out document."""
    if mode == "horizontal":
        return placed.groupBy(document).agg(F.greatest(F.max("row_end") + padding, F.lit(float(viewport))).alias("width"), (F.max("h") + 2 * padding).alias("height"))
    return placed.groupBy(document).agg(F.max("content").alias("width"), F.greatest(F.max("row_end") + padding, F.lit(1.0)).alias("height"))


def visible(placed: DataFrame, views: DataFrame, document: str, margin: float = 0.0) -> DataFrame:
    """Pages whose row meets a view's interval, both ends included.

    ``views`` has the document, ``top`` and ``view_height``.  Both sides are cut
    into bands, which makes the range join an equi-join; a pair counts in the
    first band that the two share.
    """
    band = lambda x: F.floor(x / BAND)
    low, high = F.col("top") - margin, F.col("top") + F.col("view_height") + margin
    rows = placed.withColumn("from_band", band(F.col("row_start"))).withColumn("band", F.explode(F.sequence(band(F.col("row_start")), band(F.col("row_end")))))
    asked = views.withColumn("low", low).withColumn("high", high).withColumn("view_band", band(low)).withColumn("band", F.explode(F.sequence(band(low), band(high))))
    met = rows.join(asked, [document, "band"]).where((F.col("row_end") >= F.col("low")) & (F.col("row_start") <= F.col("high")))
    return met.where(F.col("band") == F.greatest("from_band", "view_band")).drop("band", "from_band", "view_band", "low", "high")


def first_at(placed: DataFrame, views: DataFrame, document: str) -> DataFrame:
    """For each view the first page whose row ends at or after its top; views beyond the end go.

    Rows and views share one ordered window, so the cost does not grow with
    their product.
    """
    rows = placed.select(document, F.col("row_end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("event_id"), "page")
    asked = views.select(document, F.col("top").alias("at"), F.lit(1).alias("kind"), "event_id", F.lit(None).cast("int").alias("page"))
    down = Window.partitionBy(document).orderBy(F.desc("at"), "kind", F.desc("page"), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.unionByName(asked).withColumn("page", F.last("page", ignorenulls=True).over(down))
    return found.where("kind = 1 AND page IS NOT NULL").drop("kind", "at")


def dominant(seen: DataFrame, keys: list[str]) -> DataFrame:
    """The page with the most visible area, the lowest one on ties."""
    height = F.greatest(F.lit(0.0), F.least(F.col("y") + F.col("h"), F.col("top") + F.col("view_height")) - F.greatest(F.col("y"), F.col("top")))
    return seen.groupBy(*keys).agg(F.max_by("page", F.struct((height * F.col("w")).alias("area"), (-F.col("page")).alias("first"))).alias("page"))
