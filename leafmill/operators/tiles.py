"""Tile grids, rotations and affine maps as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import functions as fn

TILE = 512


def grid(pages: DataFrame, scale: Column) -> DataFrame:
    """A row for each tile (col, row) of each page at a scale, with its pixels and its source in points.

    The scale is quantised to thousandths first.  Tiles are enumerated from the
    page's own size, so no join is needed.
    """
    keyed = pages.withColumn("scale_key", fn.scale_key(scale)).withColumn("k", F.col("scale_key") / 1000.0)
    sized = keyed.withColumn("page_w", fn.page_pixels(F.col("width"), F.col("k"))).withColumn("page_h", fn.page_pixels(F.col("height"), F.col("k")))
    count = lambda px: F.sequence(F.lit(0), (F.ceil(px / float(TILE)) - 1).cast("int"))
    rows = sized.withColumn("row", F.explode(count(F.col("page_h")))).withColumn("col", F.explode(count(F.col("page_w"))))
    return source(rows)


def source(tiles: DataFrame) -> DataFrame:
    """Pixels and source rectangle of tiles; those beyond the page go."""
    x, y = F.col("col") * TILE, F.col("row") * TILE
    inside = tiles.where((x < F.col("page_w")) & (y < F.col("page_h")) & (F.col("col") >= 0) & (F.col("row") >= 0))
    w, h = F.least(F.lit(TILE), F.col("page_w") - x), F.least(F.lit(TILE), F.col("page_h") - y)
    inside = inside.withColumn("px_w", w.cast("long")).withColumn("px_h", h.cast("long"))
    across, down = F.col("width") / F.col("page_w"), F.col("height") / F.col("page_h")
    return inside.select(
        "*",
        (x * across).alias("left"),
        (F.col("height") - y * down).alias("top"),
        ((x + F.col("px_w")) * across).alias("right"),
        (F.col("height") - (y + F.col("px_h")) * down).alias("bottom"),
    )


def turned_point(x: Column, y: Column, width: Column, height: Column, turns: Column) -> tuple[Column, Column]:
    """A user-space point in display space under clockwise quarter turns."""
    q = fn.quarter(turns)
    return (
        F.when(q == 1, y).when(q == 2, width - x).when(q == 3, height - y).otherwise(x),
        F.when(q == 1, width - x).when(q == 2, height - y).when(q == 3, x).otherwise(y),
    )


def compose(m: dict[str, Column], n: dict[str, Column]) -> dict[str, Column]:
    """Affine map m and then n; each is a to f."""
    return {
        "a": m["a"] * n["a"] + m["b"] * n["c"],
        "b": m["a"] * n["b"] + m["b"] * n["d"],
        "c": m["c"] * n["a"] + m["d"] * n["c"],
        "d": m["c"] * n["b"] + m["d"] * n["d"],
        "e": m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        "f": m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    }


def determinant(m: dict[str, Column]) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def inverse(m: dict[str, Column], epsilon: float = 1e-6) -> dict[str, Column]:
    """The inverse map; null where the determinant is about zero."""
    det = F.when(F.abs(determinant(m)) >= epsilon, determinant(m))
    return {
        "a": m["d"] / det,
        "b": -m["b"] / det,
        "c": -m["c"] / det,
        "d": m["a"] / det,
        "e": (m["c"] * m["f"] - m["d"] * m["e"]) / det,
        "f": (m["b"] * m["e"] - m["a"] * m["f"]) / det,
    }


def applied(m: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def row_major(rows: Column, cols: Column) -> Column:
    """The places (row, col) of a grid, row by row."""
    count = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(count(rows), lambda r: F.transform(count(cols), lambda c: F.struct(r.alias("row"), c.alias("col")))))
