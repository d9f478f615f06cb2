"""Display lists and bitmaps as expressions: turned rectangles, tile maps, outlines, pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import functions as fn
from leafmill.operators import tiles

#: What opens and closes a level of a display list, by its kind.
OPENS = {"push_clip": "clip", "push_transform": "transform"}
CLOSES = {"pop_clip": "clip", "pop_transform": "transform"}
#: A channel value from which a pixel counts as white.
WHITE = 250


def turned_rect(left: Column, bottom: Column, right: Column, top: Column, width: Column, height: Column, turns: Column) -> tuple[Column, ...]:
    """A user-space rectangle in display space: the hull of its turned corners, as left, bottom, right, top."""
    (x1, y1), (x2, y2) = (tiles.turned_point(x, y, width, height, turns) for x, y in ((left, bottom), (right, top)))
    return F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)


def tile_map(left: Column, top: Column, right: Column, bottom: Column, px_w: Column, px_h: Column, width: Column, height: Column, turns: Column) -> dict[str, Column]:
    """The affine map from page space (y down) to the pixels of a tile that shows a source rectangle of display space (y up)."""
    q, zero = fn.quarter(turns), F.lit(0.0)
    pick = lambda *arms: F.when(q == 1, arms[1]).when(q == 2, arms[2]).when(q == 3, arms[3]).otherwise(arms[0])
    one, less = F.lit(1.0), F.lit(-1.0)
    shown = {
        "a": pick(one, zero, less, zero),
        "b": pick(zero, less, zero, one),
        "c": pick(zero, less, zero, one),
        "d": pick(less, zero, one, zero),
        "e": pick(zero, height, width, zero),
        "f": pick(height, width, zero, zero),
    }
    sx, sy = px_w / (right - left), px_h / (top - bottom)
    return tiles.compose(shown, {"a": sx, "b": zero, "c": zero, "d": -sy, "e": -left * sx, "f": top * sy})


def balanced(ops: Column) -> Column:
    """Whether every level of a display list (names of operations, in order) closes in the order of a typed stack."""
    kind = lambda names, x: F.element_at(F.create_map(*(F.lit(v) for p in names.items() for v in p)), x)
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(True).alias("ok"))

    def step(acc: Column, op: Column) -> Column:
        opened, closed, held = kind(OPENS, op), kind(CLOSES, op), acc["open"]
        fits = (F.size(held) > 0) & (F.try_element_at(held, F.lit(-1)) == closed)
        stack = F.when(opened.isNotNull(), F.concat(held, F.array(opened))).when(closed.isNotNull() & (F.size(held) > 0), F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(held)
        return F.struct(stack.alias("open"), (acc["ok"] & (closed.isNull() | F.coalesce(fits, F.lit(False)))).alias("ok"))

    return F.aggregate(ops, start, step, lambda acc: acc["ok"] & (F.size(acc["open"]) == 0))


def rect_path(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """The outline of a rectangle as commands (cmd, x, y), closed."""
    corner = lambda cmd, x, y: F.struct(F.lit(cmd).alias("cmd"), x.alias("x"), y.alias("y"))
    none = F.lit(None).cast("double")
    return F.array(corner("M", left, bottom), corner("L", right, bottom), corner("L", right, top), corner("L", left, top), corner("Z", none, none))


def used_bytes(pixels: Column, stride: Column, height: Column) -> Column:
    """The bytes of an image that its rows take; what follows is slack."""
    return F.substring(pixels, F.lit(1), (stride * height).cast("int"))


def swizzled(bgra: Column) -> Column:
    """BGRA pixels as RGBA."""
    return F.unhex(F.regexp_replace(F.hex(bgra), "(..)(..)(..)(..)", "$3$2$1$4"))


def ink(images: DataFrame, key: str, bgra: str, width: Column, height: Column) -> DataFrame:
    """The share of pixels that are not white in each image, and the quadrant (row major) with most of them, the first of equals."""
    held = images.select(key, F.hex(bgra).alias("hex"), width.alias("w"), height.alias("h"))
    each = held.select(key, "hex", "w", "h", F.explode(F.sequence(F.lit(0), (F.col("w") * F.col("h") - 1).cast("int"))).alias("at"))
    # two digits of each channel compare like its value
    dark = F.lit(False)
    for k in range(3):
        dark = dark | (F.substring("hex", F.col("at") * 8 + 2 * k + 1, F.lit(2)) < f"{WHITE:02X}")
    row, col = F.floor(F.col("at") / F.col("w")), F.col("at") % F.col("w")
    place = (F.when(row * 2 >= F.col("h"), 2).otherwise(0) + F.when(col * 2 >= F.col("w"), 1).otherwise(0)).alias("quadrant")
    sums = each.select(key, place, dark.cast("int").alias("ink")).groupBy(key, "quadrant").agg(F.sum("ink").alias("ink"), F.count("*").alias("n"))
    return sums.groupBy(key).agg((F.sum("ink") / F.sum("n")).alias("ink"), F.max_by("quadrant", F.struct("ink", -F.col("quadrant"))).alias("quadrant"))
