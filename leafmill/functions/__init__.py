"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounds to the nearest whole number, halves up."""
    return F.floor(x + 0.5)


def scale_key(pixels_per_point: Column) -> Column:
    """Pixels per point in thousandths, from 1 to 64000."""
    return F.greatest(F.lit(1), F.least(F.lit(64000), half_up(pixels_per_point * 1000))).cast("long")


def page_pixels(points: Column, pixels_per_point: Column) -> Column:
    """Size of a page side in pixels, at least one."""
    return F.greatest(F.lit(1), half_up(points * pixels_per_point)).cast("long")


def clamp_zoom(zoom: Column) -> Column:
    """From 0.1 to 16; what is no finite number counts as 1."""
    finite = zoom.isNotNull() & ~F.isnan(zoom) & (F.abs(zoom) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.1), F.least(F.lit(16.0), zoom))).otherwise(F.lit(1.0))


def wheel_factor(delta: Column) -> Column:
    return F.exp(-delta / 400.0)


def zoom_scroll(scroll: Column, anchor: Column, ratio: Column) -> Column:
    """Scroll that keeps the anchor in place when the zoom changes by a ratio."""
    return (scroll + anchor) * ratio - anchor


def quarter(turns: Column) -> Column:
    """Quarter turns as 0 to 3."""
    return F.pmod(turns, F.lit(4)).cast("int")


def displayed(width: Column, height: Column, turns: Column) -> tuple[Column, Column]:
    """Width and height as seen under a rotation."""
    swap = quarter(turns).isin(1, 3)
    return F.when(swap, height).otherwise(width), F.when(swap, width).otherwise(height)


def fit_scale(page: Column, room: Column) -> Column:
    """Scale that fits a side into room; 1 where either is degenerate."""
    return F.when((page > 0) & (room > 0), room / page).otherwise(F.lit(1.0))


def preview_side(edge: Column, long: Column, side: Column) -> Column:
    """Pixels of a preview's side when its longer side has ``edge`` pixels, capped to 16..512."""
    cap = F.greatest(F.lit(16), F.least(F.lit(512), edge))
    return F.greatest(F.lit(1), F.least(F.lit(512), F.round(side * cap / long))).cast("long")


def pool_size(cores: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(8), F.floor(cores / 2))).cast("int")


def backoff_ms(failures: Column) -> Column:
    """250 ms doubled with each failure, at most 30 s."""
    return F.least(F.lit(250) * F.pow(F.lit(2), F.least(failures, F.lit(8))), F.lit(30000)).cast("long")


def cache_budget_mb(setting: Column, preference: Column) -> Column:
    """From 64 to 16384 MB, 2048 by default; a number out of range in the first place does not fall through."""
    first, second = tolerant_int(setting), tolerant_int(preference)
    value = F.coalesce(first, second)
    return F.when(value.between(64, 16384), value).otherwise(F.lit(2048)).cast("long")


def tolerant_int(value: Column) -> Column:
    """A non-negative whole number, or null."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike("^[+]?[0-9]+$"), trimmed.try_cast("bigint"))


def aligned(size: Column, to: int = 64) -> Column:
    return (F.ceil(size / float(to)) * to).cast("long")


def ring_bytes(slots: Column, slot: int = 1 << 20, header: int = 64) -> Column:
    """Bytes of a ring of slots with an aligned header."""
    return aligned(F.lit(header) + slots * 64) + slots.cast("long") * slot


def normal_path(path: Column, fold: bool = False) -> Column:
    """Slashes one way round; letters lower-cased only where the platform folds them."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.lower(plain) if fold else plain


def base_name(path: Column) -> Column:
    """What follows the last slash, or the whole path if that is empty."""
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), path)


def one_of(value: Column, known: tuple[str, ...], otherwise: str) -> Column:
    """An enumerated text, or its default."""
    return F.when(value.isin(*known), value).otherwise(F.lit(otherwise))


def prefetch_reach(velocity: Column) -> Column:
    """Pages to fetch ahead: one for every 400 px/s, 1 to 8."""
    return F.least(F.lit(8), F.greatest(F.lit(1), half_up(F.abs(velocity) / 400))).cast("int")


def direction(velocity: Column, idle: float = 40.0) -> Column:
    return F.when(velocity > idle, 1).when(velocity < -idle, -1).otherwise(0)


def overlap(top: Column, bottom: Column, from_: Column, to: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(bottom, to) - F.greatest(top, from_))


def valid_rect(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Right of left, top over bottom, all finite."""
    finite = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in (left, bottom, right, top)]
    return F.coalesce(finite[0] & finite[1] & finite[2] & finite[3] & (right > left) & (top > bottom), F.lit(False))


def quarter_of_degrees(degrees: Column) -> Column:
    """Whole quarter turns in an angle."""
    return F.floor(F.pmod(degrees, F.lit(360)) / 90).cast("int")


def rgb(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Channels from 0 to 255 as fractions."""
    return red / 255.0, green / 255.0, blue / 255.0


def named(code: Column, names: tuple[str, ...]) -> Column:
    """The name of a code, the first name for codes beyond the list."""
    return F.coalesce(F.get(F.array(*(F.lit(n) for n in names)), code.cast("int")), F.lit(names[0]))


def whole_hash(raw: Column) -> Column:
    """A hash of 32 bytes, or null for a slice of any other length."""
    return F.when(F.octet_length(raw) == 32, raw)


def unix_now() -> Column:
    """Whole seconds of the query's start."""
    return F.unix_timestamp()


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times, with their fraction."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / 1000.0
