"""Store semantics on tables that are never updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill import functions as fn


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins: the last row of each key. One aggregate, combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys and c not in order]
    newest = log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("row"))
    return newest.select(*keys, *(F.col("row")[c].alias(c) for c in [*order, *rest]))


def touched(log: DataFrame, key: str, order: list[str], pinned: Column) -> DataFrame:
    """Upserts that refresh a row but keep its first id, and keep it pinned once it is."""
    now = F.struct(*order)
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.min_by(order[-1], now).alias("id"), F.max_by(F.struct(*rest), now).alias("row"), F.max(pinned).alias("pinned"))


def recent(files: DataFrame, limit: int) -> DataFrame:
    """Pinned ones first, then the last opened; ids break ties."""
    return files.where("last_opened IS NOT NULL").orderBy(F.desc("pinned"), F.desc("last_opened"), "id").limit(limit)


def without(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascade: children of what is gone go too."""
    return children.join(gone, key, "left_anti")


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with the name of the first one they break."""
    named = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()))
    return rows.withColumn("violation", named).where("violation IS NOT NULL")


def changed(now: DataFrame, known: DataFrame, key: str, stamp: list[str]) -> DataFrame:
    """Whether each row is unknown, has no stamp or has another one than what is known."""
    old = known.select(key, *(F.col(c).alias(f"__{c}") for c in stamp))
    same = F.lit(True)
    for c in stamp:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return now.join(old, key, "left").select(key, (~F.coalesce(same, F.lit(False))).alias("changed"))


def refuse_newer(found: Column, supported: int) -> Column:
    """The version, or an error if a newer build wrote it."""
    return F.when(found > supported, F.raise_error(F.concat(F.lit("newer schema version "), found.cast("string")))).otherwise(found)


def numbered(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def find(files: DataFrame, path: str, fold: bool = False) -> DataFrame:
    """The file of a path, or no row; files have path_hash, the hash of the normal path."""
    return files.where(F.col("path_hash") == F.sha2(fn.normal_path(F.lit(path), fold), 256))


def pinned(files: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``files`` with the pin that the updates (key, pinned) set; the others keep theirs."""
    new = updates.select(key, F.col("pinned").alias("__pinned"))
    return files.join(new, key, "left").withColumn("pinned", F.coalesce("__pinned", "pinned")).drop("__pinned")


def available(files: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with whether their path is among the listed ones."""
    there = listing.select(path).distinct().withColumn("available", F.lit(True))
    return files.join(there, path, "left").withColumn("available", F.coalesce("available", F.lit(False)))


def acquired(refs: DataFrame, slots: DataFrame, slot: str, epoch: str, state: str, ready: str) -> DataFrame:
    """What a reader of a slot gets: the slot, or Stale if it is of another epoch, or WrongState if it is not ready."""
    now = slots.select(slot, F.col(epoch).alias("__epoch"), F.col(state).alias("__state"))
    found = F.when(F.col("__epoch").isNull(), "NoSlot").when(F.col("__epoch") != F.col(epoch), "Stale").when(F.col("__state") != ready, "WrongState").otherwise("Acquired")
    return refs.join(now, slot, "left").withColumn("outcome", found).drop("__epoch", "__state")


def greeted(hellos: DataFrame, protocol: str, expected: int) -> DataFrame:
    """Workers by what they say first: accepted, of another protocol, or silent."""
    said = F.when(F.col(protocol).isNull(), "NoHandshake").when(F.col(protocol) == expected, "Accepted").otherwise("ProtocolMismatch")
    return hellos.withColumn("greeting", said)


def settings(prefs: DataFrame, asked: DataFrame, key: str, value: str, otherwise: int | None = None) -> DataFrame:
    """``asked`` keys with their setting as text and as a non-negative whole number; what is missing or no number is the default."""
    known = prefs.select(key, F.col(value).alias("setting"))
    return asked.join(known, key, "left").withColumn("number", F.coalesce(fn.tolerant_int(F.col("setting")), F.lit(otherwise).cast("long")))


def all_held(wanted: Column, held: Column) -> Column:
    """Whether all of the wanted ones are held; none wanted is held."""
    return F.size(F.array_except(F.coalesce(wanted, F.array().cast("array<long>")), F.coalesce(held, F.array().cast("array<long>")))) == 0
