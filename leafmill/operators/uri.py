"""Addresses of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMES = "^(?:doc://(?:localhost/)?|https?://doc[.]localhost/)/?"
TIERS = ("sharp", "preview", "fast")


def built(document: Column, page: Column, rotation: Column, scale: Column, col: Column, row: Column, tier: Column) -> Column:
    return F.concat(F.lit("doc://"), F.concat_ws("/", F.lit("tile"), document, page, rotation, scale, col, row, tier))


def number_of(query: Column, key: str, otherwise: int) -> Column:
    """The first value of a key that is a whole number, or a default."""
    return F.coalesce(F.regexp_extract(query, f"(?:^|&){key}=([0-9]+)(?:&|$)", 1).try_cast("bigint"), F.lit(otherwise).cast("long"))


def parsed(rows: DataFrame, address: str) -> DataFrame:
    """state (Ok, BadUri, BadRotation, BadScale), tile_key, generation and priority of each address."""
    a = F.col(address)
    known = a.rlike("^(doc://|https?://doc[.]localhost/)")
    body = F.regexp_replace(F.regexp_replace(a, SCHEMES, ""), "[?#].*$", "")
    query = F.regexp_replace(F.when(F.contains(a, F.lit("?")), F.regexp_replace(a, "^[^?]*[?]", "")).otherwise(F.lit("")), "#.*$", "")
    shape = f"^tile/([0-9]+)/([0-9]+)/([0-9]+)/([0-9]+)/([0-9]+)/([0-9]+)/({'|'.join(TIERS)})$"
    cut = rows.withColumn("__body", body).withColumn("__query", query)
    shaped = known & F.col("__body").rlike(shape)
    part = lambda k: F.regexp_extract("__body", shape, k).try_cast("bigint")
    state = F.when(~shaped, "BadUri").when(F.coalesce(part(3) > 3, F.lit(True)), "BadRotation").when(~F.coalesce(part(4).between(1, 64000), F.lit(False)), "BadScale").otherwise("Ok")
    out = cut.withColumn("state", state).withColumn("tile_key", F.when(F.col("state") == "Ok", F.col("__body")))
    return out.withColumn("generation", number_of(F.col("__query"), "g", 0)).withColumn("priority", number_of(F.col("__query"), "p", 2)).drop("__body", "__query")
