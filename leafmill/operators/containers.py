"""Page sizes of stored documents: from a document's directory, or page by page from its bodies.

A container is a row with a ``code`` that opening it gave (0 for success), whether a
password was given, a ``directory`` that lists the size of each page, and the
pages' ``bodies``.  The fast scan reads the directory only, so bodies are never
read from the file; the slow one parses each body.  A page whose size the directory
lacks, or gives in a form that is no size, falls back to its body.  Nothing raises:
a document that did not open, or a page that neither way tells, has a row with
the kind of its error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A page's box in its body: left, bottom, right, top.
BOX = r"/MediaBox\s*\[\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s+(-?[0-9.]+)\s+(-?[0-9.]+)\s*\]"
SIZE = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*x\s*([0-9]+(?:\.[0-9]+)?)\s*$"


def open_error(code: Column, password: Column) -> Column:
    """The error that a code of opening stands for; null for success."""
    return (
        F.when(code == 0, F.lit(None).cast("string"))
        .when(code == 2, "FileNotReadable")
        .when((code == 4) & password, "PasswordWrong")
        .when(code == 4, "PasswordRequired")
        .otherwise("Corrupt")
    )


def error_kind(error: Column) -> Column:
    """The class of an error that a caller switches on."""
    return (
        F.when(error.isNull(), F.lit(None).cast("string"))
        .when(error.isin("PasswordRequired", "PasswordWrong", "Corrupt"), error)
        .when(error.isin("FileNotReadable", "LibraryLoad"), "FileUnavailable")
        .when(error.isin("PageOutOfRange", "BadTileSize", "BadSourceRect", "BufferTooSmall"), "BadRequest")
        .when(error.isin("EnginePanic", "LibraryAlreadyLoaded"), "EngineFault")
        .when(error == "Cancelled", "Timeout")
        .otherwise("Corrupt")
    )


def _size(text: Column, pattern: str, at: tuple[int, int], minus: tuple[int, int] | None = None) -> Column:
    """(width, height) out of a text, or null unless both are positive and finite."""
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("double")
    width, height = part(at[0]), part(at[1])
    if minus:
        width, height = width - part(minus[0]), height - part(minus[1])
    sound = text.rlike(pattern) & (width > 0) & (height > 0) & (width < float("inf")) & (height < float("inf"))
    return F.when(sound, F.struct(width.alias("width"), height.alias("height")))


def listed(text: Column) -> Column:
    """A size as a directory lists it, "612 x 792"."""
    return _size(text, SIZE, (1, 2))


def boxed(body: Column) -> Column:
    """A size as a page's own box tells it."""
    return _size(body, BOX, (3, 4), (1, 2))


def fast_sizes(documents: DataFrame) -> DataFrame:
    """doc, page, size (null where the directory does not tell it) of documents that opened; no body is read."""
    pages = documents.where("code = 0").select("doc", F.posexplode(F.split("directory", ";")).alias("page", "text"))
    return pages.select("doc", "page", listed(F.col("text")).alias("size"))


def slow_sizes(documents: DataFrame) -> DataFrame:
    """doc, page and size of documents that opened, each page from its body."""
    pages = documents.where("code = 0").select("doc", F.posexplode("bodies").alias("page", "body"))
    return pages.select("doc", "page", boxed(F.col("body")).alias("size"))


def page_sizes(documents: DataFrame) -> DataFrame:
    """doc, page, width, height and error kind: from directories, then for the pages that are missing there from their bodies only.

    Documents that did not open have one row without a page.  A document's pages
    are those of its directory and of its bodies.
    """
    fast = fast_sizes(documents)
    # only documents with a gap have their bodies read
    gaps = fast.where("size IS NULL").select("doc").unionByName(documents.where("code = 0 AND size(split(directory, ';')) < n_bodies").select("doc")).distinct()
    slow = slow_sizes(documents.join(gaps, "doc", "left_semi")).withColumnRenamed("size", "own")
    told = fast.join(slow, ["doc", "page"], "full_outer").select("doc", "page", F.coalesce("size", "own").alias("size"))
    failed = F.when(F.col("size").isNull(), error_kind(F.lit("Corrupt")))
    closed = documents.where("code <> 0").select("doc", F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"), error_kind(open_error(F.col("code"), F.col("password"))).alias("error"))
    return told.select("doc", "page", "size.width", "size.height", failed.alias("error")).unionByName(closed)
