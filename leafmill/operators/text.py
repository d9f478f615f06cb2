"""Text search over tokens, and lines out of placed characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafmill.operators import fulltext, prefix
from leafmill.operators.sequential import carried


@F.pandas_udf(StringType())
def without_accents(text: pd.Series) -> pd.Series:
    """Text without combining marks; there is no built-in for it."""
    return text.map(lambda t: t if t is None or t.isascii() else bare(t))


def bare(char: str) -> str:
    """A character without its combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")


#: Latin letters with marks, each of which is one letter without them.
MARKED = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if bare(c) != c]
ASCII, LATIN = "^[\\x00-\\x7F]*$", "^[\\x00-\\u024F\\u1E00-\\u1EFF\\u2010-\\u2027]*$"


def folded(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with their text in lower case and without accents.

    Texts of Latin letters stay in the JVM; only the others go through Python.
    """
    plain = F.coalesce(F.col(text).rlike(LATIN), F.lit(True))
    native = F.when(F.col(text).rlike(ASCII), F.col(text)).otherwise(F.translate(text, "".join(MARKED), "".join(map(bare, MARKED))))
    latin = docs.where(plain).withColumn(text, F.lower(native))
    return latin.unionByName(docs.where(~plain).withColumn(text, F.lower(without_accents(F.col(text)))))


def tokens(text: Column) -> Column:
    """Words of letters and digits of a folded text, in order."""
    return F.regexp_extract_all(text, F.lit("([\\p{L}\\p{N}]+)"), 1)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """token, document, tf and positions of every token."""
    placed = folded(docs, text).select(key, F.posexplode(tokens(F.col(text))).alias("pos", "token"))
    return placed.groupBy("token", key).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """token, documents that hold it and how often it stands in all; each row is a document, read once and summed up in its batch."""
    return fulltext.merged(fulltext.changes(docs, text))


def matching(docs: DataFrame, text: str, term: str) -> DataFrame:
    """Documents that hold a term as a token; their text comes back folded.

    A text without the term's letters, once it is folded, is not cut into tokens.
    """
    held = folded(docs, text).where(F.contains(F.col(text), F.lit(term)))
    return held.where(F.array_contains(tokens(F.col(text)), term))


def search(docs: DataFrame, text: str, term: str, case_sensitive: bool = False, whole_word: bool = False) -> DataFrame:
    """Documents that hold a literal term, with the number of times."""
    quoted = "".join(f"\\{c}" if not c.isalnum() else c for c in term)
    pattern = ("" if case_sensitive else "(?i)") + (f"(?:^|[^\\p{{L}}\\p{{N}}]){quoted}(?:$|[^\\p{{L}}\\p{{N}}])" if whole_word else quoted)
    return docs.withColumn("hits", F.regexp_count(F.col(text), F.lit(pattern))).where("hits > 0")


def synced(docs: DataFrame, deleted: DataFrame, updated: DataFrame, key: str) -> DataFrame:
    """Documents after a batch of changes: what is deleted or updated goes, what is updated comes anew."""
    kept = docs.join(deleted.select(key).unionByName(updated.select(key)).distinct(), key, "left_anti")
    return kept.unionByName(updated)


def lines(chars: Column) -> Column:
    """``placed_lines`` of the characters in one short array, as a fold; it takes the square of the array's length."""
    shape = "array<struct<text:string,left:double,bottom:double,right:double,top:double,open:boolean>>"

    def step(acc: Column, ch: Column) -> Column:
        last = F.element_at(acc, -1)
        own = F.struct(ch["c"].alias("text"), ch["left"].alias("left"), ch["bottom"].alias("bottom"), ch["right"].alias("right"), ch["top"].alias("top"), F.lit(True).alias("open"))
        shared = F.greatest(F.lit(0.0), F.least(ch["top"], last["top"]) - F.greatest(ch["bottom"], last["bottom"]))
        small = F.least(ch["top"] - ch["bottom"], last["top"] - last["bottom"])
        grown = F.struct(
            F.concat(last["text"], ch["c"]).alias("text"),
            F.least(last["left"], ch["left"]).alias("left"),
            F.least(last["bottom"], ch["bottom"]).alias("bottom"),
            F.greatest(last["right"], ch["right"]).alias("right"),
            F.greatest(last["top"], ch["top"]).alias("top"),
            F.lit(True).alias("open"),
        )
        closed = F.struct(*(last[k].alias(k) for k in ("text", "left", "bottom", "right", "top")), F.lit(False).alias("open"))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ends = ch["c"].isin("\n", "\r")
        joins = (F.size(acc) > 0) & last["open"] & (small > 0) & (shared > small * 0.5) & (ch["right"] >= last["left"])
        return F.when(ends, F.when(F.size(acc) > 0, F.concat(head, F.array(closed))).otherwise(acc)).when(joins, F.concat(head, F.array(grown))).otherwise(F.concat(acc, F.array(own)))

    known = F.filter(chars, lambda ch: ch.isNotNull() & ch["c"].isNotNull() & ch["left"].isNotNull())
    folded = F.aggregate(known, F.array().cast(shape), lambda acc, ch: step(acc, ch).cast(shape))
    return F.transform(F.filter(folded, lambda x: F.trim(x["text"]) != ""), lambda x: F.struct(*(x[k].alias(k) for k in ("text", "left", "bottom", "right", "top"))))


#: What a trim takes away: white space of all kinds, and the byte order mark.
BLANK = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def line_of_chars():
    """The rule of one stretch of characters: each closed line with the place of its first character and its hull."""
    held: list = []  # at, characters, left, bottom, right, top of the open line

    def closed():
        if held and "".join(held[1]).strip(BLANK):
            yield held[0], "".join(held[1]), *held[2:]
        held.clear()

    def step(place, c, left, bottom, right, top):
        if c in ("\n", "\r"):
            return closed()
        if held:
            small = min(held[5] - held[3], top - bottom)
            shared = min(held[5], top) - max(held[3], bottom)
            if small > 0 and shared > small * 0.5 and not right < held[2]:
                held[1].append(c)
                held[2:] = min(held[2], left), min(held[3], bottom), max(held[4], right), max(held[5], top)
                return ()
        out = list(closed())
        held.extend((place, [c], left, bottom, right, top))
        return out

    return step, closed


def placed_lines(chars: DataFrame, keys: list[str], place: str) -> DataFrame:
    """keys, line from 0, text and hull of the lines that placed characters make.

    ``chars`` has the keys, the character's whole-numbered ``place`` in reading order,
    c, left, bottom, right and top.  A line ends at a line break, where a
    character shares half of the smaller height or less with the line's hull, and
    where it lies wholly left of the line.  Characters without code or box and blank
    lines go.

    A line break ends whatever came before, so stretches between breaks do not
    depend on one another: breaks are counted by two-level running sums, stretches
    go to tasks of their own and are folded in linear time with the open line
    as state, and lines are numbered by running sums again.  A page without breaks is
    one stretch, which is streamed through its task.
    """
    box = ["left", "bottom", "right", "top"]
    known = chars.where(F.col("c").isNotNull() & F.col("left").isNotNull()).select(*keys, F.col(place).cast("long").alias("place"), "c", *(F.col(b).cast("double").alias(b) for b in box))
    cut = prefix.before(known, keys, "place", {"stretch": F.col("c").isin("\n", "\r").cast("long")})
    types = {"at": "long", "text": "string", **dict.fromkeys(box, "double")}
    made = carried(cut.select(*keys, "stretch", "place", "c", *box), [*keys, "stretch"], ["place"], line_of_chars, types)
    numbered = prefix.before(made, keys, "at", {"line": F.lit(1)})
    return numbered.select(*keys, F.col("line").cast("int").alias("line"), "text", *box)
