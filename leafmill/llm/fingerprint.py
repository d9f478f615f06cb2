"""Operator 4: document fingerprints by one-permutation MinHash, in native expressions.

A text's five-word shingles are hashed once; the high bits of a hash name one
of ``BINS`` bins and the least hash of each bin counts.  An empty bin takes the
value of another one by optimal densification: bin j probes the bins along its
own pseudo-random permutation and takes the first that is not empty, so that
two texts whose sets agree there choose alike.  The low ``BITS`` bits of the
values, packed, are the fingerprint.  The likeness of two fingerprints is the
share of equal values, corrected for values that agree by chance.

Everything is DataFrame expressions.  The bins are laid out by sorting the
hashes with one sentinel for each bin, the largest hash it can hold.

Defined edge cases: a null text counts as empty; a text without words has the
empty fingerprint, which is wholly like another empty one and unlike all
others; fewer than five words are one shingle; equal texts have equal
fingerprints; rows that share a doc_id follow one another in the order of their
texts; a null doc_id comes first; the only document is its own successor; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read, so
extra columns never clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import shuffle_partitions

WORDS = 5
BINS = 256
BITS = 8
#: Probes tried one by one before the rest of a permutation is searched at once.
PROBES = 16
_SHIFT = 63 - int(math.log2(BINS))
_LOW = (1 << BITS) - 1
_REST = (1 << _SHIFT) - 1


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column) -> Column:
    """Non-negative hashes of the shingles of a text."""
    # the blanks are those of ASCII; fixed values
    blanks = " \t\n\x0b\x0c\r"
    words = F.split(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(blanks)), "[ \\t-\\r]+")

    def shingles(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WORDS))).bitwiseAND((1 << 63) - 1))
        few = F.array(F.xxhash64(h).bitwiseAND((1 << 63) - 1))
        return F.when(F.size(h) >= WORDS, each).otherwise(few)

    return let(words, lambda w: F.when((F.size(w) == 1) & (w[0] == ""), F.array().cast("array<bigint>")).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), shingles)))


def registers(text: Column) -> Column:
    """The low bits of the densified bins of a text; an empty array if it has no words."""
    sentinels = F.array(*(F.lit((j << _SHIFT) | _REST) for j in range(BINS)))
    bin_of = lambda x: F.shiftright(x, _SHIFT)
    real = lambda x: x.bitwiseAND(_REST) != _REST
    low = lambda x: x.bitwiseAND(_LOW).cast("int")

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))

    def densified(dense: Column) -> Column:
        def fill(full: Column) -> Column:
            def value(x: Column, j: Column) -> Column:
                # probe t of bin j is bin (factor * t + shift) mod BINS, a permutation as the factor is odd
                factor = F.xxhash64(j, F.lit(1)).bitwiseAND(BINS - 1).bitwiseOR(1)
                shift = F.xxhash64(j, F.lit(2)).bitwiseAND(BINS - 1)

                def probed(a: Column, c: Column) -> Column:
                    def probe(t: int) -> Column:
                        y = F.get(dense, (a * t + c).bitwiseAND(BINS - 1).cast("int"))
                        return F.when(real(y), low(y))

                    def searched(inverse: Column) -> Column:
                        turn = lambda y: (inverse * (bin_of(y) - c)).bitwiseAND(BINS - 1) * (_LOW + 1) + y.bitwiseAND(_LOW)
                        return low(F.array_min(F.transform(full, turn)))

                    # Newton's steps to the inverse of a, from 3 to 6 to 12 right bits
                    once = (a * (F.lit(2) - a * a)).bitwiseAND(BINS - 1)
                    inverse = (once * (F.lit(2) - a * once)).bitwiseAND(BINS - 1)
                    return F.coalesce(*(probe(t) for t in range(PROBES)), let(inverse, searched))

                both = F.struct(factor.alias("a"), shift.alias("c"))
                return F.when(real(x), low(x)).otherwise(let(both, lambda p: probed(p["a"], p["c"])))

            return F.transform(dense, value)

        return let(F.filter(dense, real), fill)

    def filled(hashes: Column) -> Column:
        dense = let(F.sort_array(F.concat(hashes, sentinels)), firsts)
        return F.when(F.size(hashes) == 0, F.array().cast("array<int>")).otherwise(let(dense, densified))

    return let(shingle_hashes(text), filled)


def packed(values: Column) -> Column:
    """Registers as hexadecimal digits, eight registers to a word."""

    def word(v: Column, g: Column) -> Column:
        at = lambda k: F.shiftleft(F.get(v, g * 8 + k).cast("long"), 8 * (7 - k))
        total = at(0)
        for k in range(1, 8):
            total = total.bitwiseOR(at(k))
        return F.lpad(F.hex(total), 16, "0")

    words = let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), lambda g: word(v, g)))
    return F.when(F.size(values) == 0, F.lit("")).otherwise(F.lower(F.array_join(words, "")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, corrected for agreement by chance, from 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    estimate = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    alone = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(alone, (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), estimate))


def bucketed(docs: DataFrame) -> DataFrame:
    """``docs`` with a bucket of doc_id: ranges of about equally many rows, from quantiles."""
    n = max(48, 4 * shuffle_partitions(docs.sparkSession))
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n))))
    # searched in two steps, so that many buckets cost little for each row
    side = max(1, math.isqrt(len(cuts)))
    groups = [cuts[k : k + side] for k in range(0, len(cuts), side)] or [[]]
    heads = F.array(*(F.lit(g[0]) for g in groups[1:])).cast("array<double>")
    parts = F.array(*(F.array(*(F.lit(c) for c in g)).cast("array<double>") for g in groups))
    upto = lambda bounds: F.size(F.filter(bounds, lambda c: c <= F.col("doc_id")))
    bucket = let(upto(heads), lambda g: g * (side + 1) + upto(F.get(parts, g)))
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = bucketed(rows)
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    # the first row of each bucket follows the last row of the bucket before; one row for each bucket
    least = rows.groupBy("bucket").agg(F.min("doc_id").alias("least"))
    ring = Window.orderBy("bucket")
    last = F.max("bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    least = least.select("bucket", "least", F.coalesce(F.lag("bucket").over(ring), last).alias("before"))
    heads = rows.join(F.broadcast(least.withColumnRenamed("bucket", "own_bucket")), (F.col("bucket") == F.col("own_bucket")) & F.col("doc_id").eqNullSafe(F.col("least")))
    firsts = heads.groupBy(F.col("before").alias("bucket")).agg(F.min("text").alias("first_text"))

    led = rows.withColumn("next_text", F.lead("text").over(order)).join(firsts, "bucket", "left")
    led = led.withColumn("first_text", F.when(F.col("next_text").isNull(), F.col("first_text")))
    n = F.length("text")
    e = F.floor(n / 2).cast("int")
    following = F.coalesce("next_text", "first_text")
    edited = led.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - e), F.substring(following, F.lit(1), e)))
    whole = edited.select(
        "bucket",
        "doc_id",
        "text",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        registers(F.col("text")).alias("own"),
        registers(F.col("edited")).alias("other"),
        F.when(F.col("first_text").isNotNull(), registers(F.col("first_text"))).alias("edge"),
    )
    whole = whole.withColumn("next", F.coalesce("edge", F.lead("own").over(order)))
    return whole.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed(F.col("own")).alias("fingerprint"),
        packed(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
