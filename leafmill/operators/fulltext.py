"""A full-text index that is kept up to date, and search over it.

The index is a folder of segments.  ``frequencies/<n>`` has signed changes of each
token's document and term frequency; ``postings/<n>`` has, for each token of each
document, its places there, in ``BUCKETS`` partitions by token.  Segment 0 comes
from a first build.  Each batch of changes becomes the next segment from the old
and new texts of the changed documents alone: old postings count -1 and new ones
+1, and what cancels out is gone.  Of a token in a document the newest segment
counts; a token that is gone has no places.  A segment counts once its write is
complete, and a batch that is applied again finds its segment there, so that
streams may repeat batches.  ``compact`` merges all segments into one.

Search reads the partitions of its terms only.  Terms are joined on documents,
the rarest first, and places are compared for phrases.  A phrase stands in a
document no more often than its least frequent term; the greatest such bound in
a block of documents says which blocks a search for the best few must look into,
so places of the others are never read.

Texts are folded as a whole in each batch by Arrow's kernels: canonical
decomposition, marks dropped, composed again, lower-cased; tokens are runs of
letters and numbers.  Null and empty texts have no tokens; documents without an
id have no postings, since a search could not name them, and count only in an index
that keeps frequencies alone; an index takes each id once, as the store does.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources import shared

BUCKETS, BLOCK = 16, 1024
#: Bytes of text that a worker holds at once.
CHARS = 2_000_000
#: Blocks that a search for the best few looks into first.
FIRST_BLOCKS = 64
POSTINGS = "token string, doc long, block long, tf int, places array<int>, seq int, bucket int"


def parts(batches, chars: int = CHARS):
    """Record batches cut to a bound of text in the last column, each copied to buffers of its own."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars, side="right")))
            yield [pa.concat_arrays([c.slice(at, to - at)]) for c in batch.columns]
            at = to


def token_lists(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Distinct tokens of the texts, the number of each token in order, and the row it stands in."""
    bare = pc.replace_substring_regex(pc.utf8_normalize(pc.fill_null(text, ""), form="NFD"), r"\p{Mn}+", "")
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.utf8_normalize(bare, form="NFC")), r"[^\p{L}\p{N}]+")
    row = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        real = code != empty
        code, row = code[real], row[real]
    return coded.dictionary, code, row


def bucket_of(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def changes(docs: DataFrame, text: str, sign: int = 1) -> DataFrame:
    """token, df and tf that the documents add (or take away), summed up in each batch; one pass, and texts are not shuffled."""

    def run(batches):
        for (texts,) in parts(batches):
            tokens, code, row = token_lists(texts)
            n = max(1, len(tokens))
            tf = np.bincount(code, minlength=n)
            df = np.bincount(np.unique(row * n + code) % n, minlength=n)
            some = np.flatnonzero(tf)
            yield pa.RecordBatch.from_arrays([tokens.take(pa.array(some)), pa.array(df[some] * sign), pa.array(tf[some] * sign)], ["token", "df", "tf"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "token string, df long, tf long")


def merged(signed: DataFrame) -> DataFrame:
    """token, df and tf out of signed changes, without tokens that are gone."""
    return signed.groupBy("token").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df > 0")


def posted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """bucket, token, doc, block, tf and places of every token of every document; in order of tokens in each batch, without a shuffle."""

    def run(batches):
        for doc, texts in parts(batches):
            tokens, code, row = token_lists(texts)
            names = tokens.to_pylist()
            buckets = np.fromiter(map(bucket_of, names), np.int32, len(names))
            rank = np.empty(len(names), np.int64)
            rank[sorted(range(len(names)), key=lambda i: (buckets[i], names[i]))] = np.arange(len(names))
            size = np.bincount(row, minlength=len(doc))
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            order = np.argsort(rank[code] * len(doc) + row, kind="stable")
            code, row, place = code[order], row[order], place[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            tf = np.diff(np.append(first, len(code)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(place.astype(np.int32)))
            own = doc.take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays([pa.array(buckets[code[first]]), tokens.take(pa.array(code[first])), own, pa.array(tf.astype(np.int32)), lists], ["bucket", "token", "doc", "tf", "places"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "bucket int, token string, doc long, tf int, places array<int>")
    return rows.withColumn("block", F.floor(F.col("doc") / BLOCK))


def _back(places: Column, by: int) -> Column:
    """Where a phrase would start whose token of this number stands at these places."""
    return F.transform(places, lambda x: x - by) if by else places


class FullTextIndex:
    """An index of documents in a folder; without postings it keeps frequencies only."""

    def __init__(self, spark: SparkSession, root: str, with_postings: bool = True):
        self.spark, self.root, self.with_postings = spark, root.rstrip("/"), with_postings

    def _segments(self, kind: str) -> list[str]:
        """Complete segments from the newest merged one on."""
        found = [n for n in shared.names(self.spark, f"{self.root}/{kind}") if shared.complete(self.spark, f"{self.root}/{kind}/{n}")]
        base = max((n for n in found if n.endswith("-merged")), default="")
        return [f"{self.root}/{kind}/{n}" for n in found if n >= base]

    def _write(self, rows: DataFrame, kind: str, name: str) -> None:
        path = f"{self.root}/{kind}/{name}"
        if not shared.complete(self.spark, path):  # else an earlier run of this batch wrote it
            writer = rows.write.mode("overwrite")
            (writer.partitionBy("bucket") if kind == "postings" else writer).parquet(path)

    def build(self, docs: DataFrame, key: str, text: str) -> None:
        """Segment 0 from all documents."""
        if self.with_postings:
            self._write(posted(docs, key, text).withColumn("seq", F.lit(0)), "postings", f"{0:09d}")
            base = self.spark.read.schema(POSTINGS).parquet(f"{self.root}/postings/{0:09d}")
            self._write(base.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), "frequencies", f"{0:09d}")
        else:
            self._write(merged(changes(docs, text)), "frequencies", f"{0:09d}")

    def apply(self, batch: int, old: DataFrame, new: DataFrame, key: str, text: str) -> None:
        """The next segment: ``old`` has the changed documents as they were, ``new`` those that are there afterwards. Batches count from 1."""
        name = f"{batch:09d}"
        if self.with_postings:
            known = ["bucket", "token", "doc", "block"]
            gone = posted(old, key, text).select(*known, F.lit(0).alias("tf"), F.lit(None).cast("array<int>").alias("places"), F.lit(-1).alias("df_change"), (-F.col("tf")).alias("tf_change"))
            come = posted(new, key, text).select(*known, "tf", "places", F.lit(1).alias("df_change"), F.col("tf").alias("tf_change"))
            both = gone.unionByName(come).groupBy(*known).agg(F.max("tf").alias("tf"), F.max("places").alias("places"), F.sum("df_change").alias("df_change"), F.sum("tf_change").alias("tf_change"))
            self._write(both.withColumn("seq", F.lit(batch)), "postings", name)
            # a document's row says what it changes, so texts are not read again
            signed = self.spark.read.schema("token string, df_change long, tf_change long").parquet(f"{self.root}/postings/{name}").select("token", F.col("df_change").alias("df"), F.col("tf_change").alias("tf"))
        else:
            signed = changes(old, text, -1).unionByName(changes(new, text, 1))
        signed = signed.groupBy("token").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df <> 0 OR tf <> 0")
        self._write(signed, "frequencies", name)  # last: it tells that the batch is in

    def frequencies(self) -> DataFrame:
        """token, df and tf of all documents as they are now."""
        return merged(self.spark.read.schema("token string, df long, tf long").parquet(*self._segments("frequencies")))

    def _postings(self, tokens: list[str]) -> DataFrame:
        """The newest postings of these tokens; other partitions are not read."""
        segments = self._segments("postings")
        # each segment's partitions are found under its own folder
        read = [self.spark.read.schema(POSTINGS).parquet(s) for s in segments]
        rows = reduce(DataFrame.unionByName, read).where(F.col("bucket").isin(sorted({bucket_of(t) for t in tokens})) & F.col("token").isin(tokens))
        if len(segments) > 1:
            rows = rows.groupBy("token", "doc", "block").agg(F.max_by(F.struct("tf", "places"), "seq").alias("x")).select("token", "doc", "block", "x.tf", "x.places")
        return rows.where("tf > 0")

    def _ordered(self, terms: list[str]) -> list[str]:
        """Distinct terms, the rarest first."""
        known = self.frequencies().where(F.col("token").isin(terms)).collect()
        df = {r["token"]: r["df"] for r in known}
        return sorted(set(terms), key=lambda t: (df.get(t, 0), t))

    def match(self, token: str) -> DataFrame:
        """Documents that hold a token."""
        return self._postings([token]).select("doc")

    def _hits(self, terms: list[str], only: Column | None = None) -> DataFrame:
        order = self._ordered(terms)
        rows = self._postings(order)
        if only is not None:
            rows = rows.where(only)
        own = lambda t: rows.where(F.col("token") == t).select(F.col("doc"), F.col("places").alias(f"p{terms.index(t)}"))
        joined = reduce(lambda a, b: a.join(b, "doc"), [own(t) for t in order])
        starts = [_back(F.col(f"p{terms.index(t)}"), i) for i, t in enumerate(terms)]
        return joined.select("doc", F.size(reduce(F.array_intersect, starts)).alias("hits")).where("hits > 0")

    def phrase(self, phrase: str) -> DataFrame:
        """doc and hits of a phrase: its tokens one after another."""
        terms = self.terms(phrase)
        return self._hits(terms) if terms else self.spark.createDataFrame([], "doc long, hits int")

    def best(self, phrase: str, max_hits: int) -> DataFrame:
        """The documents with most hits of a phrase, smaller ids first among equals; ``max_hits`` is the feature."""
        terms = self.terms(phrase)
        if not terms:
            return self.spark.createDataFrame([], "doc long, hits int")
        distinct = sorted(set(terms))
        # a document has no more hits than its rarest term's tf, and this needs no places
        bound = self._postings(distinct).groupBy("doc", "block").agg(F.count("*").alias("n"), F.min("tf").alias("most")).where(F.col("n") == len(distinct))
        blocks = shared.kept(bound.groupBy("block").agg(F.max("most").alias("most")), "blocks")
        first = [r["block"] for r in blocks.orderBy(F.desc("most"), "block").limit(FIRST_BLOCKS).collect()]
        ranked = lambda df: df.orderBy(F.desc("hits"), "doc").limit(max_hits)
        found = ranked(self._hits(terms, F.col("block").isin(first))).collect() if first else []
        known = self.spark.createDataFrame([tuple(r) for r in found], "doc long, hits int")
        least = found[-1]["hits"] if len(found) == max_hits else 1
        rest = blocks.where((F.col("most") >= least) & ~F.col("block").isin(first)).select("block")
        if rest.isEmpty():
            return ranked(known)
        docs = self._postings(distinct).join(rest, "block", "left_semi").select("doc").distinct()
        return ranked(self._hits(terms).join(docs, "doc", "left_semi").unionByName(known))

    def terms(self, phrase: str) -> list[str]:
        tokens, code, _ = token_lists(pa.array([phrase]))
        names = tokens.to_pylist()
        return [names[c] for c in code.tolist()]

    def compact(self) -> None:
        """One segment out of all; older ones are no longer read and may be deleted."""
        newest = self._segments("frequencies")[-1].rpartition("/")[2][:9]
        name = f"{newest}-merged"
        if self.with_postings:
            read = [self.spark.read.schema(POSTINGS).parquet(s) for s in self._segments("postings")]
            rows = reduce(DataFrame.unionByName, read).groupBy("bucket", "token", "doc", "block").agg(F.max_by(F.struct("tf", "places"), "seq").alias("x")).where("x.tf > 0")
            self._write(rows.select("bucket", "token", "doc", "block", "x.tf", "x.places", F.lit(int(newest)).alias("seq")), "postings", name)
        self._write(self.frequencies(), "frequencies", name)
