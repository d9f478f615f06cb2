"""The corpus pipeline: four stages, each on all that the one before kept.

1. ``quality``: documents that the classifier rejects go.
2. ``near_copies``: of each group of linked documents one stays, the one with
   the smallest doc_id, or one without an id if none has one; documents without
   words stay.
3. ``secrets``: secrets in the texts are replaced by marks; no document goes.
4. ``packing``: the documents become packed token sequences.

All stages but the last return the columns of documents.  Null or empty texts,
repeated rows, extra columns and empty tables are handled as the operators
define it.  Rows that share a doc_id or have none are documents of their own if
their texts differ; of rows with one doc_id and one text, one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import ngram_join, packing, quality, secrets
from leafmill.llm.common import checkpointed, free_name, table
from leafmill.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the cut; labels are learnt from the given documents."""
    name = free_name("quality_score", docs.columns)
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), name)
    return scored.where(F.col(name) >= quality.CUT).drop(name)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose members are linked by their shingles."""
    name = free_name("row_key", docs.columns)
    key = F.xxhash64("doc_id", "text")  # a document's own name, whether or not its id is there and its alone
    found = checkpointed(ngram_join.join(docs.select(key.alias("doc_id"), "text")))
    ids = docs.select(key.alias("key"), F.col("doc_id").alias("id")).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    ids = checkpointed(ids)
    parts = found.select(F.col("doc_id").alias("key"), "component_id").distinct().join(ids, "key")
    first = parts.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("least"))
    stay = docs.withColumn(name, key).join(first.select(F.col("least.key").alias(name)), name, "left_semi")
    again = ids.where("rows > 1").select(F.col("key").alias(name))
    if not again.isEmpty():  # repeated rows are few keys, but each may be many rows: one is picked in every task first
        order = Window.partitionBy(name).orderBy(F.xxhash64(*docs.columns))
        place = free_name("place", [name, *docs.columns])
        one = stay.join(again, name, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
        stay = stay.join(again, name, "left_anti").unionByName(one)
    return stay.select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences' pieces and places."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("near_copies", keep_one), ("secrets", hide_secrets), ("packing", pack)]

#: Tokens, learnt scores and the automaton's spans are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        # what a stage kept is read several times by the next one
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
