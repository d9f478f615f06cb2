"""Trees given by parent links."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.sources import shared

MOST_LEVELS, MOST_NODES = 32, 20_000


def flatten(links: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """seq, depth, title and path (of seq) of each node that a root reaches, level by level.

    ``links`` has id, parent (null for roots), seq and title.  A node on its own
    path is not entered again, so cycles end; deeper levels are cut.
    """
    level = links.where("parent IS NULL").select("id", "seq", F.lit(0).alias("depth"), "title", F.array("seq").alias("path"), F.array("id").alias("seen"))
    out = level
    for depth in range(1, min(levels, MOST_LEVELS)):
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("up"), F.col("seen").alias("before"))
        below = links.where("parent IS NOT NULL").join(up, "parent").where(~F.array_contains("before", F.col("id")))
        level = below.select("id", "seq", F.lit(depth).alias("depth"), "title", F.concat("up", F.array("seq")).alias("path"), F.concat("before", F.array("id")).alias("seen"))
        out = out.unionByName(level)
    return out.drop("seen", "id")


def preorder(flat: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """The first nodes in preorder; the cap is part of the outline's definition."""
    return flat.orderBy("path").limit(most)


def enabled(entries: DataFrame, page: str) -> DataFrame:
    """Entries that lead somewhere."""
    return entries.where(F.col(page).isNotNull())


@contextmanager
def _limited_early(spark: SparkSession, most: int) -> Iterator[None]:
    """Tasks cut their own rows to the first ``most`` of each document before rows meet; Spark does so only up to its threshold."""
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(most, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def walked(links: DataFrame, levels: int = MOST_LEVELS, most: int = MOST_NODES) -> DataFrame:
    """doc, nth (from 0, in preorder), depth and id of the nodes that each document's roots reach.

    ``links`` has doc, id, parent (null for roots) and seq, the order among
    siblings; an id may stand under several parents, as in damaged files.  A node on
    its own path is not entered again, so cycles end; ``levels`` bounds the depth, and of
    each document the first ``most`` nodes in preorder are kept, which is part of an
    outline's definition.  Links without a document lead nowhere.

    Links are dealt out by parent once and every level meets them there.  Before a
    node stand its parent, all that stands before its parent, and what is less in its own
    level; with ``most`` of those it is past the end, and so is all below it, so a level keeps
    no more nodes of a document than an outline has.  That number (``at``) also orders
    a level as the whole paths do; nodes of equal paths share it, and all below them is alike.
    """
    spark = links.sparkSession
    links = links.select("doc", "id", "parent", "seq")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    below = links.where("doc IS NOT NULL AND parent IS NOT NULL AND id IS NOT NULL").repartition(parts, "doc", "parent").sortWithinPartitions("doc", "parent").persist()
    level = links.where("parent IS NULL").withColumns({"up": F.lit(-1), "path": F.array().cast("array<int>"), "seen": F.slice(F.array("id"), 1, 0)})
    within = Window.partitionBy("doc").orderBy("up", "seq", "id")
    reached = []
    try:
        for depth in range(max(levels, 1)):
            if depth:
                above = level.select("doc", F.col("id").alias("parent"), F.col("at").alias("up"), "path", "seen")
                level = above.hint("merge").join(below, ["doc", "parent"]).where(~F.array_contains("seen", F.col("id")))
            level = level.withColumns({"nth": F.row_number().over(within), "at": F.col("up") + F.rank().over(within)}).where((F.col("nth") <= most) & (F.col("at") < most))
            level = level.select("doc", "id", "at", F.array_append("path", F.col("at")).alias("path"), F.array_append("seen", F.col("id")).alias("seen"))
            with _limited_early(spark, most):
                level = shared.kept(level, "outline")
            reached.append(level.select("doc", "id", "path"))
            if level.isEmpty():
                break
    finally:
        below.unpersist()
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("path"))
    return reduce(DataFrame.unionByName, reached).withColumn("nth", nth - 1).where(F.col("nth") < most).select("doc", "nth", (F.size("path") - 1).alias("depth"), "id")
