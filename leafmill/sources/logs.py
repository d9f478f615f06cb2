"""A rotating log as a streaming sink that leaves each row once.

A batch's rows are JSON lines in a folder of the batch's number, with a folder for each
day inside.  A batch counts once its write is complete; when a stream is started
again and repeats its last batch, an incomplete folder is written anew and a complete
one is left as it is.  Days beyond the retention are deleted as whole folders, and
are not read even where they are still there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.sources import shared


class LogSink:
    """Log rows under a folder; ``time`` says on which day a row belongs, rows without it on none that is kept out."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, time: str = "ts", days: int | None = None):
        self.spark, self.root, self.schema, self.time, self.days = spark, root.rstrip("/"), schema, time, days

    def _batches(self) -> list[str]:
        folder = f"{self.root}/batches"
        return [f"{folder}/{n}" for n in shared.names(self.spark, folder) if shared.complete(self.spark, f"{folder}/{n}")]

    def write(self, rows: DataFrame, batch: int) -> None:
        """Takes a batch; repeating it changes nothing."""
        path = f"{self.root}/batches/batch={batch:012d}"
        if not shared.complete(self.spark, path):
            day = F.date_format(self.time, "yyyy-MM-dd")
            rows.select(*self.schema.names, F.coalesce(day, F.lit("none")).alias("day")).write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS[XXX]").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").partitionBy("day").json(path)

    def stream(self, rows: DataFrame):
        """A writer of a stream's batches."""
        return rows.writeStream.foreachBatch(self.write)

    def _days(self) -> list[str]:
        return sorted({n[4:] for b in self._batches() for n in shared.names(self.spark, b) if n.startswith("day=")})

    def _first(self) -> str:
        """The first day that is kept: the newest one and those before it, as many as are retained."""
        known = [d for d in self._days() if d != "none"]
        if self.days is None or not known:
            return ""
        return self.spark.range(1).select(F.date_sub(F.lit(known[-1]).cast("date"), self.days - 1).cast("string")).first()[0]

    def read(self) -> DataFrame:
        """The rows of the days that are kept, with their day."""
        batches = self._batches()
        typed = StructType(self.schema.fields).add("batch", "string").add("day", "string")
        if not batches:
            return self.spark.createDataFrame([], typed).drop("batch")
        rows = self.spark.read.schema(typed).option("basePath", f"{self.root}/batches").json(batches).drop("batch")
        return rows.where((F.col("day") >= self._first()) | (F.col("day") == "none"))

    def rotate(self) -> int:
        """Deletes what is older than the retention; how many folders went."""
        first, gone = self._first(), 0
        for b in self._batches():
            for n in shared.names(self.spark, b):
                if n.startswith("day=") and n[4:] != "none" and n[4:] < first:
                    shared.delete(self.spark, f"{b}/{n}")
                    gone += 1
        return gone
