"""Sources and sinks: the store, file listings, framed messages, reports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1
_PAGE = [("file_id", T.LongType()), ("page", T.IntegerType())]


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


#: The store's tables. They are fixed; nothing is inferred.
SCHEMAS: dict[str, T.StructType] = {
    "files": _schema(("id", T.LongType()), ("path", T.StringType()), ("path_hash", T.BinaryType()), ("size", T.LongType()), ("mtime", T.LongType()), ("last_opened", T.LongType()), ("pinned", T.BooleanType())),
    "reading_state": _schema(*_PAGE, ("scroll_y", T.DoubleType()), ("zoom", T.DoubleType()), ("view_mode", T.StringType()), ("rotation", T.IntegerType()), ("updated_at", T.LongType())),
    "drafts": _schema(("file_id", T.LongType()), ("base_hash", T.BinaryType()), ("ops_blob", T.BinaryType()), ("updated_at", T.LongType())),
    "bookmarks": _schema(("id", T.LongType()), *_PAGE, ("label", T.StringType()), ("created_at", T.LongType())),
    "doc_text": _schema(*_PAGE, ("text", T.StringType())),
    "prefs": _schema(("key", T.StringType()), ("value", T.StringType())),
    "sessions": _schema(("id", T.LongType()), ("created_at", T.LongType())),
    "session_tabs": _schema(("session_id", T.LongType()), ("file_id", T.LongType()), ("panel", T.IntegerType()), ("tab_order", T.IntegerType()), ("pinned", T.BooleanType()), ("is_active", T.BooleanType())),
    "export_history": _schema(("id", T.LongType()), ("file_id", T.LongType()), ("out_path", T.StringType()), ("kind", T.StringType()), ("created_at", T.LongType())),
    "shortcuts": _schema(("command", T.StringType()), ("keys", T.StringType())),
    "thumbs": _schema(("path_hash", T.BinaryType()), ("page", T.IntegerType()), ("scale_bp", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("size", T.LongType()), ("mtime", T.LongType()), ("png", T.BinaryType()), ("created_at", T.LongType())),
    "cache_meta": _schema(("key", T.StringType()), ("value", T.StringType())),
}
#: Tables that may be lost and made anew.
DISPOSABLE = frozenset({"thumbs", "cache_meta"})


def place(root: str, name: str) -> str:
    """Precious and disposable tables lie apart."""
    return f"{root.rstrip('/')}/{'cache' if name in DISPOSABLE else 'app'}/{name}"


def create(spark: SparkSession, root: str) -> None:
    """Empty tables and the version of a new store."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(place(root, name))
    spark.createDataFrame([(VERSION,)], "version int").write.mode("ignore").parquet(f"{root.rstrip('/')}/app/schema_version")


def version(spark: SparkSession, root: str, supported: int = VERSION) -> DataFrame:
    """The store's version; reading one of a newer build is an error."""
    from leafmill.operators.relations import refuse_newer

    return spark.read.schema("version int").parquet(f"{root.rstrip('/')}/app/schema_version").select(refuse_newer(F.col("version"), supported).alias("version"))


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(place(root, name))


def in_memory(spark: SparkSession, name: str, rows: list) -> DataFrame:
    """A table from rows at hand, as in tests."""
    return spark.createDataFrame(rows, SCHEMAS[name])


def stamps(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size and mtime in whole seconds of files, by name; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime")).orderBy("path")


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, content and the hash that identifies it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "content", F.sha2("content", 256).alias("hash"))


def frames(stream: DataFrame, content: str, most: int = 8 << 20) -> DataFrame:
    """Messages of binary columns that hold frames: four bytes of little-endian length, then the message.

    A frame that is too long or cut short ends its stream with an error row.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n, raw = 0, 0, raw or b""
                while at < len(raw):
                    size = int.from_bytes(raw[at : at + 4], "little")
                    if len(raw) < at + 4 or size > most or len(raw) < at + 4 + size:
                        rows.append((key, n, None, "FrameTooLarge" if len(raw) >= at + 4 and size > most else "PeerClosed"))
                        break
                    rows.append((key, n, raw[at + 4 : at + 4 + size], None))
                    at, n = at + 4 + size, n + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.string()))], ["path", "nth", "message", "error"])

    return stream.select("path", content).mapInArrow(run, "path string, nth long, message binary, error string")


def framed(messages: DataFrame, message: str) -> DataFrame:
    """The frame of each message."""
    n = F.octet_length(message)
    size = F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0")) for k in range(4)))
    return messages.withColumn("frame", F.concat(size, F.col(message).cast("binary")))


def resident_kb(spark: SparkSession, path: str) -> DataFrame:
    """VmRSS of process status files in kB."""
    text = spark.read.text(path)
    return text.select(F.regexp_extract("value", r"^VmRSS:\s+(\d+)", 1).try_cast("bigint").alias("kb")).where("kb IS NOT NULL")


def write_report(report: DataFrame, path: str) -> None:
    """A benchmark report as JSON lines."""
    report.write.mode("overwrite").json(path)


def log_lines(log: DataFrame, time: str = "ts") -> DataFrame:
    """date and line: log rows as JSON, with the day whose folder they go to."""
    return log.select(F.to_date(time).alias("date"), F.to_json(F.struct(*log.columns)).alias("line"))


def write_log(log: DataFrame, path: str, time: str = "ts") -> None:
    """Log rows as JSON, a folder for each day."""
    log.withColumn("date", F.to_date(time)).write.mode("append").partitionBy("date").json(path)


def synthetic_pages(spark: SparkSession, pages: int, seed: int) -> DataFrame:
    """Seeded page sizes for experiments."""
    return spark.range(pages).select(F.col("id").cast("int").alias("page"), F.lit(612.0).alias("width"), (F.lit(600.0) + F.floor(F.rand(seed) * 400)).alias("height"))
