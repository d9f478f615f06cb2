"""Operator 9: a sharded store kept in shape by size-tiered compaction.

Arrivals are appended as small immutable shards.  A shard's tier is the power
of ``FAN`` that its bytes reach above the smallest size.  When a tier holds
``FAN`` shards or more, these runs of similar size are merged into files of about
the target size, all full tiers of a version in one job; the old shards stay on disk until no version that is kept names them.
A version of the store is a manifest: which shards are live and what they hold.  Its
file is created only if it is not there, and ends with a mark; a manifest without the
mark does not count, so a reader sees one version or the next one.  A writer that
finds its version taken fails and can try again on the newer one; what a writer that
died left without a mark is removed after ``STALE`` seconds.

Rows are dealt in turn to shards, each of which one task writes
as one file, so no key, source, copy group or input split decides a shard's size.  A
shard that still exceeds the target by half is split when the store is compacted.
Everything is DataFrame code; files are touched through the file system that the
store's path names.

Defined edge cases: null texts count no bytes; repeated rows are kept as often
as they arrive; an empty arrival commits a version that names no new shard; all
columns are kept under their own names, and the store's own column is chosen so
that it clashes with none; null doc_ids are kept; a table without ``source``
or ``text`` is sharded too, with a null source and no bytes.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import free_name

#: Text bytes that merged files aim at, the least tier's size, and shards of a tier that set off a merge.
TARGET = 128 << 20
SMALLEST = 1 << 20
FAN = 4
#: Shards of arrivals have the target's bytes over this; a job has so many tasks at most, and shards are spread by keys up to so many.
SHARE, MOST_TASKS, MOST_KEYS = 16, 20_000, 512
#: Seconds after which an unfinished manifest is given up, and shards that no version ever named (a week).
STALE, ABANDONED = 600, 7 * 86400
END = "end"


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class Store:
    """A folder with ``shards/`` and ``manifests/``."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, smallest: int = SMALLEST, fan: int = FAN):
        self.spark, self.path, self.target, self.smallest, self.fan = spark, path.rstrip("/"), target, smallest, fan
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("shards", "manifests"):
            self._fs.mkdirs(self._path(f"{self.path}/{part}"))

    def _versions(self) -> list[int]:
        """Versions that have a manifest file, the last first."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/manifests"))]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), reverse=True)

    def _file(self, version: int):
        return self._path(f"{self.path}/manifests/{version:012d}.json")

    def _read(self, version: int) -> list[dict] | None:
        """A manifest's shards, one line each, or None if its end is missing."""
        stream = self._fs.open(self._file(version))
        try:
            lines = self._io.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()
        return [json.loads(x) for x in lines[:-1]] if lines[-1] == END else None

    def version(self) -> int:
        """The last committed version; 0 for a new store."""
        return next((v for v in self._versions() if self._read(v) is not None), 0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """The live shards of a version: name, rows, bytes, tier and the version that made them."""
        version = self.version() if version is None else version
        return (self._read(version) or []) if version else []

    def commit(self, shards: list[dict], after: int) -> int:
        """Version ``after`` + 1, or ``Conflict`` if it is there already."""
        final = self._file(after + 1)
        try:
            out = self._fs.create(final, False)  # fails if the file is there
        except Exception as error:
            if self._fs.exists(final):
                age = time.time() - self._fs.getFileStatus(final).getModificationTime() / 1000
                if age > STALE and self._read(after + 1) is None:
                    self._fs.delete(final, False)
                raise Conflict(f"version {after + 1} is taken") from error
            raise
        try:
            out.write("\n".join([*map(json.dumps, shards), END]).encode())
        finally:
            out.close()
        return after + 1

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fan)) + 1) if size >= self.smallest else 0

    def _write(self, rows: DataFrame, made: int, shards: int) -> list[dict]:
        """``rows`` as so many immutable shards, each a folder with one file, and their manifest entries."""
        name = free_name("shard", rows.columns)
        # in turn, not by a key: a hot value cannot fill one shard; a task writes one shard, or as many as it takes to keep tasks few
        tasks = min(shards, MOST_TASKS)
        each = -(-shards // tasks)
        dealt = rows.repartition(tasks)
        turn = F.monotonically_increasing_id() % each if each > 1 else F.lit(0)
        return self._put(dealt.withColumn(name, (F.spark_partition_id() * each + turn).cast("int")), name, made)

    def _put(self, dealt: DataFrame, name: str, made: int) -> list[dict]:
        """Rows that know their shard, whose rows are in one task, as shards."""
        batch = uuid.uuid4().hex
        folder = f"{self.path}/shards/{batch}"
        size = F.coalesce(F.octet_length("text"), F.lit(0)) if "text" in dealt.columns else F.lit(0)
        dealt.write.option("maxRecordsPerFile", 0).partitionBy(name).parquet(folder)
        written = self.spark.read.schema(dealt.schema).parquet(folder)  # an empty arrival has no file to tell it
        counts = written.groupBy(name).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()  # one row for each shard
        return [{"name": f"{batch}/{name}={r[0]}", "rows": r[1], "bytes": r[2] or 0, "tier": self.tier(r[2] or 0), "made": made} for r in sorted(counts)]

    def append(self, arrivals: DataFrame, size: int | None = None) -> int:
        """A new version with the arrivals as one small shard, or several if they exceed the target; ``size`` is their bytes of text, if known."""
        after = self.version()
        if size is None:
            size = (arrivals.agg(F.sum(F.octet_length("text"))).first()[0] or 0) if "text" in arrivals.columns else 0
        made = self._write(arrivals, after + 1, max(1, math.ceil(size / self.target)))
        return self.commit(self.manifest(after) + made, after)

    def read(self, shards: list[dict], label: str | None = None) -> DataFrame:
        """The rows of some shards, with the shard's name as ``label`` if that is given."""
        paths = [f"{self.path}/shards/{s['name']}" for s in shards]
        rows = self.spark.read.parquet(*paths)
        if label is None:
            return rows
        return rows.withColumn(label, F.regexp_extract(F.input_file_name(), r"shards/([0-9a-f]+/[^/]+)/", 1))

    def runs(self, live: list[dict]) -> list[tuple[list[dict], int]]:
        """What a compaction does: shards, and into how many of about the target they go.

        A shard over the target by half is split (in turn at least halves its rows, so
        this ends).  Of a tier with ``fan`` shards or more below three quarters of the
        target, all are merged, but for the newest where shards of about the target
        would not come out.
        """
        out = [([s], math.ceil(s["bytes"] / self.target)) for s in live if s["bytes"] > self.target * 3 // 2 and s["rows"] > 1]
        tiers: dict[int, list[dict]] = {}
        for s in live:
            if s["bytes"] < self.target * 3 // 4:
                tiers.setdefault(s["tier"], []).append(s)
        for t in sorted(tiers):
            if len(tiers[t]) >= self.fan:
                run = sorted(tiers[t], key=lambda s: (s["made"], s["name"]))
                while self.target * 5 // 4 < (total := sum(s["bytes"] for s in run)) < self.target * 3 // 2:
                    run.pop()  # too much for one shard and too little for two: the newest wait
                out.append((run, max(1, round(total / self.target))))
        return out

    def compact(self) -> int | None:
        """Splits all shards over the target and merges all full tiers in one job; the new version, or None if there are neither."""
        after = self.version()
        live = self.manifest(after)
        runs = self.runs(live)
        if not runs:
            return None
        label = free_name("name", columns := self.read(runs[0][0][:1]).columns)
        table, at = [], 0
        for run, many in runs:
            table += [(s["name"], at, many) for s in run]
            at += many
        first, many = free_name("first", columns), free_name("many", columns)
        plan = self.spark.createDataFrame(table, f"{label} string, {first} int, {many} int")
        rows = self.read([s for run, _ in runs for s in run], label).join(plan, label)
        name = free_name("shard", columns)
        # rows go in turn to the shards of their run, and each shard to one task
        dealt = rows.withColumn(name, (F.col(first) + F.monotonically_increasing_id() % F.col(many)).cast("int")).drop(label, first, many)
        merged = self._put(dealt.repartition(min(at, MOST_TASKS), self._spread(name, min(at, MOST_TASKS))), name, after + 1)
        gone = {s["name"] for run, _ in runs for s in run}
        return self.commit([s for s in live if s["name"] not in gone] + merged, after)

    def _spread(self, name: str, tasks: int) -> Column:
        """Keys that hash to as many different tasks as there are, so that no two shards meet in one task while others idle."""
        if tasks > MOST_KEYS:
            return F.col(name)
        keys = self.spark.range(tasks * 20).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
        found = {r["p"]: r["id"] for r in keys}
        return F.element_at(F.array(*(F.lit(found.get(p, p)).cast("int") for p in range(tasks))), F.col(name) % tasks + 1)

    def settle(self) -> int:
        """Compacts until no tier is full and no shard too large; the last version."""
        while self.compact() is not None:
            pass
        return self.version()

    def vacuum(self, keep: int = 1, abandoned: float = ABANDONED) -> int:
        """Deletes shards that a version before the last ``keep`` ones named and none of these does, with those versions; how many shards went.

        Shards that no version names may be another writer's, who has not committed
        yet, so they go only when they are older than ``abandoned`` seconds.
        """
        versions = [v for v in self._versions() if self._read(v) is not None]
        named = {s["name"] for v in versions[:keep] for s in self._read(v)}
        was = {s["name"] for v in versions[keep:] for s in self._read(v)}
        gone = 0
        for name in sorted(was - named):
            gone += self._fs.delete(self._path(f"{self.path}/shards/{name}"), True)
        for v in versions[keep:]:
            self._fs.delete(self._file(v), False)
        for batch in self._fs.listStatus(self._path(f"{self.path}/shards")):
            parts = [p for p in self._fs.listStatus(batch.getPath()) if p.isDirectory()]
            for part in parts:
                old = time.time() - part.getModificationTime() / 1000 > abandoned
                if old and f"{batch.getPath().getName()}/{part.getPath().getName()}" not in named:
                    gone += self._fs.delete(part.getPath(), True)
        return gone


def shard(docs: DataFrame, path: str, arrivals: int = 6, **sizes) -> DataFrame:
    """``docs`` arrive as small shards in so many versions, each of which is compacted before the next.

    Small shards have a sixteenth of the target whatever the corpus, so merging
    sets in at every size; all of them are dealt out in one write, and an arrival
    names its share of them.  Texts are read once for their bytes and once to be
    written.  Returns doc_id, source, n_bytes and the number (from 0) and the bytes of
    the live shard that each row ended in.
    """
    spark = docs.sparkSession
    store = Store(spark, path, **sizes)
    text = "text" if "text" in docs.columns else None
    bytes_of = F.coalesce(F.octet_length(text), F.lit(0)) if text else F.lit(0)
    total = docs.agg(F.sum(bytes_of.cast("long"))).first()[0] or 0
    small = store._write(docs, 1, max(1, math.ceil(total * SHARE / store.target)))
    for k in range(arrivals):
        after = store.version()
        come = [s | {"made": after + 1} for s in small[k * len(small) // arrivals : (k + 1) * len(small) // arrivals]]
        store.commit(store.manifest(after) + come, after)
        store.settle()
        store.vacuum()  # what a merge replaced goes before the next arrival
    live = store.manifest()
    doc_id, n_bytes = F.col("doc_id").cast("long").alias("doc_id"), bytes_of.cast("long").alias("n_bytes")
    source = (F.col("source") if "source" in docs.columns else F.lit(None).cast("string")).alias("source")
    if not live:
        return docs.limit(0).select(doc_id, source, n_bytes, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("shard_bytes"))
    # the manifest is a table of its own, which the planner broadcasts while it is small
    table = spark.createDataFrame([(s["name"], i, s["bytes"]) for i, s in enumerate(live)], "name string, shard int, shard_bytes long")
    label = free_name("name", docs.columns)
    rows = store.read(live, label).select(F.col(label).alias("name"), doc_id, source, n_bytes)
    return rows.join(table, "name").select("doc_id", "source", "n_bytes", "shard", "shard_bytes")
