"""A store of tables with a version, and the chain of migrations that leads to it.

Tables are never changed in place.  A migration writes the tables that it changes
to folders of its version, and a small file that names the folder of every table is
created last, under the version's number: with it the version is there as a whole,
without it nothing has happened.  A run that broke off is resumed by running it
again: folders of a version that was not committed are written anew.  Of two that
run at once one creates the file, and the other finds it.  A store of a newer
build is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.relations import latest
from leafmill.sources import shared

Tables = dict[str, DataFrame]
#: From the tables of the version before, by name, to those that a version changes or adds.
Migration = Callable[[Tables], Tables]


class SchemaFromTheFuture(RuntimeError):
    """A newer build wrote the store."""


class Store:
    """The tables under a folder, as of the newest version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int | None:
        """The newest committed version; null where there is no store yet."""
        found = [int(n) for n in shared.names(self.spark, f"{self.root}/versions") if n.isdigit()]
        return max(found, default=None)

    def _folders(self, version: int) -> dict[str, str]:
        # one small file, read by Spark, so that any store of files will do
        line = self.spark.read.text(f"{self.root}/versions/{version}", wholetext=True).first()[0]
        return json.loads(line)

    def tables(self, version: int | None = None) -> Tables:
        """All tables as of a version, the newest by default; older versions stay readable."""
        version = self.version() if version is None else version
        return {} if version is None else {name: self.spark.read.parquet(f"{self.root}/{path}") for name, path in self._folders(version).items()}

    def commit(self, version: int, changed: Tables) -> bool:
        """Writes the changed tables and then the version; false if another writer committed it meanwhile."""
        before = self.version()
        folders = {} if before is None else self._folders(before)
        for name, table in changed.items():
            folders[name] = f"tables/{name}/{version}"
            table.write.mode("overwrite").parquet(f"{self.root}/{folders[name]}")
        return shared.create(self.spark, f"{self.root}/versions/{version}", json.dumps(folders, sort_keys=True))

    def migrate(self, chain: list[tuple[int, Migration]]) -> int:
        """Runs what is newer than the store, one version after another; returns the version reached."""
        target = max(v for v, _ in chain)
        current = -1 if (v := self.version()) is None else v
        if current > target:
            raise SchemaFromTheFuture(f"schema version {current}, but this build knows {target}")
        for version, change in sorted(chain, key=lambda x: x[0]):
            if version > current:
                self.commit(version, change(self.tables()))
        return self.version()

    def vacuum(self) -> None:
        """Deletes tables that neither the newest version nor an unfinished later one names."""
        version = self.version()
        used = set(self._folders(version).values())
        for name in shared.names(self.spark, f"{self.root}/tables"):
            for n in shared.names(self.spark, f"{self.root}/tables/{name}"):
                if f"tables/{name}/{n}" not in used and int(n) <= version:
                    shared.delete(self.spark, f"{self.root}/tables/{name}/{n}")


def identify(tables: Tables) -> Tables:
    """Version 1: files are known by the hash of their normal path, of which there is one; the newest row stays, pinned if any was."""
    hashed = tables["files"].withColumn("path_hash", F.sha2(F.replace("path", F.lit("\\"), F.lit("/")), 256))
    pinned = hashed.groupBy("path_hash").agg(F.max(F.coalesce("pinned", F.lit(False))).alias("pinned"))
    newest = latest(hashed.drop("pinned"), ["path_hash"], ["last_opened", "id"])
    return {"files": newest.join(pinned, "path_hash")}


def state_apart(tables: Tables) -> Tables:
    """Version 2: reading states are a table of their own with defaults and checks; states without a file go, as a cascade would have it."""
    files = tables["files"]
    state = tables["openings"].join(files.select("id"), F.col("file_id") == F.col("id"), "left_semi")
    state = latest(state, ["file_id"], ["at", "seq"])
    sound = F.col("rotation").between(0, 3)
    state = state.select("file_id", F.greatest("page", F.lit(0)).alias("page"), F.coalesce("zoom", F.lit(1.0)).alias("zoom"), F.when(sound, F.col("rotation")).otherwise(0).alias("rotation"), F.col("at").alias("updated_at"))
    return {"reading_state": state, "files": files.drop("note")}


#: Version 0 is a store as first made; each of the others is run once.
CHAIN: list[tuple[int, Migration]] = [(1, identify), (2, state_apart)]
