"""Streaming rules over several micro-batches against their batch operators."""

from pyspark.sql import functions as F

from leafmill import streaming
from leafmill.operators import schedule


def replay(spark, tmp_path, rows, schema, build, name, files=3, mode="append"):
    """Rows as files that arrive one in each micro-batch."""
    folder = tmp_path / name
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / f"part{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_gate(spark, tmp_path):
    rows = [(u, i * 3 + u, (i * 5 + u) % 7, i % 4 == 0) for i in range(30) for u in range(3)]
    schema = "user_id long, event_id long, generation long, exempt boolean"
    got = replay(spark, tmp_path, rows, schema, streaming.gated, "gate").select("event_id", "epoch", "stale").collect()
    batch = schedule.gated(spark.createDataFrame(rows, schema), "user_id", "generation", ["event_id"], F.col("exempt")).select("event_id", "epoch", "stale").collect()
    assert sorted(got) == sorted(batch)


def test_lru(spark, tmp_path):
    rows = [(1, i, f"k{i * 7 % 5}", 40 + i % 3) for i in range(45)]
    schema = "cache long, seq long, key string, bytes long"
    got = replay(spark, tmp_path, rows, schema, lambda s: streaming.lru(s, 150), "lru").collect()
    batch = schedule.lru(spark.createDataFrame(rows, schema), "cache", 150).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in batch)


def test_debounce_and_strikes(spark, tmp_path):
    rows = [(1, 0, 1), (1, 1, 2), (1, 100, 3), (1, 10_000, 4)]
    timed = lambda s: s.withColumn("ts", F.timestamp_seconds("t"))
    schema = "k long, t long, v long"
    got = replay(spark, tmp_path, rows, schema, lambda s: streaming.debounced(timed(s), "k", "ts", "v", "10 seconds", "5 seconds"), "bursts", files=4)
    assert sorted(r["v"] for r in got.collect()) == [2, 3]
    died = [(1,), (2,), (1,)]
    struck = replay(spark, tmp_path, died, "document long", streaming.strikes, "strikes", mode="complete")
    assert {r["document"]: r["quarantined"] for r in struck.collect()} == {1: True, 2: False}
