"""Size-tiered compaction at every corpus size against a plain model of its tiers."""

import math

import pytest
from conftest_llm import prose

from leafmill.llm import sharding

TARGET, SMALLEST, FAN = 64_000, 1_000, 4


def tier(size):
    return max(0, math.floor(math.log(size / SMALLEST, FAN)) + 1) if size >= SMALLEST else 0


@pytest.mark.parametrize("corpus", [0.4, 2, 7])
def test_merges_happen_at_every_size(spark, tmp_path, monkeypatch, corpus):
    rows = [(i, prose(i, 60), "hot" if i % 3 else "cold") for i in range(int(corpus * TARGET / 330))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    done = []
    real = sharding.Store.runs

    def watched(self, live):
        out = real(self, live)
        # the model: every tier that is full below three quarters of the target, and nothing else but what is too large
        by = {}
        for s in live:
            if s["bytes"] < TARGET * 3 // 4:
                by.setdefault(tier(s["bytes"]), []).append((s["made"], s["name"], s["bytes"]))
        full = [sorted(v) for v in by.values() if len(v) >= FAN]
        for v in full:
            while TARGET * 1.25 < sum(x[2] for x in v) < TARGET * 1.5:
                v.pop()
        want = [sorted(x[1] for x in v) for v in full] + [[s["name"]] for s in live if s["bytes"] > TARGET * 3 // 2]
        assert sorted(sorted(s["name"] for s in run) for run, _ in out) == sorted(want)
        done.extend(run for run, _ in out if len(run) > 1)
        return out

    monkeypatch.setattr(sharding.Store, "runs", watched)
    got = sharding.shard(docs, str(tmp_path / "s"), target=TARGET, smallest=SMALLEST, fan=FAN).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    assert done, "nothing was merged"
    sizes = {r["shard"]: r["shard_bytes"] for r in got}
    assert sum(sizes.values()) == sum(len(t.encode()) for _, t, _ in rows)
    settled = [b for b in sizes.values() if b >= TARGET * 3 // 4]
    assert all(b <= TARGET * 1.25 for b in settled) and (corpus < 2 or settled)
    left = [tier(b) for b in sizes.values() if b < TARGET * 3 // 4]
    assert all(left.count(t) < FAN for t in left)


def test_few_tasks_write_many_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_TASKS", 3)
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(400)], "doc_id long, text string")
    store = sharding.Store(spark, str(tmp_path / "s"), target=8_000, smallest=500)
    store.append(docs)
    live = store.manifest()
    assert len(live) > 6 and sum(s["rows"] for s in live) == 400 and max(s["bytes"] for s in live) < 12_000
    assert all(len(list((tmp_path / "s" / "shards" / s["name"]).glob("*.parquet"))) == 1 for s in live)
