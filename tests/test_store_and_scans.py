"""Migrations, outlines, selection, running sums, line scans and the log sink against plain versions."""

import itertools
import json
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.operators import containers, layout, outline, prefix, selection, stats, text
from leafmill.sources import logs, migrations, shared

FILES = [(1, "lib\\a", 5, True), (2, "lib/a", 9, None), (3, "lib\\b", None, False)]


def first_version(spark, root):
    store = migrations.Store(spark, str(root))
    files = spark.createDataFrame(FILES, "id long, path string, last_opened long, pinned boolean").withColumn("note", F.lit("x"))
    openings = spark.createDataFrame([(2, 1, 10, 3, None, 7), (2, 2, 11, -4, 2.5, 3), (9, 1, 1, 1, 1.0, 1)], "file_id long, seq long, at long, page int, zoom double, rotation int")
    assert store.commit(0, {"files": files, "openings": openings})
    return store


def test_migrations(spark, tmp_path):
    store = first_version(spark, tmp_path)
    assert store.migrate(migrations.CHAIN) == 2
    now = store.tables()
    assert sorted((r["id"], r["pinned"]) for r in now["files"].collect()) == [(2, True), (3, False)] and "note" not in now["files"].columns
    assert [tuple(r) for r in now["reading_state"].collect()] == [(2, 0, 2.5, 3, 11)]
    assert store.tables(0)["files"].count() == 3  # older versions stay readable
    assert store.migrate(migrations.CHAIN) == 2  # nothing to do
    with pytest.raises(migrations.SchemaFromTheFuture):
        store.migrate(migrations.CHAIN[:1])
    store.vacuum()
    assert shared.names(spark, str(tmp_path / "tables" / "files")) == ["2"] and store.tables()["files"].count() == 2


def test_migration_that_broke_off_is_resumed(spark, tmp_path):
    store = first_version(spark, tmp_path)

    def broken(tables):
        (tables["files"]).write.mode("overwrite").parquet(str(tmp_path / "tables" / "reading_state" / "2"))  # a table of the version is there
        raise OSError("lost")

    with pytest.raises(OSError):
        store.migrate([migrations.CHAIN[0], (2, broken)])
    assert store.version() == 1 and store.tables()["files"].count() == 2
    assert store.migrate(migrations.CHAIN) == 2
    assert store.tables()["reading_state"].columns == ["file_id", "page", "zoom", "rotation", "updated_at"]


def test_two_writers_of_one_version(spark, tmp_path):
    store = first_version(spark, tmp_path)
    shared.create(spark, str(tmp_path / "versions" / "1"), json.dumps({"files": "tables/files/0"}))
    assert not store.commit(1, {})
    assert migrations.Store(spark, str(tmp_path / "none")).version() is None


def preorder(links, levels, most):
    below = {}
    for doc, node, parent, seq in links:
        below.setdefault((doc, parent), []).append((seq, node))
    out = []

    def walk(doc, parent, seen, rows):
        for _, node in sorted(below.get((doc, parent), [])):
            if node not in seen and len(seen) < levels:
                rows.append((len(seen), node))
                walk(doc, node, [*seen, node], rows)

    for doc in {d for d, *_ in links}:
        rows = []
        walk(doc, None, [], rows)
        out += [(doc, k, depth, node) for k, (depth, node) in enumerate(rows[:most])]
    return sorted(out)


def test_outline_walk(spark):
    r = random.Random(1)
    links = [(d, i, None if i < 3 else r.randrange(i), r.randrange(5)) for d in range(3) for i in range(60)]
    links += [(0, 5, 40, 1), (0, 0, 59, 0), (1, 200, 201, 0), (1, 201, 200, 0), *((2, 300 + i, 299 + i if i else None, 0) for i in range(40))]
    rows = spark.createDataFrame(links, "doc long, id long, parent long, seq long")
    for levels, most in ((32, 20_000), (6, 17)):
        got = sorted(tuple(x) for x in outline.walked(rows, levels, most).select("doc", "nth", "depth", "id").collect())
        assert got == preorder(links, levels, most)
    assert outline.walked(rows.limit(0)).count() == 0


def first_nodes(links, levels, most):
    """Depth first, no further than asked for; of all paths no list is made."""
    below = {}
    for doc, node, parent, seq in links:
        below.setdefault((doc, parent), []).append((seq, node))

    def walk(doc, parent, seen):
        for _, node in sorted(below.get((doc, parent), [])):
            if node not in seen and len(seen) < levels:
                yield len(seen), node
                yield from walk(doc, node, [*seen, node])

    return sorted((doc, k, *row) for doc in {d for d, *_ in links} for k, row in enumerate(itertools.islice(walk(doc, None, []), most)))


def test_outline_walk_ends_where_paths_multiply(spark):
    """Each level has three times the paths of the one above, also where a link is there three times; a walk that makes them all before it cuts them fills the disk."""
    links = [(d, 3 * level + k, 3 * level - 3 + j if level else None, k * (1 - 2 * d)) for d in range(2) for level in range(24) for k in range(3) for j in range(3 if level else 1)]
    links += [(0, 60, 71, 0), (2, 5, None, 0), (2, 6, 5, 0)]
    chain = [(3, level, level - 1 if level else None, 0) for level in range(24) for _ in range(3)]
    got = sorted(tuple(x) for x in outline.walked(spark.createDataFrame(links + chain, "doc long, id long, parent long, seq long"), 24, 500).collect())
    assert got[:-500] == first_nodes(links, 24, 500) and len(got) == 1502
    assert got[-500:] == [(3, k, depth, depth) for k, depth in enumerate([depth for depth in range(6) for _ in range(3 ** (depth + 1))][:500])]


def test_outline_walk_by_paths(spark):
    """Links that repeat, lead back many times or have no order, id or document, against all paths sorted."""
    r = random.Random(6)
    links = [(d, r.choice([*range(1, 9), None]), r.choice([None, *range(9)]) if i > 2 else None, r.choice([0, 1, 2, None])) for d in (0, 1, None) for i in range(36)]
    links += [(3, 1, None, 0), *((3, 1, 1, k) for k in range(60)), (3, 2, 1, 70), (3, 2, 1, 70), (3, 4, 2, 0), (3, 5, 1, 80)] + r.sample(links, 12)
    none_first = lambda path: [(x is not None, x or 0) for step in path for x in step]
    rows = spark.createDataFrame(links, "doc long, id long, parent long, seq long")
    for levels, most in ((4, 10**6), (4, 40), (5, 9), (1, 3)):
        want = []
        for doc in (0, 1, 3, None):
            level, every = [((s, i),) for d, i, p, s in links if d == doc and p is None], []
            for _ in range(levels):
                every += level
                level = [(*path, (s, i)) for path in level for d, i, p, s in links if d is not None and d == doc and p is not None and p == path[-1][1] and i is not None and all(i != x for _, x in path)]
            want += [(doc, k, len(path) - 1, path[-1][1]) for k, path in enumerate(sorted(every, key=none_first)[:most])]
        assert Counter(tuple(x) for x in outline.walked(rows, levels, most).collect()) == Counter(want), (levels, most)


def test_selection(spark, monkeypatch):
    r = random.Random(2)
    groups = {
        "even": [r.random() for _ in range(700)],
        "scales": [r.choice([-1, 1]) * 10.0 ** r.uniform(-200, 300) for _ in range(700)],
        "ties": [float(r.randrange(3)) for _ in range(700)],
        "one value": [7.0] * 700,
        "few": [3.0, 1.0, 2.0],
        "ends": [math.inf, -math.inf, *range(300), *[1e308, -1e308] * 100],
        None: [float(k) for k in range(600)],
    }
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    monkeypatch.setattr(selection, "CUTS", 256)
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {x["k"]: x for x in selection.ranked(rows, ["k"], "v", shares, few=20).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs = sorted(map(float, vs))
        assert (got[k]["n"], got[k]["least"], got[k]["greatest"]) == (len(vs), vs[0], vs[-1])
        for name, share in shares.items():
            assert got[k][name] == vs[max(1, math.ceil(len(vs) * share)) - 1], (k, name)
    assert selection.ranked(rows.limit(0), ["k"], "v", shares).count() == 0
    assert stats.statistics(rows.where("k = 'few'"), ["k"], "v").columns == ["k", "n", "min_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms", "mean_ms"]


def test_running_sums(spark):
    r = random.Random(3)
    rows = [(k, p, r.randrange(9) if r.random() < 0.9 else None) for k in ("a", None, "b") for p in r.sample(range(500), 200)] + [("a", 700, 1), ("a", 700, 2)]
    got = prefix.before(spark.createDataFrame(rows, "k string, p long, v long"), ["k"], "p", {"sum": F.col("v"), "nth": F.lit(1)}, span=7).collect()
    assert len(got) == len(rows)
    for x in got:
        earlier = [v or 0 for k, p, v in rows if k == x["k"] and p < x["p"]]
        assert (x["sum"], x["nth"]) == (sum(earlier), len(earlier))


@pytest.mark.parametrize("mode", ["horizontal", "dual_cover"])
def test_layout_over_many_ranges(spark, monkeypatch, mode):
    """The same places whether or not a document is cut into ranges."""
    pages = spark.createDataFrame([(d, p, 500.0 + p % 7, 600.0 + p % 5) for d in range(2) for p in range(101)], "doc long, page int, width double, height double")
    whole = sorted(tuple(r) for r in layout.layout(pages, "doc", mode, 1000.0).collect())
    monkeypatch.setattr(prefix.before, "__defaults__", (4, 2))
    assert sorted(tuple(r) for r in layout.layout(pages, "doc", mode, 1000.0).collect()) == whole


def test_lines_of_a_long_page(spark):
    """A page of a million characters takes linear time; the fold agrees on short pages."""
    box = "c string, left double, bottom double, right double, top double"
    r = random.Random(4)
    short = [(d, p, r.choice(["a", "b", " ", "\n", "\t", None]), left := r.choice([0.0, 5.0, 300.0]), bottom := float(r.randrange(12)), left + 10, bottom + r.choice([0.0, 6.0, 10.0])) for d in range(40) for p in range(25)]
    rows = spark.createDataFrame(short, f"d long, p long, {box}")
    got = sorted((x["d"], x["line"], x["text"], x["left"], x["bottom"], x["right"], x["top"]) for x in text.placed_lines(rows, ["d"], "p").collect())
    chars = F.transform(F.sort_array(F.collect_list(F.struct("p", F.struct("c", "left", "bottom", "right", "top").alias("x")))), lambda v: v["x"])
    folded = rows.groupBy("d").agg(text.lines(chars).alias("lines")).select("d", F.posexplode("lines").alias("line", "x")).select("d", "line", "x.*")
    blank = lambda t: not t.strip(text.BLANK)
    want = [tuple(x) for x in folded.collect() if not blank(x["text"])]  # the fold trims blanks only
    assert sorted(x[:1] + x[2:] for x in got) == sorted(x[:1] + x[2:] for x in want)
    assert all(x[1] == y[1] + 1 for y, x in zip(got, got[1:], strict=False) if x[0] == y[0])
    n = 1_000_000
    long = spark.range(n).select(F.lit(1).alias("d"), F.col("id").alias("p"), F.when(F.col("id") % 100 == 99, "\n").otherwise("x").alias("c"), (F.col("id") % 100 * 5.0).alias("left"), F.floor(F.col("id") / 100).cast("double").alias("bottom"))
    long = long.withColumn("right", F.col("left") + 5).withColumn("top", F.col("bottom") + 10)
    began = time.perf_counter()
    assert text.placed_lines(long, ["d"], "p").agg(F.count("*"), F.max("line"), F.min(F.length("text"))).first()[:] == (n // 100, n // 100 - 1, 99)
    assert time.perf_counter() - began < 120


def test_log_sink_leaves_each_row_once(spark, tmp_path):
    """A stream that broke off in mid-batch and was started again, days that go, rows without a time."""
    schema = "n long, ts timestamp"
    from datetime import datetime

    sink = logs.LogSink(spark, str(tmp_path / "log"), StructType.fromDDL(schema), days=2)
    assert sink.read().count() == 0
    for k in range(3):
        rows = [(10 * k + i, datetime(2024, 1, 1 + k, 1, 2, 3, 456789 + i)) for i in range(4)] + [(100 + k, None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 2:  # the batch's folder is there, but incomplete
            (tmp_path / "log" / "batches" / f"batch={2:012d}" / "day=2024-01-03").mkdir(parents=True)
            (tmp_path / "log" / "batches" / f"batch={2:012d}" / "day=2024-01-03" / "part-0.json").write_text('{"n": 999}\n')
            assert sink.read().where("n = 999").count() == 0
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sink.stream(stream).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    sink.write(spark.createDataFrame([(5, None)], schema), 1)  # a batch that comes again
    got = sorted(r["n"] for r in sink.read().collect())
    assert got == [10, 11, 12, 13, 20, 21, 22, 23, 100, 101, 102]
    assert sink.read().where("n = 21").first()["ts"] == datetime(2024, 1, 3, 1, 2, 3, 456790)
    assert sink.rotate() == 1 and sink.rotate() == 0 and sink.read().count() == 11


def test_page_sizes_of_containers(spark, tmp_path):
    """Both scans agree, gaps fall back, errors have kinds, and the fast scan reads no bodies."""
    page = "<< /MediaBox [0 0 {} {}] >>"
    rows = [
        ("a", 0, False, "612 x 792;100.5 x 20", [page.format(612, 792), page.format(100.5, 20)], 2),
        ("b", 0, False, "612 x 792;broken;0 x 5", [page.format(612, 792), page.format(7, 8), "none"], 3),
        ("c", 0, False, "1 x 2", [page.format(1, 2), page.format(3, 4)], 2),
        *((f"e{k}", k, k % 2 == 0, None, None, 0) for k in range(1, 9)),
        ("p", 4, False, None, None, 0),
    ]
    spark.createDataFrame(rows, "doc string, code int, password boolean, directory string, bodies array<string>, n_bodies int").write.parquet(str(tmp_path / "c"))
    docs = spark.read.parquet(str(tmp_path / "c"))
    got = {(r["doc"], r["page"]): (r["width"], r["height"], r["error"]) for r in containers.page_sizes(docs).collect()}
    assert got[("b", 1)] == (7.0, 8.0, None) and got[("b", 2)] == (None, None, "Corrupt") and got[("c", 1)] == (3.0, 4.0, None) and got[("a", 1)] == (100.5, 20.0, None)
    assert [got[(d, None)][2] for d in ("e1", "e2", "e3", "e4", "p", "e5", "e6", "e7")] == ["Corrupt", "FileUnavailable", "Corrupt", "PasswordWrong", "PasswordRequired", "Corrupt", "Corrupt", "Corrupt"]
    slow = {(r["doc"], r["page"]): r["size"] for r in containers.slow_sizes(docs).collect()}
    assert all(slow[(r["doc"], r["page"])] == r["size"] for r in containers.fast_sizes(docs).where("size IS NOT NULL").collect())
    plan = containers.fast_sizes(docs.where("doc = 'a'"))._jdf.queryExecution().executedPlan().toString()
    assert "bodies" not in plan and "EqualTo(code,0)" in plan and "EqualTo(doc,a)" in plan
