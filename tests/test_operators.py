"""Literal cases of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from leafmill import functions as fn
from leafmill import sources
from leafmill.operators import display, layout, motion, outline, relations, schedule, stats, supervise, text, tiles, uri


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scale_and_pages(spark):
    lit = lambda x: F.lit(float(x))
    got = one(spark, fn.scale_key(lit(1)), fn.scale_key(lit(1.0000001)), fn.scale_key(lit(3)), fn.page_pixels(lit(612), lit(1.5)), fn.page_pixels(lit(792), lit(1.5)))
    assert tuple(got) == (1000, 1000, 3000, 918, 1188)
    assert tuple(one(spark, fn.zoom_scroll(lit(200), lit(100), lit(2)), fn.fit_scale(lit(1224), lit(1224)), fn.quarter(F.lit(-1)), fn.quarter(F.lit(5)))) == (500.0, 1.0, 3, 1)


def test_numbers(spark):
    values = [("512", 512), ("plenty", None), (" 512 ", 512), ("1.5", None), ("-3", None), ("99999999999999999999", None)]
    assert [one(spark, fn.tolerant_int(F.lit(v)))[0] for v, _ in values] == [x for _, x in values]
    assert [one(spark, fn.pool_size(F.lit(c)))[0] for c in (1, 2, 4, 8, 16, 64)] == [2, 2, 2, 4, 8, 8]
    assert one(spark, fn.backoff_ms(F.lit(20)))[0] == 30000
    budgets = [("99999", "512", 2048), ("x", "512", 512), (None, None, 2048), ("64", None, 64)]
    assert [one(spark, fn.cache_budget_mb(F.lit(a).cast("string"), F.lit(b).cast("string")))[0] for a, b, _ in budgets] == [x for *_, x in budgets]


def test_rectangles(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    rects = [((0, 0, 1, 1), True), ((0, 0, 0, 1), False), ((0, 1, 1, 0), False), ((0, 0, math.nan, 1), False), ((0, 0, math.inf, 1), False)]
    assert [one(spark, fn.valid_rect(*lit(*r)))[0] for r, _ in rects] == [ok for _, ok in rects]


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(1, 9)] + [("a", math.nan), ("b", 3.0)], "k string, v double")
    got = {r["k"]: r for r in stats.statistics(rows, ["k"], "v").collect()}
    assert (got["a"]["n"], got["a"]["p50_ms"], got["a"]["p95_ms"], got["a"]["p99_ms"], got["a"]["mean_ms"]) == (8, 4.0, 8.0, 8.0, 4.5)
    assert got["b"]["min_ms"] == got["b"]["max_ms"] == 3.0
    verdicts = one(spark, stats.verdict(F.lit(5.0), F.lit(5.0)), stats.verdict(F.lit(5.0), F.lit(5.0), True), stats.verdict(F.lit(5.0), F.lit(None).cast("double")), stats.hit_rate(F.lit(0), F.lit(0)))
    assert tuple(verdicts) == ("PASS", "FAIL", None, None)


def sheet(spark, sizes):
    return spark.createDataFrame([("d", i, float(w), float(h)) for i, (w, h) in enumerate(sizes)], "doc string, page int, width double, height double")


def test_layouts(spark):
    three = layout.layout(sheet(spark, [(612, 792)] * 3), "doc", "single", 1000.0)
    rows = three.orderBy("page").collect()
    assert [r["y"] for r in rows] == [24.0, 832.0, 1640.0] and rows[0]["x"] == (1000 - 612) / 2
    assert layout.extent(three, "doc", "single", 1000.0).first()["height"] == 24 + 792 * 3 + 16 * 2 + 24
    cover = layout.layout(sheet(spark, [(612, 792)] * 5), "doc", "dual_cover", 1000.0)
    assert [r["row"] for r in cover.orderBy("page").collect()] == [0, 1, 1, 2, 2]
    strip = layout.layout(sheet(spark, [(612, 792), (612, 600)]), "doc", "horizontal", 1000.0).orderBy("page").collect()
    assert [r["y"] for r in strip] == [24.0, 120.0] and strip[1]["x"] == 24 + 612 + 16


@pytest.mark.parametrize(("margin", "pages"), [(0.0, [0]), (200.0, [0, 1])])
def test_visible(spark, margin, pages):
    placed = layout.layout(sheet(spark, [(612, 792)] * 100), "doc", "single", 1000.0)
    views = spark.createDataFrame([("d", 1, 0.0, 800.0)], "doc string, event_id long, top double, view_height double")
    seen = layout.visible(placed, views, "doc", margin)
    assert sorted(r["page"] for r in seen.collect()) == pages


def test_dominant(spark):
    placed = layout.layout(sheet(spark, [(612, 792)] * 10), "doc", "single", 1000.0)
    views = spark.createDataFrame([("d", 1, 782.0, 800.0)], "doc string, event_id long, top double, view_height double")
    assert layout.dominant(layout.visible(placed, views, "doc"), ["event_id"]).first()["page"] == 1


def test_tiles(spark):
    grid = {(r["col"], r["row"]): r for r in tiles.grid(sheet(spark, [(612, 792)]), F.lit(1.0)).collect()}
    assert sorted(grid) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    first, last = grid[0, 0], grid[1, 1]
    assert (first["px_w"], first["px_h"], first["left"], first["top"], first["bottom"]) == (512, 512, 0.0, 792.0, 280.0)
    assert (last["px_w"], last["px_h"], last["right"], last["bottom"]) == (100, 280, 612.0, 0.0)
    big = tiles.grid(sheet(spark, [(612, 792)]), F.lit(1.5)).select(F.sum((F.col("right") - F.col("left")) * (F.col("top") - F.col("bottom")))).first()[0]
    assert abs(big / (612 * 792) - 1) < 1e-3


def test_maps(spark):
    f = lambda *v: {k: F.lit(float(x)) for k, x in zip("abcdef", v, strict=True)}
    both = tiles.compose(f(2, 0, 0, 2, 0, 0), f(1, 0, 0, 1, 10, 0))
    assert tuple(one(spark, *tiles.applied(both, F.lit(1.0), F.lit(1.0)))) == (12.0, 2.0)
    assert one(spark, tiles.inverse(f(0, 0, 0, 1, 0, 0))["a"])[0] is None
    corners = [tuple(one(spark, *tiles.turned_point(F.lit(0.0), F.lit(0.0), F.lit(612.0), F.lit(792.0), F.lit(q)))) for q in range(4)]
    assert corners == [(0.0, 0.0), (0.0, 612.0), (612.0, 792.0), (792.0, 0.0)]


def ch(c, left, bottom, w=6.0, h=10.0):
    return (c, float(left), float(bottom), float(left + w), float(bottom + h))


@pytest.mark.parametrize(
    ("chars", "lines"),
    [
        ([ch("H", 0, 0), ch("a", 6, 0), ch("i", 12, 0)], [("Hai", 0.0, 0.0, 18.0, 10.0)]),
        ([ch("a", 0, 100), ch("b", 6, 100), ch("c", 0, 80)], ["ab", "c"]),
        ([ch("a", 300, 50), ch("b", 306, 50), ch("c", 20, 50)], ["ab", "c"]),
        ([ch("T", 0, 100), ch("y", 6, 98), ch("p", 12, 99), ch("e", 18, 100)], ["Type"]),
        ([ch("a", 0, 0), ch("\n", 6, 0), ch("b", 0, 0)], ["a", "b"]),
        ([ch(" ", 0, 0), ch(" ", 6, 0)], []),
        ([], []),
        ([ch("a", 10, 100, 6, 10), ch("g", 16, 96, 6, 14)], [("ag", 10.0, 96.0, 22.0, 110.0)]),
    ],
)
def test_lines(spark, chars, lines):
    rows = spark.createDataFrame([(chars,)], "chars array<struct<c:string,left:double,bottom:double,right:double,top:double>>")
    got = rows.select(text.lines(F.col("chars"))).first()[0]
    assert [tuple(x) if isinstance(want, tuple) else x["text"] for x, want in zip(got, lines, strict=True)] == lines


def test_search(spark):
    docs = spark.createDataFrame([(1, "a marked passage"), (2, "Café CAFE"), (3, None)], "doc long, text string")
    assert [r["doc"] for r in text.matching(docs, "text", "passage").collect()] == [1]
    gone = text.synced(docs, docs.where("doc = 1").select("doc"), docs.limit(0), "doc")
    assert text.matching(gone, "text", "passage").count() == 0
    cafe = {r["token"]: r for r in text.postings(docs.where("doc = 2"), "doc", "text").collect()}
    assert cafe["cafe"]["tf"] == 2 and cafe["cafe"]["positions"] == [0, 1]
    assert [r["hits"] for r in text.search(docs, "text", "cafe").collect()] == [1]


def run_motion(spark, samples):
    rows = spark.createDataFrame([("u", i, float(t), float(o)) for i, (t, o) in enumerate(samples)], "u string, i long, ms double, o double")
    timed = rows.withColumn("ts", F.timestamp_micros((F.col("ms") * 1000).cast("long")))
    return motion.velocity(timed, "u", "ts", "o", "i").first()["velocity"]


def test_velocity(spark):
    assert run_motion(spark, [(0, 5)]) == 0
    up = run_motion(spark, [(16 * i, 100 * i) for i in range(11)])
    assert up > 1000
    assert run_motion(spark, [(16 * i, 5000 - 100 * i) for i in range(11)]) < -40
    assert abs(run_motion(spark, [(16 * i, 100 * min(i, 10)) for i in range(41)])) <= 40
    assert run_motion(spark, [(0, 0), (0.1, 1000)]) == 0


@pytest.mark.parametrize(("visible", "speed", "pages", "want"), [([4], 0.0, 10, [5, 3]), ([4], 2000.0, 5, [3]), ([], 1000.0, 10, []), ([4], 900.0, 20, [5, 6, 3])])
def test_prefetch(spark, visible, speed, pages, want):
    rows = spark.createDataFrame([(visible, speed)], "visible array<int>, speed double")
    assert rows.select(motion.prefetch(F.col("visible"), F.col("speed"), F.lit(pages))).first()[0] == want


def test_uris(spark):
    rows = [
        ("doc://tile/7/3/0/1500/2/1/sharp?g=9&p=2", "Ok", 9, 2),
        ("http://doc.localhost/tile/7/3/0/1500/2/1/sharp", "Ok", 0, 2),
        ("doc://localhost/tile/7/3/0/1500/2/1/sharp#x", "Ok", 0, 2),
        ("doc:///tile/7/3/0/1500/2/1/sharp?p=0", "Ok", 0, 0),
        ("file:///tile/7/3/0/1500/2/1/sharp", "BadUri", 0, 2),
        ("doc://tile/7/3/0/1500/2/sharp", "BadUri", 0, 2),
        ("doc://tile/7/-1/0/1500/2/1/sharp", "BadUri", 0, 2),
        ("doc://tile/7/0x10/0/1500/2/1/sharp", "BadUri", 0, 2),
        (" doc://tile/7/3/0/1500/2/1/sharp", "BadUri", 0, 2),
        ("doc://tile/7/3/4/1500/2/1/sharp", "BadRotation", 0, 2),
        ("doc://tile/7/3/0/0/2/1/sharp", "BadScale", 0, 2),
        ("doc://tile/7/3/0/999999/2/1/sharp", "BadScale", 0, 2),
    ]
    got = uri.parsed(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, u string"), "u").orderBy("i").collect()
    assert [(r["state"], r["generation"], r["priority"]) for r in got] == [r[1:] for r in rows]
    assert len({r["tile_key"] for r in got[:4]}) == 1


def test_upserts(spark):
    log = spark.createDataFrame([("/docs/a.pdf", 1, 10, 1, False), ("/docs/a.pdf", 2, 20, 2, False), ("/docs/b.pdf", 3, 5, 1, True)], "path string, ts int, size int, id int, pinned boolean")
    got = {r["path"]: r for r in relations.touched(log, "path", ["ts", "id"], F.col("pinned")).collect()}
    assert (got["/docs/a.pdf"]["id"], got["/docs/a.pdf"]["row"]["size"], got["/docs/b.pdf"]["pinned"]) == (1, 20, True)
    assert relations.latest(log, ["path"], ["ts", "id"]).where("path = '/docs/a.pdf'").first()["size"] == 20
    files = spark.createDataFrame([(1, 5, True), (2, 9, False), (3, None, True)], "id int, last_opened int, pinned boolean")
    assert [r["id"] for r in relations.recent(files, 20).collect()] == [1, 2]


def test_store(spark, tmp_path):
    sources.create(spark, str(tmp_path))
    assert sources.version(spark, str(tmp_path)).first()["version"] == sources.VERSION
    with pytest.raises(Exception, match="newer schema version"):
        sources.version(spark, str(tmp_path), sources.VERSION - 5).collect()
    assert sources.read(spark, str(tmp_path), "files").count() == 0
    checks = {"rotation": F.col("rotation").between(0, 3)}
    rows = sources.in_memory(spark, "reading_state", [(1, 0, 0.0, 1.0, "single", 7, 0), (2, 0, 0.0, 1.0, "single", 3, 0)])
    assert [r["file_id"] for r in relations.violations(rows, checks).collect()] == [1]
    assert relations.without(rows, spark.createDataFrame([(1,)], "file_id long"), "file_id").count() == 1


def test_frames(spark, tmp_path):
    sent = spark.createDataFrame([(1, "hello"), (2, "")], "i int, m string")
    raw = b"".join(bytes(r["frame"]) for r in sources.framed(sent, "m").orderBy("i").collect())
    (tmp_path / "a.bin").write_bytes(raw + b"\x05\x00\x00\x00ab")
    got = sources.frames(sources.contents(spark, str(tmp_path), "*.bin"), "content").orderBy("nth").collect()
    assert [(r["message"] and bytes(r["message"]), r["error"]) for r in got] == [(b"hello", None), (b"", None), (None, "PeerClosed")]
    assert sources.stamps(spark, str(tmp_path)).first()["size"] == len(raw) + 6


def test_gate_and_dispatch(spark):
    rows = spark.createDataFrame([(1, 1, 9, "sharp"), (1, 2, 3, "sharp"), (1, 3, 1, "preview"), (1, 4, 9, "sharp")], "doc int, seq int, gen int, kind string")
    got = schedule.gated(rows, "doc", "gen", ["seq"], F.col("kind") == "preview").orderBy("seq").collect()
    assert [r["stale"] for r in got] == [False, True, False, False]
    queue = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 2)], "q int, seq int, priority int")
    assert [r["seq"] for r in schedule.dispatched(queue, "q", 2).where("NOT shed").orderBy("nth").collect()] == [2, 1]


def test_lru():
    cache = schedule.Lru(250)
    assert [cache.access(k, 100) for k in "abc"] == ["stored"] * 3 and list(cache.held) == ["b", "c"] and cache.evictions == 1
    cache = schedule.Lru(250)
    assert [cache.access(k, 100) for k in "abac"] == ["stored", "stored", "hit", "stored"] and list(cache.held) == ["a", "c"]
    cache = schedule.Lru(150)
    assert cache.access("a", 100) == "stored" and cache.access("b", 500) == "refused" and list(cache.held) == ["a"]
    assert cache.access("a", 120) == "stored" and cache.bytes == 120
    assert schedule.Lru(150, least=1).access("b", 500) == "stored"


def test_rings_and_workers(spark):
    claims = spark.createDataFrame([(1, 0, 1, False), (1, 1, 9, False), (1, 2, 5, False)], "ring long, seq long, generation long, free boolean")
    got = schedule.ring(claims, "ring", 2).orderBy("seq").collect()
    assert [(r["slot"], r["state"]) for r in got] == [(0, "claimed"), (1, "claimed"), (0, "reclaimed")]
    jobs = spark.createDataFrame([(1, 0, 0.0, 0, 5.0), (1, 1, 1.0, 1, 5.0), (1, 2, 2.0, 2, 5.0)], "pool long, seq long, arrival double, priority int, took double")
    assert [r["seq"] for r in schedule.workers(jobs, "pool", 1).orderBy("start").collect()] == [0, 2, 1]
    jobs = spark.createDataFrame([(1, 0, 5.0, 0, 2.0), (1, 1, 5.0, 1, 9.0), (1, 2, 6.0, 0, 1.0), (1, 3, 20.0, 0, 1.0)], jobs.schema)
    got = schedule.workers(jobs, "pool", 2).orderBy("start", "worker").collect()
    assert [(r["seq"], r["start"], r["worker"]) for r in got] == [(1, 5.0, 0), (0, 5.0, 1), (2, 7.0, 1), (3, 20.0, 1)]


def test_carried_over_batches(spark):
    """A key's state survives the end of a batch; null keys are one key."""
    rows = [(None if i % 3 == 0 else i % 3, i, "ab"[i % 2], 100) for i in range(300)]
    made = spark.createDataFrame(rows, "cache long, seq long, key string, bytes long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["seq"]: r for r in schedule.lru(made, "cache", 150).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 300 and schedule.lru(made.limit(0), "cache", 150).count() == 0
    for cache in (None, 1, 2):
        state = schedule.Lru(150)
        for c, seq, key, size in rows:
            if c == cache:
                assert (got[seq]["outcome"], got[seq]["evictions"]) == (state.access(key, size), state.evictions)


@pytest.mark.parametrize(("loads", "active", "want"), [([3, 1, 7], None, 1), ([3, 1, 2], 1, 2), ([4], 0, 0), ([2, 2, 2], None, 0)])
def test_placement(spark, loads, active, want):
    rows = spark.createDataFrame([(0, i, n, i == active) for i, n in enumerate(loads)], "pool int, worker int, load int, active boolean")
    assert supervise.place(rows, "pool").first()["worker"] == want


def test_strikes_and_failures(spark):
    deaths = spark.createDataFrame([(1,), (2,)], "w int")
    residents = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "w int, doc int")
    assert {r["doc"]: r["quarantined"] for r in supervise.strikes(deaths, residents, ["w"], "doc").collect()} == {1: True, 2: False}
    runs = spark.createDataFrame([(1, i, ok) for i, ok in enumerate([False, False, True, False])], "k int, t int, ok boolean")
    assert [r["failures"] for r in supervise.consecutive_failures(runs, "k", ["t"], ~F.col("ok")).orderBy("t").collect()] == [1, 2, 1]


def test_outline(spark):
    links = spark.createDataFrame([("a", None, 1, "A"), ("b", "a", 1, "B"), ("c", "b", 1, "C"), ("x", "y", 1, "X"), ("y", "x", 1, "Y")], "id string, parent string, seq long, title string")
    flat = outline.preorder(outline.flatten(links, 5)).collect()
    assert [(r["title"], r["depth"]) for r in flat] == [("A", 0), ("B", 1), ("C", 2)]


def test_display(spark):
    lit = lambda x: F.lit(float(x))
    for turns, want in enumerate([(10.0, 20.0, 30.0, 60.0), (20.0, 70.0, 60.0, 90.0), (70.0, 140.0, 90.0, 180.0), (140.0, 10.0, 180.0, 30.0)]):
        rect = display.turned_rect(lit(10), lit(20), lit(30), lit(60), lit(100), lit(200), F.lit(turns))
        assert tuple(one(spark, *rect)) == want
        # the whole page as one tile of its own size: corners map to corners
        w, h = (100.0, 200.0) if turns % 2 == 0 else (200.0, 100.0)
        m = display.tile_map(lit(0), lit(h), lit(w), lit(0), lit(w), lit(h), lit(100), lit(200), F.lit(turns))
        corners = [tuple(one(spark, *tiles.applied(m, lit(x), lit(y)))) for x, y in ((0, 0), (100, 200))]
        assert sorted(corners) != corners[:1] * 2 and all({0.0, s} >= {c[k] for c in corners} for k, s in ((0, w), (1, h)))
    lists = [([], True), (["push_clip", "draw", "pop_clip"], True), (["push_clip", "pop_transform"], False), (["pop_clip"], False), (["push_clip"], False), (["push_clip", "push_transform", "pop_transform", "pop_clip"], True), (["push_clip", "push_transform", "pop_clip", "pop_transform"], False), (["pop_clip", "push_clip"], False)]
    assert [one(spark, display.balanced(F.array(*map(F.lit, ops)).cast("array<string>")))[0] for ops, _ in lists] == [ok for _, ok in lists]
    bgra = F.lit(bytearray([1, 2, 3, 4, 5, 6, 7, 8, 9, 9]))
    assert bytes(one(spark, display.swizzled(display.used_bytes(bgra, F.lit(4), F.lit(2))))[0]) == bytes([3, 2, 1, 4, 7, 6, 5, 8])
    white, dark = [255, 255, 250, 0], [255, 249, 255, 255]
    rows = spark.createDataFrame([(1, bytearray(white * 4)), (2, bytearray(white * 3 + dark)), (3, bytearray(dark * 2 + white * 2))], "id long, px binary")
    got = {r["id"]: (r["ink"], r["quadrant"]) for r in display.ink(rows, "id", "px", F.lit(2), F.lit(2)).collect()}
    assert got == {1: (0.0, 0), 2: (0.25, 3), 3: (0.5, 0)}


def test_shed_on_arrival(spark):
    """Against a plain list of waiting jobs."""
    import random

    r = random.Random(1)
    rows = [(k % 3, k, r.randrange(3)) for k in range(400)]
    got = {r["seq"]: (r["outcome"], r["after"]) for r in schedule.shed_on_arrival(spark.createDataFrame(rows, "user_id long, seq long, priority int"), "user_id", 5, 2).collect()}
    want = {seq: ("queued", None) for _, seq, _ in rows}
    for user in range(3):
        waiting = []
        for n, (_, seq, priority) in enumerate([x for x in rows if x[0] == user], 1):
            waiting.append((priority, seq))
            if len(waiting) > 5:
                lowest = min(waiting)
                waiting.remove(lowest)
                want[lowest[1]] = ("shed", n)
            if n % 2 == 0:
                first = min(waiting, key=lambda x: (-x[0], x[1]))
                waiting.remove(first)
                want[first[1]] = ("served", n)
    assert got == want and len({o for o, _ in got.values()}) == 3


def test_folded(spark):
    rows = ["Café CAFE", None, "ascii", "Ǆ ß Ŵỳ", "日本 é", "é 한글", "– É"]
    docs = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    got = {r["id"]: r["text"] for r in text.folded(docs, "text").collect()}
    assert got == {k: None if t is None else text.bare(t).lower() for k, t in enumerate(rows)}


def test_store_lookups(spark):
    files = spark.createDataFrame([(1, "/a/b.pdf", True), (2, "/a/C.pdf", False)], "id long, path string, pinned boolean").withColumn("path_hash", F.sha2("path", 256))
    assert [r["id"] for r in relations.find(files, "\\a\\b.pdf").collect()] == [1] and relations.find(files, "/a/c.pdf").count() == 0
    set_to = spark.createDataFrame([(1, False), (9, True)], "id long, pinned boolean")
    assert {r["id"]: r["pinned"] for r in relations.pinned(files, set_to, "id").collect()} == {1: False, 2: False}
    there = spark.createDataFrame([("/a/C.pdf",), ("/a/C.pdf",)], "path string")
    assert {r["id"]: r["available"] for r in relations.available(files, there).collect()} == {1: False, 2: True}
    hello = spark.createDataFrame([(1, 3), (2, 4), (3, None)], "id long, protocol int")
    assert {r["id"]: r["greeting"] for r in relations.greeted(hello, "protocol", 3).collect()} == {1: "Accepted", 2: "ProtocolMismatch", 3: "NoHandshake"}
