"""Operators on pairs, groups and stores against brute force."""

import random
import re
import sys
import zlib

import numpy as np
import pytest
from conftest_llm import edited, prose, texts

from leafmill.llm import graph, near_vectors, ngram_join, quality, secrets, sharding


def smallest(n, links, ids):
    """Least id of each row's component."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(i)
    out = [None] * n
    for rows in groups.values():
        known = [ids[i] for i in rows if ids[i] is not None]
        for i in rows:
            out[i] = min(known) if known else None
    return out


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def check_join(spark, rows, tasks=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()), key=str)
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] and sets[i] and sets[j] or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    parts = smallest(len(rows), links, [d for d, _ in rows])
    want = sorted(((d, len(s), p if s else d) for (d, _), s, p in zip(rows, sets, parts, strict=True)), key=str)
    assert got == want


def test_join_edges(spark):
    check_join(spark, list(enumerate(texts())))


def test_join_hot_groups(spark):
    """A large group of near copies at the threshold, a shared passage, and chains."""
    r = random.Random(4)
    base, passage = prose(7, 120), prose(8, 60)
    rows = [edited(base, k, r.choice([0.005, 0.015, 0.03])) for k in range(150)]
    rows += [prose(1000 + k, 20) + " " + passage + " " + prose(2000 + k, r.choice([5, 20, 60])) for k in range(100)]
    rows += [passage + " " + prose(3000 + k, r.choice([1, 5, 10, 14])) for k in range(60)]
    chain = prose(9, 100)
    for k in range(25):
        rows.append(chain)
        chain = edited(chain, 500 + k, 0.015)
    r.shuffle(rows)
    check_join(spark, list(enumerate(rows)))


def test_join_several_slices(spark, monkeypatch):
    """A batch is cut into many parts; every part reads its own texts."""
    monkeypatch.setattr(ngram_join, "CHARS", 3000)
    rows = [(k, prose(k % 40, 30 + k % 40).capitalize()) for k in range(300)] + [(300, None), (301, "")]
    check_join(spark, rows, 1)


def test_join_empty(spark, none):
    assert ngram_join.join(none).count() == 0


@pytest.mark.parametrize("few", [0, graph.FEW])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + k, 401 + k) for k in range(40)]
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest(450, links, list(range(450)))
    assert got == {i: want[i] for i in {x for p in links for x in p if p[0] != p[1]}}


def test_vectors(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((12, 16))
    rows = [(centres[k % 12] + 0.12 * r.standard_normal(16)).tolist() for k in range(150)]
    rows += [(centres[0] + 0.02 * r.standard_normal(16)).tolist() for _ in range(120)] + r.standard_normal((60, 16)).tolist()
    rows += [rows[3], rows[3], [2 * x for x in rows[3]], [0.0] * 16, None, [], [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.0], [1e-30] * 16]
    ids = list(range(len(rows)))
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>, label int, node string").repartition(3)
    got = {x["vec_id"]: x for x in near_vectors.near_vectors(table).collect()}
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in rows]
    unit = [np.array(v) / np.linalg.norm(np.array(v) / max(map(abs, v))) / max(map(abs, v)) if ok else None for v, ok in zip(rows, fine, strict=True)]
    links = [(i, j) for i in ids for j in range(i) if fine[i] and fine[j] and len(rows[i]) == len(rows[j]) and unit[i] @ unit[j] >= 0.9]
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    found = sum(x["n_links"] for x in got.values())
    assert len(got) == len(rows) and all(got[i]["n_links"] <= degree[i] for i in ids) and found >= 0.97 * degree.sum()
    if found == degree.sum():
        assert [got[i]["component_id"] for i in ids] == smallest(len(rows), links, ids)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)
    assert near_vectors.near_vectors(table.limit(0)).count() == 0


def vectors_by_force(table, vectors):
    """n_links and component of distinct vec_ids 0, 1, ... by brute force, against the operator's."""
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in near_vectors.near_vectors(table).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    true = np.triu(unit @ unit.T >= near_vectors.LINK, 1)
    parts = smallest(len(vectors), list(zip(*np.nonzero(true), strict=True)), list(range(len(vectors))))
    return got, {i: (int(true[i].sum() + true[:, i].sum()), parts[i]) for i in range(len(vectors))}


@pytest.mark.parametrize("rounds", [1, 5])
def test_vectors_beside_a_hot_group(spark, monkeypatch, rounds):
    """Pairs and small groups that a weak search loses beside a group whose links outnumber theirs."""
    monkeypatch.setattr(near_vectors, "TABLES", 1)
    monkeypatch.setattr(near_vectors, "WINDOW", 4)
    monkeypatch.setattr(near_vectors, "AUDITS", rounds)
    r = np.random.default_rng(5)
    rows = [*(v + 0.02 * r.standard_normal((400, 16)) for v in r.standard_normal((1, 16)))][0].tolist()
    for k in range(150):
        v = r.standard_normal(16)
        rows += (v + 0.05 * r.standard_normal((2 + k % 5, 16))).tolist()
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(3)
    got, want = vectors_by_force(table, rows)
    if rounds == 1:  # the exact comparison follows
        assert got == want
    else:
        assert sum(got[i] == want[i] for i in range(400, len(rows))) >= 0.97 * (len(rows) - 400)


def test_vectors_of_one_id(spark):
    """No vector is dropped when rows share a vec_id; they are one component."""
    a, b = [0.0, 1.0, 0.0], [1.0, 0.0, 0.0]
    rows = [(1, a), (1, b), (7, b), (8, [1.0, 0.0, 0.1]), (9, [0.0, 0.0, 1.0])]
    got = sorted((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (7, 2, 1, False), (8, 2, 1, False), (9, 0, 9, True)]


def labelled(spark, n):
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, 30 + i % 50)
        rows.append((i, text.upper().replace(" ", "!! ") if bad and i % 8 else " | ".join(text.split()) if bad else text))
        marks.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality(spark, documents, none):
    docs, labels = labelled(spark, 400)
    got = quality.classify(docs, labels).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    far = got[got["held_out"]]
    assert ((far["doc_id"] % 4 != 0).astype(int) == far["predicted"]).mean() > 0.95
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == got["predicted"].astype(bool)).all()
    scored = quality.classify(documents, labels)
    assert scored.count() == documents.count() and scored.where("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert quality.classify(none, labels).count() == 0
    one = quality.classify(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert [r["score"] for r in one] == [0.5]


def test_shards(spark, documents, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "s"), target=40_000, smallest=2_000, fan=3)
    held = documents.select("doc_id", "text", "shard", "n_chars")
    for _ in range(4):
        store.append(held)
    before = store.manifest()
    assert sum(s["rows"] for s in before) == 4 * held.count()
    first = store.version()
    store.settle()
    live = store.manifest()
    assert sum(s["rows"] for s in live) == 4 * held.count() and store.manifest(first) == before
    tiers = [s["tier"] for s in live if s["bytes"] < 30_000]
    assert all(tiers.count(t) < 3 for t in tiers)
    back = store.read(live).select("doc_id", "text")
    want = held.select("doc_id", "text")
    assert back.exceptAll(want.union(want).union(want).union(want)).count() == 0
    with pytest.raises(sharding.Conflict):
        store.commit([], 0)
    store.vacuum()
    assert store.read(live).count() == 4 * held.count()
    store.append(held.limit(0))
    assert sum(s["rows"] for s in store.manifest()) == 4 * held.count()


@pytest.mark.parametrize("tasks", [1, 24])
def test_shard_files(spark, tmp_path, tasks):
    """Shards are one file of about the target, from many tasks or one, with a hot text."""
    rows = [(i, "hot" * 100 if i % 2 else prose(i, 50)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
    store = sharding.Store(spark, str(tmp_path / "s"), target=100_000, smallest=2_000)
    store.append(docs)
    for _ in range(2):
        live = store.manifest()
        assert all(40_000 < s["bytes"] <= 150_000 for s in live) and sum(s["rows"] for s in live) == 3000
        assert all(len(list((tmp_path / "s" / "shards" / s["name"]).glob("*.parquet"))) == 1 for s in live)
        store.settle()
    grown = sharding.Store(spark, str(tmp_path / "s"), target=30_000, smallest=2_000)
    grown.settle()
    assert all(s["bytes"] <= 45_000 for s in grown.manifest()) and sum(s["rows"] for s in grown.manifest()) == 3000


def test_two_writers(spark, tmp_path):
    """Shards that a second writer has not committed yet outlive a vacuum, and only one writer gets a version."""
    docs = spark.createDataFrame([(i, prose(i, 20)) for i in range(40)] + [(None, None)], "doc_id long, text string").coalesce(1)
    one, two = (sharding.Store(spark, str(tmp_path / "s"), target=10_000, smallest=100, fan=2) for _ in range(2))
    one.append(docs)
    made = two._write(docs, 3, 1)  # written, and committed below
    one.append(docs)
    one.settle()
    assert one.vacuum() == 2 and one.vacuum() == 0
    after = two.version()
    two.commit(two.manifest(after) + made, after)
    assert two.read(two.manifest()).count() == 3 * 41
    with pytest.raises(sharding.Conflict):
        one.commit([], after)
    assert two.read(two.manifest()).count() == 3 * 41
    assert one.vacuum(abandoned=-1) >= 0 and two.read(two.manifest()).count() == 3 * 41


def test_crashed_commit(spark, tmp_path, monkeypatch):
    """A manifest that a writer left unfinished counts as none, and is given up after a while."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    store = sharding.Store(spark, str(tmp_path / "s"))
    store.append(docs)
    torn = tmp_path / "s" / "manifests" / f"{2:012d}.json"
    torn.write_text('{"name": "x/shard=0", "rows"')
    assert store.version() == 1 and store.read(store.manifest()).count() == 1
    with pytest.raises(sharding.Conflict):
        store.append(docs)
    monkeypatch.setattr(sharding, "STALE", -1)
    (tmp_path / "s" / "manifests" / f".{2:012d}.json.crc").unlink(missing_ok=True)
    with pytest.raises(sharding.Conflict):
        store.append(docs)
    assert store.append(docs) == 2 and store.read(store.manifest()).count() == 2


def test_sharded_query(spark, documents, none, tmp_path):
    got = sharding.shard(documents, str(tmp_path / "a"), target=50_000, smallest=2_000).toPandas()
    assert len(got) == documents.count()
    sizes = got.groupby("shard")["n_bytes"].sum()
    assert (got.groupby("shard")["shard_bytes"].first() == sizes).all()
    assert sharding.shard(none, str(tmp_path / "b")).count() == 0
    rows = got[["doc_id", "n_bytes"]].fillna(-1).sort_values(["doc_id", "n_bytes"]).to_numpy().tolist()
    want = sorted([-1 if d is None else d, len((t or "").encode())] for d, t in documents.select("doc_id", "text").collect())
    assert rows == want
    bare = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert sharding.shard(bare, str(tmp_path / "c")).select("n_bytes").distinct().collect()[0][0] == 0


def test_pipeline_stages(spark, tmp_path):
    sys.path.insert(0, ".")
    import corpus_pipeline

    docs, labels = labelled(spark, 200)
    more = [(500 + i, t) for i, t in enumerate(texts())]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, str(tmp_path)).cache()
    kept = {r["doc_id"] for r in good.collect()}
    assert all(i in kept for i in range(200) if i % 4) and not any(i in kept for i in range(0, 200, 4)) and good.columns == docs.columns
    apart = stages["near_copies"](spark, docs, str(tmp_path)).cache()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    parts = smallest(len(rows), links, [d for d, _ in rows])
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(d for (d, _), s, p in zip(rows, sets, parts, strict=True) if not s or p == d)
    # columns with the names that stages use, rows without an id, rows that share one
    odd = docs.limit(0).selectExpr("*", "0 quality_score", "0 __row", "0 row_key", "0 place")
    some = [(None, prose(900, 50)), (None, prose(900, 50)), (None, prose(901, 50)), (1, prose(902, 50)), (1, prose(903, 50)), (1, prose(903, 50)), (2, prose(901, 50) + " more"), (3, None), (3, None), (None, "")]
    odd = odd.unionByName(spark.createDataFrame([(d, t, "en", "s", 0, k, k, k, k) for k, (d, t) in enumerate(some)], ", ".join(f"{c} {t}" for c, t in odd.dtypes)))
    left = stages["near_copies"](spark, odd, str(tmp_path))
    assert left.columns == odd.columns and stages["quality"](spark, odd, str(tmp_path)).columns == odd.columns
    want = [(None, ""), (None, prose(900, 50)), (1, prose(902, 50)), (1, prose(903, 50)), (2, prose(901, 50) + " more"), (3, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(want, key=str)
    assert stages["near_copies"](spark, odd.limit(0), str(tmp_path)).count() == 0
    hidden = stages["secrets"](spark, docs, str(tmp_path))
    assert hidden.count() == docs.count() and hidden.columns == docs.columns
    assert secrets.scan(hidden).where("n_assign + n_access + n_hex > 0").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert ids <= {d for d, _ in rows} and out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
