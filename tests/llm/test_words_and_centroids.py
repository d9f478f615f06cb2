"""Substring dedup, spelling variants and centroid clustering against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest_llm import edited, prose, texts

from leafmill.llm import centroids, spelling, substrings

SCHEMA = "doc_id long, text string"


def cut(rows, length):
    """What each (doc_id, text) keeps, from all windows in order."""
    first, gone = {}, defaultdict(set)
    words = {r: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows}
    own = {r: i for i, r in enumerate(sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)))}
    for r in own:
        w = words[r]
        for s in range(len(w) - length + 1):
            if first.setdefault(tuple(w[s : s + length]), (own[r], s)) != (own[r], s):
                gone[r] |= set(range(s, s + length))
    return {r: (len(words[r]), len(gone[r]), " ".join(x for i, x in enumerate(words[r]) if i not in gone[r])) for r in own}


def check_cut(spark, rows, length=20, gram=8, chunk=None, monkeypatch=None):
    if chunk:
        monkeypatch.setattr(substrings, "CHUNK", chunk)
    want = cut(rows, length)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = substrings.without_repeats(docs, length, gram).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got), key=str) == sorted(((r[0], *want[r]) for r in rows), key=str)
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
    told = substrings.digests(docs, length, gram).collect()
    assert sorted(((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in told), key=str) == sorted(((r[0], want[r][1], hashlib.sha256(want[r][2].encode()).hexdigest()) for r in rows), key=str)


def test_substrings_edges(spark):
    check_cut(spark, [*enumerate(texts()), (3, None), (14, prose(1, 200)), (None, None), (900, " \t" + prose(1, 19)), (901, prose(1, 20) + "\n")])


def test_substrings_of_shared_passages(spark):
    """Passages in many documents, at borders, back to back, overlapping, and of one word only."""
    r = random.Random(3)
    passages = [prose(1000 + k, r.randint(18, 70)) for k in range(6)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts += [prose(5000 + i * 7 + len(parts), r.randint(0, 25)), r.choice(passages) if r.random() < 0.6 else " ".join(r.choice(passages).split()[r.randint(0, 9) :])]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, edited(rows[0][1], i, 0.02)) for i in range(12)] + [(300, "a " * 90), (301, "a " * 21), (302, "a b " * 40)]
    check_cut(spark, rows)


def test_substrings_in_chunks(spark, monkeypatch):
    rows = [(i, prose(i % 3, 300) + " " + prose(50 + i, 40)) for i in range(9)]
    check_cut(spark, rows, chunk=37, monkeypatch=monkeypatch)
    check_cut(spark, rows, length=6, gram=3)


def test_substrings_of_rows_that_share_an_id(spark):
    """The text with the smaller hash comes first; a repeated row is one document."""
    a, b = prose(1, 60), prose(1, 60) + " " + prose(2, 30)
    rows = spark.createDataFrame([(5, a), (5, b), (5, b), (5, b), (None, a)], SCHEMA)
    got = sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in substrings.digests(rows).collect())
    assert got in ([(False, 60, 0), *[(False, 90, 60)] * 3, (True, 60, 60)], [(False, 60, 60), *[(False, 90, 0)] * 3, (True, 60, 60)])


def test_substrings_columns_and_empty(spark, documents, none):
    assert substrings.digests(none).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert substrings.digests(none).count() == 0
    assert substrings.digests(documents).count() == documents.count()


def test_long_text_of_one_word(spark):
    rows = spark.createDataFrame([(1, "x " * 400_000), (2, "y" * 3_000_000)], SCHEMA)
    assert sorted((r["n_words"], r["n_removed"]) for r in substrings.digests(rows).collect()) == [(1, 0), (400_000, 399_999)]


def spelled(rows, least=7, often=2, times=10):
    total = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            total[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    words = {w: n for w, n in total.items() if len(w) >= least and n >= often}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    around = {w: [x for x in words if near(w, x)] for w in words}
    better = {w: [(-words[x], x) for x in around[w] if words[x] >= times * n] for w, n in words.items()}
    form = {w: min(xs)[1] for w, xs in better.items() if xs}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(around[w]), words[form[w]] if w in form else None))
    return out


def check_spelling(spark, rows):
    got = spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    want = spelled(rows)
    assert len(got) == len(want) and set(got) == want
    return want


def test_spelling(spark):
    """Doubled letters, edits at both ends and in runs, chains of forms, letters beyond ASCII, ties."""
    r = random.Random(5)
    letters = "aabbé"
    base = ["".join(r.choice(letters) for _ in range(r.randint(7, 12))) for _ in range(60)]
    words = [w for w in base for _ in range(r.choice([2, 3, 25]))]
    for w in base:
        for _ in range(5):
            k = r.randint(0, len(w))
            words += [r.choice([w[:k] + r.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k + 1 :]])] * r.choice([2, 2, 3])
    words += ["abcdefgh"] * 900 + ["abcdefghi"] * 70 + ["abcdefghij"] * 4 + ["zbcdefgh"] * 40 + ["ÀBCDEFGH"] * 30 + ["aaaaaaaa"] * 50 + ["aaaaaaaaa"] * 5 + ["aaaaaaa"] * 2
    r.shuffle(words)
    rows = [(k // 40, " ".join(words[k : k + 40])) for k in range(0, len(words), 40)]
    want = check_spelling(spark, rows)
    assert any(root != form and form for _, form, root, *_ in want)


def test_spelling_edges(spark, documents, none):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    check_spelling(spark, rows)
    assert spelling.variants(none).count() == 0
    assert spelling.variants(documents).count() == len(spelled(rows))


def test_long_texts_are_cut_between_runs(monkeypatch):
    whole = next(spelling._runs("one two, three " * 50))
    monkeypatch.setattr(spelling, "PIECE", 64)
    assert [w for part in spelling._runs("one two, three " * 50) for w in part] == whole


def clustered(rows, k=16, rounds=3, seed=1, d=64):
    kept = [(i, [min(max(int(np.floor(d_ * np.float64(x))), -(1 << 27)), 1 << 27) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v) for d_ in [64]]
    name = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=name)[:k]]
    for turn in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c)) for _, v in kept]
        if turn < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, b) in zip(kept, best, strict=True) if b == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    cost = Counter()
    for dist, j in best:
        cost[j] += dist
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, dist, cost[j], sum(cost.values()), sha[j]) for (i, _), (dist, j) in zip(kept, best, strict=True)), key=str)


def check_clusters(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((tuple(r) for r in centroids.clusters(table).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)
    assert got == clustered(rows)


def test_clusters(spark):
    r = np.random.default_rng(2)
    middle = r.normal(0, 3, (5, 64))
    rows = [(i, (middle[i % 5] + r.normal(0, 0.4, 64)).tolist()) for i in range(300)]
    check_clusters(spark, rows)
    check_clusters(spark, [(i, np.round(v, 0).tolist()) for i, v in rows])  # ties


def test_clusters_edges(spark):
    one = [0.5] * 64
    rows = [(1, one), (1, one), (2, None), (3, one[:5]), (4, [None, *one[1:]]), (5, [float("nan"), *one[1:]]), (6, [float("inf"), *one[1:]]), (None, [-0.01] * 64), (7, [1e30] * 64), (8, [0.0] * 64), (9, [])]
    check_clusters(spark, rows)
    check_clusters(spark, rows[2:7])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, cluster int, distance long")
    assert centroids.clusters(empty).count() == 0


def test_bounds_reject_no_nearest_centroid():
    r = np.random.default_rng(4)
    for scale in (1, 50, 1 << 26):
        x, c = (r.integers(-scale, scale + 1, (n, 8)) for n in (500, 12))
        number, distance = centroids.nearest(x, c)
        every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
