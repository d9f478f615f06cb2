"""The full-text and trigram indexes against scans, over builds, changes, repeated batches and merges."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from leafmill import streaming
from leafmill.operators import fulltext, trigrams
from leafmill.sources import shared

WORDS = "the of Réseau straße LICENSED under terms passage data a b İstanbul ÀÉ 日本 x1 mark".split()
SCHEMA = "doc long, text string"


def corpus(seed, ids):
    r = random.Random(seed)
    return [(i, r.choice([" ", "\n", "-", ", "]).join(r.choice(WORDS) for _ in range(r.randint(0, 40)))) for i in ids]


def tokens(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text or "") if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", bare).lower())


def counted(docs):
    df, tf = {}, {}
    for text in docs.values():
        for t in tokens(text):
            tf[t] = tf.get(t, 0) + 1
        for t in set(tokens(text)):
            df[t] = df.get(t, 0) + 1
    return {(t, df[t], tf[t]) for t in tf}


def hits(docs, phrase):
    want = tokens(phrase)
    found = {i: sum((w := tokens(t))[k : k + len(want)] == want for k in range(len(tokens(t)))) for i, t in docs.items()}
    return {(i, n) for i, n in found.items() if n}


PHRASES = ("the", "of the", "licensed under terms", "the the", "nowhere", "İstanbul", "reseau strasse", "a b a")


def check(index, docs, phrases=("of the", "a b a")):
    assert {tuple(r) for r in index.frequencies().collect()} == counted(docs)
    for p in phrases:
        assert {tuple(r) for r in index.phrase(p).collect()} == hits(docs, p), p
        for most in (3,):
            best = [tuple(r) for r in index.best(p, most).collect()]
            assert best == sorted(hits(docs, p), key=lambda x: (-x[1], x[0]))[:most], (p, most)


def test_index_over_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK", 8)
    monkeypatch.setattr(fulltext, "FIRST_BLOCKS", 2)
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    docs = dict([*corpus(1, range(60)), (60, None), (61, ""), (62, "the the the of")])
    index = fulltext.FullTextIndex(spark, str(tmp_path / "index"))
    index.build(table(list(docs.items())), "doc", "text")
    check(index, docs, PHRASES)
    for batch, (gone, come) in enumerate(((range(5), corpus(2, range(3, 9))), ((), corpus(3, range(100, 110))), (range(40, 62), [(41, "of the of the")])), 1):
        old = [(i, docs[i]) for i in {*gone, *(i for i, _ in come)} if i in docs]
        for i, _ in old:
            del docs[i]
        docs |= dict(come)
        for _ in range(2):  # a batch that comes again changes nothing
            index.apply(batch, table(old), table(come), "doc", "text")
        assert {tuple(r) for r in index.frequencies().collect()} == counted(docs)
    check(index, docs)
    index.compact()
    assert len(index._segments("postings")) == len(index._segments("frequencies")) == 1
    check(index, docs)
    assert {r["doc"] for r in index.match("licensed").collect()} == {i for i, _ in hits(docs, "licensed")}
    index.apply(4, table([(7, docs[7])]), table([]), "doc", "text")
    del docs[7]
    check(index, docs)


def test_search_reads_its_terms_partitions_only(spark, tmp_path):
    index = fulltext.FullTextIndex(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame(corpus(1, range(30)), SCHEMA), "doc", "text")
    plan = index._postings(["the", "of"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*In\(token", plan)


def test_empty_index(spark, tmp_path):
    index = fulltext.FullTextIndex(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame([], SCHEMA), "doc", "text")
    assert index.frequencies().count() == index.phrase("the").count() == index.best("the", 3).count() == index.phrase(" - ").count() == 0


def test_stream_of_changes(spark, tmp_path):
    """A stream that is stopped and started again leaves the index equal to one built anew."""
    docs = dict(corpus(5, range(20)))
    index = fulltext.FullTextIndex(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame(list(docs.items()), SCHEMA), "doc", "text")
    schema = "doc long, before string, after string"
    for k, come in enumerate((corpus(6, range(10, 25)), [(3, None), (30, "a new passage")], corpus(7, range(3)))):
        rows = [(i, docs.get(i), t) for i, t in come]
        for i, t in come:
            docs.pop(i, None) if t is None else docs.__setitem__(i, t)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streaming.indexed(stream, str(tmp_path / "index"), "doc").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        assert {tuple(r) for r in index.frequencies().collect()} == counted(docs), k
    check(index, docs)


@pytest.mark.parametrize(
    ("pattern", "needed"),
    [
        ("abc", [["abc"]]),
        ("abc|de(fgh)+", [["abc"], ["de", "fgh"]]),
        ("ab?cde", [["a", "cde"]]),
        ("a[bc]de\\.f", [["a", "de.f"]]),
        ("(?i)Abc", [["Abc"]]),
        ("(abc|def)ghi", [["ghi"]]),
        ("x{2,3}yz{0,1}", [["x", "y"]]),
        ("(?!abc)def$", [["def"]]),
        ("\\d+abc\\p{L}+[^]x]def", [["abc", "def"]]),
        ("\\Qabc\\E", None),
        ("(?x)a b c", None),
        ("(abc", None),
    ],
)
def test_literals(pattern, needed):
    assert trigrams.literals(pattern) == needed


def test_regex_index(spark, tmp_path):
    rows = [*corpus(9, range(700)), (700, None), (701, "ab"), (702, "İİİ x"), (None, "licensed under"), (703, "\0\0\0a"), (704, "the " * 50_000 + "terms passage")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = trigrams.RegexIndex(spark, str(tmp_path))
    index.build(docs, "doc", "text")
    for pattern in ("LICENSED under", "(?i)licensed.(under|of)", "terms passage|x1-mark", "İİİ", "[0-9]", "the|of|a", "passage\\W+data\\W+the", "no such thing", "日本\n日本", "(?:the )+terms"):
        got = sorted((r["doc"] for r in index.search(docs, "doc", "text", pattern).collect()), key=str)
        assert got == sorted((r["doc"] for r in docs.where(F.col("text").rlike(pattern)).collect()), key=str), pattern
    assert index.candidates([["licensed under"]]).count() < 200


def test_shared_files(spark, tmp_path):
    assert shared.create(spark, str(tmp_path / "one"), "first") and not shared.create(spark, str(tmp_path / "one"), "second")
    assert (tmp_path / "one").read_text() == "first" and shared.names(spark, str(tmp_path / "none")) == []
