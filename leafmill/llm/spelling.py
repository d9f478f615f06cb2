"""Operator 12: spelling variants over a variable-length gram index.

Words are counted over all texts first.  Grams that stand in more than one of
``SHARE`` places of the distinct words are frequent; of each length there are at
most ``SHARE``, so the dictionary has a bound.  A word is cut into grams from its
left end, and again from its right end: a gram is one character, and grows while
it is frequent, to ``LONGEST`` at most.  Rare characters thus stand alone and common ones
are told apart by their neighbours.

What a gram is follows from its own characters, so an edit at one place affects
at most one gram of the left cut and one of the right cut; these bounds are
taken for every place of every word.  All grams left and right of them must be
shared with a near word, so their inverted lists are merged into one: their
combination is the key of the index, and a word has as many keys as there are
different pairs of bounds.  Words that share a key are verified by edit
distance, and a pair is emitted at exactly one of the keys it shares, the one
whose range of places holds the edit (the leftmost one, if several give the
same word).  Only near pairs leave the join, in which large lists can be split.

Defined edge cases: null and empty texts have no words; a null doc_id counts as
empty in the hash, and rows that share a doc_id or repeat each count; edited runs
may become shorter than ``LEAST`` and then are no words; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read, so extra columns never
clash; very long texts are counted a piece at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.bpe import sliced
from leafmill.llm.common import shared_folder

LEAST, OFTEN, DIVISOR, TIMES = 7, 2, 31, 10
LETTERS = "A-Za-zÀ-ÿ"
SHARE, LONGEST = 100, 3
#: Bytes of text that a worker holds at once, and characters of a text that it cuts into runs at once.
CHARS, PIECE = 4_000_000, 1 << 20


def _runs(text: str):
    """Lower-cased runs of letters; A-Z only are lower-cased. Long texts are cut between runs."""
    low = text.encode().lower().decode()
    pattern = re.compile(f"[{LETTERS}]+")
    if len(low) <= PIECE:
        yield pattern.findall(low)
        return
    found = (m.group() for m in pattern.finditer(low))
    part: list[str] = []
    for run in found:
        part.append(run)
        if len(part) >= PIECE // 8:
            yield part
            part = []
    yield part


def counts(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """word and n of every word that occurs often enough."""

    def run(batches):
        for batch in sliced(batches, CHARS):
            total: Counter[str] = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for part in _runs(text):
                    for word, n in Counter(part).items():
                        if len(word) < least:
                            continue
                        h = zlib.crc32(word.encode(), before)
                        if h % DIVISOR == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < least:
                                continue
                        total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def dictionary(words: DataFrame, share: int = SHARE, longest: int = LONGEST) -> frozenset[str]:
    """Grams, shorter than the longest, that stand in more than one of ``share`` places; at most ``share`` of each length."""

    def run(batches):
        for batch in batches:
            total: Counter[str] = Counter()
            for w in batch.column(0).to_pylist():
                for q in range(1, longest):
                    total.update(w[a : a + q] for a in range(len(w) - q + 1))
                total[""] += len(w)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

    grams = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = _kept(grams, "grams")
    places = grams.where("gram = ''").agg(F.sum("n")).first()[0] or 0
    frequent = grams.where((F.col("gram") != "") & (F.col("n") * share > places))
    return frozenset(r["gram"] for r in frequent.select("gram").collect())


def borders(word: str, frequent: frozenset[str], longest: int = LONGEST) -> tuple[list[int], list[int]]:
    """Where the grams of the left cut end and those of the right cut begin, from the word's own ends on."""
    n = len(word)
    left, a = [0], 0
    while a < n:
        b = a + 1
        while b < n and b - a < longest and word[a:b] in frequent:
            b += 1
        left.append(b)
        a = b
    right, b = [n], n
    while b > 0:
        a = b - 1
        while a > 0 and b - a < longest and word[a:b] in frequent:
            a -= 1
        right.append(a)
        b = a
    return left, right


def keys(word: str, frequent: frozenset[str], longest: int = LONGEST) -> dict[tuple[str, str], tuple[int, int]]:
    """For each combination of unaffected grams the first and last place of an edit that leaves just these; (1, 0) for those of an insertion alone."""
    n = len(word)
    left, right = borders(word, frequent, longest)
    before, after = [0] * (n + 1), [n] * (n + 1)
    for a in left:
        before[a] = a
    for b in right:
        after[b] = b
    for i in range(1, n + 1):
        before[i] = before[i] if before[i] else before[i - 1]
    marked = set(right)
    for i in range(n - 1, -1, -1):
        after[i] = i if i in marked else after[i + 1]
    out: dict[tuple[str, str], tuple[int, int]] = {}
    for i in range(n):  # a character at i is replaced or goes
        key = word[: before[i]], word[after[i + 1] :]
        out[key] = (out[key][0] if key in out else i, i)
    for i in range(n + 1):  # a character comes in before i
        out.setdefault((word[: before[i]], word[after[i] :]), (1, 0))
    return out


def index(words: DataFrame, frequent: frozenset[str], longest: int = LONGEST) -> DataFrame:
    """key, word, n and the range of places of every key of every word."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                found, owner, low, high = [], [], [], []
                for k, w in enumerate(part.column(0).to_pylist()):
                    for (a, b), (lo, hi) in keys(w, frequent, longest).items():
                        found.append(f"{a}\x00{b}")
                        owner.append(k)
                        low.append(lo)
                        high.append(hi)
                own = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.concat_arrays([part.column(0)]).take(own), pa.concat_arrays([part.column(1)]).take(own), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["key", "word", "n", "low", "high"])

    rows = words.mapInArrow(run, "key string, word string, n long, low int, high int")
    return rows.select(F.xxhash64("key").alias("key"), "word", "n", "low", "high")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that lost executors cost no recomputation."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def near(listed: DataFrame) -> DataFrame:
    """a, b and their n for every two near words, once; of equal length a comes first, else a is the shorter one."""
    short = listed.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    long = listed.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "low", "high", F.length("word").alias("size"))
    pairs = short.join(long, "key").where(
        # the range of the longer (or second) word holds the edit's place
        """(length(a) = size AND a < b AND left(a, low) = left(b, low) AND substring(a, high + 2) = substring(b, high + 2)
          OR length(a) + 1 = size AND left(a, low) = left(b, low) AND substring(a, high + 1) = substring(b, high + 2) AND (low = 0 OR substring(a, low) <> substring(b, low + 1)))
         AND low <= high AND levenshtein(a, b, 1) = 1"""
    )
    return pairs.select("a", "n_a", "b", "n_b")


def rooted(forms: DataFrame) -> DataFrame:
    """word and root of words (word, form) that have a form; chains are halved by joining them with themselves.

    A form occurs ten times as often as its word, so chains are short whatever the corpus.
    """
    now = _kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        new = _kept(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = _kept(counts(docs, least, often), "words")
    listed = _kept(index(words, dictionary(words)), "index")
    pairs = _kept(near(listed), "near")
    ends = lambda x, y: pairs.select(F.col(x).alias("word"), F.col(f"n_{x}").alias("n"), F.col(y).alias("other"), F.col(f"n_{y}").alias("other_n"))
    both = ends("a", "b").unionByName(ends("b", "a"))
    many = both.groupBy("word").agg(F.count("*").alias("n_near"))
    forms = both.where(F.col("other_n") >= times * F.col("n")).groupBy("word").agg(F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("form"))).alias("best"))
    forms = _kept(forms.select("word", "best.form", (-F.col("best.rank")).alias("form_n")), "forms")
    out = words.join(many, "word", "left").join(forms, "word", "left").join(rooted(forms), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def oracle(least: int = LEAST, often: int = OFTEN, times: int = TIMES) -> str:
    """The same rows by joining the words that are left without one of their characters; crc32 from its polynomial."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, {step} FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (SELECT w, count(*) AS n, upper(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w))) AS x FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{LETTERS}]{{{least},}}')) AS w FROM documents) GROUP BY doc_id, w),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x), 2), lambda i: strpos('123456789ABCDEF', x[i + 1]) * 16 + strpos('123456789ABCDEF', x[i + 2]))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h FROM runs, crc),
edited AS (SELECT n, CASE WHEN h % {DIVISOR} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= {least} GROUP BY word HAVING sum(n) >= {often}),
less AS MATERIALIZED (SELECT word, n, k, left(word, k::INT) || substr(word, k::INT + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
near AS MATERIALIZED (SELECT a.word, a.n, b.word AS o, b.n AS m FROM less a JOIN less b ON a.d = b.d AND a.k = b.k AND a.word <> b.word
 UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.d = b.word UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
many AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, o AS form, m AS form_n FROM near WHERE m >= {times} * n QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, o) = 1),
chain(word, last, steps) AS (SELECT word, word, 0 FROM words UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON f.word = c.last)
SELECT word, form, (SELECT arg_max(last, steps) FROM chain c WHERE c.word = words.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM words LEFT JOIN many USING (word) LEFT JOIN forms USING (word)"""
