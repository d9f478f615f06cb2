"""Regex search with a prefilter: what literals a match must hold, and which documents hold their trigrams.

The index has, for each three characters of lower-cased texts and each block of up
to ``BLOCK`` documents, a bitmap of the documents that hold them, in ``BUCKETS``
partitions by trigram, and each block's documents.  A search takes the literals
that every match of a pattern must hold, reads the partitions of their
trigrams only, ands the bitmaps and runs the pattern over the documents left.
A pattern without such a literal of three characters runs over all documents.
Rows without an id are always left for the pattern; null texts never match.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.fulltext import parts
from leafmill.sources import shared

BLOCK, BUCKETS = 256, 16
CHARS = 1_000_000
#: Trigrams that are looked up for each alternative, the most.
MOST = 64
ROWS = "gram long, block long, bits binary, docs array<long>, bucket int"

_SPECIAL = set("^$.|?*+()[]{}\\")
_QUANTIFIER = re.compile(r"(\?|\*|\+|\{(\d+)(?:,\d*)?\})[?+]?")


def literals(pattern: str) -> list[list[str]] | None:
    """For each top-level alternative the literals that a match must hold; null where that cannot be told."""
    if re.search(r"\\Q|\(\?[a-z]*[^:=!<>a-z)i]|\(\?[a-hj-z]+[):]", pattern):
        return None  # quoted stretches and modes that change what characters mean
    branches, end = _branches(re.sub(r"^(?:\(\?i\))+", "", pattern), 0)
    return branches if end is not None else None


def _branches(p: str, i: int) -> tuple[list[list[str]], int | None]:
    """Alternatives from ``i`` to a closing bracket or the end, and where that is."""
    out: list[list[str]] = [[]]
    run = ""

    def flush() -> None:
        nonlocal run
        if run:
            out[-1].append(run)
        run = ""

    while i < len(p) and p[i] != ")":
        c = p[i]
        if c == "|":
            flush()
            out.append([])
            i += 1
            continue
        held: list[str] = []
        literal = ""
        if c == "(":
            ahead = re.match(r"\((\?(?::|=|!|<=|<!|>|<\w+>|i\)|i:))?", p[i:])
            kind = ahead.group(1) or ""
            if kind == "?i)":  # a mode from here on
                flush()
                i += len(ahead.group())
                continue
            inner, close = _branches(p, i + len(ahead.group()))
            if close is None or close >= len(p):
                return out, None
            if kind in ("", "?:", "?>", "?i:") or kind.startswith("?<") and kind.endswith(">"):
                held = inner[0] if len(inner) == 1 else []
            i = close + 1
        elif c == "[":
            depth, i = 1, i + 1
            i += p[i : i + 1] == "^"
            i += p[i : i + 1] == "]"
            while i < len(p) and depth:
                depth += (p[i] == "[") - (p[i] == "]")
                i += 2 if p[i] == "\\" else 1
            if depth:
                return out, None
        elif c == "\\":
            if i + 1 >= len(p):
                return out, None
            if p[i + 1].isalnum():
                named = re.match(r"\\(?:[pP](?:\{[^}]*\}|.)|x\{[^}]*\}|x..|u....|0[0-7]{1,3}|c.|k<\w+>|[0-9]+|.)", p[i:])
                i += len(named.group())
            else:
                literal = p[i + 1]
                i += 2
        else:
            literal = "" if c in _SPECIAL else c
            i += 1
        more = _QUANTIFIER.match(p, i)
        if more:
            i = more.end()
            least = {"?": 0, "*": 0, "+": 1}.get(more.group(1), int(more.group(2) or 0))
            run += literal if least else ""
            flush()
            out[-1].extend(held if least else [])
        elif literal:
            run += literal
        else:
            flush()
            out[-1].extend(held)
    flush()
    return out, i


def grams_of(literal: str) -> list[int]:
    low = pc.utf8_lower(pa.array([literal]))[0].as_py()
    return sorted({ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in zip(low, low[1:], low[2:])})


def indexed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of the index: bitmaps of trigrams, and in bucket -1 the documents of each block."""

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for ids, texts in parts(_short(batches), CHARS):
            rows = pc.utf8_lower(pc.fill_null(texts, "")).to_pylist()
            point = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32).astype(np.int64)
            doc = np.repeat(np.arange(len(rows)), np.fromiter(map(len, rows), np.int64, len(rows)))
            inside = np.flatnonzero(doc[2:] == doc[:-2])
            gram, doc = (point[:-2] << 42 | point[1:-1] << 21 | point[2:])[inside] if len(inside) else np.zeros(0, np.int64), doc[inside]
            order = np.argsort(gram, kind="stable")  # rows stay in order within a gram
            gram, doc = gram[order], doc[order]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
            gram, doc = gram[new], doc[new]
            flags = np.zeros((len(gram), BLOCK // 8), np.uint8)
            flags[np.arange(len(gram)), doc >> 3] = np.uint8(128) >> (doc & 7).astype(np.uint8)
            first = np.flatnonzero(np.diff(gram, prepend=-1))
            bits = np.bitwise_or.reduceat(flags, first) if len(first) else flags
            gram = gram[first]
            raw = pa.Array.from_buffers(pa.binary(BLOCK // 8), len(gram), [None, pa.py_buffer(np.ascontiguousarray(bits))]).cast(pa.binary())
            n = len(gram)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(gram), pa.nulls(1, pa.int64())]),
                    pa.array(np.full(n + 1, task)),
                    pa.concat_arrays([raw, pa.nulls(1, pa.binary())]),
                    pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([ids.to_pylist()], pa.list_(pa.int64()))]),
                    pa.array(np.append(gram % BUCKETS, -1).astype(np.int32)),
                ],
                ["gram", "block", "bits", "docs", "bucket"],
            )
            task += 1

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, ROWS)


def _short(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


class RegexIndex:
    """A trigram index in a folder, over documents whose ids do not repeat."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/trigrams"

    def build(self, docs: DataFrame, key: str, text: str) -> None:
        if not shared.complete(self.spark, self.path):
            indexed(docs, key, text).write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def candidates(self, needed: list[list[str]]) -> DataFrame:
        """Documents that hold the trigrams of all literals of one of the alternatives."""
        asked = [sorted({g for text in texts for g in grams_of(text)})[:MOST] for texts in needed]
        every = sorted({g for a in asked for g in a})
        table = self.spark.read.schema(ROWS).parquet(self.path)
        found = table.where(F.col("bucket").isin(sorted({g % BUCKETS for g in every})) & F.col("gram").isin(every))
        bits = found.groupBy("block").agg(F.collect_list(F.struct("gram", "bits")).alias("found"))  # at most one of each gram asked for
        blocks = bits.join(table.where("bucket = -1").select("block", "docs"), "block").select("found", "docs")

        def run(batches):
            for batch in batches:
                out: list[int] = []
                for held, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    known = {h["gram"]: np.frombuffer(h["bits"], np.uint8) for h in held}
                    some = np.zeros(BLOCK // 8, np.uint8)
                    for grams in asked:
                        if all(g in known for g in grams):
                            some |= np.bitwise_and.reduce([known[g] for g in grams])
                    out += [docs[k] for k in np.flatnonzero(np.unpackbits(some)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["doc"])

        return blocks.mapInArrow(run, "doc long")

    def search(self, docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
        """Documents that match a pattern, as ``rlike`` finds them."""
        needed = literals(pattern)
        if needed is None or not all(any(len(t) > 2 for t in texts) for texts in needed):
            return docs.where(F.col(text).rlike(pattern))
        found = self.candidates([[t for t in texts if len(t) > 2] for texts in needed]).where("doc IS NOT NULL").distinct().select(F.col("doc").alias(key))
        known = docs.join(found, key, "left_semi").where(F.col(text).rlike(pattern))
        return known.unionByName(docs.where(F.col(key).isNull() & F.col(text).rlike(pattern)).select(*known.columns))
