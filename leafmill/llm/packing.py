"""Operator 6: best-fit packing of token sequences by pattern fitting.

Only the histogram of piece lengths (at most ``capacity`` counts) reaches the
driver.  There, patterns of few documents that fill a sequence are enumerated,
their repeat counts are fitted to the histogram by non-negative least squares
and rounded down to what is there, and the residual histogram is packed by
best-fit decreasing.  The plan holds, for each pattern and length, a range of
ranks; it is bounded by the capacity and not by the corpus.  Pieces find their
place by their rank among pieces of equal length, counted in salted groups, so
that a length that most documents share is spread over many tasks.

Defined edge cases: a null or empty text is one piece that holds the end id
only; repeated rows are packed once each; an empty table gives an empty result;
only ``doc_id`` and ``text`` are read, so extra columns never clash.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.bpe import SPACES, Bpe, loaded, ragged, sliced
from leafmill.llm.common import checkpointed, shuffle_partitions

CAPACITY = 4096
END_ID = 1
#: Patterns tried for each longest piece.
PATTERNS_EACH = 12
FIT_ROUNDS = 300


#: Kinds of characters that the vocabulary's pattern tells apart.
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Bytes of pieces whose ids a worker keeps from batch to batch.
KNOWN_BYTES = 4_000_000


def _kinds() -> np.ndarray:
    """The kind of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((SPACE, f"[{SPACES}]+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, points):
            out[run.start() : run.end()] = kind
    return out


class WordBpe:
    """Whole texts to ids for a lower-cased vocabulary with word ends.

    The distinct words of a batch are cut into pieces all at once, and only pieces
    that the worker has not met lately are merged.  What it keeps has a bound, by
    bytes; beyond it only the pieces of the batch at hand stay.
    """

    def __init__(self, path: str):
        import regex

        self.bpe = Bpe(path)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.bpe.added)) + ")")
        self.kind = _kinds()
        self.names = np.array(sorted(self.bpe.added.values()), np.int32)
        # ids of the special tokens, then of the known pieces, and where each of those has its own
        self.ids = self.names
        self.known = pa.array([], pa.large_binary())
        self.first = self.count = np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cut, owner, token = self._cut(coded.dictionary)
        cut = cut.dictionary_encode()
        at = self._look_up(cut.dictionary)[cut.indices.to_numpy(zero_copy_only=False)]
        first, count = self.first[at], self.count[at]
        if len(special := np.flatnonzero(token >= 0)):
            first[special], count[special] = np.searchsorted(self.names, token[special]), 1
            order = np.argsort(owner, kind="stable")
            owner, first, count = owner[order], first[order], count[order]
        flat = self.ids[ragged(first, count)]
        size = np.bincount(owner, weights=count, minlength=len(coded.dictionary)).astype(np.int64)
        start = np.cumsum(size) - size
        per = size[code]
        ends = np.concatenate([[0], np.cumsum(per)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        return flat[ragged(start[code], per)], np.diff(ends[at])

    def _cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of the words, the word that each is of, and its id where it stands for a special token (else -1).

        The published pattern of this vocabulary takes 's 't 're 've 'm 'll 'd, runs
        of letters, single numbers and runs of other characters.
        """
        parts = words.to_numpy(zero_copy_only=False).tolist()
        owner: list[int] = []
        token: list[int] = []
        for i in np.flatnonzero(pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)).tolist():
            for k, part in enumerate(self.special.split(parts[i])):
                parts.append("0" if k % 2 else part)  # a special token is one digit while words are cut
                owner.append(i)
                token.append(self.bpe.added[part] if k % 2 else -1)
            parts[i] = ""
        places = np.concatenate([np.arange(len(words)), np.array(owner, np.int64)])
        tokens = np.concatenate([np.full(len(words), -1), np.array(token, np.int64)])
        # lower case letter by letter, without the rule for a final sigma
        text = unicodedata.normalize("NFC", "\n".join(parts) + "\n").replace("Σ", "σ").lower()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        new = kind == NUMBER
        new[0] = True
        new[1:] |= kind[1:] != kind[:-1]
        quote = np.flatnonzero((points == ord("'")) & new)
        after = points[quote + 1].astype(np.int64)
        pair = after << 32 | points[np.minimum(quote + 2, len(points) - 1)]
        short = np.isin(after, [ord(c) for c in "stmd"])
        long = np.isin(pair, [ord(c) << 32 | ord(d) for c, d in ("re", "ve", "ll")])
        new[quote[short | long] + 1] = False
        new[quote[short] + 2] = True
        new[quote[long] + 3] = True
        begin = np.flatnonzero(new)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        offsets = np.append((np.cumsum(width) - width)[begin], width.sum())
        cut = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(text.encode())])
        keep = kind[begin] != SPACE
        part = np.cumsum(points == ord("\n"))[begin[keep]]
        return cut.filter(pa.array(keep)), places[part], tokens[part]

    def _look_up(self, pieces: pa.Array) -> np.ndarray:
        """The places of distinct pieces among the known ones, which the others join."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        old = at >= 0
        fresh = pieces.filter(pa.array(~old))
        if self.known.nbytes + fresh.nbytes > KNOWN_BYTES:
            first, self.count = self.first[at[old]], self.count[at[old]]
            self.ids = np.concatenate([self.names, self.ids[ragged(first, self.count)]])
            self.first = len(self.names) + np.cumsum(self.count) - self.count
            self.known = pieces.filter(pa.array(old))
            at[old] = np.arange(len(self.known))
        at[~old] = len(self.known) + np.arange(len(fresh))
        ids, count = self.bpe.encode(fresh.to_numpy(zero_copy_only=False).tolist())
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.known = pa.concat_arrays([self.known, fresh])
        return at


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document cut at the capacity."""

    def run(batches):
        coder = loaded(WordBpe, vocabulary)
        for batch in sliced(batches):
            ids, sizes = coder.encode(batch.column(1))
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            sizes = sizes + 1
            begin = np.cumsum(sizes) - sizes
            cuts = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), cuts)
            number = ragged(np.zeros(len(cuts), np.int64), cuts)
            start = number * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            view = memoryview(ids.tobytes())
            at = (begin[doc] + start) * 4
            crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            out = [batch.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cut = np.append(at // 4, len(ids)).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _enumerate(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths that fill a sequence as far as the histogram allows."""
    present = np.flatnonzero(counts)
    best = np.full(capacity + 1, 0)
    best[present] = present
    best = np.maximum.accumulate(best)  # the longest present length up to each size
    found = set()
    heavy = present[np.argsort(-counts[present], kind="stable")]
    for rank, a in enumerate(present[::-1].tolist()):
        room = capacity - a
        if not best[room]:
            found.add((a,))
            continue
        seconds = {int(best[room]), *(int(best[int(room * k / PATTERNS_EACH)]) for k in range(1, PATTERNS_EACH))}
        seconds |= {int(b) for b in heavy[(rank * 3) % len(heavy) :][:4] if b <= room}
        for b in seconds - {0}:
            left, row = room - b, [a, b]
            for parts in (2, 1):
                c = int(best[left // parts])
                if c:
                    row.append(c)
                    left -= c
            found.add(tuple(sorted(row, reverse=True)))
    return sorted(found, reverse=True)


def _fit(counts: np.ndarray, patterns: list[tuple[int, ...]]) -> np.ndarray:
    """Repeat counts by non-negative least squares: accelerated projected gradients."""
    row = np.array([length for p in patterns for length in p], np.int64)
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    n, h = len(counts), counts.astype(float)
    times = lambda x: np.bincount(row, weights=x[col], minlength=n)
    back = lambda y: np.bincount(col, weights=y[row], minlength=len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(times(v))
        scale = np.linalg.norm(v)
        v /= scale
    x = z = np.zeros(len(patterns))
    t = 1.0
    for _ in range(FIT_ROUNDS):
        nxt = np.maximum(z - back(times(z) - h) / scale, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, x = nxt + (old - 1) / t * (nxt - x), nxt
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that together hold every piece of the histogram exactly once."""
    left = counts.astype(np.int64).copy()
    out = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    if left.any():
        patterns = _enumerate(left, capacity)
        repeats = _fit(left, patterns)
        for k in np.argsort(-repeats, kind="stable").tolist():
            if repeats[k] < 1:
                break
            kinds, many = np.unique(patterns[k], return_counts=True)
            n = min(int(repeats[k]), int((left[kinds] // many).min()))
            if n > 0:
                left[kinds] -= n * many
                out.append((patterns[k], n))
    while left.any():  # best-fit decreasing on what the rounding left
        taken: dict[int, int] = {}
        room, present = capacity, np.flatnonzero(left)
        while len(present) and room >= present[0]:
            length = int(present[np.searchsorted(present, room, side="right") - 1])
            n = min(room // length, int(left[length]))
            taken[length] = n
            room -= n * length
            present = present[: np.searchsorted(present, min(length - 1, room), side="right")]
        n = min(int(left[length]) // m for length, m in taken.items())
        for length, m in taken.items():
            left[length] -= n * m
        out.append((tuple(length for length, m in taken.items() for _ in range(m)), n))
    return out


def _slots(planned: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, the ranges of ranks that go to each pattern, as sorted arrays."""
    rows, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, n in planned:
        offset = 0
        for length in dict.fromkeys(lengths):
            m = lengths.count(length)
            rows.append((length, used[length], m, base, offset))
            used[length] += n * m
            offset += m * length
        base += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "many", "sequence", "offset"), columns, strict=True))


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and the gapless offset in that sequence."""
    spark = docs.sparkSession
    cut = checkpointed(pieces(docs, vocabulary, capacity, end_id, with_ids))
    salts = max(64, 2 * shuffle_partitions(spark))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in groups.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    slots = _slots(plan(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("at", F.row_number().over(order) - 1).join(firsts, ["length", "salt"])
    columns = [*cut.columns]

    def place(batches):
        key = slots["length"] << 40 | slots["rank"]
        for batch in batches:
            row = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
            length, rank = (row[k].to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            inner = rank - slots["rank"][at]
            sequence = slots["sequence"][at] + inner // slots["many"][at]
            offset = slots["offset"][at] + inner % slots["many"][at] * length
            yield pa.RecordBatch.from_arrays([*(row[c] for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*columns, (F.col("first") + F.col("at")).cast("long").alias("rank")).mapInArrow(place, schema)
