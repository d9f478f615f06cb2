"""Operator 11: exact substring dedup by seed and extend.

A window is ``LENGTH`` consecutive words.  Its anchor is the leftmost word gram of
least hash in it, as in winnowing, so equal windows have equal anchors at equal
places, and a document has about one anchor in seven words.  Documents are
joined on anchors:

1. Seeds.  Anchors whose hash occurs once have no partner.  Hashes that repeat are
   counted, and a bitmap of them (``BITS`` bits at most) keeps most other anchors
   from being shuffled again; what it lets through in error finds no partner.
2. Extension.  Every seed is held against the first occurrence of its anchor only, so
   a passage that a third of the corpus shares makes one comparison for each place,
   not one for each pair.  The match grows both ways from the anchor as far as the
   windows that the anchor governs are equal; neighbouring anchors' matches join
   into maximal repeats.
3. Rest.  Windows that differ from those of the anchor's first occurrence can only be
   equal to other such windows, since equal windows share an anchor.  They are
   grouped by their whole hash, combined before the shuffle, which makes the
   result exact whatever the first occurrence looks like.

A window is known by two hashes of 64 bits, its anchor's and its own.

Defined edge cases: null and empty texts and those of white space have no words and
lose none; texts shorter than a window lose none; a document is its doc_id and
text, so rows equal in both are one document and get equal results; of rows that
share a doc_id only, the text with the smaller hash comes first; rows without a
doc_id come after all others; an empty table gives an empty result; only
``doc_id`` and ``text`` are read, so extra columns never clash; very long texts are
taken in chunks of ``CHUNK`` words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.bpe import ragged, sliced
from leafmill.llm.common import shared_folder
from leafmill.llm.ngram_join import mixed

LENGTH, GRAM = 20, 8
#: Bytes of text and words that a worker works on at once.
CHARS, CHUNK = 4_000_000, 1 << 20
#: The bitmap of repeated hashes has 16 bits for each, from LEAST_BITS to BITS (32 MB) in all, in so many slices.
LEAST_BITS, BITS, SLICES = 16, 28, 16

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words between ASCII white space, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in words:  # the ends of a text that begins or ends with white space
        real = code != words.index(b"")
        size = np.bincount(np.repeat(np.arange(len(size)), size)[real], minlength=len(size))
        code = code[real]
    return hashes[code], size


def _rolled(word: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes, modulo 2**64, of all runs of these lengths."""
    n = len(word)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(word * power, dtype=np.uint64)])
    return [mixed((total[k:] - total[:-k]) * back[: n - k + 1]) for k in lengths]


def _leftmost(v: np.ndarray, width: int) -> np.ndarray:
    """For each window of so many values the place of the leftmost least one."""
    at, span = np.arange(len(v)), 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(v[b] < v[a], b, a)

    while span * 2 <= width:
        at = least(at[:-span], at[span:])
        span *= 2
    more = width - span
    return least(at[:-more], at[more:]) if more else at


def anchored(texts: pa.Array, length: int = LENGTH, gram: int = GRAM):
    """Anchors of the texts, chunk by chunk: row, hash, place, places before it of the first window it governs, those windows' number and hashes."""
    word, size = word_hashes(texts)
    ends = np.cumsum(size)
    for a in range(0, max(0, len(word) - length + 1), CHUNK):
        part = word[a : a + CHUNK + length - 1]
        m = len(part) - length + 1
        hashes, windows = _rolled(part, (gram, length))
        place = np.arange(a, a + m)
        row = np.searchsorted(ends, place, side="right")
        ok = np.flatnonzero(ends[row] - place >= length)
        if not len(ok):
            continue
        governs = _leftmost(hashes, length - gram + 1)[ok]
        row = row[ok]
        new = np.ones(len(ok), bool)
        new[1:] = (governs[1:] != governs[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        own = row[first]
        yield own, hashes[governs[first]].view(np.int64), governs[first] + a - (ends - size)[own], governs[first] - ok[first], np.diff(np.append(first, len(ok))), windows[ok].view(np.int64)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, the document's own key, and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))


def _repeated(named: DataFrame, length: int, gram: int) -> DataFrame:
    """Hashes of anchors that occur more than once."""

    def run(batches):
        for batch in sliced(batches, CHARS):
            for _, h, *_ in anchored(batch.column(0), length, gram):
                h, many = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(many)], ["h", "many"])

    return named.select("text").mapInArrow(run, "h long, many long").groupBy("h").agg(F.sum("many").alias("many")).where("many > 1").select("h")


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Where hashes stand in a bitmap. They are mixed once more, since anchors are the least of their windows."""
    return (mixed(h.view(np.uint64) ^ np.uint64(_BASE)) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(hashes: DataFrame, name: str, count: int) -> tuple[np.ndarray, int]:
    """A bitmap of hashes, packed, and how many bits of a place it has; its size has a fixed bound."""
    bits = min(BITS, max(LEAST_BITS, (16 * count).bit_length()))
    each = (1 << bits) // SLICES

    def placed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(batch.column(0).to_numpy(), bits))], ["place"])

    def run(batches):
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for s in np.unique(at // each).tolist():
                flags = slices.setdefault(s, np.zeros(each // 8, np.uint8))
                mine = at[at // each == s] % each
                np.bitwise_or.at(flags, mine >> 3, np.uint8(128) >> (mine & 7).astype(np.uint8))
        for s, flags in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([flags.tobytes()], pa.binary())], ["slice", "flags"])

    packed = np.zeros((1 << bits) // 8, np.uint8)
    places = hashes.select(F.col(name)).mapInArrow(placed, "place long")
    for r in places.repartition(SLICES, F.floor(F.col("place") / each)).mapInArrow(run, "slice long, flags binary").collect():
        at = r["slice"] * each // 8
        packed[at : at + each // 8] |= np.frombuffer(r["flags"], np.uint8)
    return packed, bits


def _seeds(named: DataFrame, repeated: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors that may have partners, with the windows they govern."""
    flags, bits = bitmap(repeated, "h", repeated.count())
    shared = named.sparkSession.sparkContext.broadcast(flags)

    def run(batches):
        packed = shared.value
        for batch in sliced(batches, CHARS):
            for row, h, place, lead, many, windows in anchored(batch.column(2), length, gram):
                at = _places(h, bits)
                keep = np.flatnonzero(packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                own = pa.array(row[keep])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many[keep])]).astype(np.int32)), pa.array(windows[ragged(np.cumsum(many)[keep] - many[keep], many[keep])]))
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), batch.column(0).take(own), batch.column(1).take(own), pa.array(place[keep].astype(np.int32)), pa.array(lead[keep].astype(np.int32)), lists], ["h", "doc_id", "key", "place", "lead", "windows"])

    return named.mapInArrow(run, "h long, doc_id long, key long, place int, lead int, windows array<long>")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _extended(pairs: DataFrame) -> DataFrame:
    """Of seeds next to their anchor's first occurrence: runs of equal windows (no h), and single windows (h, window) that differ."""

    def run(batches):
        for batch in batches:
            h, doc, key, place, lead, windows, first_lead, first_windows = (pa.concat_arrays([c]) for c in batch.columns)
            own, many = _flat(windows)
            other, others = _flat(first_windows)
            row = np.repeat(np.arange(batch.num_rows), many)
            start = np.cumsum(many) - many
            nth = np.arange(len(own)) - start[row]
            shift = first_lead.to_numpy().astype(np.int64) - lead.to_numpy()
            at = nth + shift[row]
            there = (at >= 0) & (at < others[row])
            equal = np.zeros(len(own), bool)
            equal[there] = own[there] == other[(np.cumsum(others) - others)[row[there]] + at[there]]
            where = place.to_numpy().astype(np.int64)[row] - lead.to_numpy()[row] + nth
            begins = equal.copy()
            begins[1:] &= ~equal[:-1] | (row[1:] != row[:-1])
            run_of = np.cumsum(begins) - 1
            begin = np.flatnonzero(begins)
            yield rows(doc, key, row[begin], where[begin], np.bincount(run_of[equal], minlength=len(begin)), pa.nulls(len(begin), pa.int64()), pa.nulls(len(begin), pa.int64()))
            rest = np.flatnonzero(~equal)
            yield rows(doc, key, row[rest], where[rest], np.ones(len(rest), np.int64), h.take(pa.array(row[rest])), pa.array(own[rest]))

    def rows(doc, key, row, start, many, h, window):
        own = pa.array(row)
        return pa.RecordBatch.from_arrays([doc.take(own), key.take(own), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32)), h, window], ["doc_id", "key", "start", "many", "h", "window"])

    return pairs.select("h", "doc_id", "key", "place", "lead", "windows", "first.lead", "first.windows").toDF("h", "doc_id", "key", "place", "lead", "windows", "first_lead", "first_windows").mapInArrow(run, "doc_id long, key long, start int, many int, h long, window long")


def _order(*rest: str) -> Column:
    """Which occurrence is earlier; documents without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", *rest)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that lost executors cost no recomputation and what reads it gets exchanges of its own."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, key and spans: (start, many) of windows that also start earlier, as many consecutive ones from a word on."""
    named = _named(docs)
    repeated = _kept(_repeated(named, length, gram), "repeated")
    seeds = _kept(_seeds(named, repeated, length, gram), "seeds")
    firsts = seeds.groupBy("h").agg(F.min(_order("place", "lead", "windows")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = _kept(firsts, "firsts")
    itself = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("place") == F.col("first.place")) & (F.col("lead") == F.col("first.lead"))
    found = _kept(_extended(seeds.join(firsts, "h").where(~itself)), "extended")
    rest = found.where("h IS NOT NULL")
    earliest = rest.groupBy("h", "window").agg(F.min(_order("start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    earliest = _kept(earliest, "earliest")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("start") == F.col("first.start"))
    more = rest.join(earliest, ["h", "window"]).where(~same)
    marks = found.where("h IS NULL").select("doc_id", "key", "start", "many").unionByName(more.select("doc_id", "key", "start", "many"))
    # of one document, so bounded by its own length; rows that repeat a document add nothing
    return marks.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "many")).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, text of the kept words and the maximal repeats (start, stop) in words of every document."""
    return _finished(docs, length, gram, False)


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return _finished(docs, length, gram, True)


def _finished(docs: DataFrame, length: int, gram: int, digest: bool) -> DataFrame:
    named = _named(docs)
    marks = _kept(repeats(docs, length, gram), "marks").withColumnsRenamed({"doc_id": "m_id", "key": "m_key"})
    both = named.join(marks, (F.col("key") == F.col("m_key")) & F.col("doc_id").eqNullSafe(F.col("m_id")), "left")
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch in sliced(batches, CHARS):
            n_words, n_removed, texts, spans = [], [], [], []
            for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()  # at ASCII white space
                n_words.append(len(words))
                whole: list[list[int]] = []
                for start, stop in sorted((c["start"], c["start"] + c["many"] + length - 1) for c in cut or ()):
                    if whole and start <= whole[-1][1]:
                        whole[-1][1] = max(stop, whole[-1][1])
                    else:
                        whole.append([start, stop])
                at, parts = 0, []
                for start, stop in whole:
                    parts += words[at:start]
                    at = stop
                parts += words[at:]
                n_removed.append(len(words) - len(parts))
                kept = b" ".join(parts)
                texts.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
                spans.append([] if digest else [{"start": a, "stop": b} for a, b in whole])
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns if digest else [*columns, pa.array(spans, span)], names if digest else [*names, "spans"])

    names = ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "text"]
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "text string, spans array<struct<start:int,stop:int>>")
    return both.select("doc_id", "text", "spans").mapInArrow(run, schema)


def oracle(length: int = LENGTH) -> str:
    """The same rows from all windows of all documents."""
    return f"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, s, array_to_string(w[s:s + {length - 1}], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - {length - 2})) AS s FROM w)),
again AS (SELECT doc_id, s FROM x QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(s, s + {length})) AS p FROM again) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
sha256(coalesce(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda v, i: NOT list_contains(g, i)), ' ') END, '')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id)"""
