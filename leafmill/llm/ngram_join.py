"""Operator 3: an exact n-gram Jaccard join by T-occurrence search.

A document's set holds the hashes of its five-word shingles.  A partner at the
threshold shares at least T = ceil(0.8 n) of a set's n shingles.  As in DivideSkip
the inverted lists of a set are divided: L = T - k of them, the longest, are set
aside, and the n - L short ones are merged.  A candidate must turn up in k of the
short lists, k = 1 + (T - 1) // ``SKIP``; the occurrences are counted in sorted
runs of the lists and added up for each pair.  Only then are its whole sets
fetched, and its overlap is found by binary probes of the partner's sorted set.
"Short" is a global order of the shingles, the known frequent ones last and hashes
otherwise, which keeps the result exact whatever was counted as frequent.  (Of the
first k common shingles none can lie behind the n - T + k first ones of either set.)

Large groups of copies are not expanded into pairs.  Equal sets are one node.
Nodes that share a MinHash value are probed against the group's least node
first, and nodes that already hang together yield no pairs.  The lists are dealt
by ranges of (shingle, node), so that a hot one is spread over tasks; lists of more
than ``HOT`` nodes, and those that a border between tasks cuts, are not merged.
They and the lists of frequent shingles get two rounds of stars, each against one
node of the list.  A pair that no short list has must have all of its k occurrences
in hot lists that are still apart, so only nodes with so many of them go on; these
are compared across their parts, block by block, where their sizes allow a link.

Defined edge cases: a text without words, or null, has an empty set, links with
nothing and is its own component; fewer than five words are one shingle; rows
that share a doc_id count as linked; a null doc_id never names a component
unless all of its documents' ids are null; an empty table gives an empty
result; only ``doc_id`` and ``text`` are read, so extra columns never clash.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.bpe import ragged, sliced
from leafmill.llm.common import checkpointed, shuffle_partitions
from leafmill.llm.graph import components

WORDS = 5
#: Likeness as a fraction of whole numbers, so that its test is exact.
NUMERATOR, DENOMINATOR = 80, 100
#: Of the occurrences that a set needs, one in so many is asked of the short lists, after the first one.
SKIP = 12
#: Longer lists are not merged but searched by stars and blocks.
HOT = 16
#: MinHash values that bring nodes to their group's least node, and the least shingles that tell beforehand
#: whether a star is worth a look: so many of LOW must be shared.
STARS, LOW, LOW_SHARED = 4, 8, 4
#: The most frequent shingles that are put last, at most so many (8 bytes each).
FREQUENT = 1_000_000
#: Shingles counted so often (in batches where they repeat) are frequent.
OFTEN = 8
#: Stars in each list of frequent shingles before its parts are compared in blocks of so many nodes.
STAR_ROUNDS, BLOCK = 2, 256
#: Bytes of text that a worker holds at once.
CHARS = 4_000_000
#: Ids that are broadcast to pick the texts of candidates; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_SEEDS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Sets(NamedTuple):
    """Sorted shingle hashes of some texts, one set after another."""

    values: np.ndarray
    sizes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def sorted_by(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and values in the order of (owner, value); the owners, which are small, by radix."""
    order = np.argsort(value)
    owner = owner[order].astype(np.uint16) if owner.max(initial=0) < 65536 else owner[order]
    turn = np.argsort(owner, kind="stable")
    return owner[turn].astype(np.int64), value[order[turn]]


def shingle_sets(texts: pa.Array) -> Sets:
    """The sets of whole texts: A-Z lower-cased, words between ASCII white space."""
    n = len(texts)
    split = pc.ascii_split_whitespace(pc.fill_null(pa.concat_arrays([texts]).cast(pa.large_string()), ""))
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, map(bytes.lower, words)), np.uint64, len(words))  # bytes lower only A-Z
    empty = np.zeros(len(words), bool)
    if b"" in words:  # the ends of a text that begins or ends with white space
        empty[words.index(b"")] = True
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n), size)
    if empty.any():
        keep = ~empty[code]
        code, doc = code[keep], doc[keep]
        size = np.bincount(doc, minlength=n)
    word = hashes[code]
    start = np.cumsum(size) - size
    owners, parts = [], []
    for k in range(1, WORDS + 1):  # texts of k words have one shingle of them all; longer ones have five-word shingles
        which = np.flatnonzero(size == k) if k < WORDS else np.flatnonzero(size >= WORDS)
        many = np.ones(len(which), np.int64) if k < WORDS else size[which] - (WORDS - 1)
        at = ragged(start[which], many)
        total = np.full(len(at), k, np.uint64)
        for j in range(k):
            total += word[at + j] * _SEEDS[j]
        owners.append(np.repeat(which, many))
        parts.append(mixed(total) >> np.uint64(1))
    owner, value = np.concatenate(owners), np.concatenate(parts).astype(np.int64)
    owner, value = sorted_by(value, owner)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return Sets(value[new], np.bincount(owner[new], minlength=n))


def divided(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sets of these sizes: how many short lists are merged, and in how many of them a partner must turn up."""
    needed = -(-NUMERATOR * sizes // DENOMINATOR)
    asked = 1 + (needed - 1) // SKIP
    return np.where(sizes > 0, sizes - needed + asked, 0), asked


def asked_of(n: str) -> Column:
    """``divided``'s second number, of a column of sizes."""
    return F.expr(f"1 + (({NUMERATOR} * {n} + {DENOMINATOR - 1}) div {DENOMINATOR} - 1) div {SKIP}")


def signatures(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, n, key, MinHash values and least shingles; kind 1: a shingle that repeats in a batch, and how often."""

    def run(batches):
        for batch in sliced(batches, CHARS):
            sets = shingle_sets(batch.column(1))
            some = np.flatnonzero(sets.sizes)
            view = memoryview(np.ascontiguousarray(sets.values).view(np.uint8))
            ends = np.cumsum(sets.sizes)
            keys = [hashlib.blake2b(view[a * 8 : b * 8], digest_size=16).digest() if b > a else None for a, b in zip(sets.starts.tolist(), ends.tolist(), strict=True)]
            least = np.zeros((STARS, len(some)), np.int64)
            if len(some):
                for r in range(STARS):
                    least[r] = (np.minimum.reduceat(mixed(sets.values.astype(np.uint64) ^ _SEEDS[8 + r]), sets.starts[some]) >> np.uint64(1)).astype(np.int64)
            mins: list = [None] * batch.num_rows
            for i, row in zip(some.tolist(), least.T.tolist(), strict=True):
                mins[i] = row
            few = np.minimum(sets.sizes, LOW)
            low = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]).astype(np.int32)), pa.array(sets.values[ragged(sets.starts, few)]))
            yield rows(0, batch.column(0).cast(pa.int64()), pa.array(sets.sizes), pa.array(keys, pa.binary()), pa.array(mins, pa.list_(pa.int64())), low)
            # equal sets are one node, so they count once
            first = np.array(sorted({k: i for i, k in reversed(list(enumerate(keys))) if k}.values()), np.int64)
            values, many = np.unique(sets.values[ragged(sets.starts[first], sets.sizes[first])], return_counts=True)
            again = many > 1
            n = int(again.sum())
            yield rows(1, pa.array(values[again]), pa.array(many[again]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())))

    def rows(kind, *columns):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *columns], ["kind", "doc_id", "n", "key", "mins", "low"])

    return docs.mapInArrow(run, "kind int, doc_id long, n long, key binary, mins array<long>, low array<long>")


def shortest_lists(docs: DataFrame, frequent) -> DataFrame:
    """doc_id, n and the first shingles of its set, as many as are merged, with those that are frequent apart."""

    def run(batches):
        last = frequent.value
        for batch in sliced(batches, CHARS):
            sets = shingle_sets(batch.column(1))
            owner = np.repeat(np.arange(batch.num_rows), sets.sizes)
            value = sets.values
            at = np.minimum(np.searchsorted(last, value), max(0, len(last) - 1))
            hot = last[at] == value if len(last) else np.zeros(len(value), bool)
            key = owner * 2 + hot  # the sets are sorted by value already
            order = np.argsort(key.astype(np.uint16) if key.max(initial=0) < 65536 else key, kind="stable")
            owner, value, hot = owner[order], value[order], hot[order]
            pick = ragged(sets.starts, divided(sets.sizes)[0])
            owner, value, hot = owner[pick], value[pick], hot[pick]
            lists = []
            for which in (~hot, hot):
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[which], minlength=batch.num_rows))])
                lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(value[which])))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets.sizes), *lists], ["doc_id", "n", "short", "long"])

    return docs.mapInArrow(run, "doc_id long, n long, short array<long>, long array<long>")


def across(entries: DataFrame) -> DataFrame:
    """The merge of the short lists: (a, b, many, asked) of pairs of nodes, and (token) alone of lists to be searched otherwise.

    ``entries`` has token, node, part and n.  Lists are read as sorted runs.  A
    pair of different parts and of fitting sizes counts once for each list that
    holds both; ``many`` is what one task counted, ``asked`` the sum it needs.
    """

    def counts(token, node, part, n, size, new):
        """Pairs of all given runs, by their starts and sizes, with their occurrences."""
        known, code = np.unique(node, return_inverse=True)
        asked = divided(n)[1]
        keys, needs = [], []
        for s in np.unique(size[size > 1]).tolist():  # lists of equal length at once
            base = new[size == s]
            for step in range(1, s):
                a = (base[:, None] + np.arange(s - step)).ravel()
                b = a + step
                ok = (part[a] != part[b]) & (DENOMINATOR * np.minimum(n[a], n[b]) >= NUMERATOR * np.maximum(n[a], n[b]))
                a, b = a[ok], b[ok]
                keys.append(np.minimum(code[a], code[b]) * len(known) + np.maximum(code[a], code[b]))
                needs.append(np.minimum(asked[a], asked[b]))
        if not keys:
            return pairs_of(*(np.zeros(0, np.int64),) * 4)
        key, first, many = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
        return pairs_of(known[key // max(1, len(known))], known[key % max(1, len(known))], many, np.concatenate(needs)[first])

    def pairs_of(a, b, many, asked):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x.astype(np.int64))) for x in (a, b, many, asked)] + [pa.nulls(len(a), pa.int64())], ["a", "b", "many", "asked", "token"])

    def tokens_of(token):
        nothing = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([nothing] * 4 + [pa.array(np.ascontiguousarray(token))], ["a", "b", "many", "asked", "token"])

    def run(batches):
        held = np.zeros((4, 0), np.int64)
        apart: set[int] = set()  # tokens whose lists are not merged here

        def work(rows):
            token = rows[0]
            new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(new, len(token)))
            other = (size > HOT) | np.isin(token[new], list(apart))
            yield tokens_of(token[new[other]])
            yield counts(*rows, size[~other], new[~other])

        for batch in batches:
            more = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if more.shape[1] and not apart:
                apart.add(int(more[0, 0]))  # a list may begin in the task before
            held = np.hstack([held, more])
            while held.shape[1] >= 100_000:
                cut = int(np.searchsorted(held[0], held[0, -1]))  # the last run may go on
                if not cut:  # nothing but one long list, of which one entry stands for all
                    apart.add(int(held[0, 0]))
                    held = held[:, -1:]
                    break
                cut = int(np.searchsorted(held[0], held[0, min(cut, 100_000) - 1], side="right"))
                yield from work(held[:, :cut])
                held = held[:, cut:]
        if held.shape[1]:
            apart.add(int(held[0, -1]))  # or go on in the task after
            yield from work(held)

    dealt = entries.select("token", "node", "part", "n")
    dealt = dealt.repartitionByRange(shuffle_partitions(entries.sparkSession), "token", "node").sortWithinPartitions("token", "node")
    return dealt.mapInArrow(run, "a long, b long, many long, asked long, token long")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs``, without those that are not in ``ids`` (doc_id) if these are few enough to be broadcast."""
    ids = bounded(ids)
    return docs.join(ids[0], "doc_id", "left_semi") if ids[1] else docs


def bounded(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df``, to be broadcast if its rows are counted to be few, and whether they are."""
    small = df.count() <= BROADCAST_IDS
    return (F.broadcast(df) if small else df), small


def linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents whose sets are alike enough, by their whole texts."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                coded = pa.concat_arrays([part.column(2), part.column(3)]).dictionary_encode()
                sets = shingle_sets(coded.dictionary)
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                left, right = code[: part.num_rows], code[part.num_rows :]
                # binary probes: each shingle of the left set in the right one, all pairs at once
                asked = ragged(sets.starts[left], sets.sizes[left])
                value, pair = sets.values[asked], np.repeat(np.arange(part.num_rows), sets.sizes[left])
                low, high = sets.starts[right][pair], (sets.starts + sets.sizes)[right][pair]
                end = high.copy()
                while (low < high).any():
                    mid = (low + high) // 2
                    less = (low < high) & (sets.values[np.minimum(mid, len(sets.values) - 1)] < value)
                    low, high = np.where(less, mid + 1, low), np.where(less, high, np.minimum(mid, high))
                hit = (low < end) & (sets.values[np.minimum(low, len(sets.values) - 1)] == value)
                shared = np.bincount(pair[hit], minlength=part.num_rows)
                union = sets.sizes[left] + sets.sizes[right] - shared
                ok = pa.array((DENOMINATOR * shared >= NUMERATOR * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["a", "b"])

    pairs = checkpointed(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    docs = texts_of(docs, ids)
    left, right = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), docs.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    texts = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return checkpointed(texts.mapInArrow(run, "a long, b long").distinct())


def between(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that tie the parts of each family together; members have node, n, family and part.

    A family is cut into bands of sizes, of which only neighbours can hold links,
    and these into blocks, a large part into blocks of its own.  Each two blocks
    are compared in a task of their own, but not two of one part.
    Overlaps are counted for all pairs at once from the shingles that both
    blocks know.  Of the links found only as many leave as join parts anew.
    """
    sizes = members.groupBy("family", "part").agg(F.count("*").alias("size"))
    # sizes of a link differ by a quarter at most, so its bands by one
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DENOMINATOR / NUMERATOR) + 1e-9)).cast("int")
    held = members.join(sizes, ["family", "part"]).withColumn("group", F.when(F.col("size") >= BLOCK, F.col("part"))).withColumn("band", band)
    groups = held.groupBy("family", "group", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    same = (F.col("h.family") == F.col("g.family")) & (F.col("h.band") == F.col("g.band")) & F.col("h.group").eqNullSafe(F.col("g.group"))
    block = F.pmod(F.xxhash64("h.node"), F.col("g.blocks")).cast("int").alias("block")
    dealt = held.alias("h").join(groups.alias("g"), same).select("h.family", "h.group", "h.band", "h.part", "h.node", block)
    blocks = groups.select("family", "group", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    name = F.concat_ws("/", F.coalesce(F.col("group").cast("string"), F.lit("-")), "band", "block")
    named, blocks = dealt.withColumn("name", name), checkpointed(blocks.withColumn("name", name))
    left, right = (blocks.select("family", F.col("band").alias(f"b{k}"), F.col("group").alias(f"g{k}"), F.col("name").alias(f"n{k}")) for k in (1, 2))
    left = left.withColumn("b2", F.explode(F.array("b1", F.col("b1") + 1)))
    meet = left.join(right, ["family", "b2"]).where("(b1 < b2 OR n1 <= n2) AND NOT coalesce(g1 = g2, false)")
    meet = meet.select("family", F.explode(F.array_distinct(F.array("n1", "n2"))).alias("name"), F.concat_ws(" ", "n1", "n2").alias("pair"))
    texts = named.join(texts_of(docs, members.select(F.col("node").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "node"), "node").select("family", "name", "node", "part", "text")
    rows = texts.join(meet, ["family", "name"]).select("family", "pair", "name", "node", "part", "text")

    def compare(table):
        table = table.combine_chunks()
        node, part, name = (table.column(c).to_numpy() for c in ("node", "part", "name"))
        sets = shingle_sets(pa.concat_arrays(table.column("text").chunks))
        owner = np.repeat(np.arange(len(node)), sets.sizes)
        _, code, many = np.unique(sets.values, return_inverse=True, return_counts=True)
        shared = many[code] > 1
        owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
        overlap = np.zeros((len(node), len(node)))
        for at in range(0, int(code.max(initial=-1)) + 1, 4096):  # a bounded stretch of shingles at a time
            some = (code >= at) & (code < at + 4096)
            holds = np.zeros((len(node), 4096), np.float32)
            holds[owner[some], code[some] - at] = 1
            overlap += holds @ holds.T
        n = sets.sizes
        alike = (DENOMINATOR * overlap >= NUMERATOR * (n[:, None] + n[None, :] - overlap)) & (part[:, None] != part[None, :]) & (n[:, None] > 0)
        if name.min() != name.max():
            alike &= name[:, None] != name[None, :]
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(alike)), strict=True):
            a, b = find(part[i]), find(part[j])
            if a != b:
                root[a] = b
                out.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return checkpointed(rows.groupBy("family", "pair").applyInArrow(compare, "a long, b long"))


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with the part (least node of the component) by the edges so far."""
    parts = components(edges)
    return nodes.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = checkpointed(signatures(docs))
    own = seen.where("kind = 0").drop("kind")
    counted = seen.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    frequent = counted.orderBy(F.desc("n"), "doc_id").limit(FREQUENT).select("doc_id").toPandas()["doc_id"].to_numpy(np.int64)
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(frequent))

    # one node for each different set: the least document that has it
    sets = own.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.min("mins").alias("mins"), F.min("low").alias("low"))
    sets = checkpointed(sets)
    nodes = sets.where("node is not null")
    every = nodes.select("node").distinct()

    # each node against the least node that shares one of its MinHash values, if their least shingles are alike
    shared = nodes.select("node", "low", F.posexplode("mins").alias("r", "value"))
    leaders = shared.groupBy("r", "value").agg(F.min(F.struct("node", "low")).alias("leader"), F.count("*").alias("many")).where("many > 1")
    alike = F.size(F.array_intersect("low", "leader.low")) >= F.least(F.lit(LOW_SHARED), (F.size("low") + 1) / 2)
    stars = shared.join(leaders, ["r", "value"]).where((F.col("node") != F.col("leader.node")) & alike)
    edges = linked(stars.select(F.col("leader.node").alias("a"), F.col("node").alias("b")).distinct(), docs)
    parted = checkpointed(labelled(nodes.select("node", "n").distinct(), edges))

    # occurrences in the short lists
    lists = shortest_lists(docs, frequent).join(parted.withColumnRenamed("node", "doc_id").drop("n"), "doc_id")
    lists = checkpointed(lists.select(F.col("doc_id").alias("node"), "part", "n", "short", "long"))
    short = lists.select(F.explode("short").alias("token"), "node", "part", "n")
    merged = checkpointed(across(short))
    hot = merged.where("token is not null").select("token").distinct()
    hot = short.select("token", "node", "n").join(bounded(hot)[0], "token", "left_semi").unionByName(lists.select(F.explode("long").alias("token"), "node", "n"))
    hot = checkpointed(hot.groupBy("node", "n").agg(F.collect_list("token").alias("tokens")))  # no more than a set's merged ones
    # what short lists lack of the occurrences, hot ones may hold
    most = bounded(checkpointed(hot.select("node", F.size("tokens").alias("most"))))[0]
    candidates = merged.where("token is null").groupBy("a", "b").agg(F.sum("many").alias("many"), F.min("asked").alias("asked"))
    for side in ("a", "b"):
        candidates = candidates.join(most.select(F.col("node").alias(side), F.col("most").alias(f"most_{side}")), side, "left")
    nothing = F.lit(0)
    candidates = candidates.where(F.col("many") + F.least(F.coalesce("most_a", nothing), F.coalesce("most_b", nothing)) >= F.col("asked"))
    edges = edges.unionByName(linked(candidates.select("a", "b"), docs))

    for turn in range(STAR_ROUNDS + 1):
        parts = checkpointed(labelled(every, edges))
        now = hot.join(parts, "node").select(F.explode("tokens").alias("token"), "node", "n", "part")
        apart = now.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "part", "n")).alias("one")).where("low <> high")
        now = now.join(bounded(checkpointed(apart.select("token", "one")))[0], "token").select("node", "n", "part", "one")
        if turn < STAR_ROUNDS:  # a star around some node of the lists
            fits = DENOMINATOR * F.least("n", "one.n") >= NUMERATOR * F.greatest("n", "one.n")
            star = now.where((F.col("part") != F.col("one.part")) & fits).groupBy("node", F.col("one.node").alias("other"), "n").agg(F.count("*").alias("many"))
            star = star.where(F.col("many") * 2 >= asked_of("n")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
            edges = edges.unionByName(linked(star, docs))
        else:  # nodes that lists which are still apart bring together form a family
            held = now.groupBy("node", "n", "part").agg(F.count("*").alias("many"), F.collect_set("one.node").alias("others"))
            # the smallest partner asks the least
            held = checkpointed(held.where(F.col("many") >= asked_of(f"(({NUMERATOR} * n + {DENOMINATOR - 1}) div {DENOMINATOR})")))
            # the list's node need not be held itself, so it only names the family
            met = components(held.select(F.col("node").alias("a"), F.explode("others").alias("b")).where("a <> b"))
            family = held.drop("others", "many").join(met.withColumnRenamed("component", "family"), "node")
            edges = edges.unionByName(between(checkpointed(family), docs))

    parts = labelled(every, edges)
    named = sets.join(parts, "node", "left").select("key", F.coalesce("part", "node").alias("component_id"))
    whole = own.join(named, "key", "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
