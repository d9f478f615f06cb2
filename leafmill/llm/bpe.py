"""Operator 5: byte-level BPE encoding and decoding by speculate-and-verify.

Speculation proposes tokens for every distinct piece by greedy longest match,
all pieces advancing in lock step through one trie.  Verification tests every
adjacent pair of proposed tokens at once: a pair is compatible when no merge
that BPE would have applied earlier crosses their border.  A piece whose tokens
are all reachable and pairwise compatible is exactly its BPE encoding; only the
other pieces undergo exact merging, also in lock step.  In a piece of more than
``LONG_PIECE`` bytes some proposal is all but sure to fail, so it is merged exactly
at once, with a heap of its pairs, which takes n log n steps.

Texts are cut at single blanks and newlines by Arrow kernels before anything is
looked up, so the work that depends on content is done once per distinct piece
of a batch.  Memory is bounded by the batch (``BATCH_CHARS`` characters, or one
text if it is longer).

Defined edge cases: a null text counts as empty; an empty text has no tokens;
repeated rows give repeated results; an empty table gives an empty result; only
``doc_id`` and ``text`` are read, so extra columns never clash.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters handled together by one worker.
BATCH_CHARS = 4_000_000
#: Pieces of more bytes are merged one by one with a heap; the result is the same.
LONG_PIECE = 256
NO_RANK = np.iinfo(np.int64).max


class IntMap:
    """Integer keys to integer values by open addressing, looked up in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            at, who = slot[free], left[free]
            self.keys[at] = keys[who]
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            left, slot = left[go], slot[go]
        return out


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every (start, length), one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Bpe:
    """A BPE vocabulary as arrays; ``encode`` turns distinct pieces into ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_alphabet()
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = suffix
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_id = np.array([vocab[c] for c in chars], np.int64)
        self.last_id = np.array([vocab[c + suffix] for c in chars], np.int64)
        size = max(vocab.values()) + 1
        self.size = size
        left, right, rank = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        a = np.array([vocab[x] for x, _ in merges], np.int64)
        b = np.array([vocab[y] for _, y in merges], np.int64)
        c = np.array([vocab[x + y] for x, y in merges], np.int64)
        order = np.arange(len(merges))
        left[c[::-1]], right[c[::-1]], rank[c[::-1]] = a[::-1], b[::-1], order[::-1]
        self.left, self.right, self.rank, self.made = left, right, rank, c
        self.pair = IntMap(a * size + b, order)
        self.ranks: dict[int, int] | None = None  # the same as a dictionary, made when a long piece needs it
        back = {ch: i for i, ch in enumerate(chars)}
        self.bytes_of: list[bytes] = [b""] * size
        whole, strings = [], []
        for token, i in vocab.items():
            ended = bool(suffix) and token.endswith(suffix)
            raw = bytes(back[ch] for ch in (token[: -len(suffix)] if ended else token))
            self.bytes_of[i] = raw
            whole.append(i)
            strings.append((raw, ended or not suffix))
        for token, i in self.added.items():
            if i >= len(self.bytes_of):
                self.bytes_of += [b""] * (i + 1 - len(self.bytes_of))
            self.bytes_of[i] = token.encode()
        self._trie(whole, strings)

    def _trie(self, ids: list[int], strings: list[tuple[bytes, bool]]) -> None:
        """Tokens that BPE can reach, by their bytes; 256 stands for the end of a piece."""
        usable = [k for k, (raw, _) in enumerate(strings) if raw]
        syms, starts = self._symbols([strings[k][0] for k in usable], np.array([strings[k][1] for k in usable]))
        got, counts = self._merge(syms, np.diff(starts))
        first = np.cumsum(counts) - counts
        alone = (counts == 1) & (got[np.minimum(first, len(got) - 1)] == np.array([ids[k] for k in usable]))
        children: dict[int, int] = {}
        token_at, nodes = {}, 1
        for k, ok in zip(usable, alone, strict=True):
            if not ok:
                continue
            raw, ended = strings[k]
            node = 0
            for step in (*raw, 256) if ended and self.suffix else raw:
                key = node * 257 + step
                if key not in children:
                    children[key] = nodes
                    nodes += 1
                node = children[key]
            token_at[node] = ids[k]
        self.step = IntMap(np.fromiter(children, np.int64, len(children)), np.fromiter(children.values(), np.int64, len(children)))
        self.token_at = np.full(nodes, -1, np.int64)
        self.token_at[list(token_at)] = list(token_at.values())

    def _symbols(self, pieces: list[bytes], closed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.byte_id[raw]
        if self.suffix:
            last = starts[1:] - 1
            last = last if closed is None else last[closed]
            ids[last] = self.last_id[raw[last]]
        return ids, starts

    def _merge(self, syms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging: each round merges the first of the lowest-ranked pairs of every piece."""
        n, done = len(lengths), []
        piece = np.repeat(np.arange(n), lengths)
        syms = syms.copy()

        def ranks(at: np.ndarray) -> np.ndarray:
            r = np.full(len(at), NO_RANK)
            ok = at + 1 < len(syms)
            ok[ok] = piece[at[ok]] == piece[at[ok] + 1]
            got = self.pair.get(syms[at[ok]] * self.size + syms[at[ok] + 1])
            r[ok] = np.where(got < 0, NO_RANK, got)
            return r

        rank = ranks(np.arange(len(syms)))
        while len(syms):
            new = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            count = np.diff(np.append(new, len(syms)))
            best = np.minimum.reduceat(rank, new)
            over = best == NO_RANK
            if over.any():
                gone = np.repeat(over, count)
                done.append((piece[gone], syms[gone]))
                syms, piece, rank = syms[~gone], piece[~gone], rank[~gone]
                new = np.cumsum(count[~over]) - count[~over]
                count, best = count[~over], best[~over]
                if not len(syms):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, count))
            owner = piece[hits]
            at = hits[np.concatenate([[True], owner[1:] != owner[:-1]])]
            syms[at] = self.made[rank[at]]
            keep = np.ones(len(syms), bool)
            keep[at + 1] = False
            syms, piece, rank = syms[keep], piece[keep], rank[keep]
            at -= np.arange(len(at))
            again = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[again] = ranks(again)
        owner = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=n)

    def _merge_long(self, syms: np.ndarray) -> np.ndarray:
        """Exact merging of one long piece: the first of the lowest-ranked pairs comes off a heap."""
        if self.ranks is None:
            held = self.pair.keys >= 0
            self.ranks = dict(zip(self.pair.keys[held].tolist(), self.pair.values[held].tolist(), strict=True))
        ranks, size, made, n = self.ranks, self.size, self.made.tolist(), len(syms)
        token, after, before = syms.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair.get(syms[:-1] * size + syms[1:])
        known = np.flatnonzero(first >= 0)
        heap = (first[known] * n + known).tolist()  # rank, then place
        heapq.heapify(heap)
        while heap:
            rank, at = divmod(heapq.heappop(heap), n)
            right = after[at]
            # what a merge has changed since it was pushed no longer has that rank
            if token[at] < 0 or right >= n or ranks.get(token[at] * size + token[right]) != rank:
                continue
            token[at], token[right] = made[rank], -1
            after[at] = end = after[right]
            if end < n:
                before[end] = at
                new = ranks.get(token[at] * size + token[end])
                if new is not None:
                    heapq.heappush(heap, new * n + at)
            left = before[at]
            if left >= 0:
                new = ranks.get(token[left] * size + token[at])
                if new is not None:
                    heapq.heappush(heap, new * n + left)
        out = np.array(token, np.int64)
        return out[out >= 0]

    def _speculate(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest matches: (token, piece) in order, and which pieces got stuck."""
        end = b"\0" if self.suffix else b""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(end.join(pieces) + end, np.uint8).astype(np.int64)
        stop = np.cumsum(lengths + len(end))
        if self.suffix:
            raw[stop - 1] = 256
        live = np.arange(len(pieces))
        at, limit = stop - lengths - len(end), stop
        node, token, after = np.zeros(len(live), np.int64), np.full(len(live), -1), at.copy()
        stuck, out = np.zeros(len(pieces), bool), []
        while len(live):
            inside = at < limit
            nxt = np.full(len(live), -1)
            nxt[inside] = self.step.get(node[inside] * 257 + raw[at[inside]])
            go = nxt >= 0
            node = np.where(go, nxt, 0)
            at = at + go
            took = self.token_at[node] * go - ~go
            seen = took >= 0
            token, after = np.where(seen, took, token), np.where(seen, at, after)
            fail = ~go
            if fail.any():
                bad = fail & (token < 0)
                stuck[live[bad]] = True
                good = fail & ~bad
                out.append((live[good], after[good], token[good]))
                at = np.where(good, after, at)
                token = np.where(good, -1, token)
                alive = ~bad & ~(good & (at >= limit))
                if not alive.all():
                    live, at, limit, node, token, after = (x[alive] for x in (live, at, limit, node, token, after))
        owner, pos, tok = (np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.zeros(0, np.int64),) * 3
        order = np.argsort(pos, kind="stable")
        return tok[order], owner[order], stuck

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the border between tokens a and b alone.

        The two tokens are taken apart in the reverse order of their making; a
        merge across the border that ranks before the one that used up either
        side would have come first (on equal rank, the one further left does).
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        used_a, used_b = np.full(len(a), NO_RANK), np.full(len(a), NO_RANK)
        while len(live):
            cross = self.pair.get(a * self.size + b)
            wrong = (cross >= 0) & (cross < used_a) & (cross <= used_b)
            ok[live[wrong]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~wrong & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb, used_a, used_b = (x[go] for x in (live, a, b, ra, rb, used_a, used_b))
            undo_b = rb >= ra
            used_b, used_a = np.where(undo_b, rb, used_b), np.where(undo_b, used_a, ra)
            a, b = np.where(undo_b, a, self.right[a]), np.where(undo_b, self.left[b], b)
        return ok

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty pieces, one after another, and how many each has."""
        n = len(pieces)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        short = np.flatnonzero(lengths <= LONG_PIECE)
        tok, owner, stuck = self._speculate([pieces[i] for i in short]) if len(short) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(tok[inner] * self.size + tok[inner + 1], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)
        stuck[owner[inner[~fits[which]]]] = True
        good = ~stuck[owner]
        exact = short[stuck]
        parts = [(short[owner[good]], tok[good])]
        for i in np.flatnonzero(lengths > LONG_PIECE).tolist():
            got = self._merge_long(self._symbols([pieces[i]])[0])
            parts.append((np.full(len(got), i), got))
        if len(exact):
            todo = [pieces[i] for i in exact]
            syms, starts = self._symbols(todo)
            got, counts = self._merge(syms, np.diff(starts))
            parts.append((np.repeat(exact, counts), got))
        owner, ids = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=n)


#: The characters that byte-level patterns treat as white space, as a character class.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space that keeps a text from being cut at single blanks and newlines.
UNEVEN = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|[\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^[ \n]|[ \n]\z"


class ByteLevel:
    """Whole texts to ids and back for a byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        self.bpe = Bpe(path)
        # the published byte-level pattern; fixed values
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.bpe.added)) + ")") if self.bpe.added else None
        self.lengths = np.array([len(b) for b in self.bpe.bytes_of], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bpe.bytes_of), np.uint8)

    def _units(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each distinct unit; a unit is split by the pattern before merging."""
        index: dict[str, int] = {}
        owner: list[int] = []
        pieces: list[int] = []
        for i, s in enumerate(strings):
            for w in self.words.findall(s):
                owner.append(i)
                pieces.append(index.setdefault(w, len(index)))
        ids, counts = self.bpe.encode([w.encode() for w in index])
        first = np.cumsum(counts) - counts
        took = np.array(pieces, np.int64)
        per = counts[took] if len(took) else took
        sizes = np.zeros(len(strings), np.int64)
        np.add.at(sizes, np.array(owner, np.int64), per)
        return ids[ragged(first[took], per)] if len(took) else ids[:0], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's ids."""
        n = len(texts)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, UNEVEN)
        for token in self.bpe.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False)
        even = np.flatnonzero(~odd)
        doc_parts, code_parts, strings = [], [], []
        if len(even):
            lined = pc.replace_substring(texts.take(pa.array(even)), "\n", " \n ")
            split = pc.split_pattern(lined, " ")
            sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = split.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            known = coded.dictionary.to_pylist()
            newline = code == next((i for i, s in enumerate(known) if s == "\n"), -1)
            blank = np.ones(len(code), bool)
            blank[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
            blank &= ~newline
            blank[1:] &= ~newline[:-1]
            code = code * 2 + blank
            seen = np.zeros(2 * len(known), bool)
            seen[code] = True
            used, code = np.flatnonzero(seen), (np.cumsum(seen) - 1)[code]
            strings += [" " * (u & 1) + known[u >> 1] for u in used.tolist()]
            doc_parts.append(np.repeat(even, sizes))
            code_parts.append(code)
        extra: dict[str, int] = {}
        for i in np.flatnonzero(odd).tolist():
            whole = texts[i].as_py()
            row: list[int] = []
            for k, part in enumerate(self.special.split(whole) if self.special else [whole]):
                if k % 2:
                    row.append(-1 - self.bpe.added[part])
                else:
                    row += [len(strings) + extra.setdefault(w, len(extra)) for w in self.words.findall(part)]
            doc_parts.append(np.full(len(row), i))
            code_parts.append(np.array(row, np.int64))
        strings += list(extra)
        ids, sizes = self._units(strings)
        first = np.cumsum(sizes) - sizes
        names = sorted(self.bpe.added.values())
        first = np.concatenate([first, len(ids) + np.arange(len(names))])
        sizes = np.concatenate([sizes, np.ones(len(names), np.int64)])
        ids = np.concatenate([ids, np.array(names, np.int64)])
        doc = np.concatenate(doc_parts) if doc_parts else np.zeros(0, np.int64)
        code = np.concatenate(code_parts) if code_parts else doc
        for k, name in enumerate(names):
            code[code == -1 - name] = len(strings) + k
        order = np.argsort(doc, kind="stable")
        doc, code = doc[order], code[order]
        per = sizes[code]
        return ids[ragged(first[code], per)], np.bincount(doc, weights=per, minlength=n).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        return self.flat[ragged(self.starts[ids], self.lengths[ids])].tobytes()


def sliced(batches, chars: int = BATCH_CHARS):
    """Arrow record batches cut so that each holds about ``chars`` bytes of its texts.

    Every part is copied to buffers of its own: Arrow's kernels on strings misread
    the offsets of a slice that has been cast.
    """
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + chars, side="right")))
            part = batch.slice(at, to - at)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], part.schema.names)
            at = to


_LOADED: dict[tuple, object] = {}


def loaded(kind, path: str):
    """One vocabulary per worker process."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def encode_decode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids and decoded.

    ``vocabulary`` is the path of a byte-level tokenizer file, which every
    executor can open.  Special tokens in a text are recognised, as the
    tokenizers library does by default.
    """
    import hashlib

    def run(batches):
        coder = loaded(ByteLevel, vocabulary)
        for batch in sliced(batches):
            ids, sizes = coder.encode(batch.column(1))
            ends = np.cumsum(sizes)
            per_byte = np.concatenate([[0], np.cumsum(coder.lengths[ids])])
            packed, plain = memoryview(ids.astype("<u4").tobytes()), memoryview(coder.decode(ids))
            shas, texts, rows, strings = [], [], [], []
            for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                shas.append(hashlib.sha256(packed[start * 4 : end * 4]).hexdigest())
                text = plain[per_byte[start] : per_byte[end]]
                # ids that a caller altered may decode to broken UTF-8; ours are whole texts
                texts.append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    rows.append(ids[start:end].astype(np.int32))
                    strings.append(bytes(text).decode("utf-8", "replace"))
            out = [batch.column(0).cast(pa.int64()), pa.array(sizes), pa.array(shas, pa.string()), pa.array(texts, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out += [pa.array(rows, pa.list_(pa.int32())), pa.array(strings, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
