r"""Operator 1: secret scans by one combined deterministic automaton.

Each rule has a *probe*, the shortest form of a match, and a *whole*, its
longest form.  The probes of all rules are compiled together: an NFA over
bytes, subset construction, minimisation, one transition array.  One pass over
the bytes of a batch then finds the ends of all probes of all rules.  The pass
runs in lock step over thousands of lanes; a lane starts right after a byte
that takes every state to the start state, so cutting changes nothing.  Stretches
without such a byte are cut anywhere: their lanes are first read from every state
that turns up at a lane's end, which tells the state each begins in.  At each
hit the reversed probe gives the start of the match, the whole's own automaton
its longest end.  Matches of a kind are leftmost and non-overlapping; those that
are too short are dropped after they have used up their text.

Beside the base kinds there are tokens of code hosts, chats, payment and cloud
services, JSON web tokens, credentials in addresses, and private keys, from their
first line to their last one, or to the end of their base64 if that is missing.

Defined edge cases: a null text counts as empty; a text without secrets has
zero counts and an empty span list; whole texts are read however long they are;
repeated rows give repeated results; an empty table gives an empty result; only
``doc_id`` and ``text`` are read (``redact`` keeps all other columns as they
are), so extra columns never clash.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.bpe import sliced

LANES = 8192


def either(word: str) -> str:
    """A pattern for an ASCII word in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


class Rule(NamedTuple):
    kind: str
    probe: str
    whole: str
    least: int  # characters that the match, or its value where ``head`` is given, must have
    head: str = ""  # what comes before the value


_KEY = "({}|{}|{}|{}|{}_?{})".format(*map(either, ("password", "passwd", "secret", "token", "api", "key")))
_HEAD = _KEY + "[\"']?\\x20*[:=]\\x20*[\"']?"

_BEGIN = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: What stands between the lines of a private key: base64, header fields, line ends also as written in strings.
_BODY = "[A-Za-z0-9+/=:,\\\\\x20\x09\x0D\x0A]"
_FIELDS = "([\\x0D]?[\\x0A][A-Za-z-]+:[A-Za-z0-9,:\\x20-]*)*([\\x0D]?[\\x0A])?"
_AWS = "(aws_secret_access_key|AWS_SECRET_ACCESS_KEY|[sS]ecretAccessKey)[\"']?\x20*[:=]\x20*[\"']?"
#: A user and a password before the host of an address.
_USER = "://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&'()*+,;=-]+@"

#: The base kinds in the order of the contract, then those that this operator adds.
RULES = (
    Rule("assign", _HEAD + "[A-Za-z0-9+/_.=-]", _HEAD + "[A-Za-z0-9+/_.=-]+", 12, _HEAD),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16}", "[0-9a-f]+", 16),
    Rule("github", "gh[pousr]_[A-Za-z0-9]", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 32),
    Rule("pem", _BEGIN, _BEGIN + "(({0}|-{0})*-----END [A-Z ]*PRIVATE KEY-----|({1}([\x0D]?[\x0A][A-Za-z0-9+/]{{32}}[A-Za-z0-9+/=]*)+)?)".format(_BODY, _FIELDS), 27),
    Rule("stripe", "[sr]k_(live|test)_[A-Za-z0-9]", "[sr]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("google", "AIza[A-Za-z0-9_-]", "AIza[A-Za-z0-9_-]+", 39),
    Rule("gitlab", "glpat-[A-Za-z0-9_-]", "glpat-[A-Za-z0-9_-]+", 26),
    Rule("aws", _AWS + "[A-Za-z0-9+/]", _AWS + "[A-Za-z0-9+/]+", 40, _AWS),
    Rule("url", "://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&'()*+,;=-]", _USER, 8),
)
BASE = 3


def parse(pattern: str):
    """A syntax tree of ('set', bytes), ('cat', ...), ('alt', ...), ('rep', tree, least, most)."""
    at = 0

    def one() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord(c)

    def atom():
        nonlocal at
        if pattern[at] == "(":
            at += 1
            tree = alternatives()
            at += 1
            return tree
        if pattern[at] != "[":
            return ("set", frozenset({one()}))
        at += 1
        negative = pattern[at] == "^"
        at += negative
        inside: set[int] = set()
        while pattern[at] != "]":
            low = high = one()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                high = one()
            inside |= set(range(low, high + 1))
        at += 1
        return ("set", frozenset(range(256)) - inside if negative else frozenset(inside))

    def alternatives():
        nonlocal at
        options, row = [], []
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                options.append(("cat", *row))
                row = []
                continue
            tree = atom()
            while at < len(pattern) and pattern[at] in "?*+{":
                c = pattern[at]
                at += 1
                if c == "{":
                    end = pattern.index("}", at)
                    low, _, high = pattern[at:end].partition(",")
                    most = int(high) if high else None if "," in pattern[at:end] else int(low)
                    tree, at = ("rep", tree, int(low), most), end + 1
                else:
                    tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
            row.append(tree)
        options.append(("cat", *row))
        return options[0] if len(options) == 1 else ("alt", *options)

    return alternatives()


def backwards(tree):
    """The tree of the reversed strings."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", backwards(tree[1]), *tree[2:])
    parts = [backwards(t) for t in tree[1:]]
    return (tree[0], *(parts[::-1] if tree[0] == "cat" else parts))


class Nfa:
    """States with byte-set edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int) -> int:
        """The state after ``tree`` when begun at ``start``."""
        if tree[0] == "set":
            end = self.state()
            self.edges[start].append((tree[1], end))
            return end
        if tree[0] == "cat":
            for t in tree[1:]:
                start = self.add(t, start)
            return start
        end = self.state()
        if tree[0] == "alt":
            for t in tree[1:]:
                self.empty[self.add(t, start)].append(end)
            return end
        _, inner, least, most = tree
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.add(inner, start)
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa(NamedTuple):
    """Transition array of (state, byte); accept holds a bit for each rule; the start state is 0."""

    step: np.ndarray
    accept: np.ndarray
    dead: int  # the state that nothing leaves, or -1


def determinise(nfa: Nfa, start: int, again: bool) -> Dfa:
    """Subset construction and minimisation; ``again`` begins a new match at every byte."""
    first = nfa.closure([start])
    index, todo, rows, accept = {first: 0}, [first], [], []
    while todo:
        states = todo.pop(0)
        accept.append(sum({1 << nfa.accepts[s] for s in states if s in nfa.accepts}))
        targets: list[set] = [set() for _ in range(256)]
        for s in states | (first if again else frozenset()):
            for over, to in nfa.edges[s]:
                for b in over:
                    targets[b].add(to)
        row, known = [], {}
        for t in targets:
            key = frozenset(t)
            if key not in known:
                closed = nfa.closure(key) | (first if again else frozenset())
                if closed not in index:
                    index[closed] = len(index)
                    todo.append(closed)
                known[key] = index[closed]
            row.append(known[key])
        rows.append(row)
    step, accept = np.array(rows), np.array(accept)
    block = np.unique(accept, return_inverse=True)[1]
    while True:  # states stay together while they accept alike and step to the same blocks
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    names = np.full(block.max() + 1, -1)
    order = [block[0], *(b for b in range(len(names)) if b != block[0])]
    names[order] = np.arange(len(names))
    member = np.array([np.flatnonzero(block == b)[0] for b in order])
    step = names[block[step[member]]].astype(np.int32)
    accept = accept[member].astype(np.int32)
    stuck = np.flatnonzero((step == np.arange(len(step))[:, None]).all(1) & (accept == 0))
    return Dfa(step, accept, int(stuck[0]) if len(stuck) else -1)


def single(tree) -> Dfa:
    nfa = Nfa()
    start = nfa.state()
    nfa.accepts[nfa.add(tree, start)] = 0
    return determinise(nfa, start, False)


class Scanner:
    """The combined automaton of some rules, with the ones that measure its hits."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nfa = Nfa()
        start = nfa.state()
        for k, rule in enumerate(rules):
            end = nfa.add(parse(rule.probe), start)
            nfa.accepts[end] = k
        self.all = determinise(nfa, start, True)
        back = [parse(r.probe) for r in rules]
        self.back = [single(backwards(t)) for t in back]
        self.whole = [single(parse(r.whole)) for r in rules]
        self.head = [single(parse(r.head)) if r.head else None for r in rules]
        self.resets = (self.all.step == 0).all(axis=0)
        if not self.resets[10]:
            raise ValueError("a rule reads across line ends")

    def hits(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where probes end in a byte buffer, and the bits of the rules that end there.

        The buffer is cut into lanes that are read in lock step.  Lanes begin after
        bytes that reset every state, where there are any; a longer stretch without
        one is cut anywhere, and what state its lanes begin in is found out first.
        """
        n = len(raw)
        width = max(256, -(-n // LANES))
        resets = np.flatnonzero(self.resets[raw])
        wanted = np.searchsorted(resets, np.arange(width, n, width))
        fresh = np.unique(np.concatenate([[0], resets[wanted[wanted < len(resets)]] + 1]))
        long = np.diff(np.append(fresh, n)) > 2 * width
        cuts = [np.arange(a + width, b - width, width) for a, b in zip(fresh[long].tolist(), np.append(fresh[1:], n)[long].tolist(), strict=True)]
        starts = np.sort(np.concatenate([fresh, *cuts])).astype(np.int64)
        ends = np.append(starts[1:], n)
        state = np.zeros(len(starts), np.int32)
        if cuts:
            self._begin(raw, starts, ends, state, np.isin(starts, fresh))
        where, which = [], []
        self._read(raw, starts, ends, state, (where, which))
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        where, which = np.concatenate(where), np.concatenate(which)
        order = np.argsort(where, kind="stable")
        return where[order], which[order]

    def _begin(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray, fresh: np.ndarray) -> None:
        """Sets the states that lanes in the middle of a stretch begin in: lanes are read once from each state that turns up at a lane's end."""
        inner = np.flatnonzero(~fresh | np.append(~fresh[1:], False))  # lanes of cut stretches
        leads: dict[int, np.ndarray] = {}
        todo = {0}
        while todo:
            q = todo.pop()
            leads[q] = self._read(raw, starts[inner], ends[inner], np.full(len(inner), q, np.int32))
            todo |= set(np.unique(leads[q]).tolist()) - set(leads)
        now = 0
        for i, lane in enumerate(inner.tolist()):
            now = 0 if fresh[lane] else now
            state[lane] = now
            now = int(leads[now][i])

    def _read(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, found: tuple[list, list] | None = None) -> np.ndarray:
        """The states in which lanes end that begin in the given ones; ``found`` gets where probes end, and which."""
        order = np.argsort(starts - ends, kind="stable")
        length, starts, state = (ends - starts)[order], starts[order], first[order]
        out = np.zeros(len(order), np.int32)
        step, accept = self.all.step.ravel(), self.all.accept
        hit, live = accept != 0, len(starts)
        for t in range(int(length[0]) if len(length) else 0):
            while length[live - 1] <= t:
                live -= 1
                out[live] = state[live]
            state = step[(state[:live] << 8) + raw[starts[:live] + t]]
            if found is not None:
                got = hit[state]
                if got.any():
                    lanes = np.flatnonzero(got)
                    found[0].append(starts[lanes] + t)
                    found[1].append(accept[state[lanes]])
        out[:live] = state[:live]
        back = np.empty(len(order), np.int32)
        back[order] = out
        return back

    @staticmethod
    def longest(dfa: Dfa, text: bytes, at: int, to: int, way: int = 1) -> int:
        """Bytes of the longest match from ``at`` towards ``to``, or -1; runs of bytes that leave a state as it is are skipped at once."""
        state, best, n = 0, -1, 0
        step, accept, skips = _rows(dfa)
        while at != to:
            new = step[state][text[at]]
            if new == dfa.dead:
                break
            at += way
            n += 1
            if new == state and way == 1:
                more = skips[state].match(text, at, to).end() - at
                at += more
                n += more
            state = new
            if accept[state]:
                best = n
        return best

    def spans(self, text: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of one text, from its probes' ends."""
        out = []
        places = np.array([h[0] for h in hits], np.int64)
        flags = np.array([h[1] for h in hits], np.int64)
        for k, rule in enumerate(self.rules):
            mine = places[flags >> k & 1 == 1]
            done = i = 0
            while i < len(mine):
                at = int(mine[i])
                i += 1
                # the probe read backwards gives the start, no further than the last match
                start = at + 1 - self.longest(self.back[k], text, at, done - 1, -1)
                if start > at:
                    continue
                size = self.longest(self.whole[k], text, start, len(text))
                if size < 0:
                    continue
                done = start + size
                i = max(i, int(np.searchsorted(mine, done)))
                value = size - (self.longest(self.head[k], text, start, done) if self.head[k] else 0)
                if value >= rule.least:
                    out.append((start, k, done))
        return sorted(out)


_ROWS: dict[int, tuple] = {}


def _rows(dfa: Dfa) -> tuple[list[list[int]], list[int], list[re.Pattern]]:
    """An automaton's rows as lists, and for each state a pattern of the bytes that leave it as it is."""
    if id(dfa.step) not in _ROWS:
        kept = ["".join(f"\\x{b:02x}" for b in np.flatnonzero(row == q)) for q, row in enumerate(dfa.step)]
        _ROWS[id(dfa.step)] = dfa.step.tolist(), dfa.accept.tolist(), [re.compile(f"[{c}]*".encode() if c else b"") for c in kept], dfa.step
    return _ROWS[id(dfa.step)][:3]


@cache
def scanner() -> Scanner:
    return Scanner()


def found(texts: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
    """For each text that has some: its spans as (start, rule, end) in code points."""
    scan = scanner()
    lined = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
    offsets = np.frombuffer(lined.buffers()[1], np.int64)[lined.offset : lined.offset + len(lined) + 1]
    raw = np.frombuffer(lined.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    where, which = scan.hits(raw)
    out = {}
    doc = np.searchsorted(offsets, where, side="right") - 1
    for i in np.unique(doc).tolist():
        mine = doc == i if len(doc) < 64 else slice(*np.searchsorted(doc, [i, i + 1]))
        base, end = int(offsets[i]), int(offsets[i + 1]) - 1
        text = raw[base:end]
        spans = scan.spans(text.tobytes(), list(zip((where[mine] - base).tolist(), which[mine].tolist(), strict=True)))
        if spans:
            points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
            out[i] = [(int(points[a]), k, int(points[b])) for a, k, b in spans]
    return out


def joined(spans) -> str:
    return ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_added of every text."""

    def run(batches):
        for batch in sliced(batches):
            n = batch.num_rows
            by_row = found(batch.column(1))
            counts = np.zeros((len(RULES), n), np.int64)
            shas, strings = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
            for i, spans in by_row.items():
                for _, k, _ in spans:
                    counts[k, i] += 1
                strings[i] = joined(spans)
                shas[i] = hashlib.sha256(joined(s for s in spans if s[1] < BASE).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts[:BASE]), pa.array(shas, pa.string()), pa.array(strings, pa.string()), pa.array(counts[BASE:].sum(axis=0))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """All rows and columns of ``docs`` with every span of ``text`` replaced by its kind's mark.

    Overlapping spans are replaced together under the first one's kind.  A null
    text stays null.  ``n_chars`` is set anew where it is there and the text changed.
    """
    schema, columns = docs.schema, docs.columns
    place, count = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else -1

    def run(batches):
        for batch in sliced(batches):
            by_row = found(batch.column(place))
            if by_row:
                texts = batch.column(place).to_pylist()
                for i, spans in by_row.items():
                    parts, at = [], 0
                    for start, k, end in spans:
                        if start >= at:
                            parts += [texts[i][at:start], mark.format(RULES[k].kind)]
                        at = max(at, end)
                    texts[i] = "".join(parts) + texts[i][at:]
                arrays = batch.columns
                arrays[place] = pa.array(texts, batch.schema.field(place).type)
                if count >= 0:
                    sizes = batch.column(count).to_pylist()
                    for i in by_row:
                        sizes[i] = len(texts[i])
                    arrays[count] = pa.array(sizes, batch.schema.field(count).type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, schema)
