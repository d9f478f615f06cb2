"""The quality model's features and fit against plain versions."""

import random

import numpy as np
from conftest_llm import prose, texts

from leafmill.llm import quality


def plain_features(text):
    """Counted byte by byte and word by word."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * 18
    kinds = [0] * 11
    for b in raw:
        c = chr(b)
        if b >= 128:
            k = 10
        elif "A" <= c <= "Z":
            k = 0
        elif "a" <= c <= "z":
            k = 1
        elif "0" <= c <= "9":
            k = 2
        elif c == " ":
            k = 3
        elif c == "\n":
            k = 4
        elif c in "\t\r\x0b\x0c":
            k = 5
        elif c in ".,;:?'\"":
            k = 6
        elif c == "|":
            k = 7
        else:
            k = 9 if c in "!#$%&*+-/<=>@[\\]^_`{}~()" else 8
        kinds[k] += 1
    words, word = [], b""
    for b in raw + b" ":
        if b in b" \t\n\r\x0b\x0c":
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    alnum = lambda b: chr(b).isalnum() and b < 128
    m = max(1, len(words))
    twice = sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    shouted = sum(any(65 <= b <= 90 for b in w) and not any(97 <= b <= 122 for b in w) for w in words)
    marked = sum(w[-1] < 128 and not alnum(w[-1]) and chr(w[-1]) not in ".,;:?" for w in words)
    lone = sum(w[0] < 128 and not alnum(w[0]) for w in words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [k / len(raw) for k in kinds] + [len(set(words)) / m, len(set(words)) / m**0.8, twice / m, shouted / m, marked / m, lone / m, len(set(lines)) / max(1, len(lines))]


def test_features():
    for text in [*texts(), "ÀB|| C\t\x0b{x} |a| !\x01", "\ud800 lone"]:
        assert np.allclose(quality.features(text), plain_features(text)), text


def plain_fit(rows, good, decay=1e-3):
    """Gradient descent on the loss of every pair of a good and a bad row, and the borders that err least."""
    x = np.hstack([rows, np.sqrt(rows)])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    x = (x - mean) / scale
    d = (x[good][:, None] - x[~good][None]).reshape(-1, x.shape[1])
    w, rate = np.zeros(x.shape[1]), 0.1
    for _ in range(20_000):
        lost = 1 / (1 + np.exp(d @ w))
        w += rate * ((d * lost[:, None]).mean(axis=0) - decay * w)
    s = x @ w
    borders = sorted(set(s))
    wrong = {a: (s[good] < a).mean() + (s[~good] >= a).mean() for a in borders}
    return w, s, min(wrong.values())


def test_fit():
    r = random.Random(3)
    junk = lambda: "".join(r.choice("@#|<>AB1 \n!") for _ in range(200)) + " " + prose(r.randrange(999), r.choice([2, 60]))
    rows = np.array([quality.features(prose(k, 60) if k % 2 else junk()) for k in range(80)])
    good = np.array([bool(k % 2) ^ (k % 19 == 0) for k in range(80)])  # some labels are wrong
    model = quality.fit(rows, good)
    w, s, least = plain_fit(rows, good)
    mine = ((quality.spread(rows) - model.mean) / model.scale) @ model.weights
    rank = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(rank(mine), rank(s))[0, 1] > 0.99
    assert np.corrcoef(model.weights, w)[0, 1] > 0.99
    called = model.score(rows) >= quality.CUT
    assert (~called[good]).mean() + called[~good].mean() <= least + 0.02
