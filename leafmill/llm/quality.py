"""Operator 10: a quality classifier by Bradley-Terry pairwise ranking.

A document's features are statistics of its whole text.  Scores are linear in
the standardised features; the weights maximise the likelihood that the better
document of a preference pair (label 1 against label 0) scores higher, which is
logistic loss on feature differences.  The cut between good and bad is the
quantile of the training scores that errs least, and the reported score is the
logistic of the distance from it, so that 0.3 is that cut.

Training reads at most ``TRAIN_ROWS`` labelled rows of each class, chosen by
hash; every document is scored.

Defined edge cases: a null or empty text has all features zero and gets a score
like any other; repeated rows score alike; rows without a doc_id are scored and
never held out; with no labels of one of the classes every score is 0.5; an
empty table gives an empty result; only ``doc_id`` and ``text`` are inputs, so
extra columns never clash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.bpe import sliced

#: The most labelled rows of each class that training reads.
TRAIN_ROWS = 8000
#: Preference pairs drawn for training.
PAIRS = 100_000
#: A document is kept from this score on.
CUT = 0.3
HELD_OUT = 5

#: Bytes by kind: upper case, lower case, digits, blanks, line ends, other white space, sentence marks, other marks.
_KINDS = np.full(256, 8)
for _k, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), b" ", b"\n", b"\t\r\x0b\x0c", b".,;:?'\"", b"|")):
    _KINDS[list(_set)] = _k
_KINDS[list(b"!#$%&*+-/<=>@[\\]^_`{}~()")] = 9
_KINDS[128:] = 10


def features(text: str | None) -> list[float]:
    """Statistics of one text; shares are of its bytes, words or lines."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * 18
    n = len(raw)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=11) / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m, distinct = max(1, len(words)), set(words)
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    shouted = sum(w.isupper() for w in words)
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,;:?" for w in words)
    lone = sum(not w[:1].isalnum() and w[0] < 128 for w in words)
    return [
        *kinds.tolist(),
        len(distinct) / m,
        len(distinct) / m**0.8,
        twice / m,
        shouted / m,
        marked / m,
        lone / m,
        len(set(lines)) / max(1, len(lines)),
    ]


def spread(rows: np.ndarray) -> np.ndarray:
    """The features with their square roots, which open up small shares."""
    return np.hstack([rows, np.sqrt(rows)])


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(rows), 0.5)
        far = (((spread(rows) - self.mean) / self.scale) @ self.weights - self.cut) * self.slope
        return 1 / (1 + np.exp(-np.clip(far + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(rows: np.ndarray, good: np.ndarray, pairs: int = PAIRS, decay: float = 1e-3) -> Model:
    """Weights by Newton steps on the pairwise loss, then the quantile that errs least."""
    if not good.any() or good.all():
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, 1.0)
    x = spread(rows)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    x = (x - mean) / scale
    draw = np.random.default_rng(7)
    d = x[draw.choice(np.flatnonzero(good), pairs)] - x[draw.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        lost = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        slope = d.T @ lost / pairs - decay * w
        bend = (d * (lost * (1 - lost))[:, None]).T @ d / pairs + decay * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = x @ w
    order = np.argsort(s, kind="stable")
    ranked, ok = s[order], good[order]
    # balanced errors if the k lowest are called bad; only borders between different scores count
    wrong = np.concatenate([[0], np.cumsum(ok)]) / ok.sum() + (1 - np.concatenate([[0], np.cumsum(~ok)]) / (~ok).sum())
    k = 1 + int(np.argmin(np.where(ranked[1:] > ranked[:-1], wrong[1:-1], 9)))
    # of the quantiles that err alike, the middle one
    same = np.flatnonzero(np.isclose(wrong[1:-1], wrong[k]) & (ranked[1:] > ranked[:-1])) + 1
    k = int(same[len(same) // 2])
    return Model(mean, scale, w, float((ranked[k - 1] + ranked[k]) / 2), 4 / max(1e-9, float(np.std(s))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model of ``labels.quality`` from the rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("at", F.xxhash64("doc_id"))
    # two sorts with a limit, whose tasks keep ``most`` rows each
    chosen = [known.where(F.col("quality") == q).orderBy("at", "doc_id").limit(most) for q in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).select("doc_id", "quality")
    # at most 2 * most small rows, so this side's size is bounded
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in sliced(batches):
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "quality", "row"])

    # repeated doc_ids would pass the bound: one of their rows, whichever has the least features
    seen = texts.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, row array<double>")
    got = seen.groupBy("doc_id", "quality").agg(F.min("row").alias("row")).toPandas().sort_values("doc_id")
    if not len(got):
        return fit(np.zeros((0, 18)), np.zeros(0, bool))
    return fit(np.array(got["row"].tolist()), got["quality"].to_numpy() == 1)


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """All rows and columns of ``docs`` with one more, ``name``, from 0 to 1."""
    from pyspark.sql.types import DoubleType, StructType

    place = docs.columns.index("text")
    schema = StructType([*docs.schema.fields]).add(name, DoubleType())

    def run(batches):
        for batch in sliced(batches):
            rows = np.array([features(t) for t in batch.column(place).to_pylist()]).reshape(-1, 18)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(rows))], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))
