"""Quality classifier learned from trusted positives and unlabelled text (non-negative unbiased risk).

The features are shares of byte classes and hashed byte pairs, and shapes of words and lines, computed over whole texts.
A linear score is fitted on a bounded sample. First a plain classifier tells trusted texts from unlabelled ones; the
share of unlabelled texts above a low quantile of the trusted ones estimates the class prior. Then the risk
prior * R+(trusted) + max(0, R-(unlabelled) - prior * R-(trusted)) is minimised by gradient steps; a step that would push the
bracket below zero goes the other way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, with_body
from .shingles import flat_bytes, mixed, word_hashes, word_spans

#: Trusted and unlabelled texts that the model is fitted on, about at most.
TRUSTED, UNLABELLED = 6000, 12_000
PAIR_BUCKETS = 256
SHORT = 120
STEPS, RATE, DECAY = 400, 0.05, 1e-3
#: The fewer trusted texts, the more the weights are drawn to 0.
FEW = 4.0

_CLASS = np.full(256, 9, np.uint8)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"-", b"!?", b"#*$%&|<>", b"()[]{}/\\=+_@~^`")):
    _CLASS[list(_bytes)] = _k
_CLASSES = 10


def features(column: pa.Array) -> np.ndarray:
    """One row of features for each text; an empty text has zeros."""
    data, offsets = flat_bytes(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    some = np.maximum(size, 1)[:, None]
    classes = np.bincount(doc * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES) / some
    pair = np.zeros((n, PAIR_BUCKETS))
    if len(data) > 1:
        inside = doc[1:] == doc[:-1]
        code = ((data[:-1].astype(np.uint32) << 8 | data[1:]) * np.uint32(2654435761)) >> np.uint32(24)
        pair = np.bincount(doc[:-1][inside] * PAIR_BUCKETS + code[inside], minlength=n * PAIR_BUCKETS).reshape(n, PAIR_BUCKETS)
        pair = np.sqrt(pair / some)
    hashes, words = word_hashes(data, offsets)
    starts, ends = word_spans(data, offsets)
    owner = np.repeat(np.arange(n), words)
    many = np.maximum(words, 1)
    length = np.bincount(owner, ends - starts, n) / many
    spread = np.sqrt(np.maximum(np.bincount(owner, (ends - starts) ** 2.0, n) / many - length**2, 0))
    next_same = np.zeros(n)
    if len(hashes) > 1:
        twin = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
        next_same = np.bincount(owner[1:][twin], minlength=n) / many
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n) / many
    long_words = np.bincount(owner[ends - starts > 20], minlength=n) / many
    # lines: breaks, and lines equal to one before
    lines = np.bincount(doc[data == 10], minlength=n) + 1.0
    again = _repeated_lines(data, offsets, doc) / lines
    shapes = np.stack([np.log1p(size), np.log1p(words), length, spread, next_same, distinct, long_words, np.log1p(lines), again, np.log1p(size / lines)], 1)
    return np.where((size > 0)[:, None], np.concatenate([classes, shapes, pair], 1), 0).astype(np.float32)


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n)
    first = np.zeros(len(data), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    first[1:] |= data[:-1] == 10
    at = np.flatnonzero(first)
    place = np.arange(len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    weight = mixed(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    line = np.add.reduceat(np.where(data == 10, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * weight), at)
    owner = doc[at]
    keep = line != 0  # empty lines do not count as repeated
    line, owner = line[keep], owner[keep]
    order = np.lexsort((line, owner))
    twin = (owner[order][1:] == owner[order][:-1]) & (line[order][1:] == line[order][:-1])
    return np.bincount(owner[order][1:][twin], minlength=n).astype(float)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(w: np.ndarray, gradient) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Model:
    """Standardised linear score."""

    def __init__(self, trusted: np.ndarray, unlabelled: np.ndarray):
        both = np.concatenate([trusted, unlabelled]).astype(np.float64)
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-6
        p, u = self.inputs(trusted), self.inputs(unlabelled)
        w0 = np.zeros(p.shape[1])
        decay = DECAY + FEW / len(p)

        def plain(w, p=p[::2], u=u[::2]):  # logistic loss on one half, both sides with the same weight
            return (p.T @ (_sigmoid(p @ w) - 1) / len(p) + u.T @ _sigmoid(u @ w) / len(u)) / 2 + decay * w

        w = _adam(w0, plain)
        p2, u2 = (p[1::2], u[1::2]) if len(p) > 1 and len(u) > 1 else (p, u)  # the other half tells what share looks trusted
        low = np.quantile(p2 @ w, 0.02)
        self.prior = float(np.clip((u2 @ w >= low).mean() / 0.98, 0.05, 0.98))

        def risk(w):
            sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
            loss_neg = np.log1p(np.exp(np.clip(u @ w, -40, 40))).mean() - self.prior * np.log1p(np.exp(np.clip(p @ w, -40, 40))).mean()
            neg = u.T @ su / len(u) - self.prior * (p.T @ sp) / len(p)
            if loss_neg < 0:
                return -neg + decay * w
            return self.prior * (p.T @ (sp - 1)) / len(p) + neg + decay * w

        self.weights = _adam(w0, risk)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        # shares of a short text are noisy: the shorter, the closer it is taken to be to the mean
        size = np.expm1(x[:, _CLASSES : _CLASSES + 1].astype(np.float64))
        z = np.clip((x - self.mean) / self.scale, -8, 8) * (size / (size + SHORT))
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.inputs(x) @ self.weights)


MASK = (1 << 62) - 1


def hash_bar(most: int, n: int) -> int:
    """Of ``n`` rows about ``most`` have 62 bits of a hash below this number, however large ``n`` is; all have it where there are no more."""
    return MASK + 1 if n <= most else (MASK + 1) * most // n


def _rows(batches):
    for batch in slices(batches):
        x = features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["trusted", "x"])


def fit(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """``docs``: texts to learn from, taken as unlabelled; ``trusted``: ids of the positives among them. None without positives."""
    ids = trusted.select(F.col(doc_id).cast("long").alias("__id")).where("__id is not null").distinct()
    known, every = ids.count(), docs.count()
    if not known or not every:
        return None

    def part(column, salt: int, most: int, n: int):
        return F.xxhash64(column, F.lit(salt)).bitwiseAND(F.lit(MASK)) < hash_bar(most, n)

    some = F.broadcast(ids.where(part("__id", 3, TRUSTED, known)).withColumn("__p", F.lit(True)))  # about TRUSTED ids at most
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("text"), part(F.col(doc_id), 5, UNLABELLED, every).alias("__u")).join(some, "__id", "left")
    kinds = F.filter(F.array(F.when(F.col("__p"), F.lit(True)), F.when(F.col("__u"), F.lit(False))), lambda k: k.isNotNull())
    sample = rows.select(F.explode(kinds).alias("trusted"), "text").mapInArrow(_rows, "trusted boolean, x binary").toArrow().to_pandas()
    x = np.stack([np.frombuffer(b, np.float32) for b in sample["x"]]) if len(sample) else np.empty((0, 0))
    t = sample["trusted"].to_numpy(bool)
    return Model(x[t], x[~t]) if t.any() and (~t).any() else None


def _score(batches, shared, body: str, n_keep: int):
    for batch in slices(batches, body):
        s = shared.value.scores(features(batch.column(batch.schema.get_field_index(body))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(s)], names=[*batch.schema.names[:n_keep], "score"])


def classify(docs: DataFrame, learn_from: DataFrame, trusted: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    A null text is an empty one and has a score like any other. Very long texts are read whole, one slice each. Where nothing can be
    learned all scores are 0.5. Null ids, ties and repeated rows are rows like any other; columns not in ``keep`` are not carried, so their
    names cannot clash. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows, body = with_body(docs, keep, text)
    model = fit(learn_from, trusted, doc_id, text)
    if model is None:
        scored = rows.select(*keep, F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
        scored = rows.mapInArrow(lambda it: _score(it, shared, body, len(keep)), ", ".join([*fields, "score double"]))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
