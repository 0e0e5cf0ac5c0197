"""Quality classifier learned from positives and unlabelled text.

Trusted documents (label 1) are the positives, web text of unknown quality the rest. A small network
minimises the non-negative unbiased risk

    prior * E_p[loss(f, 1)] + max(0, E_u[loss(f, 0)] - prior * E_p[loss(f, 0)])

where the second part is the negatives' risk, estimated without any negative; when a step would push
it below zero, it goes the other way instead. The prior, the share of positives among the unlabelled
text, is estimated first: where a classifier of positives against unlabelled text accepts a share s_p
of held-back positives, it accepts a share s_u >= prior * s_p of unlabelled text, so the least s_u / s_p
bounds the prior. Features describe a whole text's form, not its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import batches, bounded_sample, bounded_texts, fit_in_task, held_out
from keelson.session import ship

#: Positives and unlabelled documents that are learned from at most, and bytes of each.
POSITIVES, UNLABELLED, SAMPLE_BYTES = 3000, 6000, 64_000_000
HIDDEN, STEPS, RATE, DECAY = 16, 1200, 1e-2, 1e-5
#: The same for the classifier that the prior is read from, which must not learn rows by heart.
PRIOR_STEPS, PRIOR_DECAY = 300, 1e-3
#: Probability from which a document counts as good.
THRESHOLD = 0.3
#: Words of one block when repetition is measured, so that it doesn't depend on a text's length.
BLOCK = 100

_CLASS = np.full(256, 4, np.uint8)  # by byte: 0 lower, 1 upper, 2 digit, 3 space, 4 punctuation, 5 beyond ASCII
for _range, _kind in (("az", 0), ("AZ", 1), ("09", 2)):
    _CLASS[ord(_range[0]) : ord(_range[1]) + 1] = _kind
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[128:] = 5
FEATURES = 22


def features(text: str | None) -> np.ndarray:
    """Figures of a text's form; zeros for a null text or one without words."""
    out = np.zeros(FEATURES)
    words = (text or "").split()
    if not words:
        return out
    raw = text.encode("utf-8", "replace")
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    share = np.bincount(kinds, minlength=6) / len(raw)
    out[:6] = share
    inside = kinds[1:] != kinds[:-1]
    out[6] = inside.mean() if len(inside) else 0
    out[7] = ((kinds[1:] == 4) & (kinds[:-1] == 4)).mean() if len(inside) else 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out[8], out[9], out[10] = lengths.mean() / 10, lengths.std() / 10, np.log1p(lengths.max()) / 5
    out[11] = np.log1p(len(words)) / 10
    blocks = [words[i : i + BLOCK] for i in range(0, len(words), BLOCK)]
    if len(blocks) > 1 and len(blocks[-1]) < BLOCK // 2:
        blocks[-2:] = [blocks[-2] + blocks[-1]]
    out[12] = sum(len(set(b)) / len(b) for b in blocks) / len(blocks)
    out[13] = len(set(words)) / len(words)
    out[14] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    lines = text.split("\n")
    out[15] = 1 - len(set(lines)) / len(lines)
    out[16] = np.log1p(len(lines)) / 5
    ends = [w[-1] for w in words]
    out[17] = sum(not c.isalnum() for c in ends) / len(words)
    out[18] = sum(not w[0].isalnum() for w in words) / len(words)
    out[19] = sum(w[0].isupper() for w in words) / len(words)
    out[20] = len(zlib.compress(raw, 1)) / len(raw)
    out[21] = sum(c in ".!?" for c in ends) / len(words)
    return out


@dataclass
class Model:
    """A network of one hidden layer over standardised features, and the prior it was trained with."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _train(p: np.ndarray, u: np.ndarray, gradient, seed: int, steps: int = STEPS, decay: float = DECAY) -> Model:
    """Adam on both whole samples (small batches would often misjudge the negatives' risk); ``gradient(fp, fu)`` gives the risk's slope in each output."""
    rng = np.random.default_rng(seed)
    mean, scale = u.mean(0), u.std(0) + 1e-3
    model = Model(mean, scale, rng.normal(0, 0.3, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0, 1.0)
    xp, xu = model.inputs(p), model.inputs(u)
    params = [a.astype(np.float32) for a in (model.w1, model.b1, model.w2, np.zeros(1))]
    m, v = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    x = np.concatenate([xp, xu]).astype(np.float32)
    for step in range(1, steps + 1):
        h = np.tanh(x @ params[0] + params[1])
        f = h @ params[2] + params[3]
        g = np.concatenate(gradient(f[: len(xp)], f[len(xp) :])).astype(np.float32)
        back = g[:, None] * params[2] * (1 - h * h)
        slopes = [x.T @ back + decay * params[0], back.sum(0), h.T @ g + decay * params[2], np.array([g.sum()])]
        for i, s in enumerate(slopes):
            m[i], v[i] = 0.9 * m[i] + 0.1 * s, 0.999 * v[i] + 0.001 * s**2
            params[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = params[0], params[1], params[2], float(params[3][0])
    return model


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, from rows that the classifier hasn't seen."""

    def apart(fp: np.ndarray, fu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -_sigmoid(-fp) / (2 * len(fp)), _sigmoid(fu) / (2 * len(fu))

    fp, fu = [], []
    for half in (0, 1):
        model = _train(p[half::2], u[half::2], apart, 1, PRIOR_STEPS, PRIOR_DECAY)
        fp.append(model.logits(p[1 - half :: 2]))
        fu.append(model.logits(u[1 - half :: 2]))
    fp, fu = np.sort(np.concatenate(fp)), np.sort(np.concatenate(fu))
    at = np.quantile(fp, np.linspace(0.0, 0.9, 91))
    sp, su = 1 - np.searchsorted(fp, at) / len(fp), 1 - np.searchsorted(fu, at) / len(fu)
    # shares of many rows only: a small share's error would decide otherwise
    ratios = np.where(sp > 0.5, su / np.maximum(sp, 1e-9), 1.0)
    return float(np.clip(ratios.min(), 0.02, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> Model:
    """Trains on the features of positives and unlabelled rows; without either, every score is 0.5."""
    if len(p) < 4 or len(u) < 4:
        n = FEATURES
        return Model(np.zeros(n), np.ones(n), np.zeros((n, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 0.5)
    prior = estimate_prior(p, u)

    def risk(fp: np.ndarray, fu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gu, gp = _sigmoid(fu) / len(fu), -prior * _sigmoid(fp) / len(fp)
        if negative < 0:
            return -gp, -gu
        return gp - prior * _sigmoid(-fp) / len(fp), gu

    model = _train(p, u, risk, 2)
    model.prior = prior
    return model


def _featured(rows: DataFrame, positive: bool) -> DataFrame:
    """key, x (the features of each row's text) and positive."""

    def of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            found = [features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.float64()))], ["key", "x"])

    ship(rows.sparkSession)
    return rows.mapInArrow(of, "key long, x array<double>").withColumn("positive", F.lit(int(positive)))


def learn(
    docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, bytes_: int = SAMPLE_BYTES
) -> Model:
    """The model learned from rows that aren't held out.

    Positives are the documents that ``labels`` (doc_id, quality) marks 1; a document marked more than
    once is trusted if any mark is 1. Unlabelled are documents of any kind, their marks unread. Both
    samples are bounded in rows and bytes of text; one task trains on their features.
    """
    open_ = docs.where(~held_out("doc_id")).select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    row = F.xxhash64(F.col("_id").cast("string"), "text").alias("key")
    trusted = labels.where((F.col("quality") == 1) & ~held_out("doc_id")).select(F.col("doc_id").alias("_id")).distinct()
    chosen = bounded_sample(trusted, F.col("_id"), positives, trusted.count())  # about `positives` ids
    p = open_.join(F.broadcast(chosen), "_id", "left_semi").select(row, "text")
    n, size = open_.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    u = bounded_sample(open_.select(row, "text"), F.concat_ws(" ", F.lit("u"), "key"), int(unlabelled * min(1, bytes_ / max(size or 0, 1) * max(n, 1) / unlabelled)), n)

    def train(found: pa.Table) -> Model:
        found = found.sort_by([("key", "ascending")])
        x, positive = np.array(found.column("x").to_pylist()).reshape(found.num_rows, FEATURES), found.column("positive").to_numpy() == 1
        parts = [x[positive], x[~positive]]
        return fit(*[part[np.random.default_rng(0).permutation(len(part))] for part in parts])

    return fit_in_task(_featured(bounded_texts(p, "key", positives, bytes_), True).unionByName(_featured(u, False)), train)


SCHEMA = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` with score (probability of good quality) and predicted.

    Null and empty texts have no form at all (all features 0) and are scored as such. Equal texts get
    equal scores. Columns of ``docs`` with these names are replaced.
    """
    kept = docs.drop("score", "predicted")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            texts = batch.column("text").cast(pa.string()).to_pylist()
            found = model.score(np.array([features(t) for t in texts]))
            columns = [pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *SCHEMA.names])

    ship(kept.sparkSession)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *SCHEMA.fields]))
