"""Language identification by error-correcting output codes.

Every language has a codeword, and one binary classifier on character n-grams predicts each bit. A
text's margins are compared with every codeword by a loss in which each classifier counts as much as
it is worth for that language (its accuracy there in training); the nearest codeword wins, and where
the runner-up is almost as near the text is flagged as ambiguous.

Classifiers are linear in n-gram frequencies, so the margins of a text are sums over its words, and
each distinct word is looked at once for each task. One task trains, on a bounded sample drawn by a hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keelson.llm.common import batches, fit_in_task, held_out, lists, tidy
from keelson.session import ship

#: Documents that are learned from at most: of a language, of all, and bytes of the latter; languages at most.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_BYTES, LANGUAGES = 400, 4000, 64_000_000, 500
#: Buckets of n-grams, lengths of n-grams.
BUCKETS, NGRAMS = 1 << 13, (1, 2, 3)
#: Classifiers at most, steps and rate of training, decay of the weights.
MAX_BITS, STEPS, RATE, DECAY = 31, 150, 0.5, 1e-4
#: Texts whose two nearest codewords have probabilities closer than this are ambiguous.
AMBIGUITY = 0.2
UNDETERMINED = "und"
REMEMBERED_WORDS, LONGEST_REMEMBERED = 150_000, 48
WORD = re.compile(r"[^\W\d_]+")  # letters, and numbers like ½ that aren't digits


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; what else counts as a word character, as ½ and ², divides them."""
    found = WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [run for word in found for run in ("".join(c if c.isalpha() else " " for c in word)).split()]


class Ngrams:
    """Buckets of a word's character n-grams, with marks for its ends."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self._known: dict[str, int] = {}

    def of(self, word: str) -> list[int]:
        known, w, out = self._known, f"<{word}>", []
        for n in NGRAMS:
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                b = known.get(g)
                if b is None:
                    b = zlib.crc32(g.encode("utf-8", "replace")) % self.buckets
                    if len(known) < 200_000:
                        known[g] = b
                out.append(b)
        return out


def codewords(n: int, bits: int | None = None) -> np.ndarray:
    """Codewords (+1 or -1) of ``n`` languages: exhaustive up to 5, else random with a wide distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = range(1, 1 << (n - 1))
        return np.array([[1 if n - 1 == i or not c >> i & 1 else -1 for c in columns] for i in range(n)], float)
    rng, bits = np.random.default_rng(7), bits or min(MAX_BITS, 10 * int(np.ceil(np.log2(n))))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        near = ((code[:, None] != code[None]).sum(2) + bits * 2 * np.eye(n)).min()
        if near > far:
            best, far = code, near
    return best


@dataclass
class Model:
    """Learned languages, their codewords, each classifier's worth for them, and the classifiers."""

    langs: list[str]
    code: np.ndarray
    worth: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    sharpness: float = 1.0

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Probabilities of the languages from their loss-weighted distances to the margins."""
        loss = np.log1p(np.exp(-np.clip(self.code[None] * margins[:, None], -30, 30)))
        far = (loss * self.worth[None]).sum(2)
        p = np.exp(-(far - far.min(1, keepdims=True)) * self.sharpness)
        return p / p.sum(1, keepdims=True)


def frequencies(texts: list[str | None], ngrams: Ngrams) -> list[np.ndarray]:
    """Buckets of all n-grams of each text."""
    return [np.array([b for w in words_of(t) for b in ngrams.of(w)], np.int64) for t in texts]


def training_rows(
    docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS, bytes_: int = SAMPLE_BYTES
) -> DataFrame:
    """lang and sparse n-gram frequencies of the sampled documents that may be learned from.

    The ``LANGUAGES`` with most documents are learned. Each language gives at most about ``per_language`` rows, fewer if there are many languages, so that all of
    them have at most about ``rows`` rows, and ``bytes_`` bytes of text at most for each of those rows' share.
    """
    seen = docs.where(~held_out("doc_id") & F.col("lang").isNotNull()).select(
        F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("key"),
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
    )
    counts = seen.groupBy("lang").agg(F.count("*").alias("_n"), F.sum(F.octet_length("text")).alias("_bytes")).orderBy(F.col("_n").desc(), "lang").limit(LANGUAGES)
    all_langs = F.count("*").over(Window.partitionBy())
    bound = F.least(F.lit(float(per_language)), rows / all_langs)
    share = F.least(F.lit(1.0), bound / F.col("_n"), bytes_ / rows * bound / F.greatest("_bytes", F.lit(1)))
    shares = counts.select("lang", (share * (1 << 30)).cast("long").alias("_share"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "key"), 34)
    chosen = seen.join(F.broadcast(shares), "lang").where(place < F.col("_share")).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("share", pa.list_(pa.float32()))])

    def features(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = Ngrams()
        for batch in batches(stream):
            at, share = [], []
            for found in frequencies(batch.column("text").to_pylist(), ngrams):
                which, n = np.unique(found, return_counts=True)
                at.append(which.astype(np.int32))
                share.append((n / max(1, found.size)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(at, schema.field(1).type), pa.array(share, schema.field(2).type)], schema=schema)

    ship(docs.sparkSession)
    return chosen.mapInArrow(tidy(features), "lang string, at array<int>, share array<float>")


def fit(rows: pa.Table) -> Model:
    """Trains the classifiers by full-batch logistic regression on frequencies, in an order of the rows' own."""
    found = [r for r in zip(rows.column("lang").to_pylist(), lists(rows.column("at")), lists(rows.column("share"))) if len(r[1])]
    found.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    labels = np.array([lang for lang, _, _ in found], object)
    langs = sorted(set(labels))
    code = codewords(len(langs))
    of = np.array([langs.index(v) for v in labels], np.int64)
    x = np.zeros((len(found), BUCKETS), np.float32)
    for i, (_, at, share) in enumerate(found):
        x[i, at] = share
    size = np.mean([np.dot(share, share) for _, _, share in found]) if found else 0.0
    y = code[of] if len(found) else np.zeros((0, code.shape[1]))
    scale = np.float32(1 / max(1e-9, np.sqrt(size))) if len(found) else np.float32(1)
    x *= scale
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    balance = (1 / np.bincount(of, minlength=len(langs))[of]).astype(np.float32) if len(found) else np.zeros(0, np.float32)
    balance = (balance / max(balance.sum(), 1e-9))[:, None]
    for step in range(1, STEPS + 1 if len(langs) > 1 else 0):
        z = x @ w + b
        g = -y / (1 + np.exp(np.clip(y * z, -30, 30))) * balance
        gw = x.T @ g.astype(np.float32) + DECAY * w
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= 2 * g.sum(0)
    z = x @ w + b
    worth = np.ones_like(code)
    for i in range(len(langs)):
        worth[i] = (z[of == i] * code[i] > 0).mean(0) + 1e-3
    worth /= worth.sum(1, keepdims=True) / code.shape[1] if worth.size else 1
    return Model(langs, code, worth, w * scale, b)


class Scorer:
    """Margins of texts; remembers the summed weights of each distinct word."""

    def __init__(self, model: Model):
        self.model, self._ngrams = model, Ngrams()
        self._at: dict[str, int] = {}
        self._sums = np.zeros((1024, model.weights.shape[1] + 1), np.float32)

    def _learn(self, words: list[str]) -> None:
        found = [self._ngrams.of(w) for w in words]
        starts = np.cumsum([0, *[len(f) for f in found]])
        values = self.model.weights[np.concatenate([np.array(f, np.int64) for f in found])]
        sums = np.add.reduceat(values, starts[:-1], axis=0)
        n = len(self._at)
        while n + len(words) > len(self._sums):
            self._sums = np.concatenate([self._sums, np.zeros_like(self._sums)])
        self._sums[n : n + len(words), :-1] = sums
        self._sums[n : n + len(words), -1] = np.diff(starts)
        self._at.update(zip(words, range(n, n + len(words))))

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Margins of each text, and how many n-grams it has."""
        if len(self._at) > REMEMBERED_WORDS:
            self._at.clear()
            self._sums = np.zeros((1024, self._sums.shape[1]), np.float32)
        parts = [words_of(t) for t in texts]
        new = [w for w in set().union(*parts) if w not in self._at]
        if new:
            self._learn(new)
        at, sums = self._at, self._sums
        total = np.stack([sums[[at[w] for w in words]].sum(0, dtype=np.float64) if words else np.zeros(sums.shape[1]) for words in parts])
        for w in new:
            if len(w) > LONGEST_REMEMBERED:
                del at[w]
        n = total[:, -1]
        return total[:, :-1] / np.maximum(n, 1)[:, None] + self.model.bias, n


SCHEMA = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, score (its probability) and ambiguous.

    Only the text decides, all of it. A text that is null, empty or without a letter is ``und`` with
    score 0, as is every text if no language was learned; with one learned language, that one is
    predicted. Equal texts get equal results. Columns of ``docs`` with these names are replaced.
    """
    kept = docs.drop("lang_pred", "score", "ambiguous")
    out = T.StructType([*kept.schema.fields, *SCHEMA.fields])
    langs = np.array(model.langs or [UNDETERMINED], object)

    def predict(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches(stream):
            margins, n = scorer.margins(pa.array(batch.column("text")).cast(pa.string()).to_pylist())
            p = model.decode(margins) if model.langs else np.zeros((len(n), 1))
            best, known = p.argmax(1), (n > 0) & bool(model.langs)
            top = np.sort(p, 1)[:, ::-1]
            gap = top[:, 0] - top[:, 1] if p.shape[1] > 1 else np.ones(len(n))
            columns = [
                pa.array(np.where(known, langs[best], UNDETERMINED), pa.string()),
                pa.array(np.where(known, top[:, 0], 0.0)),
                pa.array(~known | (gap < AMBIGUITY)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *SCHEMA.names])

    ship(kept.sparkSession)
    return kept.mapInArrow(tidy(predict), out)


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """The model learned from ``docs``: text and lang of rows that aren't held out."""
    return fit_in_task(training_rows(docs, per_language), fit)
