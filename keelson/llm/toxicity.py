"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words are cut into overlapping windows, all of them, to its end. Words with marks inside are read
whole and by the parts between the marks, long ones in pieces that overlap. Each word comes in as its
own vector (words that training saw often) plus the scaled sum of its character n-grams' (all words,
so inflected or unseen forms are read too). A gated recurrent unit runs over a window in each
direction, attention pools the states, and a text is as toxic as its most toxic window.

Labels belong to texts, not windows, so training alternates: windows of clean texts are clean, and of a
toxic text those count as toxic that hold the n-grams most peculiar to toxic texts (at first) or that
the last round found toxic (later on), at least the most suspicious one. It
runs in one task on a bounded sample, drawn by a hash, of which a part only sets the scale. When scoring, a word's vector is put through the input
weights once for each distinct word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import batches, bounded_sample, bounded_texts, fit_in_task, held_out, tidy
from keelson.session import ship

#: Labelled documents of each kind that are learned from at most, and bytes of their texts.
TOXIC, CLEAN, SAMPLE_BYTES = 1200, 3000, 24_000_000
#: Words of a window and between windows; sizes of word vectors and of each direction's state.
WINDOW, STRIDE, WIDTH, STATE = 32, 24, 16, 8
#: Texts that hold a word for it to get its own vector, such words at most, buckets and lengths of n-grams
#: anywhere in a word and at its beginning.
MIN_TEXTS, MAX_WORDS, BUCKETS, NGRAMS, BEGINNINGS = 8, 4000, 1 << 13, (3,), (5, 6, 7, 8)
#: Rounds of training, batches of each, windows of a batch, rate and decay; a quarter of the texts calibrates.
ROUNDS, BATCHES, BATCH, RATE, DECAY, CALIBRATE = 4, 250, 256, 6e-3, 1e-5, 4
#: Share of a text's greatest log odds from which words stand out, and of the words around them that are swapped.
PEAK, SWAPPED = 0.8, 0.3
THRESHOLD = 0.5
#: Words remembered, characters of a piece of a word, and those that it shares with the next piece.
REMEMBERED_WORDS, LONGEST_WORD, OVERLAP = 150_000, 40, 12


def _joining() -> str:
    """Signs that belong to the letter before them (vowel signs, accents, joiners), as ranges of a character class."""
    signs = [c for c in (*range(0x20000), *range(0xE0100, 0xE01F0)) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Cf")]
    first = [c for c, before in zip(signs, [-1, *signs]) if c != before + 1]
    last = [c for c, after in zip(signs, [*signs[1:], -1]) if c != after - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))


JOINING = _joining()
JOINED = re.compile(f"[{JOINING}]*")
PARTS = re.compile(rf"[^\W_](?:[^\W_]|[{JOINING}])*")


def words_of(text: str | None) -> list[str]:
    """Words in lower case, with the marks around them."""
    return (text or "").lower().split()


def pieces_of(word: str) -> list[str]:
    """What is read of a word: all of it but the marks around it, in pieces of at most ``LONGEST_WORD`` characters.

    Of a word with marks inside, the parts between them follow the whole. A word of marks stays itself.
    """
    if word.isalnum():
        return _cut(word)
    core = _core(word)
    if core.isalnum():  # the only part of itself
        return _cut(core)
    parts = PARTS.findall(core)
    return _cut(core) + ([] if parts == [core] else [x for part in parts for x in _cut(part)])


def _core(word: str) -> str:
    """A word without the marks around it; looked for from both ends, so in time proportional to their number."""
    begin, end = 0, len(word)
    while end and not (word[end - 1].isalnum() or word[end - 1] == "_"):
        end -= 1
    if not end:
        return word
    while not (word[begin].isalnum() or word[begin] == "_"):
        begin += 1
    return word[begin : JOINED.match(word, end).end()]


def _cut(run: str) -> list[str]:
    """Consecutive pieces of a run; each shares its last ``OVERLAP`` characters with the next one."""
    if len(run) <= LONGEST_WORD:
        return [run]
    return [run[i : i + LONGEST_WORD] for i in range(0, max(1, len(run) - OVERLAP), LONGEST_WORD - OVERLAP)]


def grams_of(words: list[str], buckets: int | None = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, one after another, and each word's number of them.

    A word's two ends count as characters. Beginnings are told apart from the same n-gram elsewhere by their mark. Without ``buckets`` the n-grams' whole hashes are returned.
    """
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes *= np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(29)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins = np.cumsum(lengths) - lengths
    counts = [np.maximum(lengths - n + 1, 0) for n in NGRAMS] + [(lengths >= n).astype(np.int64) for n in BEGINNINGS]
    sizes = np.sum(counts, axis=0)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(sizes.sum(), np.uint64)
    for n, count in zip(NGRAMS + BEGINNINGS, counts):
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(begins, count) + inside
        mixed = np.full(len(at), n, np.uint64)
        for j in range(n):
            mixed = mixed * np.uint64(0xC2B2AE3D27D4EB4F) + codes[at + j]
        out[np.repeat(starts, count) + inside] = mixed ^ (mixed >> np.uint64(31))
        starts = starts + count
    return (out % np.uint64(buckets)).astype(np.int64) if buckets else out, sizes


def windows_of(n: int) -> list[int]:
    """Starts of the windows over ``n`` words; the last one reaches the end. None for no words."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE)) if n else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Model:
    """Parameters by name, the words with vectors of their own, and the logit at which a text's score is 0.5."""

    p: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    shift: float = 0.0
    trained: bool = field(default=True)

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input part of both directions' gates for each word: (words, 2 * 3 * STATE)."""
        out = np.empty((len(words), 6 * STATE), np.float32)
        for i in range(0, len(words), 10_000):
            some = words[i : i + 10_000]
            grams, sizes = grams_of(some)
            sums = np.add.reduceat(self.p["grams"][grams], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
            out[i : i + 10_000] = (sums + self.p["words"][[self.vocabulary.get(w, 0) for w in some]]) @ self.p["wx"] + self.p["bx"]
        return out


def init(vocabulary: dict[str, int], seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, s: rng.normal(0, s, shape)
    p = {
        "words": normal(len(vocabulary) + 1, WIDTH, s=0.1),
        "grams": normal(BUCKETS, WIDTH, s=0.2),
        "wx": normal(WIDTH, 6 * STATE, s=0.3),
        "bx": np.zeros(6 * STATE),
        "u": normal(2, STATE, 3 * STATE, s=0.3),
        "bn": np.zeros((2, 1, STATE)),
        "a": normal(2 * STATE, s=0.3),
        "w": normal(2 * STATE, s=0.3),
        "b": np.zeros(1),
    }
    p["words"][0] = 0
    return Model({k: v.astype(np.float32) for k, v in p.items()}, vocabulary)


def forward(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. x: (windows, WINDOW, 6 * STATE) input gates, mask: 1 where there is a word."""
    n, steps, _ = x.shape
    s = STATE
    both = np.stack([x[:, :, : 3 * s], x[:, ::-1, 3 * s :]])  # (2, n, steps, 3s)
    here = np.stack([mask, mask[:, ::-1]])[..., None]
    h = np.zeros((2, n, s), np.float32)
    states, saved = np.empty((2, n, steps, s), np.float32), []
    for t in range(steps):
        g = h @ p["u"]
        zr = _sigmoid(both[:, :, t, : 2 * s] + g[:, :, : 2 * s])
        z, r = zr[..., :s], zr[..., s:]
        q = g[..., 2 * s :] + p["bn"]
        c = np.tanh(both[:, :, t, 2 * s :] + r * q)
        m = here[:, :, t]
        new = h + m * (1 - z) * (c - h)
        if keep:
            saved.append((h, z, r, q, c, m))
        h = new
        states[:, :, t] = h
    out = np.concatenate([states[0], states[1][:, ::-1]], axis=2)  # (n, steps, 2s)
    e = out @ p["a"] + (mask - 1) * 1e4
    e -= e.max(1, keepdims=True)
    alpha = np.exp(e)
    alpha /= alpha.sum(1, keepdims=True)
    pooled = (alpha[..., None] * out).sum(1)
    logits = pooled @ p["w"] + p["b"]
    return (logits, (both, here, saved, out, alpha, pooled)) if keep else logits


def infer(p: dict[str, np.ndarray], tables: tuple[np.ndarray, np.ndarray], at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The logits of ``forward`` without what training needs. tables: a direction's gates by word; at: words of windows."""
    n, steps = at.shape
    s = STATE
    states = np.empty((2, steps, n, s), np.float32)
    by_step, there = np.ascontiguousarray(at.T), np.ascontiguousarray(mask.T)[..., None]
    x, g, zr, c = (np.empty((n, k * s), np.float32) for k in (3, 3, 2, 1))
    for k, (table, order) in enumerate(zip(tables, (range(steps), range(steps - 1, -1, -1)))):
        h, u, bn = np.zeros((n, s), np.float32), p["u"][k], p["bn"][k]
        for t in order:
            np.take(table, by_step[t], axis=0, out=x, mode="clip")
            np.matmul(h, u, out=g)
            np.add(x[:, : 2 * s], g[:, : 2 * s], out=zr)
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            np.add(g[:, 2 * s :], bn, out=c)
            c *= zr[:, s:]
            c += x[:, 2 * s :]
            np.tanh(c, out=c)
            z = zr[:, :s]
            np.subtract(1, z, out=z)
            z *= there[t]
            c -= h
            c *= z
            h = np.add(h, c, out=states[k, t])
    e = (states[0] @ p["a"][:s] + states[1] @ p["a"][s:]).T + (mask - 1) * 1e4
    e -= e.max(1, keepdims=True)
    np.exp(e, out=e)
    w = (states[0] @ p["w"][:s] + states[1] @ p["w"][s:]).T
    return (e * w).sum(1) / e.sum(1) + p["b"]


def backward(p: dict[str, np.ndarray], slope: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Slopes of the parameters and of x, from the logits' slopes."""
    both, here, saved, out, alpha, pooled = kept
    s, steps = STATE, out.shape[1]
    d = {"w": pooled.T @ slope, "b": np.array([slope.sum()])}
    dpool = slope[:, None] * p["w"]
    dalpha = (out * dpool[:, None]).sum(2)
    de = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
    d["a"] = np.tensordot(de, out, ((0, 1), (0, 1)))
    dout = alpha[..., None] * dpool[:, None] + de[..., None] * p["a"]
    dstates = np.stack([dout[..., :s], dout[:, ::-1, s:]])
    d["u"], d["bn"] = np.zeros_like(p["u"]), np.zeros_like(p["bn"])
    dboth = np.zeros_like(both)
    dh = np.zeros_like(saved[0][0])
    ut = p["u"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, z, r, q, c, m = saved[t]
        dh = dh + dstates[:, :, t]
        dc = dh * m * (1 - z) * (1 - c**2)
        dz = -dh * m * (c - h) * z * (1 - z)
        dr = dc * q * r * (1 - r)
        dg = np.concatenate([dz, dr, dc * r], axis=2)
        dboth[:, :, t] = np.concatenate([dz, dr, dc], axis=2)
        d["u"] += h.transpose(0, 2, 1) @ dg
        d["bn"] += (dc * r).sum(1, keepdims=True)
        dh = dh * (1 - m * (1 - z)) + dg @ ut
    return d, np.concatenate([dboth[0], dboth[1][:, ::-1]], axis=2)


def table_of(words: list[list[str]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (as rows of word numbers) and their masks."""
    at = np.zeros((len(words), WINDOW), np.int32)
    mask = np.zeros((len(words), WINDOW), np.float32)
    for i, w in enumerate(words):
        at[i, : len(w)] = [index[x] for x in w]
        mask[i, : len(w)] = 1
    return at, mask


class _Trainer:
    """Adam over windows of words; vectors of words and n-grams that a batch lacks stay as they are."""

    def __init__(self, model: Model, windows: list[list[str]]):
        self.model = model
        self.all = sorted(set().union(*map(set, windows)))
        index = {w: i for i, w in enumerate(self.all)}
        self.at, self.mask = table_of(windows, index)
        parts = [grams_of(self.all[i : i + 10_000]) for i in range(0, len(self.all), 10_000)]
        self.flat = np.concatenate([grams.astype(np.uint16) for grams, _ in parts])  # buckets are fewer than 2^16
        self.sizes = np.concatenate([sizes for _, sizes in parts])
        del parts
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.own = np.array([model.vocabulary.get(w, 0) for w in self.all])
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.step = 0

    def _words(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes, p = self.sizes[which], self.model.p
        owner, edges = np.repeat(np.arange(len(which)), sizes), np.cumsum(sizes) - sizes
        grams = self.flat[np.arange(len(owner)) + np.repeat(self.starts[which] - edges, sizes)]
        e = np.add.reduceat(p["grams"][grams], edges, axis=0) / np.sqrt(sizes)[:, None] + p["words"][self.own[which]]
        return e.astype(np.float32), grams, owner

    def learn(self, at: np.ndarray, mask: np.ndarray, target: np.ndarray) -> None:
        """One step on windows: words by number, where there are words, and what each window should be."""
        p, rows = self.model.p, at
        which, inverse = np.unique(at, return_inverse=True)
        e, grams, owner = self._words(which)
        x = (e @ p["wx"] + p["bx"])[inverse.reshape(len(rows), WINDOW)]
        logits, kept = forward(p, x, mask, True)
        slope = ((_sigmoid(logits) - target) / len(rows)).astype(np.float32)
        d, dx = backward(p, slope, kept)
        dwords = np.zeros((len(which), 6 * STATE), np.float32)
        order = np.argsort(inverse.reshape(-1), kind="stable")
        edges = np.searchsorted(inverse.reshape(-1)[order], np.arange(len(which)))
        dwords[:] = np.add.reduceat(dx.reshape(-1, 6 * STATE)[order], edges, axis=0)
        d["wx"], d["bx"] = e.T @ dwords, dwords.sum(0)
        de = dwords @ p["wx"].T
        d["words"] = np.zeros_like(p["words"])
        np.add.at(d["words"], self.own[which], de)
        d["words"][0] = 0
        share = (de / np.sqrt(self.sizes[which])[:, None])[owner]
        d["grams"] = np.stack([np.bincount(grams, share[:, j], BUCKETS) for j in range(WIDTH)], 1).astype(np.float32)
        self.step += 1
        fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k in p:
            g = (d[k] + np.float32(DECAY) * p[k]).astype(np.float32, copy=False)
            self.m[k] *= np.float32(0.9)
            self.m[k] += np.float32(0.1) * g
            g *= g
            self.v[k] *= np.float32(0.999)
            self.v[k] += np.float32(0.001) * g
            np.sqrt(self.v[k], out=g)
            g += np.float32(1e-7)
            np.divide(self.m[k], g, out=g)
            p[k] -= np.float32(RATE * fix) * g

    def logits(self) -> np.ndarray:
        p, out = self.model.p, []
        x = self.model.inputs(self.all)
        tables = np.ascontiguousarray(x[:, : 3 * STATE]), np.ascontiguousarray(x[:, 3 * STATE :])
        for i in range(0, len(self.at), 2048):
            out.append(infer(p, tables, self.at[i : i + 2048], self.mask[i : i + 2048]))
        return np.concatenate(out)


def fit(texts: list[str], toxic: np.ndarray, clean_weight: float = 1.0, seed: int = 5) -> Model:
    """Trains on texts and their labels (0 or 1); ``clean_weight`` is what a false alarm counts for."""
    pool: dict[str, str] = {}  # one object for each distinct piece of a word
    of_word: dict[str, list[str]] = {}
    cut = []
    for t in texts:
        words = words_of(t)
        for word in [w for w in set(words) if w not in of_word]:
            of_word[word] = [pool.setdefault(w, w) for w in pieces_of(word)]
        cut.append([w for word in words for w in of_word[word]])
    del of_word
    kept = [i for i, t in enumerate(cut) if t]
    texts, cut, toxic = [texts[i] for i in kept], [cut[i] for i in kept], np.asarray(toxic)[kept]
    rng = np.random.default_rng(seed)
    judge = np.zeros(len(cut), bool)  # texts that the scale is taken from, and nothing else
    judge[rng.permutation(len(cut))[: len(cut) // CALIBRATE]] = True
    learned = [t for t, j in zip(cut, judge) if not j]
    seen = Counter(w for t in learned for w in set(t))
    common = sorted((w for w, n in seen.items() if n >= MIN_TEXTS), key=lambda w: (-seen[w], w))[:MAX_WORDS]
    model = init({w: i + 1 for i, w in enumerate(common)})
    y = toxic[~judge]
    if not len(y) or y.min() == y.max():
        model.trained = False
        return model
    windows = [[t[s : s + WINDOW] for s in windows_of(len(t))] for t in learned]
    owner = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    trainer = _Trainer(model, [w for t in windows for w in t])
    of_toxic = y[owner] == 1
    clean = np.flatnonzero(~of_toxic)
    odds = _peculiarity(windows, y)
    peculiar = np.array([v.max() for v in odds])
    peaks = np.zeros(trainer.at.shape, bool)
    for i, v in enumerate(odds):
        peaks[i, : len(v)] = v >= min(PEAK * v.max(), v.max())
    positive, hard = _suspicious(peculiar, owner, of_toxic, PEAK), clean
    first = positive
    for round_ in range(ROUNDS):
        for _ in range(BATCHES):
            rows = np.concatenate([rng.choice(positive, BATCH // 2), rng.choice(clean, BATCH // 4), rng.choice(hard, BATCH // 4)])
            at, mask = trainer.at[rows], trainer.mask[rows]
            # toxic words among clean ones: words around them change places with those of clean windows
            lent = rng.choice(clean, BATCH // 2)
            swap = (rng.random((BATCH // 2, WINDOW)) < SWAPPED) & ~peaks[rows[: BATCH // 2]] & (mask[: BATCH // 2] > 0) & (trainer.mask[lent] > 0)
            at[: BATCH // 2][swap] = trainer.at[lent][swap]
            trainer.learn(at, mask, of_toxic[rows].astype(np.float32))
        logits = trainer.logits()
        # toxic texts: their suspicious windows, at least the most suspicious one; the others count neither way
        top = np.full(len(windows), -np.inf)
        np.maximum.at(top, owner, logits)
        bar = np.quantile(logits[clean], 0.998)
        found = np.flatnonzero(of_toxic & ((logits == top[owner]) | (logits > bar)))
        positive = np.union1d(found, first)
        hard = clean[logits[clean] >= np.quantile(logits[clean], 0.95)]
    scale = [i for i in range(len(cut)) if judge[i]] or list(range(len(cut)))
    _calibrate(model, Scorer(model).tops([words_of(texts[i]) for i in scale]), toxic[scale], clean_weight)
    return model


def _peculiarity(texts: list[list[list[str]]], toxic: np.ndarray) -> list[np.ndarray]:
    """For each window's words the greatest log odds of their n-grams to be of a toxic text, by texts that hold them."""
    vocabulary = sorted(set().union(*(w for t in texts for w in t)))
    number = {w: i for i, w in enumerate(vocabulary)}
    blocks = [vocabulary[i : i + 10_000] for i in range(0, len(vocabulary), 10_000)]
    distinct = np.empty(0, np.uint64)
    for block in blocks:
        distinct = np.union1d(distinct, grams_of(block, None)[0])
    found = []
    for block in blocks:  # codes of four bytes, block by block
        grams, sizes = grams_of(block, None)
        found.append((np.searchsorted(distinct, grams).astype(np.int32), sizes))
    code, sizes = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    del found, distinct
    starts = np.cumsum(sizes) - sizes
    held = np.zeros((2, code.max() + 1))
    for t, y in zip(texts, toxic):
        words = list({number[w] for window in t for w in window})
        inside = np.unique(np.concatenate([code[starts[w] : starts[w] + sizes[w]] for w in words]))
        held[int(y), inside] += 1
    clean, bad = (held[k] + 0.5 for k in (0, 1))
    odds = np.log(bad / ((toxic == 1).sum() + 1)) - np.log(clean / ((toxic == 0).sum() + 1))
    of_word = np.maximum.reduceat(odds[code], starts)
    return [of_word[[number[w] for w in window]] for t in texts for window in t]


def _suspicious(value: np.ndarray, owner: np.ndarray, of_toxic: np.ndarray, share: float) -> np.ndarray:
    """Windows of toxic texts whose value is at least ``share`` of their text's greatest."""
    top = np.full(owner.max() + 1, -np.inf)
    np.maximum.at(top, owner, value)
    return np.flatnonzero(of_toxic & (value >= np.minimum(share * top[owner], top[owner])))


def _calibrate(model: Model, top: np.ndarray, toxic: np.ndarray, clean_weight: float) -> None:
    """Sets the scale on which a score of 0.5 divides both kinds with the least weighted errors."""
    order = np.argsort(top, kind="stable")
    bad = toxic[order] == 1
    wrong = np.concatenate([[0], np.cumsum(bad)]) + clean_weight * ((~bad).sum() - np.concatenate([[0], np.cumsum(~bad)]))
    edge = np.concatenate([[top[order[0]] - 1], top[order], [top[order[-1]] + 1]])
    best = np.flatnonzero(wrong == wrong.min())
    model.shift = float(np.mean([(edge[i] + edge[i + 1]) / 2 for i in best]))


def learn(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, bytes_: int = SAMPLE_BYTES) -> Model:
    """The model learned from labelled documents (doc_id, toxic) that aren't held out.

    A document marked more than once is toxic if any mark says so; null marks are ignored. The sample of
    whole texts is bounded by ``toxic`` and ``clean`` rows and ``bytes_`` bytes of each kind, and one task
    trains on it. If only one kind is known, nothing can be learned and every score is 0.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = {k: bounded_sample(marks.where(F.col("toxic") == k), F.col("doc_id"), bound, counts.get(k, 0)) for k, bound in ((1, toxic), (0, clean))}
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))

    def rows(k: int, bound: int) -> DataFrame:
        known = chosen[k].select(F.col("doc_id").alias("_id"))  # about `bound` ids
        found = texts.join(F.broadcast(known), "_id", "left_semi").select(F.col("_id").cast("long").alias("doc_id"), "text")
        return bounded_texts(found, "doc_id", bound, bytes_).withColumn("toxic", F.lit(k).cast("long"))

    total, bad = counts.get(0, 0), max(1, counts.get(1, 0))

    def train(found: pa.Table) -> Model:
        found = found.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        y = found.column("toxic").to_numpy()
        rare = total / bad / max(1e-9, (y == 0).sum() / max(1, (y == 1).sum()))
        return fit(found.column("text").to_pylist(), y, float(rare))

    return fit_in_task(rows(1, toxic).unionByName(rows(0, clean)), train)


class Scorer:
    """Scores texts over all their windows; remembers each distinct word's input to the gates."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self._rows: dict[str, int] = {}  # of pieces
        self._at: dict[str, tuple[int, ...]] = {}  # the rows of words' pieces
        self._x = np.zeros((2, 4096, 3 * STATE), np.float32)

    def _learn(self, words: list[str]) -> None:
        """Words share the entries of equal pieces."""
        single, several = {}, {}  # most words are one piece
        for w in words:
            if w.isalnum() and len(w) <= LONGEST_WORD:
                single[w] = w
            elif len(pieces := pieces_of(w)) == 1:
                single[w] = pieces[0]
            else:
                several[w] = pieces
        n, rows = len(self._rows), self._rows
        new = [c for c in dict.fromkeys(chain(single.values(), chain.from_iterable(several.values()))) if c not in rows]
        while n + len(new) > self._x.shape[1]:
            self._x = np.concatenate([self._x, np.zeros_like(self._x)], axis=1)
        if new:
            x = self.model.inputs(new)
            self._x[0, n : n + len(new)], self._x[1, n : n + len(new)] = x[:, : 3 * STATE], x[:, 3 * STATE :]
            rows.update(zip(new, range(n, n + len(new))))
        self._at.update(zip(single, zip(map(rows.__getitem__, single.values()))))
        self._at.update((w, tuple([rows[c] for c in some])) for w, some in several.items())

    def tops(self, parts: list[list[str]]) -> np.ndarray:
        """The greatest logit of each text's windows; minus infinity for a text without words."""
        if max(len(self._rows), len(self._at)) > REMEMBERED_WORDS:
            self._clear()
        new = [w for w in set().union(*parts) if w not in self._at]
        if new:
            self._learn(new)
        found = [list(chain.from_iterable(map(self._at.__getitem__, words))) for words in parts]
        sizes = [len(f) for f in found]
        flat = np.fromiter(chain.from_iterable(found), np.int64, sum(sizes))
        for w in new:
            if len(w) > LONGEST_WORD:
                del self._at[w]
        first = np.cumsum([0, *sizes])
        spans = [windows_of(n) for n in sizes]
        starts = np.array([f + x for f, span in zip(first, spans) for x in span], np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in spans])
        top = np.full(len(parts), -np.inf)
        for i in range(0, len(starts), 1024):
            at = starts[i : i + 1024, None] + np.arange(WINDOW)
            ends = first[owner[i : i + 1024] + 1][:, None]
            found = infer(self.model.p, (self._x[0], self._x[1]), flat[np.minimum(at, ends - 1)], (at < ends).astype(np.float32))
            np.maximum.at(top, owner[i : i + 1024], found)
        return top

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of texts; 0 for a text without words."""
        if not self.model.trained:
            return np.zeros(len(texts))
        top = self.tops([words_of(t) for t in texts])
        return np.where(np.isfinite(top), _sigmoid(np.clip(top - self.model.shift, -30, 30)), 0.0)


SCHEMA = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` with score (of the most toxic window, 0 to 1) and predicted.

    Null and empty texts and texts without a word score 0. Words of any length are read to their end, and
    every window of a text of any length counts. Columns with these names are replaced.
    """
    kept = docs.drop("score", "predicted")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches(stream):
            found = scorer.score(batch.column("text").cast(pa.string()).to_pylist())
            columns = [pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *SCHEMA.names])

    ship(kept.sparkSession)
    return kept.mapInArrow(tidy(run), T.StructType([*kept.schema.fields, *SCHEMA.fields]))
