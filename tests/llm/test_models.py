"""Trained operators: accuracy on documents that weren't learned from, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import langid, quality, queries, toxicity
from keelson.llm.common import bounded_texts, held_out

SF = "/root/testdata/sf0.01"
ODD = [
    (1, None, "en", "a", "clash"), (2, "", "en", "b", "c"), (3, "12 34 !!", None, "b", "c"), (4, "word", "en", None, "c"), (4, "word", "en", None, "c"),
    (5, "x" * 200_000, "de", "a", "c"), (None, "no id", "de", "a", "c"), (6, "la la " * 20_000, "fr", "a", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_folds(spark):
    rows = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (1 - y).sum())


def test_codewords():
    for n in (2, 3, 4, 5, 12):
        code = langid.codewords(n)
        gaps = (code[:, None] != code[None]).sum(2) + 99 * np.eye(n)
        assert gaps.min() >= (2 ** (n - 2) if n <= 5 else 8)


def test_a_wrong_bit_is_corrected():
    code = langid.codewords(5)
    model = langid.Model(list("abcde"), code, np.ones_like(code), np.zeros((1, code.shape[1])), np.zeros(code.shape[1]))
    for i in range(5):
        for bit in range(code.shape[1]):
            margins = 3 * code[i].copy()
            margins[bit] *= -1
            assert model.decode(margins[None])[0].argmax() == i


def test_languages(spark, docs):
    out = queries.op1_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.98 and out.score.between(0, 1).all()


def test_letters_and_margins_by_hand(spark, docs):
    assert langid.words_of("½ ²③ 12_a Éa½b") == ["a", "éa", "b"] and langid.words_of("½ ² ③") == []
    model = langid.learn(docs, 40)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(20).collect()]
    margins, n = langid.Scorer(model).margins(texts)
    for text, margin, size in zip(texts, margins, n):
        grams = langid.frequencies([text], langid.Ngrams())[0]
        assert size == len(grams) and np.allclose(margin, model.weights[grams].sum(0) / max(1, size) + model.bias, atol=1e-3)
        far = [sum(w * np.log1p(np.exp(-c * m)) for w, c, m in zip(model.worth[i], model.code[i], margin)) for i in range(len(model.langs))]
        assert model.decode(margin[None])[0].argmax() == int(np.argmin(far))


def test_samples_are_bounded_in_rows_and_bytes(spark):
    df = spark.range(2000).selectExpr("id % 2 AS doc_id", "repeat('x', 1000) || id AS text")
    assert bounded_texts(df, "doc_id", 10**6, 10**9).count() == 2000
    for rows, bytes_ in ((200, 10**9), (10**6, 200_000)):
        assert 120 < bounded_texts(df, "doc_id", rows, bytes_).count() < 280
    assert bounded_texts(df.union(df), "doc_id", 10**6, 10**9).count() == 2000


def test_languages_of_odd_rows(spark, docs):
    model = langid.learn(docs, 60)
    out = langid.identify(spark.createDataFrame(ODD, SCHEMA), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score", "ambiguous"]
    rows = out.collect()
    assert len(rows) == len(ODD)
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and all(r["score"] == 0 for r in rows[:3])
    assert all(r["lang_pred"] in model.langs for r in rows[3:])
    none = langid.learn(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame(ODD, SCHEMA), none).collect()} == {"und"}
    one = langid.learn(docs.where("lang = 'de'"), 20)
    assert {r["lang_pred"] for r in langid.identify(docs.limit(5), one).collect()} == {"de"}
    assert langid.identify(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_quality(spark, labels):
    out = queries.op3_quality(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(out.score.to_numpy(), out.quality.to_numpy()) > 0.95
    assert out[out.quality == 1].predicted.mean() > 0.97


def test_bad_text_is_rejected(spark):
    """Given labels enough; and scores are those of the network worked out by hand."""
    sf = "/root/testdata/sf0.1"
    table, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(table, labels, 1500, 3000)
    rows = quality.score(table.join(labels.where(held_out("doc_id")), "doc_id"), model).select("text", "quality", "score", "predicted").toPandas()
    assert rows[rows.quality == 0].predicted.mean() < 0.05 and rows[rows.quality == 1].predicted.mean() > 0.97
    for _, r in rows.head(20).iterrows():
        h = [np.tanh(sum(x * w for x, w in zip(model.inputs(quality.features(r.text)), column)) + b) for column, b in zip(model.w1.T, model.b1)]
        want = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(h, model.w2)) + model.b2)))
        assert abs(r.score - want) < 1e-5 and r.predicted == int(r.score >= 0.3)


def test_prior():
    rng = np.random.default_rng(0)
    n = quality.FEATURES
    good, bad = rng.normal(0, 1, (4000, n)), rng.normal(1.5, 1, (1000, n))
    p, u = good[:2000], np.concatenate([good[2000:], bad])[rng.permutation(3000)]
    assert abs(quality.estimate_prior(p, u) - 2 / 3) < 0.06


def test_quality_of_odd_rows(spark, docs, labels):
    odd = spark.createDataFrame(ODD, SCHEMA)
    for model in (quality.learn(docs, labels, 100, 200), quality.learn(docs, labels.limit(0))):
        rows = quality.score(odd, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert rows[3]["score"] == rows[4]["score"]
    assert quality.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    model = toxicity.init({"a": 1})
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask, top = rng.normal(size=(3, toxicity.WINDOW, 6 * toxicity.STATE)), np.ones((3, toxicity.WINDOW)), np.array([1, -2, 0.5])
    mask[1, 10:] = 0
    _, kept = toxicity.forward(p, x, mask, True)
    slopes, _ = toxicity.backward(p, top, kept)
    for k in ("u", "a", "w", "bn", "b"):
        at = tuple(int(rng.integers(0, s)) for s in p[k].shape)
        ends = []
        for e in (1e-3, -1e-3):
            q = {**p, k: p[k].copy()}
            q[k][at] += e
            ends.append((toxicity.forward(q, x, mask) * top).sum())
        assert abs((ends[0] - ends[1]) / 2e-3 - slopes[k][at]) < 1e-3 * max(1, abs(slopes[k][at]))


def test_inference_equals_forward():
    rng = np.random.default_rng(1)
    p, s = toxicity.init({}).p, toxicity.STATE
    table, at = rng.normal(size=(40, 6 * s)).astype(np.float32), rng.integers(0, 40, (7, toxicity.WINDOW))
    mask = np.ones((7, toxicity.WINDOW), np.float32)
    mask[2, 5:] = 0
    found = toxicity.infer(p, (table[:, : 3 * s].copy(), table[:, 3 * s :].copy()), at, mask)
    assert np.allclose(found, toxicity.forward(p, table[at], mask), atol=1e-5)


def test_windows_cover_everything():
    for n in range(0, 200):
        covered = {i for s in toxicity.windows_of(n) for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_toxicity(spark, model):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.where(held_out("doc_id")), "doc_id")
    out = toxicity.score(docs, model).select("toxic", "score", "predicted").toPandas()
    # a twentieth of this table's toxic labels are on texts of noise without a toxic word
    assert auc(out.score.to_numpy(), out.toxic.to_numpy()) > 0.95
    assert out[out.toxic == 1].predicted.mean() > 0.8 and out[out.toxic == 0].predicted.mean() < 0.05


def test_toxic_words_anywhere_in_a_long_text(spark, model):
    plain = " ".join(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0 AND quality = 1"), "doc_id").where("lang = 'en'").limit(12).collect())
    words = plain.split()
    middle = words[:3000] + ["idiot", "stupid", "loser"] + words[3000:]
    end = [*words, "pathetic", "moron", "scum"]
    scores = toxicity.Scorer(model).score([plain, " ".join(middle), " ".join(end)])
    assert scores[0] < min(scores[1:]) and (scores[1:] > 0.5).all()


def test_words_are_read_to_their_end():
    rng = np.random.default_rng(2)
    for n in (1, 39, 40, 41, 67, 68, 69, 1000):
        for alphabet in ("abcdefghij", "語言文字章句", "कहिदी", "ab.,_-/#"):
            word = "x" + "".join(rng.choice(list(alphabet), n - 1))
            core, at = toxicity.pieces_of(word), 0
            whole = word.rstrip(".,-/#")
            assert max(map(len, core)) <= toxicity.LONGEST_WORD
            for i in range(0, max(1, len(whole) - toxicity.OVERLAP), toxicity.LONGEST_WORD - toxicity.OVERLAP):
                assert i <= at and core.pop(0) == whole[i : i + toxicity.LONGEST_WORD]
                at = i + toxicity.LONGEST_WORD
            assert at >= len(whole)
    assert toxicity.pieces_of("(you,idiot_there!)") == ["you,idiot_there", "you", "idiot", "there"]
    assert toxicity.pieces_of("word!") == ["word"] and toxicity.pieces_of("!?") == ["!?"]
    assert len(toxicity.pieces_of("a" + "." * 1_000_000 + "b!")) > 30_000


@pytest.mark.parametrize("mark", [",", ".", "_", "-", "/", "###"])
def test_toxic_words_in_a_text_without_spaces(spark, model, mark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plain = docs.join(labels.where("toxic = 0 AND quality = 1"), "doc_id").where("lang = 'en'").orderBy("doc_id").limit(4).collect()
    words = " ".join(r["text"] for r in plain).split()[:1500]
    toxic = [*words[:1000], "idiot", "stupid", "loser", *words[1000:]]
    scores = toxicity.Scorer(model).score([mark.join(words), mark.join(toxic)])
    assert scores[0] < 0.5 < scores[1]


def test_toxicity_of_odd_rows(spark, model, docs, labels):
    rows = toxicity.score(spark.createDataFrame(ODD, SCHEMA), model).collect()
    assert len(rows) == len(ODD) and [r["score"] for r in rows[:2]] == [0, 0] and all(0 <= r["score"] <= 1 for r in rows)
    blank = toxicity.learn(docs, labels.where(F.col("toxic") == 0), 10, 10)
    assert {r["score"] for r in toxicity.score(spark.createDataFrame(ODD, SCHEMA), blank).collect()} == {0.0}
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_toxicity_takes_plain_words_as_they_are(monkeypatch):
    """Words of one piece skip the search for parts; scores are those of windows by themselves."""
    texts = ["plain words alone", "with-marks inside, and " + "long" * 30 + " one", "", "x" * 40, "x" * 41, "ends. (both) a_b _"]
    cut, pieces = [], toxicity.pieces_of
    scorer = toxicity.Scorer(model := toxicity.init({"plain": 1, "inside": 2}))
    monkeypatch.setattr(toxicity, "pieces_of", lambda w: cut.append(w) or pieces(w))
    found = scorer.tops([toxicity.words_of(t) for t in texts])
    assert sorted(set(cut)) == sorted(["with-marks", "inside,", "long" * 30, "x" * 41, "ends.", "(both)", "a_b", "_"])
    for text, top in zip(texts, found):
        read = [c for w in toxicity.words_of(text) for c in pieces(w)]
        windows = [read[i : i + toxicity.WINDOW] for i in toxicity.windows_of(len(read))]
        if not windows:
            assert top == -np.inf
            continue
        index = {w: i for i, w in enumerate(sorted(set(read)))}
        at, mask = toxicity.table_of(windows, index)
        assert abs(toxicity.forward(model.p, model.inputs(sorted(set(read)))[at], mask).max() - top) < 1e-4
