"""Near duplicates against brute force over all pairs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import neardup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 8))
def test_alignment(a, b, most):
    x, y = np.array(a, np.int32), np.array(b, np.int32)
    want = distance(a, b) <= most
    assert neardup.edits_within(x, y, most) == want
    if abs(len(a) - len(b)) <= most:
        assert neardup._row_by_row(x, y, most) == want


def brute(rows):
    """class of each doc_id, over all pairs."""
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(i, t, t.lower().split()) for i, t in rows if i is not None and t is not None]
    for k, (i, t, w) in enumerate(known):
        for j, u, v in known[:k]:
            if t == u or w and v and distance(w, v) <= max(len(w), len(v)) // 5:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i, _ in rows}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    out, n = [], 0
    for base in range(12):
        words = [word() for _ in range(int(rng.integers(60, 140)))]
        for copy in range(int(rng.integers(1, 18))):
            w = list(words)
            for _ in range(copy % 4):
                w[int(rng.integers(0, len(w)))] = word()
            out.append((n, " ".join(w)))
            n += 1
    passage = " ".join(word() for _ in range(55))
    out += [(n + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(40)]
    return out


def classes(spark, rows, schema="doc_id long, text string"):
    return {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, schema)).collect()}


def test_against_brute_force(spark, rows, monkeypatch):
    assert classes(spark, rows) == brute(rows)
    monkeypatch.setattr(neardup, "SMALL", 2)  # blocks for every bucket of more than two
    monkeypatch.setattr(neardup, "BLOCK", 4)
    assert classes(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None), (2, None), (3, ""), (4, ""), (5, "  \n"), (6, "a b"), (7, "A b"), (8, "a c"), (9, long), (10, long + " end"),
        (11, long[: len(long) // 2]), (9, long), (12, "!!! ???"), (13, "x " * 500), (14, "x " * 400),
    ]
    got = classes(spark, rows)
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 9, 11: 11, 12: 12, 13: 13, 14: 13}
    assert len(neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == len(rows)
    assert classes(spark, []) == {}
    clash = spark.createDataFrame([(1, "a b c d e f", 5, "z"), (2, "a b c d e f", 6, "y")], "doc_id long, text string, uid long, component string")
    assert {tuple(r)[:3] for r in neardup.classes(clash).collect()} == {(1, 1, 1), (2, 1, 1)}
    nulls = neardup.classes(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["class_id"]) for r in nulls) == [(False, 3), (True, 3)] or len(nulls) == 2


def test_a_text_of_most_rows(spark):
    rows = [(i, "the same words in very many documents") for i in range(300)] + [(i, f"text number {i} stands alone here") for i in range(300, 320)]
    got = classes(spark, rows)
    assert {got[i] for i in range(300)} == {0} and len(set(got.values())) == 21


def test_alignment_of_long_texts():
    rng = np.random.default_rng(3)
    for n in (1_000, 30_000):
        a = rng.integers(0, 10**6, n)
        for share, near in ((0.02, True), (0.1, True), (0.3, False)):
            b = a.copy()
            b[rng.random(n) < share] = -1
            assert neardup.linked(a, b, neardup.word_pairs(a), neardup.word_pairs(b)) == near
    assert not neardup.linked(a, a[: n // 2], neardup.word_pairs(a), neardup.word_pairs(a[: n // 2]))


def test_anchors_never_understate_edits():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = rng.integers(0, 6, int(rng.integers(1, 60)))
        b = a.copy()
        for _ in range(int(rng.integers(0, 6))):
            at = int(rng.integers(0, len(b) + 1))
            b = np.insert(b, at, rng.integers(0, 6)) if rng.random() < 0.5 or len(b) < 2 else np.delete(b, at % len(b))
        assert neardup.anchored_edits(a, b, len(a)) >= distance(list(a), list(b))
    a = rng.permutation(20_000)
    b = np.where(rng.random(20_000) < 0.04, -1, a)
    # by hand: all words that aren't in an unchanged run of five or more are replaced
    runs = np.split(a == b, np.flatnonzero(np.diff(a == b)) + 1)
    assert neardup.anchored_edits(a, b, 4000) == sum(len(r) for r in runs if not r[0] or len(r) < 5)


def test_the_filter_never_parts_a_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.integers(0, 4, int(rng.integers(1, 40)))
        b = a.copy()
        for _ in range(int(rng.integers(0, 8))):
            at = int(rng.integers(0, len(b) + 1))
            b = [np.insert(b, at, rng.integers(0, 4)), np.delete(b, at % max(1, len(b))) if len(b) > 1 else b][int(rng.integers(0, 2))]
        most = neardup.most_edits(len(a), len(b))
        assert neardup.linked(a, b, neardup.word_pairs(a), neardup.word_pairs(b)) == (distance(list(a), list(b)) <= most)


def test_alignment_by_bits():
    rng = np.random.default_rng(8)
    for n in (1, 2, 63, 64, 65, 130):
        for _ in range(30):
            a = rng.integers(0, 5, n)
            b = np.concatenate([a[: n // 2], rng.integers(0, 5, int(rng.integers(0, 9))), a[n // 2 + int(rng.integers(0, 9)) :], [1]])
            d = distance(list(a), list(b))
            assert [neardup._by_bits(a, b, most) for most in (d - 1, d, d + 1)] == [False, True, True]


def test_texts_just_beyond_the_edits_are_hardly_aligned(monkeypatch):
    """Many texts that differ from each other in more than a fifth of their words, but share enough word pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 30, 150)
    texts = []
    for _ in range(60):
        b = base.copy()
        at = int(rng.integers(0, 130))
        b[at : at + 18] = rng.integers(0, 1 << 30, 18)  # a run leaves more word pairs than single words do
        b[rng.permutation(150)[:10]] = rng.integers(0, 1 << 30, 10)
        texts.append(b.astype(np.int32))
    aligned, align = [], neardup.edits_within
    monkeypatch.setattr(neardup, "edits_within", lambda *x: aligned.append(1) or align(*x))
    column, ids = pa.array(texts, pa.list_(pa.int32())), pa.array(range(60), pa.int64())
    found = neardup.block_links(pa.table({"uid": ids, "component": ids, "w": column}), pa.table({"id": ids, "group": ids, "v": column}))
    assert len(aligned) < 400  # of 60 * 59

    up = list(range(60))
    links = [(a, b) for a in range(60) for b in range(a) if neardup._row_by_row(texts[a], texts[b], 30)]
    for pairs in (links, zip(*(found.column(c).to_pylist() for c in ("a", "b")))):
        group = list(up)
        for a, b in pairs:
            group = [group[b] if g == group[a] else g for g in group]
        sets = {frozenset(k for k in up if group[k] == g) for g in group}
        want = sets if pairs is links else want
    assert sets == want


def test_values_in_common(monkeypatch):
    rng = np.random.default_rng(6)
    for _ in range(100):  # tables and single counts, in one part or many
        monkeypatch.setattr(neardup, "DENSE", int(rng.integers(0, 300)))
        monkeypatch.setattr(neardup, "EXPANDED", int(rng.integers(1, 500)))
        sa, sb = ([np.unique(rng.integers(0, 40, int(rng.integers(0, 30)))) for _ in range(int(rng.integers(1, 50)))] for _ in range(2))
        want = [[len(set(x.tolist()) & set(y.tolist())) for y in sb] for x in sa]
        assert neardup.in_common(sa, sb).tolist() == want


def test_recall_on_a_table(spark):
    """Of the pairs of different texts that at most a fifth of the words as edits lie between, nearly all share a class."""
    found = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    texts = {" ".join((r["text"] or "").lower().split()): r["doc_id"] for r in found}
    number: dict[str, int] = {}
    docs = [(i, np.array([number.setdefault(w, len(number)) for w in t.split()], np.int64)) for t, i in texts.items() if t]
    docs = [(i, w, neardup.word_pairs(w)) for i, w in docs]
    pairs = [(i, j) for k, (i, a, p) in enumerate(docs) for j, b, q in docs[:k] if neardup.linked(a, b, p, q)]
    assert len(pairs) > 50
    assert np.mean([got[i] == got[j] for i, j in pairs]) >= 0.95
    # and no class holds what links don't connect
    assert sum(got[i] != i for i, _, _ in docs) <= len({i for pair in pairs for i in pair} | set()) + len(found) - len(docs)


def test_texts_that_share_an_id(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, one), (5, two), (5, one), (7, three), (8, three + " more"), (9, two + " more"), (None, one), (6, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS _row", "1 AS uid", "2 AS digest")
    found = neardup.classes(docs).collect()
    assert len(found) == len(rows)
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in neardup.representatives(docs).collect())
    assert [(-1, one), (6, ""), (6, ""), (7, three)] == [k for k in kept if k[0] in (-1, 6, 7)] and (5, one) in kept
    assert len(kept) == 6 and neardup.representatives(docs).columns == docs.columns
    assert neardup.representatives(docs.limit(0)).count() == 0
