"""Operators with exact results, against plain Python or DuckDB."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.llm import chat, fingerprints, mixing, packing, queries, sharding, topk

DOCS = "doc_id long, text string, source string, size string"
ODD = [
    (1, None, "b", "x"), (2, "", "b", "x"), (3, "word", None, None), (3, "word", None, None), (3, "other words here.\n\nMore! Yes?", "a", "y"),
    (None, "no id", "a", "z"), (4, "é" * 3000, "a", "z"), (5, "one " * 9000, "c", "z"), (6, "one two", "a", None), (7, "one two", "c", None),
]


def duck(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted((tuple(r[i] for i in sorted(range(len(names)), key=lambda i: names[i])) for r in cur.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(oracles_ := queries.oracle_sql()))
def test_oracle(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert got == duck(sf, oracles_[name])


# --- packing ---


def test_packing_hands_few_texts_at_once_to_python(spark, monkeypatch):
    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.settle
    monkeypatch.setattr(packing, "settle", lambda df, what: seen.append(int(spark.conf.get(name))) or write(df, what))
    before = spark.conf.get(name)
    assert packing.pack(spark.createDataFrame(ODD, DOCS), queries.tokenizer_path()).where("piece = 0").count() == len(ODD)
    assert seen == [1024] and spark.conf.get(name) == before


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25))
def test_plan_uses_every_piece(counts):
    used = np.zeros(65, int)
    for times, lengths in packing.plan(counts, 64):
        assert times > 0 and sum(lengths) <= 64
        used += times * np.bincount(lengths, minlength=65)
    assert {i: n for i, n in enumerate(used.tolist()) if n} == counts


def test_plan_is_close_to_the_least():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    assert sum(t for t, _ in packing.plan(counts)) <= 1.002 * lengths.sum() / 2048 + 1


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAbB éÉüßİıŉΣσς.,!?'\t\n 　\xa012٣中文é<|endoftext|>\x1cﬁǅ#$-_"), max_size=40))
def test_word_encoder(text):
    import pyarrow as pa

    path = queries.tokenizer_path()
    want = _whole(path).encode(text, add_special_tokens=False).ids
    got = packing.encoder(path).encode(pa.array([text, None]))
    assert np.frombuffer(got[0], "<u4").tolist() == want and got[1] == b""


_TOKENIZERS = {}


def _whole(path):
    from tokenizers import Tokenizer

    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def test_packing_of_odd_rows(spark):
    out = packing.pack(spark.createDataFrame(ODD, DOCS), queries.tokenizer_path()).toPandas()
    tokens = {i: [*_whole(queries.tokenizer_path()).encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in ODD if i != 3}
    for doc, ids in tokens.items():
        rows = out[out.doc_id.isna()] if doc is None else out[out.doc_id == doc]
        rows = rows.sort_values("piece")
        cut = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        assert rows.piece.tolist() == list(range(len(cut)))
        assert rows.length.tolist() == [len(c) for c in cut]
        assert rows.start.tolist() == [2048 * i for i in range(len(cut))]
        assert rows.ids_crc32.tolist() == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cut]
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert packing.pack(spark.createDataFrame([], DOCS), queries.tokenizer_path()).count() == 0


# --- mixing ---


def test_mixing_near_targets(spark, sf):
    out = queries.op7_mixing(spark, sf).toPandas()
    total = out["size"].sum()
    by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"), own=("source_size", "first"))
    assert abs(by.target.sum() - total) < 1 and (by.target <= 3 * by.own + 1e-6).all()
    assert ((by.taken - by.target).abs() <= 2 * by.most).all()
    assert (out.taken <= 3 * out["size"]).all() and out.taken.sum() <= total
    again = queries.op7_mixing(spark, sf).toPandas()
    assert sorted(map(tuple, out.values.tolist()), key=str) == sorted(map(tuple, again.values.tolist()), key=str)


def test_mixing_of_odd_rows(spark):
    out = mixing.mix(spark.createDataFrame(ODD, DOCS)).collect()
    assert len(out) == len(ODD)
    assert sorted(r["size"] for r in out) == sorted(len((t or "").split()) for _, t, *_ in ODD)
    assert all(r["taken"] == r["copies"] * r["size"] for r in out)
    clash = mixing.mix(spark.createDataFrame([(1, "a b", "s", 5, "x")], "doc_id long, text string, source string, _order long, target string"))
    assert clash.columns == ["doc_id", "text", "source", "_order", "size", "source_size", "target", "copies", "taken"]
    assert [tuple(r) for r in clash.collect()] == [(1, "a b", "s", 5, 2, 2, 2.0, 1, 2)]
    empty = mixing.mix(spark.createDataFrame([(1, None, "a", ""), (2, " ", "b", "")], DOCS)).collect()
    assert [(r["target"], r["taken"], r["copies"]) for r in empty] == [(0.0, 0, 1)] * 2
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


# --- sharding ---


def test_sharding_laws(spark, sf):
    out = queries.op5_sharding(spark, sf).toPandas()
    moved = out[out.shard != out.grown_shard]
    assert (moved.grown_shard == 8).all() and 0 < len(moved) < 0.25 * len(out)
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(zlib.crc32(texts[i].encode()) == c and len(texts[i].encode()) + 1 == s for i, c, s in zip(out.doc_id, out.text_crc32, out["size"]))


def test_weights_move_only_their_subtrees(spark):
    def placed(weight):
        racks = tuple(
            sharding.Node(f"r{r}/k{k}", children=tuple(sharding.Node(f"s{r}{k}{s}", weight if (r, k, s) == (1, 0, 1) else 1.0, r * 4 + k * 2 + s) for s in range(2)))
            for r in range(2)
            for k in range(2)
        )
        root = sharding.Node("root", children=(sharding.Node("r0", children=racks[:2]), sharding.Node("r1", children=racks[2:])))
        key = F.col("id").cast("string")
        return [r[0] for r in spark.range(4000).select(sharding.descend(key, root)).collect()]

    before, after = placed(1.0), placed(3.0)
    assert 0.1 < sum(x == 5 for x in before) / 4000 < 0.15 < sum(x == 5 for x in after) / 4000
    assert all(b // 4 == 1 for a, b in zip(before, after) if a != b)  # only into the region that grew
    assert all(a // 4 == 1 for a in after if a // 4 == 1)


def test_sharding_of_odd_rows(spark):
    tree = sharding.tree(8)
    out = sharding.shard_documents(spark.createDataFrame(ODD, DOCS), tree, sharding.grown(tree, 8)).toPandas()
    assert len(out) == len(ODD) and sorted(out["size"]) == sorted(len((t or "").encode()) + 1 for _, t, *_ in ODD)
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.shard_documents(spark.createDataFrame([], DOCS), tree, tree).count() == 0


# --- fingerprints ---


def edited(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(t) // 4
        yield i, t, t[: len(t) - q] + n[:q]


@pytest.mark.parametrize("size", [1, 3])
def test_fingerprints(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "BUCKET_DOCS", size)
    for rows in (ODD, ODD[:1], [(i * 7, f"Text {i}. It has parts.\nTwo {i % 5}.", "a", "") for i in range(40)]):
        out = fingerprints.fingerprints(spark.createDataFrame(rows, DOCS)).collect()
        want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e in edited([r[:2] for r in rows]))
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out) == want
        for r in out:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            assert (r["fingerprint"] == r["edited_fingerprint"]) == (r["edited_branches"] == [] and r["fingerprint"] == r["edited_fingerprint"])
    assert fingerprints.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_roots_tell_texts_apart(spark, sf):
    texts = ["a", "a\n", "a\n\n", "\n\na", "a b", "a. b", "a. b.", "a.\nb.", "a.\n\nb.", "", "x" * 130, "x" * 131]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(fingerprints.fingerprint(fingerprints.tree(F.col("t"))).alias("f")).collect()
    assert len({r["f"].split("#")[0] for r in out}) == len(texts)
    docs = fingerprints.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    assert docs.near_edited.mean() > 0.6 > 0.1 > docs.near_next.mean()


def test_branches_locate_the_edit(spark):
    rows = [(1, "One. Two.\nThree.\n\nFour four four four four.", "a", ""), (2, "Z" * 90, "a", "")]
    found = {r["doc_id"]: r["edited_branches"] for r in fingerprints.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[1] == [[1, 0]]


def test_likeness_counts_repeats(spark):
    rng = np.random.default_rng(4)
    pairs = [(["x"] * 100, ["x"] * 75 + [str(i) for i in range(22)]), ([], []), (["a"], []), (["ab", "a", "a"], ["a", "ab", "ab"])]
    pairs += [tuple([str(x) for x in rng.integers(0, 5, rng.integers(0, 30))] for _ in "ab") for _ in range(40)]
    out = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", fingerprints.likeness(F.col("a"), F.col("b")).alias("l")).collect()
    for r in out:
        common = sum((Counter(r["a"]) & Counter(r["b"])).values())
        assert r["l"] == (2 * common / (len(r["a"]) + len(r["b"])) if r["a"] or r["b"] else 1)
    rows = [(1, "One equal line.\n" * 100, "a", ""), (2, "".join(f"No {i} is like it.\n" for i in range(100)), "a", "")]
    assert {r["doc_id"]: r["near_edited"] > 0.7 for r in fingerprints.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}[1]


# --- chats ---

TURNS = "conv_id long, turn long, role string, text string"


def test_chats(spark, monkeypatch):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", None)
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, c], 5: [a, b, c], 6: [b], 7: [a, ("user", "")], 8: [(None, "<|im_end|>x")]}
    rows = [(i, n * 3 + i, *t) for i, turns in convs.items() for n, t in enumerate(turns)] + [(None, 1, "user", "lost")]
    for block in (512, 2):
        monkeypatch.setattr(chat, "BLOCK", block)
        out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()}
        assert sorted(out) == [3, 4, 6, 7, 8]
        assert out[3]["copies"] == 2 and out[3]["n_turns"] == 3
        assert out[3]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
        assert out[8]["rendered"] == "<|im_start|>unknown\n<im_end>x<|im_end|>\n"
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_long_chat_in_segments(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 16)
    monkeypatch.setattr(chat, "SEGMENT", 10)
    rows = [(1, i, "user", f"t{i}") for i in range(100)] + [(2, i, "user", f"t{i}") for i in range(60)] + [(3, None, "user", "same")] * 30
    out = chat.format_chats(spark.createDataFrame(rows, TURNS)).orderBy("conv_id", "segment").collect()
    assert [(r["conv_id"], r["segment"]) for r in out] == [(1, i) for i in range(10)] + [(3, i) for i in range(3)]
    assert "".join(r["rendered"] for r in out[:10]) == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(100))


# --- top-k ---


@pytest.mark.parametrize("blocks", [(1024, 4096), (3, 7)])
def test_topk(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)] + [(60 + i, [0.5] * 6) for i in range(30)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, []), (120, [1e9] * 6), (None, [1.0] * 6), (125, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = topk.top_k(df, F.col("vec_id") % 5 == 0, k=4).collect()
    ok = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in ok:
        if q % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q)[:4]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(scored, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 5"), F.lit(True)).count() == 0


def test_topk_of_repeated_ids_and_huge_scores(spark):
    rows = [(0, [3.0, 1.0]), (0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.top_k(df, F.col("vec_id") == 0, k=5).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in out] == [(1, 2, 64 * 128), (2, 1, 64 * 64)]  # (1, 2) asks
    huge = spark.createDataFrame([(i, [s * 1e9] * 6) for i, s in enumerate((1, 1, 2, -1, -3))], df.schema)
    out = topk.top_k(huge, F.col("vec_id") == 0, k=5).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in out] == [(1, 1, 2**63 - 1), (2, 2, 2**63 - 1), (3, 3, -(2**63)), (4, 4, -(2**63))]


def test_walk_ends_early():
    rng = np.random.default_rng(0)
    rows = (rng.normal(size=(4000, 4)) * 64).astype(np.float32)
    rows[:30] *= 5
    lists = np.argsort(rows, axis=0).astype(np.int32)
    q = rows[0]
    ids, scores, depth = topk.walk(lists, rows, np.arange(4000), q, 0, 10)
    want = np.lexsort((np.arange(4000), -(rows @ q)))
    assert ids.tolist() == [i for i in want if i != 0][:10] and depth < 2000
