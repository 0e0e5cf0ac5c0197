"""The pipeline's stages on small tables."""

import corpus_pipeline
import pytest

from keelson.llm import langid, mixing, neardup, toxicity
from keelson.session import give_back, settle, table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_against_what_they_call_and_by_themselves(spark, sf):
    """Each stage keeps just the rows that its operator, called by itself, speaks for; ``run`` is the stages in order."""
    docs = table(spark, sf, "documents")
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settle(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        before = docs.collect()
        if name == "language_id":
            judged = {r["doc_id"]: r["lang_pred"] != "und" and not r["ambiguous"] for r in langid.identify(docs, langid.learn(docs)).collect()}
            assert rows(out) == sorted((tuple(r) for r in before if judged[r["doc_id"]]), key=str)
        elif name == "toxicity":
            model = toxicity.learn(docs, table(spark, sf, "labels"))
            assert rows(out) == sorted((tuple(r) for r in before if toxicity.Scorer(model).score([r["text"]])[0] < 0.5), key=str)
        elif name == "near_duplicates":
            classes = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(classes.values()))
        else:
            times = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
            assert rows(out) == sorted((tuple(r) for r in before for _ in range(times[r["doc_id"]])), key=str)
        docs = out
        names.append(name)
    assert names == ["language_id", "toxicity", "near_duplicates", "mixing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == docs.count()
    fill = {}
    for r in packed.collect():
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    whole = corpus_pipeline.run(spark, sf)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(whole.select(columns)) == rows(packed.select(columns))


def test_odd_documents(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, taken string, _row string"
    some = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "12 34", "en", "a", 5), (None, "and the of", "en", "a", 10)]
    for docs in ([(*r, "s", "z", "t", "r") for r in some], []):
        docs = spark.createDataFrame(docs, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            found = out.collect()
            assert len(found) <= 3 * len(some)
            if name != "packing":
                assert out.columns == docs.columns and all(tuple(r)[5:] == ("s", "z", "t", "r") for r in found)


def test_documents_that_share_an_id(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, one, "en", "s", 1), (1, two, "en", "s", 1), (1, one, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["text"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [one, two]


def test_equal_rows_at_the_end_of_the_mix(spark):
    """A document repeated so often that the service ends among its rows is served just as often as there are words left."""
    docs = spark.createDataFrame([(7, "a b c", "s")] * 40 + [(8, "d " * 30, "t")], "doc_id long, text string, source string")
    mixed = mixing.mix(docs).collect()
    taken = {s: sum(r["taken"] for r in mixed if r["source"] == s) for s in "st"}
    target = {r["source"]: r["target"] for r in mixed}
    assert all(abs(taken[s] - target[s]) <= 30 for s in "st") and sum(taken.values()) <= 150 and max(r["copies"] for r in mixed) <= 3
    assert len({r["copies"] for r in mixed if r["source"] == "s"}) == 2 or taken["s"] % 120 == 0
    served = mixing.serve(docs).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in served} == {s: sum(r["copies"] for r in mixed if r["source"] == s) for s in "st"}


def full_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))


def test_stages_begin_with_memory_given_back(spark, sf, monkeypatch):
    """Executors collect what earlier stages left before a stage reads anything; its results are checked above."""

    class Begun(Exception):
        pass

    def begun(session):
        before = full_collections(session)
        give_back(session)
        assert full_collections(session) > before
        raise Begun

    monkeypatch.setattr(corpus_pipeline, "give_back", begun)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Begun):
            stage(spark, None, sf)
