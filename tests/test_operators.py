"""Operators against plain Python, on small and odd inputs."""

import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.functions import scalars as S
from keelson.operators import documents, intervals, keyvalue, queue, records, tree
from keelson.plans.components import components, contracted, renamed
from keelson.plans.ranking import hash_bucket, hash_order, running_total
from keelson.sources import log, objects

few = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
COMMANDS = "key string, seq long, op string, value string, if_value string, if_not_exists boolean"


def interpret(commands):
    """The fold, one command after another."""
    state, applied = {}, {}
    for k, _, op, v, if_v, absent in sorted(commands, key=lambda c: c[1]):
        now = state.get(k)
        applied.setdefault(k, 0)
        if absent and now is not None or not absent and if_v is not None and now != if_v:
            continue
        if op == "SET":
            state[k] = v
        elif op == "APPEND":
            state[k] = (now or "") + v
        elif now is not None:
            del state[k]
        else:
            continue
        applied[k] += 1
    return {k: (state.get(k), n) for k, n in applied.items()}


@few
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["SET", "DELETE", "APPEND"]), st.sampled_from("xyz"), st.sampled_from([None, "x"]), st.booleans()), min_size=1, max_size=25))
def test_conditional_fold(spark, rows):
    commands = [(k, i, op, v, if_v, absent) for i, (k, op, v, if_v, absent) in enumerate(rows)]
    out = keyvalue.conditional_fold(spark.createDataFrame(commands, COMMANDS), ["key"], ["seq"])
    assert {r["key"]: (r["value"], r["applied"]) for r in out.collect()} == interpret(commands)


def test_wraparound(spark):
    rows = spark.createDataFrame([("a", 2**63 - 1), ("a", 5), ("b", -(2**63)), ("b", -1)], "k string, d long")
    out = {r["k"]: r["value"] for r in keyvalue.incremented(rows, ["k"], F.col("d")).collect()}
    assert out == {"a": -(2**63) + 4, "b": 2**63 - 1}


@few
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(1, 12)), min_size=1, max_size=12))
def test_overlay(spark, writes):
    rows = [(s, a, a + n, i) for i, (s, a, n) in enumerate(writes)]
    want = {}
    for s, a, e, i in rows:
        for x in range(a, e):
            want[s, x] = i
    got = {}
    for r in intervals.overlay(spark.createDataFrame(rows, "s int, start long, end long, seq long"), "s", "seq").collect():
        for x in range(r["start"], r["end"]):
            assert (r["s"], x) not in got
            got[r["s"], x] = r["seq"]
    assert got == want


def test_overlaps_report_each_pair_once(spark):
    r = spark.createDataFrame([(1, 0, 0, 100), (2, 0, 5, 5)], "id long, s int, from long, until long")
    c = spark.createDataFrame([(0, 10, 95), (0, 100, 110)], "s int, start long, end long")
    assert [tuple(x) for x in intervals.overlaps(r, c, "s", 10).select("id", "lo", "hi").collect()] == [(1, 10, 95)]


def test_split_by_segment(spark):
    r = spark.createDataFrame([(90, 120)], "offset long, length long")
    assert sorted(tuple(x) for x in intervals.split_by_segment(r, 100).select("segment", "from", "until").collect()) == [(0, 90, 100), (1, 0, 100), (2, 0, 10)]


def test_ranges_with_gap(spark):
    r = spark.createDataFrame([("a", 0, 10), ("a", 2, 4), ("a", 10, 12), ("a", 20, 22)], "g string, start long, end long")
    out = sorted(tuple(x) for x in intervals.coalesce_ranges(r, ["g"]).select("start", "end", "pieces").collect())
    assert out == [(0, 12, 3), (20, 22, 1)]


def test_records(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, None, 7)], "id int, name string, n int")
    assert [r["id"] for r in records.find(rows, {"name": "a"}).collect()] == [1]
    assert records.find(rows, {}, records.compare("n", "LESS_THAN", 6)).count() == 1
    assert records.find_one(rows, {"id": 2}).count() == 1
    with pytest.raises(Exception, match="more than one"):
        records.find_one(rows.union(rows), {"id": 2}).collect()
    part = records.update(rows, spark.createDataFrame([(2, None, 9)], rows.schema), ["id"], partial=True)
    assert {tuple(r) for r in part.collect()} == {(1, "a", None, False), (2, "b", 9, True), (3, None, 7, False)}
    assert records.upsert(rows, spark.createDataFrame([(4, "d", 1)], rows.schema), ["id"]).count() == 4


def test_queue_redelivers_until_deleted(spark):
    sent = queue.send(spark.createDataFrame([("q", 1, "x"), ("q", 2, "y")], "queue string, message_id long, body string"), 0)
    got = queue.receive(sent, 1, 1)
    assert [(r["message_id"], r["version"], r["invisible_until"]) for r in got.collect()] == [(1, 2, 30001)]
    after = records.upsert(sent, got, ["queue", "message_id"])
    assert [r["message_id"] for r in queue.receive(after, 2, 5).collect()] == [2]
    assert queue.receive(after, 40000, 5).count() == 2
    receipts = got.select("queue", queue.receipt().alias("receipt"))
    assert [r["message_id"] for r in queue.delete(after, receipts).collect()] == [2]
    assert queue.delete(sent, receipts).count() == 2


def test_tree_paths(spark):
    e = spark.createDataFrame([(0, "a", 1), (1, "b c", 2)], "parent long, name string, inode long")
    p = spark.createDataFrame([("/a/b%20c",), ("a//b%20c/",), ("/a/x",), ("/",)], "path string")
    assert {r["path"]: r["inode"] for r in tree.resolve(e, p, 0).collect()} == {"/a/b%20c": 2, "a//b%20c/": 2, "/a/x": None, "/": 0}


def test_documents_paths_and_nulls(spark):
    d = spark.createDataFrame([('{"a": {"b": 1}, "x": null, "p.q": 3}',), ("{}",)], "doc string")
    out = documents.project(d, {"b": "a.b", "x": "x", "deep": "x.y"}).collect()
    assert [tuple(r) for r in out] == [("1", None, None), (None, None, None)]
    literal = d.select(documents.json_path(F.col("doc"), "p.q", {"p.q"}).alias("v")).collect()
    assert literal[0]["v"] == "3"


def test_scalars(spark):
    df = spark.createDataFrame([("123456789",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(S.crc32c(F.col("t").cast("binary"))).collect()] == [0xE3069283, 0, None]
    assert [r[0] for r in df.select(S.parse_long(F.col("t"))).collect()] == [123456789, 0, None]
    assert S.murmur3_bytes([b"hello", b"", b"The quick brown fox jumps over the lazy dog"]).tolist() == [0x248BFA47, 0, 0x2E4FF723]
    assert zlib.crc32(b"a") == spark.sql("SELECT crc32('a')").first()[0]


@few
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
def test_components(spark, edges):
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in out} == label


def rows_of_joins(spark, run):
    """Rows that joins make while ``run`` runs, by Spark's own metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.range(1).count()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    listed = lambda found: [found.apply(i) for i in range(found.size())]
    last = max(e.executionId() for e in listed(store.executionsList()))
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    made = 0
    for e in (e.executionId() for e in listed(store.executionsList()) if e.executionId() > last):
        values = store.executionMetrics(e)
        for node in listed(store.planGraph(e).allNodes().toSeq()):
            for m in listed(node.metrics().toSeq()) if "Join" in node.name() else ():
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made


def test_edges_inside_a_large_component_are_not_joined_in_every_round(spark):
    """A large group that is connected at once, and a path that takes rounds."""
    edges = [(i, 10_000 + h) for i in range(2_000) for h in range(3)] + [(20_000 + i, 20_001 + i) for i in range(300)]
    table = spark.createDataFrame(edges, "a long, b long").localCheckpoint()
    found = []
    assert len(edges) < rows_of_joins(spark, lambda: found.extend(components(table).collect())) < 5 * len(edges)
    assert len(found) == 2_003 + 301 and {r["component"] for r in found} == {0, 20_000}


@few
@given(*[st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=12)] * 2)
def test_components_of_further_edges(spark, first, further):
    """What two tables of edges connect is what the second one connects between the first one's components."""
    one, two = (spark.createDataFrame(e, "a long, b long") for e in (first, further))
    groups = components(one)
    merged = components(contracted(two, groups))
    out = {r["node"]: r["component"] for r in renamed(groups, "component", merged).union(merged.join(groups, "node", "left_anti")).collect()}
    assert out == {r["node"]: r["component"] for r in components(one.union(two)).collect()}


def test_running_total_of_a_large_group(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("g"), "id", hash_order("id").alias("o")).withColumn("b", hash_bucket(F.col("o"), 4))
    df = df.withColumn("g", F.when(F.col("g"), "hot"))
    out = running_total(df, ["g"], "b", ["o", "id"], F.lit(1), "n").toPandas()
    for _, g in out.groupby("g", dropna=False):
        assert sorted(g["n"]) == list(range(len(g)))
        assert g.sort_values("n")["o"].is_monotonic_increasing


def test_log_frames_and_stream(spark, tmp_path):
    payloads = [bytes(j % 255 for j in range(i)) for i in range(1, 100)]
    data = b"".join(map(log.frame, payloads))
    assert [p for _, p in log.decode(data)] == payloads
    broken = bytearray(data)
    broken[log.HEADER * 2 + 2] ^= 1
    assert [p for _, p in log.decode(bytes(broken))] == payloads[:1]
    path = tmp_path / "a.log"
    path.write_bytes(data)
    spark.dataSource.register(log.LogSource)
    batch = spark.read.format("framed_log").load(str(path))
    assert [bytes(r["value"]) for r in batch.orderBy("offset").collect()] == payloads
    stream = spark.readStream.format("framed_log").option("path", str(path)).option("maxframes", "7").load()
    job = stream.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).start()
    job.processAllAvailable()
    job.stop()
    assert spark.table("frames").count() == 99


def test_snapshots(spark, tmp_path):
    for v, n in ((1, 3), (2, 5)):
        objects.write_snapshot(spark.range(n), str(tmp_path / "t"), v, ["id"])
    assert objects.latest_snapshot(spark, str(tmp_path / "t")).count() == 5


def test_prefix_is_pushed_to_parquet(spark, sf, capsys):
    entries = spark.read.parquet(f"{sf}/customer.parquet").withColumnRenamed("c_name", "key")
    keyvalue.prefix_scan(entries, "Customer#00000001", keys_only=True).explain("formatted")
    out = capsys.readouterr().out
    assert "StringStartsWith(c_name,Customer#00000001)" in out and "ReadSchema: struct<c_name:string>" in out


def test_deep_trees(spark):
    edges = spark.range(300).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    found = tree.ancestors(edges)
    assert found.count() == 300 * 299 // 2 and found.where("node - ancestor <> depth").count() == 0
    with pytest.raises(ValueError):
        tree.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"))
    assert tree.ancestors(edges.limit(0)).count() == 0
    entries = edges.where("node < 20").select("parent", F.col("node").alias("inode"), F.lit("d").alias("name"))
    paths = spark.createDataFrame([("/d" * n,) for n in (1, 8, 9, 19, 20, 25)], "path string")
    assert {len(r["path"]) // 2: r["inode"] for r in tree.resolve(entries, paths, 0).collect()} == {1: 1, 8: 8, 9: 9, 19: 19, 20: None, 25: None}


def test_checksums_against_a_loop(spark):
    rng = np.random.default_rng(0)
    values = [rng.bytes(int(n)) for n in (0, 1, 255, 256, 257, 511, 512, 513, 3000, 0, 5)]

    def slow(value):
        crc = 0xFFFFFFFF
        for byte in value:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    assert S.crc32c_bytes(values).tolist() == [slow(v) for v in values] and S.crc32c_bytes([b"123456789"])[0] == 0xE3069283
    got = spark.createDataFrame([(v,) for v in values] + [(None,)], "v binary").select(S.crc32c("v").alias("c"), S.murmur3("v").alias("m")).collect()
    assert [r["c"] for r in got] == [slow(v) for v in values] + [None] and got[-1]["m"] is None
    assert [r["m"] for r in got[:-1]] == S.murmur3_bytes(values).tolist()


def test_logs_are_checked_together(monkeypatch):
    from keelson.sources import log

    payloads = [bytes([i % 251]) * (i * 7 % 900) for i in range(300)]
    calls, count = [], log.crc32c_bytes
    monkeypatch.setattr(log, "crc32c_bytes", lambda values: calls.append(len(values)) or count(values))
    logs = log.frames(payloads)
    assert [[p for _, p in found] for found in log.decode_each(logs)] == [[p] for p in payloads]
    assert [p for _, p in log.decode(b"".join(logs))] == payloads
    assert calls == [300, 300, 300]  # not one by one
    joined = [logs[3] + logs[4] + logs[5], b"", b"no frame, but long enough"]
    broken = bytearray(joined[0])
    broken[log.HEADER + len(payloads[3]) + log.HEADER] ^= 1
    assert log.decode_each([*joined, bytes(broken)]) == [list(log.decode(d)) for d in [*joined, bytes(broken)]]
    assert [len(x) for x in log.decode_each([*joined, bytes(broken)])] == [3, 0, 0, 1]
    monkeypatch.setattr(log, "TOGETHER", 7)
    assert [p for _, p in log.decode(b"".join(logs))] == payloads and len(list(log.decode(b"".join(logs), limit=20))) == 20
