"""Streams give the same state however their input is cut, and replaying a batch changes nothing."""

from pyspark.sql import functions as F

from keelson.streaming import folds


def test_any_split_and_replay(spark, tmp_path):
    rows = [("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"), ("b", 1, "old")]
    schema = "key string, seq long, value string"
    results = []
    for name, cuts in (("one", [rows]), ("two", [rows[:1], rows[1:]]), ("back", [rows[2:], rows[:2]])):
        run = folds.apply_batches(str(tmp_path / name), folds.merge_last_write)
        for i, part in enumerate(cuts):
            run(spark.createDataFrame(part, schema), i)
        run(spark.createDataFrame(cuts[-1], schema), len(cuts) - 1)
        state = spark.read.parquet(str(tmp_path / name)).where(F.col("batch") == len(cuts) - 1)
        results.append(sorted((r["key"], r["value"]) for r in state.collect()))
    assert results == [[("a", "z"), ("b", "y")]] * 3


def test_queue_stream(spark, tmp_path):
    commands = [
        ("q", 1, "SEND", "m1", "one", 0, 0), ("q", 2, "SEND", "m2", "two", 0, 5), ("q", 3, "RECEIVE", None, None, 1, 10),
        ("q", 4, "RECEIVE", None, None, 5, 11), ("q", 5, "DELETE", "m1:2", None, 0, 12), ("q", 6, "RECEIVE", None, None, 5, 99_999),
    ]
    schema = "queue string, seq long, op string, message_id string, body string, n long, now long"
    spark.createDataFrame(commands, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = folds.queue_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    job = out.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination()
    got = sorted((r["seq"], r["message_id"], r["version"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(3, "m1", 2), (4, "m2", 2), (6, "m2", 3)]


def test_late_rows_are_left_out(spark, tmp_path):
    """Rows in time order come in by three batches; one that is later than the watermark allows isn't counted."""
    parts = [["2024-01-01 00:10:00", "2024-01-01 09:00:00"], ["2024-01-01 08:30:00", "2024-01-01 00:20:00"], ["2024-01-01 09:30:00"]]
    folder, schema = tmp_path / "in", "ts timestamp, event_type string, value double"
    got = {}

    def keep(batch, i):
        got.update({(r["start"].hour, r["event_type"]): r["n"] for r in batch.collect()})

    for part in parts:  # a run of the stream for each, from the same checkpoint
        spark.createDataFrame([(t, "a", 1.0) for t in part], "ts string, event_type string, value double").selectExpr(
            "CAST(ts AS timestamp) AS ts", "event_type", "value"
        ).coalesce(1).write.mode("append").parquet(str(folder))
        counts = folds.windowed_counts(spark.readStream.schema(schema).parquet(str(folder)), "1 hour", "2 hours")
        job = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c"))
        job.trigger(availableNow=True).start().awaitTermination()
    assert got == {(0, "a"): 1, (8, "a"): 1, (9, "a"): 2}


def test_a_queues_state_is_not_touched_for_each_message(monkeypatch):
    """Random commands against a plain dict; SENDs of one batch reach the state by parts."""
    import random

    import pandas as pd

    class State(dict):
        calls = 0

        def called(self, found=None):
            State.calls += 1
            return found

        containsKey = lambda self, k: self.called(k in self)
        getValue = lambda self, k: self.called(self.get(k))
        updateValue = lambda self, k, v: self.called(self.__setitem__(k, v))
        removeKey = lambda self, k: self.called(self.pop(k))
        iterator = lambda self: iter(list(self.items()))

    class Handle:
        getMapState = lambda self, *_: State()

    monkeypatch.setattr(folds, "PARTS", 16, raising=False)
    columns, rng = ["queue", "seq", "op", "message_id", "body", "n", "now"], random.Random(3)
    queue = folds.QueueProcessor()
    queue.init(Handle())
    sends = pd.DataFrame([("q", i, "SEND", str(i), f"body {i}", 0, i % 7) for i in range(3000)], columns=columns)
    assert all(x.empty for x in queue.handleInputRows(("q",), iter([sends[1000:], sends[:1000]]), None))
    assert State.calls < 100

    queue, held = folds.QueueProcessor(), {}
    queue.init(Handle())
    for batch in range(6):
        commands, want = [], []
        for i in range(150):
            seq, m, now = batch * 1000 + i, str(rng.randrange(40)), (batch * 150 + i) * 700
            op = rng.choice(["SEND", "SEND", "SEND", "RECEIVE", "DELETE"])
            if op == "SEND":
                held.setdefault(m, (f"b{seq}", now, 1))
            elif op == "RECEIVE":
                for at, k in sorted((v[1], k) for k, v in held.items() if v[1] < now)[:3]:
                    held[k] = (held[k][0], now + 30_000, held[k][2] + 1)
                    want.append((seq, k, *held[k][::2]))
            else:
                m = f"{m}:{rng.randrange(1, 4)}"
                if str(held.get(m.rpartition(":")[0], ("", 0, 0))[2]) == m.rpartition(":")[2]:
                    del held[m.rpartition(":")[0]]
            commands.append(("q", seq, op, None if op == "RECEIVE" else m, f"b{seq}", 3, now))
        rng.shuffle(commands)
        got = pd.concat(list(queue.handleInputRows(("q",), iter([pd.DataFrame(commands, columns=columns)]), None)))
        assert list(got[["seq", "message_id", "body", "version"]].itertuples(index=False, name=None)) == want
