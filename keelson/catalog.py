"""The registered queries: each applies one operator to the driver's tables.

Names begin with the operator's id in the survey. Where a table of the original has no counterpart
among the driver's, a view over them stands in, built alike in Spark and in the DuckDB text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.functions import scalars as S
from keelson.operators import documents as D
from keelson.operators import intervals as I
from keelson.operators import keyvalue as KV
from keelson.operators import queue as Q
from keelson.operators import records as R
from keelson.operators import tree as TR
from keelson.registry import query
from keelson.session import table
from keelson.sources import log as L
from keelson.sources import objects as O

# --- Views over the driver's tables -----------------------------------------------------------------


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """event_id as key, props as document with a sparse second member."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    sparse = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "nested": {"a": {"b": '), k + 1, F.lit('}}, "kind": "'), "event_type", F.lit('"}')))
    return e.select(F.col("event_id").alias("key"), F.coalesce(sparse, F.concat(F.lit('{"k": '), k, F.lit("}"))).alias("doc"))


DOCS = """docs AS (SELECT event_id AS key, coalesce(CASE WHEN event_id % 3 = 0 THEN
  '{"k": ' || k || ', "nested": {"a": {"b": ' || (k + 1) || '}}, "kind": "' || event_type || '"}' END, '{"k": ' || k || '}') AS doc
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_nationkey").alias("keyspace_id"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), F.col("c_custkey").alias("id"))


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("user_id", "ts", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("delta"))


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


# --- Sources ------------------------------------------------------------------------------------------


@query("src_01_sql_scan", "SELECT event_id AS doc_key, json_extract_string(props,'$.k') AS k, json_extract_string(props,'$.missing') AS missing FROM events")
def _(spark, sf):
    docs = table(spark, sf, "events").select(F.col("event_id").alias("doc_key"), F.col("props").alias("doc"))
    return D.project(docs, {"k": "k", "missing": "missing"}, keep=("doc_key",))


@query("src_02_cursor_from_key", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name >= 'Customer#000000500'")
def _(spark, sf):
    return KV.scan(_entries(spark, sf), start=F.lit("Customer#000000500")).select("key", "value")


@query("src_03_keyspace_scan", "SELECT c_nationkey AS keyspace_id, c_name AS key, c_mktsegment AS value FROM customer WHERE c_nationkey = 7 ORDER BY key")
def _(spark, sf):
    return KV.scan(_entries(spark, sf), F.lit(7), ordered=True).select("keyspace_id", "key", "value")


@query("src_04_prefix_scan", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def _(spark, sf):
    return KV.prefix_scan(_entries(spark, sf), "Customer#00000001").select("key", "value")


@query("src_05_prefix_keys", "SELECT c_name AS key FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def _(spark, sf):
    return KV.prefix_scan(_entries(spark, sf), "Customer#0000001", keys_only=True)


@query("src_06_structured_prefix_scan", "SELECT c_mktsegment AS value FROM customer WHERE starts_with(c_name, 'Customer#00000002')")
def _(spark, sf):
    return KV.prefix_scan(_entries(spark, sf), "Customer#00000002").drop("key", "keyspace_id", "id")


@query("src_07_point_read", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name = 'Customer#000000042'")
def _(spark, sf):
    return R.find(_entries(spark, sf), {"key": "Customer#000000042"}).select("key", "value")


@query("src_08_point_read_no_data", "SELECT c_name AS key, md5(c_mktsegment) AS digest FROM customer WHERE c_name = 'Customer#000000042'")
def _(spark, sf):
    return R.find(_entries(spark, sf), {"key": "Customer#000000042"}).select("key", F.md5("value").alias("digest"))


@query("src_09_exists", "SELECT o_orderkey AS key, CAST(EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS INTEGER) AS found FROM orders")
def _(spark, sf):
    entries = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return KV.exists(entries, table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")))


@query("src_10_dictionary", f"WITH {DOCS} SELECT name, count(*) AS occurrences FROM (SELECT unnest(json_keys(doc)) AS name FROM docs) GROUP BY name")
def _(spark, sf):
    return D.dictionary(_docs(spark, sf))


FRAMES = """frames AS (SELECT source AS log, doc_id, octet_length(encode(text)) AS length,
  CAST(coalesce(sum(16 + octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM documents)"""


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("log"), "doc_id", "text")
    return L.positions(d, "log", ["doc_id"], "text")


@query("src_11_log_read", f"WITH {FRAMES} SELECT doc_id, \"offset\", CAST(length AS INTEGER) AS length FROM frames WHERE log = 'src3' AND \"offset\" >= 10000 ORDER BY \"offset\" LIMIT 20")
def _(spark, sf):
    return L.read(_frames(spark, sf), "src3", 10000, 20).select("doc_id", "offset", "length")


@query("src_12_log_decode")
def _(spark, sf):
    """Frames of each document encoded and decoded again: ok says that the payload came back."""

    def round_trip(rows):
        import pandas as pd

        for batch in rows:
            starts, held = [0], 0  # parts of few frames and few bytes, but never less than a frame
            for i, t in enumerate(batch["text"]):
                if i - starts[-1] >= L.TOGETHER or held > L.TOGETHER_BYTES:
                    starts, held = [*starts, i], 0
                held += len(t)
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                pdf = batch.iloc[a:b]
                payloads = [t.encode() for t in pdf["text"]]
                good = [[p for _, p in log] == [payload] for log, payload in zip(L.decode_each(L.frames(payloads)), payloads)]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "ok": good})

    return table(spark, sf, "documents").select("doc_id", "text").mapInPandas(round_trip, "doc_id long, ok boolean")


@query("src_13_find_by_example", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#13' AND p_size = 10")
def _(spark, sf):
    return R.find(table(spark, sf, "part"), {"p_brand": "Brand#13", "p_size": 10}).select("p_partkey", "p_name")


@query("src_15_key_condition", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber > 1")
def _(spark, sf):
    return R.find(table(spark, sf, "lineitem"), {"l_orderkey": 7}, R.compare("l_linenumber", "GREATER_THAN", 1)).select("l_orderkey", "l_linenumber", "l_quantity")


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Customers numbered as a 4-ary tree: entries (parent, name, inode)."""
    c = table(spark, sf, "customer")
    parent = F.when(F.col("c_custkey") > 0, F.floor((F.col("c_custkey") - 1) / 4))
    return c.select(parent.cast("long").alias("parent"), F.concat(F.lit("n"), "c_custkey").alias("name"), F.col("c_custkey").alias("inode"))


TREE = "tree AS (SELECT CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 4 END AS parent, 'n' || c_custkey AS name, c_custkey AS inode FROM customer)"


@query("src_16_list_children", f"WITH {TREE} SELECT name, inode FROM tree WHERE parent = 5")
def _(spark, sf):
    return _tree(spark, sf).where("parent = 5").select("name", "inode")


@query(
    "src_17_resolve_path",
    f"""WITH RECURSIVE {TREE}, p AS (
          SELECT inode, '//n' || inode AS path FROM tree WHERE parent = 0
          UNION ALL SELECT t.inode, p.path || '//n' || t.inode FROM tree t JOIN p ON t.parent = p.inode)
        SELECT path || '/' AS path, inode FROM p UNION ALL SELECT path || '/none', NULL FROM p""",
)
def _(spark, sf):
    """The path of every node, and one below each that doesn't exist."""
    t = _tree(spark, sf)
    step = lambda s, _: F.when(s["at"] > 0, F.struct(F.floor((s["at"] - 1) / 4).alias("at"), F.concat(F.lit("//n"), s["at"], s["path"]).alias("path"))).otherwise(s)
    path = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.col("inode").alias("at"), F.lit("").alias("path")), step)["path"]
    paths = t.where("parent IS NOT NULL").select(path.alias("path"))
    paths = paths.select(F.explode(F.array(F.concat("path", F.lit("/")), F.concat("path", F.lit("/none")))).alias("path"))
    return TR.resolve(t, paths, 0)


@query("src_18_byte_range", "SELECT doc_id, substr(text, 11, 20) AS part FROM documents WHERE octet_length(encode(text)) = length(text)")
def _(spark, sf):
    d = table(spark, sf, "documents").where(F.octet_length("text") == F.char_length("text"))
    return d.select("doc_id", F.decode(O.byte_range(F.encode("text", "UTF-8"), 10, 29), "UTF-8").alias("part"))


@query("src_19_blob_by_hash", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE sha256(text) IN (SELECT min(sha256(text)) FROM documents)")
def _(spark, sf):
    hashed = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return hashed.join(F.broadcast(hashed.agg(F.min("hash").alias("hash"))), "hash", "left_semi").select("doc_id", "hash")


@query("src_20_object_listing")
def _(spark, sf):
    """Names and sizes of the table files; content isn't read."""
    listed = O.list_objects(spark, sf, "*.parquet")
    return listed.select(S.last_part(F.col("path")).alias("name"), "length")


SEGMENTS = f"""chunks AS (SELECT user_id AS segment, {K} AS start, {K} + 10 AS stop, event_id AS seq FROM events)"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = _commands(spark, sf)
    return c.select(F.col("user_id").alias("segment"), F.col("delta").alias("start"), (F.col("delta") + 10).alias("end"), F.col("event_id").alias("seq"))


OVERLAY = f"""{SEGMENTS},
cuts AS (SELECT DISTINCT segment, p FROM (SELECT segment, unnest([start, stop]) AS p FROM chunks)),
pieces AS (SELECT segment, p, lead(p) OVER (PARTITION BY segment ORDER BY p) AS til FROM cuts),
seen AS (SELECT s.segment, s.p, s.til, max(c.seq) AS seq FROM pieces s JOIN chunks c ON s.segment = c.segment AND c.start <= s.p AND c.stop >= s.til GROUP BY ALL),
flagged AS (SELECT *, CASE WHEN lag(til) OVER w = p AND lag(seq) OVER w = seq THEN 0 ELSE 1 END AS b FROM seen WINDOW w AS (PARTITION BY segment ORDER BY p)),
islands AS (SELECT *, sum(b) OVER (PARTITION BY segment ORDER BY p) AS i FROM flagged),
shown AS (SELECT segment, seq, min(p) AS start, max(til) AS "end" FROM islands GROUP BY segment, i, seq)"""


@query(
    "src_21_volume_read",
    f"""WITH {OVERLAY}, want AS (SELECT DISTINCT segment FROM chunks)
        SELECT segment, greatest(start, 20) AS lo, least("end", 60) AS hi, seq FROM shown WHERE start < 60 AND "end" > 20""",
)
def _(spark, sf):
    shown = I.overlay(_chunks(spark, sf), "segment", "seq")
    want = shown.select("segment").distinct().withColumns({"from": F.lit(20).cast("long"), "until": F.lit(60).cast("long")})
    return I.overlaps(want, shown, "segment", 50).select("segment", "lo", "hi", "seq")


@query("src_23_collection", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf):
    return table(spark, sf, "region")


@query("src_24_list_queues", "SELECT DISTINCT event_type AS name FROM events WHERE starts_with(event_type, 'p')")
def _(spark, sf):
    queues = table(spark, sf, "events").select(F.lit("p1").alias("project"), F.col("event_type").alias("name")).distinct()
    return Q.list_queues(queues, "p1", "p").select("name")


@query("src_26_prefix_view", "SELECT substr(c_name, 10) AS key, c_mktsegment AS value FROM customer WHERE starts_with(c_name, 'Customer#')")
def _(spark, sf):
    return KV.prefix_view(_entries(spark, sf), "Customer#").select("key", "value")


@query("src_29_columns", "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM orders)")
def _(spark, sf):
    return spark.createDataFrame([(c,) for c in table(spark, sf, "orders").columns], "name string")


# --- Sinks and changes ----------------------------------------------------------------------------------


@query("snk_01_set_last_write", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    return KV.last_write(_commands(spark, sf), ["user_id"], "event_type", ["ts", "event_id"])


@query("snk_02_set_if_absent", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    return KV.first_write(_commands(spark, sf), ["user_id"], "event_type", ["ts", "event_id"])


def _conditional(spark: SparkSession, sf: str) -> DataFrame:
    """Commands: every third only if absent, views set if the value is the one before in their type."""
    c = _commands(spark, sf)
    op = F.when(F.col("event_id") % 7 == 0, "DELETE").otherwise("SET")
    return c.select(
        "user_id", "ts", "event_id", op.alias("op"), F.col("event_type").alias("value"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("if_value"), (F.col("event_id") % 3 == 0).alias("if_not_exists"),
    )


CAS = """WITH RECURSIVE cmd AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_id % 7 = 0 THEN 'DELETE' ELSE 'SET' END AS op,
         event_type AS value, CASE WHEN event_id % 2 = 0 THEN event_type END AS if_value, event_id % 3 = 0 AS absent FROM events),
state AS (
  SELECT user_id, 0::BIGINT AS n, NULL::VARCHAR AS v, 0::BIGINT AS applied FROM (SELECT DISTINCT user_id FROM cmd)
  UNION ALL
  SELECT user_id, n, CASE WHEN ok THEN CASE WHEN op = 'SET' THEN value END ELSE v END, applied + CASE WHEN ok THEN 1 ELSE 0 END
  FROM (SELECT s.user_id, c.n, c.op, c.value, s.v, s.applied,
               coalesce(CASE WHEN absent THEN s.v IS NULL WHEN if_value IS NOT NULL THEN s.v = if_value ELSE true END, false)
               AND (op <> 'DELETE' OR s.v IS NOT NULL) AS ok
        FROM state s JOIN cmd c ON c.user_id = s.user_id AND c.n = s.n + 1))
SELECT user_id, arg_max(coalesce(v, ''), n) AS value, max(applied) AS applied FROM state GROUP BY user_id"""


@query("snk_03_compare_and_set", CAS)
def _(spark, sf):
    out = KV.conditional_fold(_conditional(spark, sf), ["user_id"], ["ts", "event_id"])
    return out.select("user_id", F.coalesce("value", F.lit("")).alias("value"), "applied")


@query("snk_04_delete_fold", "SELECT user_id, v AS value FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v FROM events GROUP BY user_id) WHERE v <> 'error'")
def _(spark, sf):
    return KV.live(_commands(spark, sf).withColumn("op", F.col("event_type")), ["user_id"], "op", "event_type", ["ts", "event_id"], "error")


@query("snk_05_multi_delete", "SELECT count(*) AS changed FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumn("key", F.col("o_custkey"))
    return KV.multi_delete(orders, table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("key")))[1]


@query("snk_06_append_fold", "SELECT user_id, string_agg(event_type, '' ORDER BY ts, event_id) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    return KV.appended(_commands(spark, sf), ["user_id"], "event_type", ["ts", "event_id"])


@query("snk_07_increment_fold", f"SELECT user_id, CAST(sum({K}) AS BIGINT) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    return KV.incremented(_commands(spark, sf), ["user_id"], F.col("delta"))


@query("snk_08_incr_decr", f"SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN {K} ELSE -{K} END) AS BIGINT) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    return KV.incremented(_commands(spark, sf), ["user_id"], F.when(F.col("event_type") == "click", F.col("delta")).otherwise(-F.col("delta")))


@query(
    "snk_09_compound",
    """WITH c AS (SELECT o_orderkey AS seq, unnest([1, 2]) AS child, o_custkey, o_orderstatus, o_orderpriority FROM orders)
       SELECT o_custkey AS key, arg_max(CASE child WHEN 1 THEN o_orderstatus ELSE o_orderpriority END, (seq, child)) AS value FROM c GROUP BY o_custkey""",
)
def _(spark, sf):
    child = lambda v: F.struct(F.lit("SET").alias("op"), F.col("o_custkey").alias("key"), F.col(v).alias("value"))
    requests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.array(child("o_orderstatus"), child("o_orderpriority")).alias("children"))
    return KV.last_write(KV.compound(requests), ["key"], "value", ["seq", "child"])


@query("snk_10_structured_set", f"WITH {DOCS} SELECT key, json_extract_string(doc, '$.k') AS k, json_extract_string(doc, '$.kind') AS kind FROM docs")
def _(spark, sf):
    return D.expand(_docs(spark, sf), ["k", "kind"], keep=("key",))


def _le(h: str) -> str:
    return " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2))


VERSION = "CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT)"
VERSIONS = f"""v AS (SELECT c_custkey AS key, CAST(('0x' || {_le("md5(c_mktsegment || c_custkey)")}) AS UBIGINT)::HUGEINT AS u FROM customer)"""


@query(
    "snk_11_versioned_delete",
    f"""WITH {VERSIONS}, r AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN {VERSION} WHEN o_orderkey % 3 = 0 THEN 1 END AS want
          FROM orders LEFT JOIN v ON v.key = o_orderkey)
        SELECT r.key, CASE WHEN v.key IS NULL THEN 'NOT_FOUND' WHEN r.want IS NOT NULL AND r.want <> {VERSION} THEN 'VERSION_MISMATCH' ELSE 'DONE' END AS code
        FROM r LEFT JOIN v ON r.key = v.key""",
)
def _(spark, sf):
    entries = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.concat("c_mktsegment", "c_custkey").alias("value"))
    version = S.md5_version(F.col("value"))
    known = entries.select(F.col("key").alias("o_orderkey"), version.alias("v"))
    wanted = F.when(F.col("o_orderkey") % 2 == 0, F.col("v")).when(F.col("o_orderkey") % 3 == 0, F.lit(1))
    requests = table(spark, sf, "orders").join(known, "o_orderkey", "left").select(F.col("o_orderkey").alias("key"), wanted.alias("if_version"))
    return KV.versioned_delete(entries, requests, version)


@query("snk_12_create_keyspace", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT 'NEW', max(n_nationkey) + 1 FROM nation")
def _(spark, sf):
    known = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"))
    return D.ensure_keys(known, spark.range(1).select(F.lit("NEW").alias("name")))


@query(
    "snk_13_ensure_keys",
    f"""WITH {DOCS}, names AS (SELECT DISTINCT unnest(json_keys(doc)) AS name FROM docs)
        SELECT 'k' AS name, CAST(1 AS BIGINT) AS id UNION ALL SELECT name, 1 + row_number() OVER (ORDER BY name) FROM names WHERE name <> 'k'""",
)
def _(spark, sf):
    known = spark.range(1).select(F.lit("k").alias("name"), F.lit(1).cast("long").alias("id"))
    return D.ensure_keys(known, D.dictionary(_docs(spark, sf)))


@query("snk_14_log_append", f"WITH {FRAMES} SELECT log, doc_id, \"offset\", \"offset\" + 16 + length AS next_offset FROM frames")
def _(spark, sf):
    return _frames(spark, sf).select("log", "doc_id", "offset", "next_offset")


@query("snk_15_insert", "SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT o_custkey + 1000000, min(o_orderpriority) FROM orders GROUP BY o_custkey")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    new = table(spark, sf, "orders").groupBy((F.col("o_custkey") + 1000000).alias("c_custkey")).agg(F.min("o_orderpriority").alias("c_mktsegment"))
    return R.insert(rows, new.union(rows), ["c_custkey"])


@query(
    "snk_16_guarded_update",
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_acctbal > 0 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment, c_acctbal, (c_custkey % 2 = 0 AND c_acctbal > 0) AS changed FROM customer",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = rows.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("VIP"))
    return R.update(rows, new, ["c_custkey"], F.col("c_acctbal") > 0)


@query("snk_17_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000, 'NEW' FROM customer WHERE c_custkey % 2 = 0")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    even = rows.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("NEW"))
    return R.upsert(rows, even.union(even.withColumn("c_custkey", F.col("c_custkey") + 1000000)), ["c_custkey"])


@query("snk_18_guarded_delete", "SELECT c_custkey FROM customer WHERE NOT (c_nationkey = 3 AND c_acctbal < 0)")
def _(spark, sf):
    rows = table(spark, sf, "customer")
    return R.delete(rows, rows.where("c_nationkey = 3"), ["c_custkey"], F.col("c_acctbal") < 0).select("c_custkey")


@query("snk_19_reindex", "SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer WHERE c_mktsegment <> lower(c_mktsegment)")
def _(spark, sf):
    return R.reindex(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), {"c_mktsegment": F.lower("c_mktsegment")})


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    bodies = e.select(F.col("event_type").alias("queue"), F.col("event_id").alias("message_id"), F.col("props").alias("body"))
    sent = Q.send(bodies, 0)
    return sent.withColumn("invisible_until", F.col("message_id") % 100 * 1000)


@query("snk_20_send", "SELECT event_id AS message_id, md5(props) AS body_md5, CAST(1 AS BIGINT) AS version FROM events")
def _(spark, sf):
    return _messages(spark, sf).select("message_id", "body_md5", "version")


RECEIVE = """received AS (SELECT queue, message_id, CAST(2 AS BIGINT) AS version, CAST(80000 AS BIGINT) AS invisible_until FROM (
  SELECT event_type AS queue, event_id AS message_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 100 * 1000, event_id) AS n
  FROM events WHERE event_id % 100 * 1000 < 50000) WHERE n <= 10)"""


@query("snk_21_receive", f"WITH {RECEIVE} SELECT * FROM received")
def _(spark, sf):
    return Q.receive(_messages(spark, sf), 50_000, 10).select("queue", "message_id", "version", "invisible_until")


@query("snk_22_delete_by_receipt", f"WITH {RECEIVE} SELECT event_type AS queue, count(*) AS remaining FROM events WHERE (event_type, event_id) NOT IN (SELECT queue, message_id FROM received WHERE message_id % 2 = 0) GROUP BY event_type")
def _(spark, sf):
    got = Q.receive(_messages(spark, sf), 50_000, 10)
    after = R.upsert(_messages(spark, sf), got, ["queue", "message_id"])
    stale = F.when(F.col("message_id") % 2 == 0, Q.receipt()).otherwise(F.concat_ws(":", "message_id", F.lit(1)))
    return Q.delete(after, got.select("queue", stale.alias("receipt"))).groupBy("queue").agg(F.count("*").alias("remaining"))


@query("snk_23_create_if_absent", f"WITH {TREE} SELECT parent, name FROM tree UNION SELECT 0, 'n1' UNION SELECT 0, 'new'")
def _(spark, sf):
    t = _tree(spark, sf).select("parent", "name")
    new = spark.createDataFrame([(0, "n1"), (0, "new")], "parent long, name string")
    return R.insert(t, new, ["parent", "name"])


@query("snk_24_tombstones", f"WITH {TREE} SELECT inode, CAST(1000 AS BIGINT) AS at_millis FROM tree WHERE parent = 2")
def _(spark, sf):
    t = _tree(spark, sf)
    return TR.delete(t, t.where("parent = 2").select("parent", "name"), 1000)[1].select("inode", F.col("at").alias("at_millis"))


@query("snk_25_move", f"WITH {TREE} SELECT CASE WHEN parent = 2 THEN 3 ELSE parent END AS parent, name, inode FROM tree")
def _(spark, sf):
    t = _tree(spark, sf)
    return TR.move(t, t.where("parent = 2").select("parent", "name", F.lit(3).cast("long").alias("to_parent"), F.col("name").alias("to_name")))


@query("snk_26_blob_put", "SELECT sha256(text) AS hash, CAST(max(octet_length(encode(text))) AS BIGINT) AS length, count(*) AS copies FROM documents GROUP BY 1")
def _(spark, sf):
    return O.content_addressed(table(spark, sf, "documents"), "text")


@query("snk_27_interval_overlay", f'WITH {OVERLAY} SELECT segment, start, "end", seq FROM shown')
def _(spark, sf):
    return I.overlay(_chunks(spark, sf), "segment", "seq")


@query(
    "snk_29_collection_changes",
    f"""WITH c AS (SELECT user_id, event_type AS field, (ts, event_id) AS o, {K} AS v, event_id % 4 = 0 AS is_set FROM events),
        b AS (SELECT user_id, field, arg_max(v, o) AS base, max(o) AS since FROM c WHERE is_set GROUP BY ALL)
        SELECT c.user_id, c.field, CAST(coalesce(any_value(b.base), 0) + coalesce(sum(CASE WHEN NOT is_set AND (since IS NULL OR o > since) THEN v END), 0) AS VARCHAR) AS value
        FROM c LEFT JOIN b ON c.user_id = b.user_id AND c.field = b.field GROUP BY c.user_id, c.field""",
)
def _(spark, sf):
    c = _commands(spark, sf)
    op = F.when(F.col("event_id") % 4 == 0, "$set").otherwise("$inc")
    changes = c.select("user_id", op.alias("op"), F.col("event_type").alias("field"), F.col("delta").cast("string").alias("value"), "ts", "event_id")
    return D.fold_fields(changes, "user_id", ["ts", "event_id"])


@query("snk_30_snapshot", "SELECT * FROM nation")
def _(spark, sf):
    from keelson.session import shared_dir

    folder = f"{shared_dir(spark)}/nation-snapshots"
    for version in (1, 2):
        O.write_snapshot(table(spark, sf, "nation"), folder, version, ["n_nationkey"])
    return O.latest_snapshot(spark, folder)


@query("snk_31_row_encoding", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(r_name)) AS BIGINT) AS chars FROM region")
def _(spark, sf):
    cells = table(spark, sf, "region").select(F.to_json(F.struct("*")).alias("row"))
    back = cells.select(F.from_json("row", "r_regionkey int, r_name string").alias("r"))
    return back.agg(F.count("*").alias("n"), F.sum(F.length("r.r_name")).alias("chars"))


@query("snk_33_ref_compare_and_put", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_mktsegment").alias("was"))
    wanted = rows.where("c_custkey % 2 = 0 OR c_custkey % 3 = 0")
    seen = F.when(F.col("c_custkey") % 3 == 0, F.col("was")).otherwise("stale")
    new = wanted.select("c_custkey", F.lit("moved").alias("c_mktsegment"), seen.alias("was"))
    return R.update(rows, new, ["c_custkey"], F.col("was") == F.col("_new_was")).select("c_custkey", "c_mktsegment")


@query("snk_34_create_table_as", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    from keelson.session import settle

    return settle(table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")), "ctas")


# --- Projections, filters --------------------------------------------------------------------------------


@query("prj_01_column", "SELECT p_name FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_name")


@query("prj_02_alias", "SELECT p_name AS k1 FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("k1"))


@query("prj_03_reorder", "SELECT p_size, p_name, p_name AS again, p_partkey FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_size", "p_name", F.col("p_name").alias("again"), "p_partkey")


@query("prj_04_star", f"WITH {DOCS} SELECT key, json_extract_string(doc, '$.k') AS k, json_extract_string(doc, '$.kind') AS kind, CAST(json_extract(doc, '$.nested') AS VARCHAR) IS NOT NULL AS has_nested FROM docs")
def _(spark, sf):
    docs = _docs(spark, sf)
    return D.expand(docs, ["k", "kind", "nested"], keep=("key",)).withColumn("has_nested", F.col("nested").isNotNull()).drop("nested")


@query("prj_05_json_path", f"WITH {DOCS} SELECT key, json_extract_string(doc, '$.nested.a.b') AS b, json_extract_string(doc, '$.k.a') AS none FROM docs")
def _(spark, sf):
    return D.project(_docs(spark, sf), {"b": "nested.a.b", "none": "k.a"}, keep=("key",))


@query("prj_06_computed", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, upper(l_returnflag) || '!' AS flag FROM lineitem")
def _(spark, sf):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", net.alias("net"), F.concat(F.upper("l_returnflag"), F.lit("!")).alias("flag"))


@query("prj_07_suppress_fields", "SELECT c_mktsegment AS value FROM customer")
def _(spark, sf):
    return _entries(spark, sf).select("key", "value").drop("key")


@query("prj_08_requested_properties", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, sf):
    requested = ["c_acctbal", "c_shoe_size"]
    customer = table(spark, sf, "customer")
    return customer.select("c_custkey", *[c for c in requested if c in customer.columns])


@query("flt_01_where", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 50 OR user_id = 7")
def _(spark, sf):
    return table(spark, sf, "events").where((F.col("event_type") == "click") & (F.col("value") > 50) | (F.col("user_id") == 7)).select("event_id")


@query("flt_02_example_equality", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(spark, sf):
    return R.find(table(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey")


@query("flt_03_less_than", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000")
def _(spark, sf):
    return table(spark, sf, "supplier").where(R.compare("s_acctbal", "LESS_THAN", 1000)).select("s_suppkey")


@query("flt_04_greater_and_starts_with", "SELECT p_partkey FROM part WHERE p_size > 40 AND starts_with(p_brand, 'Brand#1')")
def _(spark, sf):
    return table(spark, sf, "part").where(R.compare("p_size", "GREATER_THAN", 40) & R.compare("p_brand", "STARTS_WITH", "Brand#1")).select("p_partkey")


@query("flt_05_guard", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    out = R.update(rows, rows.withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"], F.col("c_nationkey") == 3)
    return out.select("c_custkey", "c_acctbal")


@query("flt_06_hash_and_range_key", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 33 AND l_linenumber = 2")
def _(spark, sf):
    return R.find(table(spark, sf, "lineitem"), {"l_orderkey": 33, "l_linenumber": 2}).select("l_orderkey", "l_linenumber")


@query("flt_07_keyspace_membership", "SELECT c_name AS key FROM customer WHERE c_nationkey = 4 AND starts_with(c_name, 'Customer#0000')")
def _(spark, sf):
    return KV.prefix_scan(KV.scan(_entries(spark, sf), F.lit(4)), "Customer#0000", keys_only=True)


@query("flt_08_lower_bound", "SELECT min(c_name) AS first_key, (SELECT max(c_name) FROM customer WHERE c_name <= 'Customer#000000077x') AS floor_key FROM customer WHERE c_name >= 'Customer#000000077x'")
def _(spark, sf):
    e, at = _entries(spark, sf), F.lit("Customer#000000077x")
    return e.agg(F.min(F.when(F.col("key") >= at, F.col("key"))).alias("first_key"), F.max(F.when(F.col("key") <= at, F.col("key"))).alias("floor_key"))


@query("flt_09_valid_checksum", "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("stored", F.crc32("text") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    return d.where(F.crc32("text") == F.col("stored")).select("doc_id")


@query("flt_10_modified_since", "SELECT count(*) AS n FROM events WHERE date_trunc('second', ts) <> (SELECT max(date_trunc('second', ts)) FROM events)")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.date_trunc("second", "ts").alias("s"))
    top = F.broadcast(e.agg(F.max("s").alias("since")))
    return e.crossJoin(top).where("s <> since").agg(F.count("*").alias("n"))


@query("flt_11_token_expiry", "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 365 DAY >= TIMESTAMP '1997-01-01'")
def _(spark, sf):
    live = F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS") >= F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")
    return table(spark, sf, "orders").where(live).select("o_orderkey")


@query("flt_12_type_prefix", "SELECT c_custkey AS id, 'C' AS kind FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("C:"), "c_name").alias("record"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("S:"), "s_name").alias("record"))
    return c.unionByName(s).where(F.col("record").startswith("C:")).select("id", F.substring("record", 1, 1).alias("kind"))


# --- Joins --------------------------------------------------------------------------------------------------


@query("jon_01_self_join", "SELECT a.n_name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.alias("a"), n.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select("a.n_name", F.col("b.n_name").alias("other"))


@query("jon_02_acl_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("jon_03_semi_access", "SELECT c_custkey FROM customer WHERE c_nationkey = 1 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    granted = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    owned, others = c.where("c_nationkey = 1"), c.where("c_nationkey <> 1")
    return owned.union(others.join(granted, "c_custkey", "left_semi")).select("c_custkey")


@query("jon_04_lookup_chain", "SELECT o_orderkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    t = {n: table(spark, sf, n) for n in ("orders", "customer", "nation", "region")}
    out = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return out.join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "r_name")


@query("jon_05_entry_inode", f"WITH {TREE} SELECT name, c_acctbal FROM tree LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON inode = c_custkey WHERE parent = 3")
def _(spark, sf):
    inodes = table(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("inode"), "c_acctbal")
    return TR.list_children(_tree(spark, sf), inodes, 3).select("name", "c_acctbal")


@query("jon_06_index_dereference", "SELECT c_name AS name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf):
    c = table(spark, sf, "customer")
    index = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("primary"))
    return index.join(c, F.col("primary") == F.col("c_custkey")).select("name", "c_acctbal")


@query("jon_07_keys_to_values", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'MACHINERY'")
def _(spark, sf):
    values = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("c_mktsegment"))
    out = table(spark, sf, "orders").join(values, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.where("c_mktsegment IS NOT NULL").select("o_orderkey", "c_mktsegment")


@query(
    "jon_08_recursive_path",
    """WITH RECURSIVE e AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 4 END AS parent FROM customer),
       up AS (SELECT node, parent AS ancestor, 1 AS depth FROM e WHERE parent IS NOT NULL
              UNION ALL SELECT u.node, e.parent, u.depth + 1 FROM up u JOIN e ON e.node = u.ancestor WHERE e.parent IS NOT NULL)
       SELECT node, ancestor, depth FROM up""",
)
def _(spark, sf):
    edges = _tree(spark, sf).select(F.col("inode").alias("node"), "parent")
    return TR.ancestors(edges)


@query("jon_09_range_chunks", f"WITH {SEGMENTS}, r AS (SELECT o_orderkey AS id, o_custkey AS segment, o_orderkey % 90 AS lo, o_orderkey % 90 + 15 AS hi FROM orders) SELECT r.id, c.seq, greatest(lo, start) AS lo, least(hi, stop) AS hi FROM r JOIN chunks c ON c.segment = r.segment AND start < r.hi AND stop > r.lo")
def _(spark, sf):
    start = F.col("o_orderkey") % 90
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("segment"), start.alias("from"), (start + 15).alias("until"))
    return I.overlaps(r, _chunks(spark, sf), "segment", 32).select("id", "seq", "lo", "hi")


@query("jon_10_anti_peers", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') ORDER BY c_custkey LIMIT 50")
def _(spark, sf):
    dead = table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").where("c_acctbal > 0").join(dead, "c_custkey", "left_anti").select("c_custkey").orderBy("c_custkey").limit(50)


@query(
    "jon_11_floor_segment",
    f"""WITH {FRAMES}, s AS (SELECT log, "offset" AS start FROM frames WHERE doc_id % 100 < 20)
        SELECT f.log, f."offset", max(s.start) AS segment FROM frames f LEFT JOIN s ON s.log = f.log AND s.start <= f."offset" GROUP BY ALL""",
)
def _(spark, sf):
    f = _frames(spark, sf)
    return L.segment_of(f.where("doc_id % 100 < 20").select("log", F.col("offset").alias("start")), f.select("log", "offset"))


# --- Aggregations, windows, sorts, sets -------------------------------------------------------------------


@query("agg_01_changed_count", "SELECT count(*) FILTER (WHERE o_orderkey % 2 = 0) AS changed FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("changed"))


@query("agg_05_max_key", "SELECT n_regionkey, max(n_nationkey) + 1 AS next_id FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg((F.max("n_nationkey") + 1).alias("next_id"))


@query("agg_06_arg_max_valid", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS page FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("page"))


@query("agg_07_min_open", "SELECT min(event_id) AS horizon FROM events WHERE event_type = 'purchase'")
def _(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase'").agg(F.min("event_id").alias("horizon"))


@query("agg_08_distinct_keys", f"WITH {DOCS} SELECT DISTINCT unnest(json_keys(doc)) AS name FROM docs")
def _(spark, sf):
    return D.dictionary(_docs(spark, sf)).select("name")


@query("agg_09_multiset_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("agg_10_priority", f"SELECT event_type, p FROM (SELECT event_type, CAST(sum(CASE WHEN event_id % 2 = 0 THEN {K} ELSE -{K} END) AS BIGINT) AS p FROM events GROUP BY event_type) ORDER BY p DESC, event_type LIMIT 1")
def _(spark, sf):
    delta = F.when(F.col("event_id") % 2 == 0, F.col("delta")).otherwise(-F.col("delta"))
    sums = _commands(spark, sf).groupBy("event_type").agg(F.sum(delta).alias("p"))
    return sums.orderBy(F.col("p").desc(), "event_type").limit(1)


@query("agg_11_unique_probe", "SELECT n_nationkey, n_name FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")
def _(spark, sf):
    name = table(spark, sf, "nation").agg(F.min("n_name")).first()[0]
    return R.find_one(table(spark, sf, "nation"), {"n_name": name}).select("n_nationkey", "n_name")


@query(
    "agg_12_coalesce_ranges",
    """WITH r AS (SELECT user_id, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + 60 AS stop FROM events),
       b AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 86400 THEN 0 ELSE 1 END AS b FROM r),
       i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM b)
       SELECT user_id, min(start) AS start, max(stop) AS "end", count(*) AS pieces FROM i GROUP BY user_id, i""",
)
def _(spark, sf):
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    ranges = table(spark, sf, "events").select("user_id", start.alias("start"), (start + 60).alias("end"))
    return I.coalesce_ranges(ranges, ["user_id"], 86400)


@query("win_01_running_increment", f"SELECT event_id, CAST(sum({K}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM events")
def _(spark, sf):
    return KV.running(_commands(spark, sf), ["user_id"], ["ts", "event_id"], F.col("delta"), "value").select("event_id", "value")


@query("win_02_running_length", "SELECT event_id, CAST(sum(length(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS length FROM events")
def _(spark, sf):
    return KV.running(_commands(spark, sf), ["user_id"], ["ts", "event_id"], F.length("event_type"), "length").select("event_id", "length")


@query("win_03_log_offset", f'WITH {FRAMES} SELECT log, doc_id, "offset" FROM frames')
def _(spark, sf):
    return _frames(spark, sf).select("log", "doc_id", "offset")


@query("win_04_ranking", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders")
def _(spark, sf):
    by = Window.partitionBy("o_custkey")
    rank, before = F.rank().over(by.orderBy(F.col("o_totalprice").desc())), F.lag("o_orderkey").over(by.orderBy("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", rank.alias("r"), before.alias("previous"))


@query("srt_01_key_order", "SELECT c_name AS key FROM customer ORDER BY key LIMIT 100")
def _(spark, sf):
    return KV.scan(_entries(spark, sf), ordered=True).select("key").limit(100)


@query("srt_02_priority_order", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 50")
def _(spark, sf):
    return table(spark, sf, "part").orderBy(F.col("p_size").desc(), "p_partkey").select("p_partkey").limit(50)


@query("srt_01_key_order_whole", "SELECT c_name AS key FROM customer ORDER BY key")
def _(spark, sf):
    return KV.scan(_entries(spark, sf), ordered=True).select("key")


@query("srt_02_priority_order_whole", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey")
def _(spark, sf):
    return table(spark, sf, "part").orderBy(F.col("p_size").desc(), "p_partkey").select("p_partkey")


@query("srt_03_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf):
    return table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "o_totalprice").limit(25)


@query("lim_01_limit_after_filter", "SELECT c_custkey FROM customer WHERE c_nationkey = 2 ORDER BY c_custkey LIMIT 10")
def _(spark, sf):
    return R.find(table(spark, sf, "customer").orderBy("c_custkey"), {"c_nationkey": 2}, limit=10).select("c_custkey")


@query("lim_03_receive_batch", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def _(spark, sf):
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("n", F.row_number().over(line)).where("n <= 3").select("user_id", "event_id")


@query("lim_04_top_1", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def _(spark, sf):
    return table(spark, sf, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").select("p_partkey").limit(1)


@query("set_01_union_intersect_except", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0 UNION SELECT -1")
def _(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select("s_nationkey")
    gone = table(spark, sf, "nation").where("n_regionkey = 0").select("n_nationkey")
    return c.intersect(s).subtract(gone).union(spark.range(1).select(F.lit(-1).alias("k"))).distinct()


@query("set_02_membership", "SELECT n_nationkey AS id FROM nation WHERE n_regionkey <> 1 UNION SELECT n_nationkey FROM nation WHERE n_nationkey < 3")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_regionkey")
    return n.select("id").exceptAll(n.where("n_regionkey = 1").select("id")).union(n.where("id < 3").select("id")).distinct()


@query("set_03_key_union", f"WITH {DOCS} SELECT DISTINCT unnest(json_keys(doc)) AS name FROM docs UNION SELECT 'extra'")
def _(spark, sf):
    return D.dictionary(_docs(spark, sf)).select("name").union(spark.range(1).select(F.lit("extra").alias("name"))).distinct()


@query("set_04_keyspace_concatenation", "SELECT c_name AS key, 'customer' AS store FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("key"), F.lit("customer").alias("store"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("key"), F.lit("supplier").alias("store")))


# --- Scalar functions ------------------------------------------------------------------------------------------


def _scalar(name: str, source: str, key: str, spark_columns, oracle: str) -> None:
    """A query of one or more scalar expressions over a table."""

    @query(name, oracle)
    def _(spark, sf):
        return table(spark, sf, source).select(key, *[c.alias(n) for n, c in spark_columns().items()])


_scalar("str_f1_starts_with", "part", "p_partkey", lambda: {"v": F.startswith(F.encode("p_name", "UTF-8"), F.encode(F.lit("p"), "UTF-8"))}, "SELECT p_partkey, starts_with(p_name, 'p') AS v FROM part")
_scalar("str_f2_concat", "part", "p_partkey", lambda: {"v": F.concat("p_name", F.lit("|"), "p_brand")}, "SELECT p_partkey, p_name || '|' || p_brand AS v FROM part")
_scalar("str_f3_hex", "part", "p_partkey", lambda: {"lo": F.lower(F.hex("p_name")), "back": F.decode(F.unhex(F.hex("p_name")), "UTF-8")}, "SELECT p_partkey, lower(hex(p_name)) AS lo, p_name AS back FROM part")
_scalar("str_f4_base64url", "documents", "doc_id", lambda: {"v": S.base64url(F.encode("text", "UTF-8")), "back": F.decode(S.unbase64url(S.base64url(F.encode("text", "UTF-8"))), "UTF-8") == F.col("text")}, "SELECT doc_id, translate(base64(encode(text)), '+/', '-_') AS v, true AS back FROM documents")
_scalar("str_f5_utf8", "documents", "doc_id", lambda: {"n": F.length(F.encode("text", "UTF-8")), "same": F.decode(F.encode("text", "UTF-8"), "UTF-8") == F.col("text")}, "SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS n, true AS same FROM documents")
_scalar("str_f6_case", "part", "p_partkey", lambda: {"lo": F.lower("p_brand"), "up": F.upper("p_name")}, "SELECT p_partkey, lower(p_brand) AS lo, upper(p_name) AS up FROM part")
_scalar("str_f7_path_parts", "pages", "page_id", lambda: {"n": F.size(S.path_parts(F.col("url"))), "last": F.element_at(S.path_parts(F.col("url")), -1)}, "SELECT page_id, CAST(len(list_filter(string_split(url, '/'), lambda x: x <> '')) AS INTEGER) AS n, url_decode(list_filter(string_split(url, '/'), lambda x: x <> '')[-1]) AS last FROM pages")
_scalar("str_f8_parent_path", "pages", "page_id", lambda: {"parent": S.parent_path(F.col("url")), "last": S.last_part(F.col("url"))}, "SELECT page_id, regexp_extract(rtrim(url, '/'), '^(.*)/[^/]*$', 1) AS parent, string_split(rtrim(url, '/'), '/')[-1] AS last FROM pages")
_scalar("str_f9_strip_prefix", "customer", "c_custkey", lambda: {"v": F.substring("c_name", F.lit(10), F.length("c_name"))}, "SELECT c_custkey, substr(c_name, 10) AS v FROM customer")
_scalar("str_f10_octets", "documents", "doc_id", lambda: {"n": F.octet_length("text").cast("long")}, "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents")
_scalar("str_f11_parse_long", "lineitem", "l_orderkey", lambda: {"v": S.parse_long(F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, "+5").otherwise(F.concat(F.lit("-"), "l_partkey")))}, "SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE -l_partkey END AS v FROM lineitem")
_scalar("str_f12_compare_bytes", "part", "p_partkey", lambda: {"v": F.encode("p_name", "UTF-8") < F.encode(F.lit("m"), "UTF-8")}, "SELECT p_partkey, encode(p_name) < encode('m') AS v FROM part")
_scalar("hsh_01_md5", "documents", "doc_id", lambda: {"v": F.md5("text")}, "SELECT doc_id, md5(text) AS v FROM documents")
_scalar("hsh_02_md5_version", "customer", "c_custkey", lambda: {"v": S.md5_version(F.concat("c_mktsegment", "c_custkey"))}, f"WITH {VERSIONS} SELECT key AS c_custkey, {VERSION} AS v FROM v")
_scalar("hsh_03_sha256", "documents", "doc_id", lambda: {"v": F.sha2("text", 256)}, "SELECT doc_id, sha256(text) AS v FROM documents")
UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
_scalar("hsh_07_uuid3", "documents", "doc_id", lambda: {"v": S.uuid3(F.col("text"))}, f"SELECT doc_id, {UUID} AS v FROM (SELECT doc_id, md5(text) AS h FROM documents)")
_scalar("mth_01_wrap", "orders", "o_orderkey", lambda: {"v": S.wrap64(F.lit(9223372036854775807).cast("decimal(38,0)") + F.col("o_orderkey") * 3)}, "SELECT o_orderkey, CAST(-9223372036854775809 + o_orderkey * 3 AS BIGINT) AS v FROM orders WHERE o_orderkey > 0 UNION ALL SELECT 0, 9223372036854775807 FROM orders WHERE o_orderkey = 0")
_scalar("mth_02_ceil_div", "lineitem", "l_orderkey", lambda: {"v": S.ceil_div(F.col("l_extendedprice"), 4096)}, "SELECT l_orderkey, (CAST(trunc(l_extendedprice) AS BIGINT) + 4095) // 4096 AS v FROM lineitem")
_scalar("mth_03_div_mod", "orders", "o_orderkey", lambda: {"d": F.expr("o_orderkey div 7"), "m": F.col("o_orderkey") % 7}, "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey % 7 AS m FROM orders")
_scalar("mth_04_big_endian", "orders", "o_orderkey", lambda: {"h": F.hex(S.big_endian(F.col("o_orderkey"))), "back": S.from_big_endian(S.big_endian(F.col("o_orderkey")))}, "SELECT o_orderkey, lpad(CASE WHEN o_orderkey = 0 THEN '0' ELSE printf('%X', o_orderkey) END, 16, '0') AS h, o_orderkey AS back FROM orders")
_scalar("dat_02_add_duration", "events", "event_id", lambda: {"v": F.col("ts") + F.expr("INTERVAL 30 SECONDS")}, "SELECT event_id, ts + INTERVAL 30 SECOND AS v FROM events")
_scalar("dat_03_http_date", "orders", "o_orderkey", lambda: {"v": S.http_date(F.col("o_orderdate"))}, "SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S') || ' GMT' AS v FROM orders")
_scalar("dat_04_seconds", "events", "event_id", lambda: {"v": F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000)}, "SELECT event_id, epoch_us(ts) // 1000000 AS v FROM events")
_scalar("jsn_01_parse", "events", "event_id", lambda: {"k": F.try_variant_get(F.parse_json("props"), "$.k", "bigint")}, f"SELECT event_id, {K} AS k FROM events")
_scalar("jsn_02_path_get", "events", "event_id", lambda: {"v": D.json_path(F.col("props"), "k")}, "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
_scalar("jsn_03_keys", "events", "event_id", lambda: {"v": F.array_join(F.json_object_keys("props"), ",")}, "SELECT event_id, array_to_string(json_keys(props), ',') AS v FROM events")
_scalar("jsn_05_serialize", "nation", "n_nationkey", lambda: {"v": F.to_json(F.struct("n_nationkey", "n_name"))}, """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS v FROM nation""")
_scalar("jsn_06_type", "events", "event_id", lambda: {"v": S.json_type(F.when(F.col("event_id") % 3 == 0, D.json_path(F.col("props"), "k")).when(F.col("event_id") % 3 == 1, "true").otherwise(F.col("value").cast("string")))}, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'boolean' ELSE 'double' END AS v FROM events")
_scalar("xml_01_element", "part", "p_partkey", lambda: {"v": S.xml_element("name", F.concat(F.col("p_name"), F.lit("<&>")))}, "SELECT p_partkey, '<name>' || p_name || '&lt;&amp;&gt;</name>' AS v FROM part")


@query("hsh_04_crc32")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.crc32("text").alias("v"))


@query("hsh_05_crc32c")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.crc32c(F.encode("text", "UTF-8")).alias("v"))


@query("hsh_06_murmur3")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.murmur3(F.encode("p_name", "UTF-8")).alias("v"), (S.murmur3(F.encode("p_name", "UTF-8")) % 65535).alias("type_id"))


@query("hsh_08_random_ids")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.uuid().alias("id"))


@query("dat_01_now_millis", "SELECT n_nationkey, true AS recent FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", (F.unix_millis(F.current_timestamp()) > 1_700_000_000_000).alias("recent"))


@query("jsn_04_set_inc_json", f"SELECT user_id, CAST(sum({K}) AS BIGINT) AS total FROM events GROUP BY user_id")
def _(spark, sf):
    c = _commands(spark, sf).select("user_id", F.lit("$inc").alias("op"), F.lit("total").alias("field"), F.col("delta").cast("string").alias("value"), "ts", "event_id")
    merged = D.fold_fields(c, "user_id", ["ts", "event_id"])
    docs = merged.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("field", "value")))).alias("doc"))
    return docs.select("user_id", F.get_json_object("doc", "$.total").cast("long").alias("total"))


# --- Streaming, run to the end of the present input -----------------------------------------------------------


def _streamed(spark: SparkSession, source: DataFrame, batch, name: str, mode: str = "append") -> str:
    """Runs a stream of what there is through ``foreachBatch`` and returns the folder of its snapshots."""
    import uuid

    from keelson.session import shared_dir

    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    job = source.writeStream.outputMode(mode).foreachBatch(batch(f"{folder}/state")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return f"{folder}/state"


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{sf}/events.parquet*")


@query("str_02_command_stream", f"SELECT user_id AS key, CAST(sum({K}) AS BIGINT) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    from keelson.streaming.folds import apply_batches, merge_counters

    deltas = _event_stream(spark, sf).select(F.col("user_id").alias("key"), F.get_json_object("props", "$.k").cast("long").alias("delta"))
    folder = _streamed(spark, deltas, lambda f: apply_batches(f, merge_counters), "counters")
    last = spark.read.parquet(folder)
    return last.join(F.broadcast(last.agg(F.max("batch").alias("batch"))), "batch").select("key", "value")


@query(
    "str_03_visibility_queue",
    """SELECT queue, message_id, CAST(2 AS BIGINT) AS version FROM (
         SELECT event_type AS queue, CAST(event_id AS VARCHAR) AS message_id,
                row_number() OVER (PARTITION BY event_type ORDER BY event_id % 100 * 1000, CAST(event_id AS VARCHAR)) AS n
         FROM events WHERE event_id % 100 * 1000 < 50000) WHERE n <= 10""",
)
def _(spark, sf):
    from keelson.session import settle, shared_dir
    from keelson.streaming.folds import queue_stream

    none = F.lit(None).cast("string")
    e = table(spark, sf, "events")
    sends = e.select(F.col("event_type").alias("queue"), F.col("event_id").alias("seq"), F.lit("SEND").alias("op"), F.col("event_id").cast("string").alias("message_id"), F.col("props").alias("body"), F.lit(0).cast("long").alias("n"), (F.col("event_id") % 100 * 1000).alias("now"))
    asks = e.groupBy(F.col("event_type").alias("queue")).agg(F.lit(1 << 60).cast("long").alias("seq"))
    asks = asks.select("queue", "seq", F.lit("RECEIVE").alias("op"), none.alias("message_id"), none.alias("body"), F.lit(10).cast("long").alias("n"), F.lit(50_000).cast("long").alias("now"))
    commands = settle(sends.unionByName(asks), "queue-commands")
    stream = spark.readStream.schema(commands.schema).parquet(commands.inputFiles()[0].rpartition("/")[0])
    provider, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        delivered = _streamed(spark, queue_stream(stream), lambda f: lambda batch, i: batch.write.mode("overwrite").parquet(f"{f}/batch={i}"), "queue")
    finally:
        spark.conf.set(provider, was) if was else spark.conf.unset(provider)
    return spark.read.parquet(delivered).select("queue", "message_id", "version")


@query("str_05_subscription", "SELECT event_id, event_type FROM events")
def _(spark, sf):
    changes = _event_stream(spark, sf).select("event_id", "event_type")
    rows = _streamed(spark, changes, lambda f: lambda batch, i: batch.write.mode("overwrite").parquet(f"{f}/batch={i}"), "subscription")
    return spark.read.parquet(rows).select("event_id", "event_type")


def _window_stream(spark: SparkSession, sf: str, name: str, *window: str) -> DataFrame:
    """start, event_type and n of the streamed events' windows, under a watermark; of each window the row of the last batch that changed it."""
    from keelson.streaming.folds import windowed_counts

    counts = windowed_counts(_event_stream(spark, sf), *window)
    folder = _streamed(spark, counts, lambda f: lambda batch, i: batch.write.mode("overwrite").parquet(f"{f}/batch={i}"), name, "update")
    return spark.read.parquet(folder).groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("str_07_late_data", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    return _window_stream(spark, sf, "late", "1 hour", "2 hours").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("str_08_tumbling_windows", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    out = _window_stream(spark, sf, "tumbling", "1 hour", "2 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("str_08_sliding_windows", "SELECT (date_trunc('hour', ts) - o * INTERVAL 1 HOUR)::TIMESTAMP AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS o) GROUP BY ALL")
def _(spark, sf):
    out = _window_stream(spark, sf, "sliding", "2 hours", "2 hours", "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "str_08_sessions",
    """WITH b AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events),
       i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM b)
       SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, i""",
)
def _(spark, sf):
    from keelson.streaming.folds import sessions

    out = sessions(table(spark, sf, "events"), "1 hour", "2 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("str_09_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    first = _event_stream(spark, sf).select("user_id", "event_type").dropDuplicates()
    rows = _streamed(spark, first, lambda f: lambda batch, i: batch.write.mode("overwrite").parquet(f"{f}/batch={i}"), "first")
    return spark.read.parquet(rows).select("user_id", "event_type")


# --- Superset: what Spark SQL adds -------------------------------------------------------------------------------


@query("sql_bind_parameters", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100")
def _(spark, sf):
    return spark.sql("SELECT c_custkey FROM {c} WHERE c_mktsegment = :segment AND c_acctbal > :least", args={"segment": "BUILDING", "least": 100}, c=table(spark, sf, "customer"))


@query("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "sql_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )
