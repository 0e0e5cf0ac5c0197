"""Message queues with a visibility timeout, as changes of a table of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How long a received message stays hidden.
VISIBILITY_MILLIS = 30_000


def list_queues(queues: DataFrame, project: object, prefix: str | None = None) -> DataFrame:
    out = queues.where(F.col("project") == F.lit(project))
    return out if prefix is None else out.where(F.col("name").startswith(prefix))


def send(bodies: DataFrame, now: int) -> DataFrame:
    """Messages from (queue, message_id, body): with the body's MD5, version 1, visible at once."""
    return bodies.withColumns({"body_md5": F.md5("body"), "version": F.lit(1).cast("long"), "invisible_until": F.lit(now).cast("long")})


def receive(messages: DataFrame, now: int, n: int) -> DataFrame:
    """Up to ``n`` visible messages of each queue, in order of invisible_until and id, hidden and one version on."""
    line = Window.partitionBy("queue").orderBy("invisible_until", "message_id")
    visible = messages.where(F.col("invisible_until") < now)
    taken = visible.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= n).drop("_n")
    return taken.withColumns({"version": F.col("version") + 1, "invisible_until": F.lit(now + VISIBILITY_MILLIS).cast("long")})


def receipt() -> Column:
    """A receipt names the message and the version that was received."""
    return F.concat_ws(":", "message_id", "version")


def delete(messages: DataFrame, receipts: DataFrame) -> DataFrame:
    """Messages without those whose receipt (queue, receipt) is current; stale receipts do nothing."""
    return messages.withColumn("receipt", receipt()).join(receipts, ["queue", "receipt"], "left_anti").drop("receipt")
