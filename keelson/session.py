"""Session builder, table loader and durable intermediate tables."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "keelson", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC and adaptive execution.

    ``master`` and everything in ``conf`` (dots written as ``__``) override the defaults; on a
    cluster both are left to ``spark-submit``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder ``sf_dir``, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset the session must be local, and a temporary folder is set; on a cluster an
    unset folder is an error, as no local folder is visible to every executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="keelson-"))
    return context.getCheckpointDir()


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again.

    What follows reads the same rows however often it runs, has a short lineage, and an executor
    that is lost takes nothing with it. ``discard`` deletes the table when it is no longer needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._keelson_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables, once everything that was made of them has been settled itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._keelson_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back(spark: SparkSession) -> None:
    """Has the executors collect their garbage, one task for each core, so that what earlier work left goes back to the system.

    A JVM enlarges its heap long before it collects it fully, and starts from the larger heap in what comes next. On a busy
    cluster, or where explicit collection is switched off, some executors keep their heap; results don't depend on it.
    """
    cores = spark.sparkContext.defaultParallelism
    collected = spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc') AS done")
    collected.write.format("noop").mode("overwrite").save()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors that don't have it installed; once per application."""
    context = spark.sparkContext
    if getattr(context, "_keelson_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="keelson-code-")) / "keelson.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._keelson_shipped = True
