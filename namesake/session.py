"""Session settings and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "namesake", master: str | None = None, checkpoint_dir: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    Adaptive execution splits skewed join partitions and coalesces small ones;
    partition counts are left to it unless the caller passes one. On a cluster
    ``checkpoint_dir`` names the folder all executors share, unless the cluster does.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Call sites of every column expression are costly to record.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if checkpoint_dir:
        settings["spark.checkpoint.dir"] = checkpoint_dir
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder.

    A folder of our own is made only for a local master, where no cluster
    names one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="namesake-")
    sc.setCheckpointDir(made)
    return shared_dir(spark)


#: Paths of the tables ``cut`` and ``scratch`` made and nothing has removed, oldest first.
WRITTEN: list[str] = []


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(sc._jsc.hadoopConfiguration())


def file_system(spark: SparkSession, path: str):
    """(path, file system) as the cluster's own objects."""
    return _file_system(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` this evaluates the plan once and leaves a columnar
    table, so later scans prune columns. It outlives lost executors. The table
    is removed when the session's file system closes, or by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/namesake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, fs = _file_system(spark, path)
    fs.deleteOnExit(target)
    WRITTEN.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/namesake-{name}-{uuid.uuid4().hex}"
    target, fs = _file_system(spark, path)
    fs.deleteOnExit(target)
    WRITTEN.append(path)
    return path


def release(table: DataFrame) -> None:
    """Remove a table ``cut`` wrote, once a later one has replaced it.

    Only for a loop's former state: no plan that is still to run may read it.
    """
    remove(table.sparkSession, table.written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path of ours that no plan still to run reads."""
    target, fs = _file_system(spark, path)
    fs.delete(target, True)
    if path in WRITTEN:
        WRITTEN.remove(path)
