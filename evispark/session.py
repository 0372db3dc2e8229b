"""A session with the settings that the operators expect."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "evispark", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one: UTC, adaptive execution with skew handling and coalescing.

    Memory, parallelism and shuffle partitions are the cluster's business; pass them in ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one where all is one machine."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evispark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that ``written`` made.
_folders: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read back: computed once however often it is used.

    A lost executor costs its own tasks, not the plan above. The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _folders:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the folder's owner clears it
            return


def make_importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package, wherever the driver was started from.

    On a cluster the package is installed on the executors or shipped with ``addPyFile``.
    """
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH", ""))))
