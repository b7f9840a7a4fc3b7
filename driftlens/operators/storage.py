"""Written tables that cut lineage, below the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of sessions that run on one machine and name none, as in tests.
_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where driver and tasks are one process."""
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="driftlens-"))
    return _OWN_FOLDER[0]


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the cluster's checkpoint folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table written below the shared folder.

    Unlike a checkpoint, which keeps the size estimate of its plan, the table has its files' true size:
    in a loop of joins such estimates multiply without end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Removes tables made by `stored` that nothing reads any more."""
    for df in tables:
        files = df.inputFiles() if df is not None else []
        if files and "/tables-" in files[0]:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
