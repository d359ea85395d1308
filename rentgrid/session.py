"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "rentgrid", shuffle_partitions: int = 8,
                  memory: str = "8g", extra: dict[str, str] | None = None) -> SparkSession:
    """A single-machine session for tests and ``bench.py``; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine, so there the
    setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="rentgrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    _delete_on_exit(spark, folder)
    return folder


#: Folders of the tables written since the innermost ``tables_made`` began.
_MADE: list[list[str]] = []


@contextmanager
def tables_made():
    """A list of the folders of all shared tables that are written inside the block."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        made = _MADE.pop()
        if _MADE:
            _MADE[-1].extend(made)


def drop_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete shared tables that nothing reads any more."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(table: DataFrame) -> None:
    """Delete a table that ``shared_table`` returned and that nothing reads any more."""
    drop_folders(table.sparkSession, [table._folder])


def _delete_on_exit(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Unlike a checkpoint the table keeps columns apart and tells the planner its
    size. It goes when the session's file system closes.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _delete_on_exit(spark, folder)
    if _MADE:
        _MADE[-1].append(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table._folder = folder
    return table


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
