"""Session-level helpers: shared checkpoint folder, bounded broadcasts, session defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 200_000
# Files a task of a bucketed write may hold open, and the setting that allows it; beyond them Spark sorts.
FILES_AT_ONCE = 24
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def local_session(cpus: str = "*", app: str = "framegate") -> SparkSession:
    """Session used by the tests and the bench; a cluster passes its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master falls back to a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="framegate-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder, for tables written between stages."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def unsized(df: DataFrame) -> DataFrame:
    """Rows whose size Spark underestimates: the next join may not broadcast them through the driver on that estimate.

    An explode counts as one row out per row in, a checkpoint keeps the estimate of the plan it ends, and a file's size is
    that of compressed rows.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: ends the lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return unsized(df.checkpoint(eager=True))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = unsized(spark.read.schema(df.schema).parquet(path))
    table.staged_at = path
    return table


def buckets(spark: SparkSession) -> int:
    """Buckets of a bucketed table: as many as there are shuffle partitions, so that joins and sums by its key move nothing."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Write ``df`` as a table with buckets by ``keys`` (``frame_id`` if none are given) and read it back: it survives lost
    executors, only the columns asked for are read, and joins by the keys with another such table move nothing."""
    spark = df.sparkSession
    name = f"framegate_{uuid.uuid4().hex}"
    before = spark.conf.get(OPEN_FILES, None)
    # A task holds one bucket or a few; with their files open at once Spark need not sort wide rows to write them.
    spark.conf.set(OPEN_FILES, str(FILES_AT_ONCE))
    path = scratch_path(spark, name)
    try:
        df.write.bucketBy(buckets(spark), *(keys or ["frame_id"])).option("path", path).saveAsTable(name)
    finally:
        spark.conf.unset(OPEN_FILES) if before is None else spark.conf.set(OPEN_FILES, before)
    table = spark.table(name)
    table.staged_at = path
    return table


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    folder, files = _file_system(spark, path)
    files.delete(folder, True)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it doesn't exist."""
    folder, files = _file_system(spark, path)
    if not files.exists(folder):
        return []
    return [f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory() and not f.getPath().getName().startswith("_")]


def unstage(*tables: DataFrame) -> None:
    """Delete written tables whose readers have been written themselves."""
    for table in tables:
        delete_folder(table.sparkSession, table.staged_at)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting at most ``max_rows + 1`` rows of the side."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
