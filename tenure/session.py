"""Session helpers: defaults for standalone runs and reliable checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spark_session(app: str = "tenure", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library assumes (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the cluster's shared folder.

    The folder is ``spark.checkpoint.dir``; only a local master may fall back
    to a folder of its own.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write a table that is read several times once, as Parquet in the shared folder.

    Readers prune its columns. The files go when the program ends.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df))


def written_path(df: DataFrame) -> str:
    """Write a table in the shared folder and say where."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path, compression="zstd")
    return path


def written_by_key(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Write a table that is joined several times on a key once, in the shared folder and dealt by the key.

    It is a table of ``parts`` buckets, so that joins on the key do not shuffle it again. A checkpoint keeps how its rows
    are dealt as well, but holds each row as an object of several times its size.
    """
    spark = df.sparkSession
    name, path = f"dealt_{uuid.uuid4().hex}", shared_path(spark, "dealt")
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    # the frame has found its files; only the catalog's entry goes
    spark.sql(f"DROP TABLE {name}")
    return table


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the program ends."""
    path = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


_WRITTEN: list[tuple[SparkSession, str]] = []


def written_so_far() -> int:
    """A mark for ``remove_written``."""
    return len(_WRITTEN)


@atexit.register
def remove_written(since: int = 0, keep: int = 0) -> None:
    """Remove the tables written since a mark, but the last ``keep``; nothing may read them any more."""
    gone = _WRITTEN[since:len(_WRITTEN) - keep]
    _WRITTEN[since:len(_WRITTEN) - keep] = []
    for spark, path in gone:
        with contextlib.suppress(Exception):  # the session may have ended before
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tenure-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
