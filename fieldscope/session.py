"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

FEWEST = 16  # tasks that a small table is written by
NARROW, WIDE = 100_000, 4_000  # rows that a task writes: of some numbers or keys, of texts


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A laptop session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldscope")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` wins. Only a local master without that setting
    gets a folder of its own; elsewhere an unset folder is an error, because
    executors could not see what another machine wrote.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = f"/tmp/fieldscope-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def in_few_tasks(df, rows: int, of_a_task: int = NARROW):
    """``df`` of about ``rows`` rows in no more tasks than these rows ask for, or FEWEST.

    Else a table of some thousand rows that comes out of hundreds of shuffle partitions is written as hundreds of files. On a
    local file system without Hadoop's native library each file costs the executor three processes (chmod).
    Partitions are put together, never split, so a larger table than said only makes larger tasks.
    """
    return df.coalesce(max(FEWEST, -(-rows // of_a_task)))


def pin(df, label: str, rows: int | None = None):
    """Write ``df`` to the shared folder and read it back; by few tasks if it has only about ``rows`` narrow rows.

    Cuts the lineage with data that outlives any executor.
    """
    path = fresh_dir(df.sparkSession, label)
    (df if rows is None else in_few_tasks(df, rows)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
