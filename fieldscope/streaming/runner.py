"""Running streams to tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.plans.spread import portions
from fieldscope.session import fresh_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep operator state in RocksDB, which arbitrary stateful processing needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream with the table's own schema.

    ``path`` is a folder, or a pattern when the table is a single file.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_time(stream: DataFrame, micros: str = "ts_us", delay: str = "10 minutes") -> DataFrame:
    """Add ``event_time`` from epoch microseconds, with a watermark."""
    return stream.withColumn("event_time", F.timestamp_micros(micros)).withWatermark("event_time", delay)


END_OF_TIME_US = 7_258_118_400_000_000  # the year 2200: past every window, session and timer, and pandas can hold it


class End:
    """The end of a stream's input, as rows that a stream can carry."""

    def __init__(self, stream: DataFrame, values: dict):
        self.spark, self.schema, self.values = stream.sparkSession, stream.schema, values
        self.path = fresh_dir(self.spark, "end")
        self.spark.createDataFrame([], self.schema).write.parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def reach(self) -> None:
        """Add one row, all null but for its time and key, which moves the watermark past everything."""
        row = [F.lit(self.values.get(f.name)).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).select(*row).write.mode("append").parquet(self.path)


def closable(stream: DataFrame, micros: str = "ts_us", **key) -> tuple[DataFrame, End]:
    """The stream with an end that can be reached once its input is finished: what is open then is completed.

    ``key`` gives the end's row values for columns that may not be null, such as a session that doesn't occur.
    """
    end = End(stream, {micros: END_OF_TIME_US, **key})
    return stream.unionByName(end.rows()), end


def run_to_table(stream: DataFrame, label: str, output_mode: str = "append", end: End | None = None) -> DataFrame:
    """Process everything available, append to a new table, return that table.

    With ``end`` (see ``closable``) the input is then declared finished, which writes what was still open.
    """
    spark = stream.sparkSession
    path = fresh_dir(spark, label)

    def run() -> None:
        (
            stream.writeStream.format("parquet")
            .outputMode(output_mode)
            .option("checkpointLocation", f"{path}.checkpoint")
            .trigger(availableNow=True)
            .start(path)
            .awaitTermination()
        )

    run()
    if end is not None:
        end.reach()
        run()
    return spark.read.schema(stream.schema).parquet(path)


MERGE_ROWS = 100_000  # rows of the log that one task merges at a time: a merge holds them several times over


class LogTable:
    """A keyed table that a stream keeps up to date as a log of runs, merged when there are enough of them.

    ``collapse`` turns a micro-batch into rows of the table; they become a run of their own, in folders by hash of the key,
    so that a batch writes what it brings and no more. ``merge`` puts the rows of several runs together: each time ``fan`` runs
    of a size are there, they become one, so a row is written once per power of ``fan``. Runs from the first batch on, before which
    nothing lies, are put together by ``settle``, and all that a reader sees by ``finish``. A run that covers other runs takes their
    place once it is complete; they go with the next batch. A batch that is run again writes its own run anew, or nothing if
    its run was merged already, so a restart changes nothing.
    """

    def __init__(
        self,
        path: str,
        keys: Sequence[str],
        collapse: Callable[[DataFrame], DataFrame],
        merge: Callable[[DataFrame], DataFrame],
        settle: Callable[[DataFrame], DataFrame] | None = None,
        finish: Callable[[DataFrame], DataFrame] | None = None,
        buckets: int = 16,
        fan: int = 8,
    ):
        self.path, self.keys, self.collapse, self.merge = path.rstrip("/"), list(keys), collapse, merge
        self.settle, self.finish, self.buckets, self.fan = settle or merge, finish or merge, buckets, fan

    def _files(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self, spark: SparkSession) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """The complete runs that count, as first and last batch, and those that others cover."""
        jvm, root, files = self._files(spark)
        if not files.exists(root):
            return [], []
        names = [s.getPath().getName() for s in files.listStatus(root)]
        complete = [n for n in names if n.startswith("run=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        spans = sorted((tuple(map(int, n.removeprefix("run=").split("_"))) for n in complete), key=lambda r: (r[0], -r[1]))
        live, covered, upto = [], [], -1
        for run in spans:
            (covered if run[1] <= upto else live).append(run)
            upto = max(upto, run[1])
        return live, covered

    def _read(self, spark: SparkSession, runs: list[tuple[int, int]]) -> DataFrame | None:
        jvm, _, files = self._files(spark)
        paths = [f"{self.path}/run={a}_{b}" for a, b in runs]
        filled = [p for p in paths if any(s.isDirectory() for s in files.listStatus(jvm.org.apache.hadoop.fs.Path(p)))]
        if not filled:
            return None
        return portions(spark.read.option("basePath", self.path).parquet(*filled).drop("_bucket", "run"), *self.keys, rows=MERGE_ROWS)

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/run={first}_{last}")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        live, covered = self.runs(spark)
        if not any(a <= batch_id <= b and (a, b) != (batch_id, batch_id) for a, b in live):
            self._write(self.collapse(batch), batch_id, batch_id)
        jvm, _, files = self._files(spark)
        for a, b in covered:  # no reader of an earlier batch needs them any more
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/run={a}_{b}"), True)
        size = self.fan
        while (batch_id + 1) % size == 0:
            first = batch_id + 1 - size
            parts = [r for r in self.runs(spark)[0] if r[0] >= first]
            held = self._read(spark, parts) if len(parts) > 1 else None
            if held is not None:
                self._write(self.settle(held) if first == 0 else self.merge(held), first, batch_id)
            size *= self.fan

    def current(self, spark: SparkSession) -> DataFrame:
        """A row per key, from all runs that count."""
        live, _ = self.runs(spark)
        held = self._read(spark, live)
        if held is None:
            raise ValueError(f"no rows below {self.path}")
        return self.finish(held)

    def follow(self, stream: DataFrame, **trigger) -> None:
        """Feed the stream into the table; by default all that is available, then stop."""
        (
            stream.writeStream.foreachBatch(self.update)
            .option("checkpointLocation", f"{self.path}.checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
            .awaitTermination()
        )
