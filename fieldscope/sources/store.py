"""The evidence store and run history as partitioned tables."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.operators.evidence import RECORD, accepted, evidence_delete, evidence_envelope, evidence_number, evidence_prune, ticket_number
from fieldscope.operators.history import history_normalize
from fieldscope.session import pin


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("created_date", F.date_from_unix_date(F.floor(F.col("created_at") / 86400).cast("int")))


FIRST = {"records": [], "ids": []}
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # fixed value: Spark's folder name for a null
IDS = 16  # id tables that are read together before they become one


class EvidenceStore:
    """Records and handed-out ids as immutable folders, and a log of numbered snapshots that says which of them count.

    ``path/records/part=<name>/created_date=<day>`` holds records, ``path/ids/<name>`` the highest number of accounts,
    ``path/log/<n>`` the folders of snapshot n. A writer writes new folders first and then publishes the next number by a rename
    that fails if the number exists; who comes second takes its change up again from the newer snapshot. So a writer that is
    lost at any step leaves the old snapshot or the new one, nothing has to be unlocked, and readers never wait. A record is
    named by account and ticket; ids only grow, so clearing or deleting records never frees a ticket.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _files(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        hadoop, files = self._files(path)
        return [s.getPath().getName() for s in files.listStatus(hadoop)] if files.exists(hadoop) else []

    def snapshot(self) -> tuple[int, dict]:
        """The newest number and what it lists; 0 before the first commit."""
        version = max((int(n) for n in self._names(f"{self.path}/log") if n.isdigit()), default=0)
        if not version:
            return 0, FIRST
        hadoop, files = self._files(f"{self.path}/log/{version}")
        stream = files.open(hadoop)
        try:
            return version, json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, version: int, content: dict) -> bool:
        """Make ``content`` snapshot ``version``; false if another writer has."""
        jvm = self.spark.sparkContext._jvm
        draft, files = self._files(f"{self.path}/log/draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(json.dumps(content).encode())
        out.close()
        target, _ = self._files(f"{self.path}/log/{version}")
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, no_options)
            return True
        except Py4JJavaError as problem:
            files.delete(draft, False)
            if "FileAlreadyExistsException" in str(problem.java_exception):
                return False
            raise

    def _commit(self, change: Callable[[dict], tuple[dict | None, object]]):
        """Apply ``change`` to the newest snapshot until its result is published; it may run more than once."""
        while True:
            version, held = self.snapshot()
            content, result = change(held)
            if content is None or self._publish(version + 1, content):
                return result

    def _write_records(self, records: DataFrame) -> list[str]:
        part = f"part={uuid.uuid4().hex}"
        records.write.partitionBy("created_date").parquet(f"{self.path}/records/{part}")
        return [f"{part}/{day}" for day in self._names(f"{self.path}/records/{part}") if day.startswith("created_date=")]

    def _write_ids(self, numbers: DataFrame, held: dict) -> list[str]:
        """The snapshot's id tables with these; many of them become one."""
        name = uuid.uuid4().hex
        if len(held["ids"]) >= IDS:
            numbers = self._last_ids(held).unionByName(numbers)
        numbers.groupBy("account").agg(F.max("last_id").alias("last_id")).write.parquet(f"{self.path}/ids/{name}")
        return [name] if len(held["ids"]) >= IDS else [*held["ids"], name]

    def _read_records(self, folders: list[str]) -> DataFrame | None:
        root = f"{self.path}/records"
        return self.spark.read.option("basePath", root).parquet(*(f"{root}/{f}" for f in folders)) if folders else None

    def _last_ids(self, held: dict) -> DataFrame | None:
        if not held["ids"]:
            return None
        ids = self.spark.read.parquet(*(f"{self.path}/ids/{n}" for n in held["ids"]))
        return ids.groupBy("account").agg(F.max("last_id").alias("last_id"))

    def records(self) -> DataFrame | None:
        found = self._read_records(self.snapshot()[1]["records"])
        return None if found is None else found.drop("part")

    def last_ids(self) -> DataFrame | None:
        """The highest number of each account: handed out, or in a ticket that was imported."""
        return self._last_ids(self.snapshot()[1])

    def append(self, exports: DataFrame) -> DataFrame:
        """Number, envelope and append exports; returns (account, id, ticket), ticket null if rejected."""

        def change(held):
            numbered = pin(evidence_number(exports, self._last_ids(held)), "numbered")
            ids = self._write_ids(numbered.select("account", F.col("number").cast("bigint").alias("last_id")), held)
            folders = self._write_records(_dated(evidence_envelope(accepted(numbered))))
            return {"records": held["records"] + folders, "ids": ids}, numbered

        numbered = self._commit(change)
        stored = accepted(numbered).select("account", "id", "ticket")
        return numbered.select("account", "id").join(stored, ["account", "id"], "left")

    def import_records(self, records: DataFrame) -> None:
        """Add records that have tickets already; their numbers are not handed out again."""
        kept = pin(_dated(evidence_envelope(records)), "imported")
        numbers = kept.select("account", ticket_number(F.col("ticket")).alias("last_id")).where("last_id is not null")

        def change(held):
            return {"records": held["records"] + self._write_records(kept), "ids": self._write_ids(numbers, held)}, None

        self._commit(change)

    def _without(self, held: dict, doomed: Callable[[DataFrame], DataFrame]) -> tuple[dict | None, int]:
        """The snapshot without the records that ``doomed`` picks; folders that hold none of them stay as they are."""
        current = self._read_records(held["records"])
        if current is None:
            return None, 0
        chosen = pin(current.join(doomed(current).select(*RECORD).distinct(), RECORD, "left_semi").select(*RECORD, "part", "created_date"), "doomed")
        removed = chosen.count()
        if not removed:
            return None, 0
        touched = {f"part={r['part']}/created_date={r['created_date'] or NO_DAY}" for r in chosen.select("part", "created_date").distinct().toLocalIterator()}
        rest = evidence_delete(self._read_records(sorted(touched)).drop("part"), chosen.select(*RECORD).distinct())
        folders = [f for f in held["records"] if f not in touched] + self._write_records(rest)
        return {"records": folders, "ids": held["ids"]}, removed

    def delete(self, records: DataFrame) -> int:
        """Delete by account and ticket; returns how many existed."""
        return self._commit(lambda held: self._without(held, lambda _: records))

    def prune(self, max_bytes: int, max_records: int) -> int:
        """Apply the retention budgets for good; returns how many records went."""

        def beyond(current):
            sized = current.select(*RECORD, "created_at", F.col("payload.content").alias("content"), F.col("ticket").alias("id"))
            return current.join(evidence_prune(sized, max_bytes, max_records).select(*RECORD), RECORD, "left_anti")

        return self._commit(lambda held: self._without(held, beyond))

    def clear(self) -> int:
        """Remove every record and return their number; ids keep counting up."""

        def change(held):
            current = self._read_records(held["records"])
            removed = 0 if current is None else current.count()
            return ({"records": [], "ids": held["ids"]} if removed else None), removed

        return self._commit(change)

    def compact(self, folders: int = 8) -> int:
        """Put the records of days that lie in ``folders`` folders or more into one each; returns how many days."""

        def change(held):
            days: dict[str, list[str]] = {}
            for f in held["records"]:
                days.setdefault(f.split("/")[1], []).append(f)
            many = [d for d, found in days.items() if len(found) >= folders]
            if not many:
                return None, 0
            old = [f for d in many for f in days[d]]
            made = self._write_records(self._read_records(old).drop("part").repartition("created_date", "account"))
            return {"records": [f for f in held["records"] if f not in set(old)] + made, "ids": held["ids"]}, len(many)

        return self._commit(change)

    def vacuum(self, older_s: float = 7 * 86400) -> int:
        """Remove folders that the newest snapshot does not list and that are older than any reader or writer still at work."""
        version, held = self.snapshot()
        until, removed = (time.time() - older_s) * 1000, 0
        known = {f"records/{f}" for f in held["records"]} | {f"ids/{n}" for n in held["ids"]}
        stale = [f"records/{p}/{d}" for p in self._names(f"{self.path}/records") for d in self._names(f"{self.path}/records/{p}") if d.startswith("created_date=")]
        stale += [f"ids/{n}" for n in self._names(f"{self.path}/ids")] + [f"log/{n}" for n in self._names(f"{self.path}/log") if n != str(version)]
        for name in stale:
            hadoop, files = self._files(f"{self.path}/{name}")
            if name not in known and files.getFileStatus(hadoop).getModificationTime() < until:
                removed += bool(files.delete(hadoop, True))
        return removed


def append_history(entries: DataFrame, path: str) -> str:
    """Append normalised run entries."""
    history_normalize(entries).write.mode("append").parquet(path)
    return path


def clear_table(table: DataFrame, path: str) -> int:
    """Empty a table of events, calls, errors or history; returns the removed row count."""
    removed = table.count()
    table.limit(0).write.mode("overwrite").parquet(path)
    return removed
