"""The index as a log of changes: every change appends its rows to a folder of its own and then claims
the next number with a marker, so readers see whole changes only, and a change that fails leaves
nothing.  What was written before is never rewritten, but by compaction now and then.

A marker is created exclusively.  Of two writers that claim one number, one finds it taken: it goes
on to the next if its rows don't depend on what it read, and reads anew if they do.  (A local file
system checks and creates in two steps, so there single writers are assumed.)"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "song_id string, vec_id long, emb_key string, cls array<double>"
CHANGES = f"{ENTRIES}, status string"
MARKER = "number long, folder string, whole boolean"
#: Changes that readers put together; one more is followed by a compaction.
MOST_CHANGES = 32
#: How often a change that depends on the index is tried while others write.
TRIES = 5


class SongNotFound(KeyError):
    pass


class SongExists(ValueError):
    pass


class WriteConflict(RuntimeError):
    """Another writer was first."""


class IndexStore:
    """Songs and what became of them (done, failed or deleted) below a path."""

    COLUMNS = [c.split()[0] for c in ENTRIES.split(", ")]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> list[tuple[int, str]]:
        """Number and folder of the last whole state and the changes since, a bounded number."""
        try:
            rows = self.spark.read.schema(MARKER).json(f"{self.path}/log").filter("folder IS NOT NULL")
            last = rows.filter("whole").agg(F.max("number")).first()[0]
            return sorted((r["number"], r["folder"]) for r in rows.filter(F.col("number") >= (last or 0)).collect())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _changes(self) -> DataFrame:
        log = self._log()
        parts = [self.spark.read.schema(CHANGES).parquet(f"{self.path}/{folder}").withColumn("number", F.lit(n).cast("long")) for n, folder in log]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{CHANGES}, number long")

    @staticmethod
    def _last(rows: DataFrame, *columns: str) -> DataFrame:
        order = F.struct("number", F.col("status") == "failed")
        return rows.groupBy("song_id").agg(F.max_by(F.struct("status", *columns), order).alias("row")).select("song_id", "row.*")

    def ids(self) -> DataFrame:
        """song_id of every song of the index, and the number of the change that its row is in; vectors aren't
        read.  A later failure doesn't take a song out."""
        rows = self._changes().filter("status <> 'failed'").select("song_id", "status", "number")
        return self._last(rows, "number").filter("status = 'done'").select("song_id", "number")

    def entries(self) -> DataFrame:
        """A row a song of the index.  Which row counts is decided on ids alone, then their rows are read."""
        rows = self._changes().filter("status = 'done'")
        return rows.join(self.ids(), ["song_id", "number"], "left_semi").select(*self.COLUMNS)

    def progress(self) -> DataFrame:
        """Songs seen, failed ones too; vectors aren't read."""
        return self._last(self._changes().select("song_id", "status", "number")).filter("status <> 'deleted'")

    def _claim(self, number: int, folder: str, whole: bool) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{number:012d}.json")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = fs.create(path, False)
        except Py4JJavaError:
            if fs.exists(path):
                return False
            raise
        out.write(bytearray(json.dumps({"number": number, "folder": folder, "whole": whole}).encode()))
        out.close()
        return True

    def _number(self) -> int:
        """The last number claimed, also by a writer that was lost before it filled its marker: readers skip
        that one, and the next writer goes on after it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _commit(self, rows: DataFrame, base: int | None = None) -> None:
        """base: the number that rows depend on, if they do."""
        folder = f"changes-{uuid.uuid4().hex}"
        rows.select(*[F.col(c) for c in self.COLUMNS], "status").write.parquet(f"{self.path}/{folder}")
        number = (self._number() if base is None else base) + 1
        while not self._claim(number, folder, False):
            if base is not None:
                raise WriteConflict(folder)
            number += 1
        if len(self._log()) > MOST_CHANGES:
            self.compact()

    def compact(self) -> bool:
        """Writes the whole state to a folder of its own; False if another writer was first."""
        number, folder = self._number(), f"whole-{uuid.uuid4().hex}"
        failed = self._named(self.progress().filter("status = 'failed'"), "failed")
        self.entries().withColumn("status", F.lit("done")).unionByName(failed).write.parquet(f"{self.path}/{folder}")
        return self._claim(number + 1, folder, True)

    def _named(self, ids: DataFrame, status: str) -> DataFrame:
        empty = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ENTRIES.split(", ")[1:]]
        return ids.select("song_id", *empty, F.lit(status).alias("status"))

    def scratch(self, df: DataFrame) -> DataFrame:
        """df as a table beside the log, for what is read more than once."""
        path = f"{self.path}/scratch-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def pending(self, songs: DataFrame, retry_failed: bool = False) -> DataFrame:
        done = self.progress().filter("status <> 'failed'") if retry_failed else self.progress()
        return songs.join(done.select("song_id"), "song_id", "left_anti")

    def apply(self, rows: DataFrame, failed: DataFrame | None = None, deleted: DataFrame | None = None, base: int | None = None) -> None:
        """One change: rows (entries) replace those of the same songs, failed ones are noted and deleted
        ones leave.  The three name different songs, each once."""
        change = rows.select(*self.COLUMNS, F.lit("done").alias("status"))
        for ids, status in ((failed, "failed"), (deleted, "deleted")):
            if ids is not None:
                change = change.unionByName(self._named(ids, status))
        self._commit(change, base)

    def upsert(self, rows: DataFrame, failed: DataFrame | None = None) -> None:
        self.apply(rows, failed)

    def add(self, rows: DataFrame) -> None:
        for _ in range(TRIES):
            base = self._number()
            if (found := rows.join(self.ids(), "song_id", "left_semi").select("song_id").first()) is not None:
                raise SongExists(found["song_id"])
            try:
                return self.apply(rows, base=base)
            except WriteConflict:
                continue
        raise WriteConflict("add")

    def delete(self, ids: DataFrame) -> tuple[int, int]:
        """ids: (song_id).  How many were removed and how many were unknown; nothing is written if none
        was removed.  Features are kept by content elsewhere and go only when nothing refers to them."""
        ids = self.scratch(ids.select("song_id").distinct())
        known = self.scratch(ids.join(self.ids(), "song_id", "left_semi"))
        removed = known.count()
        if removed:
            self._commit(self._named(known, "deleted"))
        return removed, ids.count() - removed

    def delete_one(self, song_id: str) -> None:
        if not self.delete(self.spark.createDataFrame([(song_id,)], "song_id string"))[0]:
            raise SongNotFound(song_id)

    def orphans(self, features: DataFrame) -> DataFrame:
        """Feature keys that no entry refers to."""
        return features.select("emb_key").join(self.entries().select("emb_key"), "emb_key", "left_anti")

    def info(self) -> DataFrame:
        entries, progress = self.ids(), self.progress()
        return entries.agg(F.count("*").alias("vectors")).join(progress.agg(F.count("*").alias("processed"))).withColumn("path", F.lit(self.path))
