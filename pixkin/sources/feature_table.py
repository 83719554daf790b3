"""Feature rows and fetched images as append-only tables, so that no change rewrites what is there.

Every append has a number that grows with time.  Features are written once a key; a removal is a row
of its own, which hides what was written before it.  `compact` writes what is live to a folder of its own,
with the names of the appended files that it has read: readers take that folder and all other appended
files, so that what another writer appends meanwhile is never lost.
"""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixkin.operators.features import SCHEMA, decoded, deflated
from pixkin.sources.images import fetched, usable

REMOVED = "emb_key string, removed_at long"
CACHE = "id string, content binary, number long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class FeatureTable:
    """Rows of `extract_features`, one a key of the canonical pixels."""

    COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _compacted(self) -> str | None:
        row = _table(self.spark, f"{self.path}/compacted", "folder string, number long").orderBy(F.desc("number")).first()
        return row["folder"] if row else None

    def _parts(self) -> tuple[DataFrame, DataFrame | None]:
        """The appended rows that no compaction has taken in, with their file, and the last compaction's rows."""
        schema, folder = f"{SCHEMA}, number long", self._compacted()
        rows = _table(self.spark, f"{self.path}/rows", schema)
        rows = rows.select("*", F.col("_metadata.file_name").alias("file")) if rows.inputFiles() else rows.withColumn("file", F.lit(""))
        if folder is None:
            return rows, None
        taken = _table(self.spark, f"{self.path}/{folder}-files", "file string")
        return rows.join(F.broadcast(taken), "file", "left_anti"), _table(self.spark, f"{self.path}/{folder}", schema)

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = _table(self.spark, f"{self.path}/removed", REMOVED).groupBy("emb_key").agg(F.max("removed_at").alias("removed_at"))
        return rows.join(gone, "emb_key", "left").filter("removed_at IS NULL OR removed_at < number").drop("removed_at")

    def read(self, columns: list[str] | None = None) -> DataFrame:
        """emb_key and the columns asked for; the scan reads no others."""
        columns = [c for c in columns or self.COLUMNS if c != "emb_key"]
        new, old = self._parts()
        rows = new.select("emb_key", *columns, "number")
        rows = rows if old is None else rows.unionByName(old.select("emb_key", *columns, "number"))
        return self._live(rows).select("emb_key", *columns)

    def add(self, features: DataFrame) -> None:
        """Appends the keys that aren't there; of rows with one key, that of the smallest id.  Rows
        with an error or without a key are left out."""
        good = features.filter("error IS NULL AND emb_key IS NOT NULL").select(*self.COLUMNS)
        first = good.groupBy("emb_key").agg(F.min_by(F.struct(*[c for c in self.COLUMNS if c != "emb_key"]), "id").alias("row"))
        new = first.join(self.read(["id"]).select("emb_key"), "emb_key", "left_anti").select("emb_key", "row.*")
        new.select(*self.COLUMNS, F.lit(time.time_ns()).alias("number")).write.mode("append").parquet(f"{self.path}/rows")

    def remove_unreferenced(self, entries: DataFrame, keys: DataFrame | None = None) -> None:
        """Hides the keys, or those of `keys` (emb_key), that no entry (emb_key) refers to."""
        held = self.read(["id"]).select("emb_key")
        held = held if keys is None else held.join(keys, "emb_key", "left_semi")
        gone = held.join(entries.select("emb_key"), "emb_key", "left_anti")
        gone.withColumn("removed_at", F.lit(time.time_ns())).write.mode("append").parquet(f"{self.path}/removed")

    def compact(self) -> None:
        """Writes the live rows to a folder of their own, which readers take from then on."""
        folder, number = f"rows-{uuid.uuid4().hex}", time.time_ns()
        new, old = self._parts()
        files = new.select("file").distinct()
        before = self._compacted()
        if before is not None:
            files = files.unionByName(_table(self.spark, f"{self.path}/{before}-files", "file string"))
        files.coalesce(1).write.parquet(f"{self.path}/{folder}-files")  # first: only what is listed is taken in
        taken = _table(self.spark, f"{self.path}/{folder}-files", "file string")
        rows = new.join(F.broadcast(taken), "file", "left_semi").drop("file")
        rows = rows if old is None else rows.unionByName(old)
        self._live(rows).withColumn("number", F.lit(number)).write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(folder, number)], "folder string, number long").coalesce(1).write.mode("append").parquet(f"{self.path}/compacted")


class ImageCache:
    """Fetched images by id.  What is cached and can be decoded isn't fetched again; what can't be
    decoded is, and the newer row stands for it.  Placeholders are never cached."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, ids: DataFrame | None = None) -> DataFrame:
        """(id, content) of all or of those ids (id)."""
        return self._last(_table(self.spark, self.path, CACHE), ids)

    def _last(self, rows: DataFrame, ids: DataFrame | None) -> DataFrame:
        """The last row of an id is found without its bytes, which then are dealt by id alone, and once: no number
        is above the last, and an equality would be a key of the join."""
        last = _table(self.spark, self.path, CACHE).select("id", "number")
        last = last if ids is None else last.join(ids.select("id"), "id", "left_semi")
        last = last.groupBy("id").agg(F.max("number").alias("last"))
        return rows.join(last, "id").filter("number >= last").dropDuplicates(["id"]).select("id", "content")

    def images(self, urls: DataFrame, get: Callable, decode: Callable, partitions: int = 100) -> DataFrame:
        """urls: (id, url).  Each id with its decoded image, the columns of `decoded`; data is null where
        there is none."""
        held = decoded(self.read(urls), decode).filter("data IS NOT NULL").select("id")
        found = fetched(urls.join(held, "id", "left_anti"), get, partitions).filter("content IS NOT NULL")
        # fetched, tried and written in one go: what is fetched is fetched once
        rows = decoded(found, decode, keep=True).filter(usable(F.col("width"), F.col("height"))).select(F.col("id").cast("string").alias("id"), "content")
        rows.withColumn("number", F.lit(time.time_ns())).write.mode("append").option("compression", "zstd").parquet(self.path)
        small = self._last(deflated(_table(self.spark, self.path, CACHE), "content"), urls)
        return decoded(urls.select("id").join(small, "id", "left"), lambda x: decode(zlib.decompress(x)))
