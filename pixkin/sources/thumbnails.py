"""Thumbnails as a data source of Spark: spark.read.format("thumbnails").

Options: ids, a JSON array of strings; template, an address in which {id} stands for an id; per_partition, the ids
that one task fetches one after the other, which bounds the connections; attempts.  Filters on id (equal, in, not
null) are pushed down: what they leave out is never planned, nor fetched.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from pixkin.sources.images import ATTEMPTS, attempted

SCHEMA = "id string, url string, content binary"
ROWS = 16


class Ids(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class Reader(DataSourceReader):
    def __init__(self, ids: list[str], template: str, per_partition: int, attempts: int, get, wait):
        self.ids, self.template, self.per_partition, self.attempts, self.get, self.wait = list(dict.fromkeys(ids)), template, per_partition, attempts, get, wait

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802, Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("id",):
                self.ids = [i for i in self.ids if i == f.value]
            elif isinstance(f, In) and f.attribute == ("id",):
                wanted = set(f.value)
                self.ids = [i for i in self.ids if i in wanted]
            elif not (isinstance(f, IsNotNull) and f.attribute == ("id",)):
                yield f  # left to Spark

    def partitions(self) -> list[Ids]:
        n = self.per_partition
        return [Ids(self.ids[i : i + n]) for i in range(0, len(self.ids), n)]

    def read(self, partition: Ids) -> Iterator[pa.RecordBatch]:
        ids = partition.ids if partition else []
        for at in range(0, len(ids), ROWS):
            some = ids[at : at + ROWS]
            urls = [self.template.replace("{id}", i) for i in some]
            content = [attempted(self.get, u, self.attempts, self.wait) for u in urls]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(urls, pa.string()), pa.array(content, pa.binary())], names=["id", "url", "content"])


class ThumbnailSource(DataSource):
    """Register with spark.dataSource.register; pushed filters need
    spark.sql.python.filterPushdown.enabled.  A subclass can fetch in another way."""

    @staticmethod
    def get(url: str) -> tuple[int, bytes]:
        from pixkin.service import http_get

        return http_get(url)

    wait = staticmethod(time.sleep)

    @classmethod
    def name(cls) -> str:
        return "thumbnails"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        number = lambda name, default: max(1, int(self.options.get(name, default)))
        return Reader([str(i) for i in json.loads(self.options.get("ids", "[]")) if i], self.options["template"], number("per_partition", 50), number("attempts", ATTEMPTS), self.get, self.wait)
