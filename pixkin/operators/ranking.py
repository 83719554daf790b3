"""Places in a total order, and pages of it, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixkin.sources.scratch import written


def numbered(rows: DataFrame, order: list[Column], name: str = "place", tasks: int | None = None) -> DataFrame:
    """Adds the place of each row, from 1, in an order that has to be total, or rows alike get their places as it
    falls.  Rows are dealt by ranges of the order and sorted there; the sums of the ranges' sizes before each,
    a row a range, are all that meets.  The rows are written once, as a second run might deal otherwise."""
    columns, part, at = rows.columns, "_range", "_in_range"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(seen, seen + b.num_rows) + 1)], names=[*columns, part, at])
            seen += b.num_rows

    dealt = rows.repartitionByRange(*([tasks] if tasks else []), *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = written(dealt.mapInArrow(count, f"{schema}, {part} int, {at} long"), "numbered")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.select(part, (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_before"))  # a row a range
    return dealt.join(F.broadcast(before), part).select(*columns, (F.col("_before") + F.col(at)).alias(name))


def paged(placed: DataFrame, size: int, place: str = "place") -> DataFrame:
    """Adds the page, from 1, of `size` places each."""
    return placed.withColumn("page", F.floor((F.col(place) - 1) / size) + 1)
