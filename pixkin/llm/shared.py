"""What the operators of this subpackage share: word patterns, names that don't clash, written
intermediate tables, a test of membership that shuffles nothing, and running sums that no single
task has to hold."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.  Only in local mode may that be unset:
    then it is a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


#: Rows of an Arrow batch while a table is written: texts may be long, and a batch is held several times.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """For the jobs that are run inside it."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(min(int(before), rows)))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


class Scratch:
    """Intermediate tables of one run below the shared folder.  A table is made once, its lineage ends
    there and a lost executor takes nothing with it; it is dropped when its last reader is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        with small_batches(self.spark):
            df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for what a returned DataFrame still reads."""
    return Scratch(df.sparkSession).table(df, name)


def free_name(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case of letters."""
    taken, name = {c.lower() for df in frames for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def source_key(column: Column | str = "source") -> Column:
    """A grouping key that is never null and orders as the column does, nulls last."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c))


def running_sum(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str | None, name: str
) -> DataFrame:
    """Adds `name`: the sum of `value` (None: the number of rows) over the rows that come earlier
    under the same keys, in the order of bucket and then `order`.

    Buckets are ranges of a uniform hash.  One key may hold most of the rows: its rows are sorted
    bucket by bucket in separate tasks, and only the buckets' sums meet.  df is read twice, so it
    should be a written table.  Keys and bucket must not be null."""
    amount = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    by, own, base = [*keys, bucket], free_name("own_sum", df), free_name("base_sum", df)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by).agg(F.sum(amount).alias(own))
    sums = sums.select(*by, F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias(base))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(sums, by).withColumn(name, F.col(base) + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return out.drop(base)


#: Bits of a bitmap of keys, which has this size whatever the number of keys: 8 MB.
KEY_BITS = 26


def maybe_among(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """Adds `name`: whether `key` may be among the values of keys' only column (true for all of them
    and for a few others), false where it is null.  The keys become a bitmap of a fixed size, at most
    2,048 rows of 4 KB, that is broadcast: df isn't shuffled.  With more keys than it suits more rows
    count as possible, and a join afterwards has to tell them apart."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << KEY_BITS)) + 1
    part, at, bits = (free_name(x, df) for x in ("bitmap_part", "bitmap_at", "bitmap_bits"))
    cells = keys.filter(F.col(keys.columns[0]).isNotNull()).select(cell(F.col(keys.columns[0])).alias("c"))
    bitmap = cells.groupBy(F.bitmap_bucket_number("c").alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias(bits))
    placed = df.withColumn(part, F.when(key.isNotNull(), F.bitmap_bucket_number(cell(key)))).withColumn(at, F.bitmap_bit_position(cell(key)))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(F.col(at) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (F.col(at) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return placed.join(F.broadcast(bitmap), part, "left").select(*df.columns, hit.alias(name))
