"""Feature tables bucketed by id, which joins on id read without shuffling them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from pixkin.sources.scratch import shared_folder


def bucketed(rows: DataFrame, key: str = "id", buckets: int | None = None, name: str = "features") -> DataFrame:
    """rows as a table of the session, its files in the shared folder, bucketed and sorted by key.  There are as many
    buckets as the session shuffles into: with fewer, Spark would rather shuffle both sides of a join."""
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, key)  # one file a bucket
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
