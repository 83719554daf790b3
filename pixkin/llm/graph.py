"""Connected components of a table of links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: (a, b), either way round.  Per linked node: id and component_id, the smallest id that
    can be reached.  Alternates the large-star and small-star steps, which only ever replace links
    by links to smaller nodes; every round is a few joins and sums over the links, written out, and
    drops the round before.  The last round's table stays, for the result reads it."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    turn, name = 0, f"edges-{uuid.uuid4().hex}"
    edges = scratch.table(edges, f"{name}-{turn}")
    mark = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    state = mark()
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.withColumnRenamed("m", "b"))
        turn += 1
        edges = scratch.table(small.distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        if (now := mark()) == state:
            break
        state = now
    stars = edges.groupBy("a").agg(F.min("b").alias("component_id")).withColumnRenamed("a", "id")
    return stars.unionByName(stars.select(F.col("component_id").alias("id"), "component_id").distinct())
