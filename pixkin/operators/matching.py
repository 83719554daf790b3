"""Matching of two images' descriptors, a row a keypoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixkin.functions.signatures import differing


def descriptor_matches(pairs: DataFrame, descriptors: DataFrame, bits: int, ratio: float) -> DataFrame:
    """pairs: (id_a, id_b); descriptors: (id, point, descriptor as a signature).

    Per pair and point of b its nearest point of a, by differing bits and then by number, that of the second
    nearest, and whether the first is clearly nearer (`ratio` times the second at most, not equal).  Points of b
    are left out where a has fewer than two, as are null descriptors.  The points of a pair meet each other
    within the join, and of each point's row only two go on to the window."""
    own = descriptors.filter("descriptor IS NOT NULL")
    side = lambda s: own.select(F.col("id").alias(f"id_{s}"), F.col("point").alias(f"point_{s}"), F.col("descriptor").alias(f"descriptor_{s}"))
    met = pairs.select("id_a", "id_b").join(side("b"), "id_b").join(side("a"), "id_a")
    met = met.select("id_a", "id_b", "point_a", "point_b", differing(F.col("descriptor_a"), F.col("descriptor_b"), bits).alias("d"))
    near = Window.partitionBy("id_a", "id_b", "point_b").orderBy("d", "point_a")
    two = met.withColumn("n", F.row_number().over(near)).filter("n <= 2").groupBy("id_a", "id_b", "point_b")
    out = two.agg(F.min_by("point_a", "n").alias("point_a"), F.min_by("d", "n").cast("long").alias("d1"), F.max_by("d", "n").cast("long").alias("d2"), F.count("*").alias("many"))
    return out.filter("many = 2").select("id_a", "id_b", "point_a", "point_b", "d1", "d2", (F.col("d1") < ratio * F.col("d2")).alias("good"))


def match_counts(matches: DataFrame, least: int) -> DataFrame:
    """Per pair the number of good matches, and whether they are enough to align it."""
    return matches.groupBy("id_a", "id_b").agg(F.count_if("good").alias("good_matches")).withColumn("alignable", F.col("good_matches") >= least)
