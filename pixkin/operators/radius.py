"""Join of signatures within a Hamming radius by a multi-index hash.

Of signatures that differ in at most `radius` bits, cut into radius + 1 parts, one part at least is equal.  So
rows meet by (part, its value), and only there are their bits compared.  Equal signatures are first made one
class, whose smallest id stands for it, so that a signature that very many rows have is one row in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.functions.signatures import differing, run_of_bits


def signature_classes(rows: DataFrame) -> DataFrame:
    """rows: (id, signature).  Per signature class_id, the smallest id, and how many rows have it.  A null
    signature is none."""
    return rows.filter("signature IS NOT NULL").groupBy("signature").agg(F.min("id").alias("class_id"), F.count("*").alias("rows"))


def within_radius(classes: DataFrame, bits: int, radius: int) -> DataFrame:
    """classes: (class_id, signature).  Pairs id_a < id_b of classes that differ in at most `radius` bits,
    with how many: each once, by the first of its equal parts."""
    parts = radius + 1
    if not 0 <= radius < bits or bits > parts * 63:
        raise ValueError(f"{parts} parts can't be cut from {bits} bits")
    edges = [bits * i // parts for i in range(parts + 1)]
    cut = F.array(*[run_of_bits(F.col("signature"), a, b) for a, b in zip(edges, edges[1:], strict=False)])
    rows = classes.select("class_id", "signature", cut.alias("parts")).select("*", F.posexplode("parts").alias("part", "value"))
    a, b = (rows.select("part", "value", *[F.col(c).alias(f"{c}_{s}") for c in ("class_id", "signature", "parts")]) for s in "ab")
    apart = differing(F.col("signature_a"), F.col("signature_b"), bits)
    first = F.array_position(F.zip_with("parts_a", "parts_b", lambda x, y: x == y), True) == F.col("part") + 1
    near = a.join(b, ["part", "value"]).filter((F.col("class_id_a") < F.col("class_id_b")) & (apart <= radius) & first)
    return near.select(F.col("class_id_a").alias("id_a"), F.col("class_id_b").alias("id_b"), apart.cast("long").alias("apart"))
