"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child draws -ln(u) / weight, u being a
hash of the row's key and the child's name, and the smallest draw wins.  A child's draws depend on
nothing but its own weight, so when weights change under one subtree, rows move only into or out of
that subtree.  Racks are filled one after the other, and a rack that would have to be shared by a
grown shard count starts a region of its own, so growing from a full layout takes rows only into
the new shard.  Only DataFrame functions are used.

Defined results: a null text has size 1 and checksum 0; a null doc_id draws as the word "null";
repeated rows go to one shard and have a slot each; very long texts only have a larger size; an empty
table gives no rows; other columns are ignored by `shard_rows` and kept by `assign`, which adds one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import running_sum, written

SHARDS = 16
SHARDS_A_RACK = 4
RACKS_A_REGION = 2


@dataclass(frozen=True)
class Node:
    """A region, a rack or (without children) the shard with number `shard`."""

    name: str
    weight: float = 1.0
    children: tuple["Node", ...] = ()
    shard: int = -1


def inner(name: str, children: tuple[Node, ...]) -> Node:
    return Node(name, sum(c.weight for c in children), children)


def layout(shards: int, a_rack: int = SHARDS_A_RACK, racks: int = RACKS_A_REGION) -> Node:
    """Shards 0 to shards-1 of equal weight in racks and regions, filled in turn."""
    leaves = [Node(f"shard{i}", 1.0, (), i) for i in range(shards)]
    rack = [inner(f"rack{i // a_rack}", tuple(leaves[i : i + a_rack])) for i in range(0, shards, a_rack)]
    region = [inner(f"region{i // racks}", tuple(rack[i : i + racks])) for i in range(0, len(rack), racks)]
    return inner("root", tuple(region))


def descend(node: Node, key: Column) -> Column:
    """The number of the shard that the key reaches from this node."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(node.children[0], key)
    draws = []
    for i, child in enumerate(node.children):
        # 52 bits of a digest, as a number strictly between 0 and 1
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + child.name))), 1, 13), 16, 10).cast("double")
        draws.append(F.struct((-F.log((bits + 0.5) / float(2**52)) / child.weight).alias("draw"), F.lit(i).alias("child")))
    child = F.least(*draws)["child"]
    if not any(c.children for c in node.children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in node.children]), child + 1)
    # the winner is found once and then looked up, so only one subtree's draws are made
    out = F.when(child == 0, descend(node.children[0], key))
    for i, c in enumerate(node.children[1:], 1):
        out = out.when(child == i, descend(c, key))
    return out


def assign(df: DataFrame, tree: Node, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """Adds the shard of each row; all other columns are kept, so `name` must not be one of them."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name} already: give another name")
    return df.withColumn(name, descend(tree, F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("int"))


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs: (doc_id, text).  Per row: size, checksum, shard, slot within the shard and the shard it
    would have with one more."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = assign(assign(rows, layout(shards)), layout(shards + 1), name="grown_shard")
    bucket = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"))), 1, 2)
    rows = written(rows.withColumn("bucket", bucket), "shard-rows")
    return running_sum(rows, ["shard"], "bucket", ["doc_id", "size", "text_crc32"], None, "slot").drop("bucket")


def op5_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_rows(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
