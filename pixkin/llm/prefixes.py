"""Prefix trie of conversations: a Cartesian tree over the common prefixes of neighbours in sorted order.

Every turn becomes a digest of role and text, and a conversation the digests of its turns one after the
other, so that sorting these bytes puts conversations with a common prefix next to each other.

1. Conversations are dealt by range of (bytes, conv_id) into blocks of bounded size and sorted there.
   An identical conversation that is very common spreads over blocks, as conv_id is part of the range.
2. In a block, L[i] is the number of turns that row i shares with the row before it.  The nearest smaller
   values of L on both sides give the interval of rows that share L[i] turns: a node of the Cartesian
   tree.  Nodes of one interval and one L are merged, and between a node and the one above it the missing
   depths are filled in, as are the depths below the last branch of each row.  Everything asked for
   is a sum or least value over an interval: it is taken from prefix sums and a table of range minima.
3. A node that touches an edge of its block may go on in the next one.  A block's minimum of L tells down to
   which depth it lies inside one node; the turns that two blocks share at their common edge tell which nodes
   meet.  Only the nodes on the paths of the blocks' first and last rows, no deeper than what they
   share with a neighbour, go to the driver: the number of blocks times that depth.

saved_tokens of a node of depth d over rows l to r: a node with k members holds k - 1 pairs of neighbours,
so the sum over its subtree is, over those pairs i, the code points of turns d to L[i].

Defined results: a null conv_id is no conversation; a conversation without turns cannot be named by the
table, but one may be left without any; turns of one number follow by the digest of role and text, and repeated
rows are repeated turns; a null role or text is empty and equal to it; an empty table gives no rows; very long texts
count in full; other columns are ignored.  The digests of one conversation (16 bytes a turn) meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, written

#: Conversations and turns in a block, about.
BLOCK_ROWS, BLOCK_TURNS = 50_000, 1_000_000
DIGEST = 16
#: Turns of another conversation that start one, at most.
SHARED = 5

#: Columns of a node.  edge: 1 if it touches the block's first row, plus 2 if its last; up_edge: its parent's.
#: chars: code points of all turns down to the node; ends: ids of the members that end there, comma-joined.
NODE = "block int, depth int, edge int, up_edge int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string, ends_sha256 string"
_NAMES = [c.split()[0] for c in NODE.split(", ")]
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens", "chars"]


def own_turns(turns: DataFrame) -> DataFrame:
    """turns: (conv_id, turn, role, text).  Per conversation: conv_id, sign (its turns' digests) and size
    (their code points).  Texts aren't shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sign = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    row = F.struct("turn", sign.alias("sign"), F.length(text).cast("long").alias("size"))
    own = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row"))
    own = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return own.select("conv_id", F.col("rows.sign").alias("sign"), F.col("rows.size").alias("size"))


def rebuilt(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Per conversation: conv_id, key (the digests of its turns one after the other) and sizes.  Its first h
    turns are those of the conversation conv_id - conv_id % 100."""
    own = scratch.table(own_turns(turns), "own-turns")
    first = own.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), *[F.slice(c, 1, SHARED).alias(f"base_{c}") for c in ("sign", "size")])
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).cast("int")
    both = own.withColumn("base", F.expr("conv_id - conv_id % 100")).withColumn("h", h).join(first, "base", "left")

    def joined(c: str, kind: str) -> Column:
        head = F.slice(F.coalesce(f"base_{c}", F.array().cast(f"array<{kind}>")), F.lit(1), F.col("h"))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.size(c)))

    key = F.unhex(F.array_join(F.transform(joined("sign", "binary"), F.hex), ""))
    return both.select("conv_id", key.alias("key"), joined("size", "bigint").alias("sizes"))


def _nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place the nearest one before and after it with a smaller value; -1 and the length for none."""
    n, stack = len(values), []
    left, right = np.full(n, -1), np.full(n, n)
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][0] > v:
            right[stack.pop()[1]] = i
        if stack and stack[-1][0] == v:  # its own left is the equal one's
            left[i] = left[stack[-1][1]]
            right[stack.pop()[1]] = -2  # merged with this one
        elif stack:
            left[i] = stack[-1][1]
        stack.append((v, i))
    return left, right


def _range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first .. last] for each pair."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    power = np.log2(last - first + 1).astype(np.int64)
    out = np.empty(len(first), values.dtype)
    for p, level in enumerate(levels):
        at = np.flatnonzero(power == p)
        out[at] = np.minimum(level[first[at]], level[last[at] - (1 << p) + 1])
    return out


def _shared_turns(key: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per row the turns it shares with the row before it, 0 for the first.  key: two longs a turn."""
    out = np.zeros(len(n), np.int64)
    common = np.minimum(n[1:], n[:-1])
    row = np.repeat(np.arange(1, len(n)), common)
    if len(row):
        place = np.arange(len(row)) - np.repeat(np.cumsum(common) - common, common)
        other = (key[begin[row] + place] != key[begin[row - 1] + place]).any(axis=1)
        out[1:] = common
        np.minimum.at(out, row[other], place[other])
    return out


def _block_nodes(block: int, ids: np.ndarray, keys: list[bytes], sizes: list[np.ndarray]) -> dict[str, list | np.ndarray]:
    """All nodes of the trie of one block's sorted rows, with the columns of NODE."""
    m, n = len(ids), np.array([len(k) // DIGEST for k in keys])
    begin = np.cumsum(n) - n
    shared = _shared_turns(np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2), begin, n)
    # code points of the first d turns of row i are chars[begin[i] + i + d]
    chars = np.concatenate([x for s in sizes for x in ((0,), np.cumsum(s))]).astype(np.int64)
    start = begin + np.arange(m)
    pairs = np.append(0, np.cumsum(chars[start + shared])).astype(np.int64)  # pairs[i]: before row i; row 0 shares nothing
    ends = n > np.append(shared[1:], -1)  # no row after it goes on from it
    leaves = np.append(0, np.cumsum(ends))

    # the Cartesian tree's nodes, merged: rows first .. last share depth turns; one row has no pair
    lefts, rights = _nearest_smaller(shared[1:])
    at = np.flatnonzero(rights != -2)
    first, last, depth = lefts[at] + 1, rights[at], shared[1:][at]
    if m == 1:
        first, last, depth = np.zeros((3, 1), np.int64)
    edge_left, edge_right = np.append(shared, -1), np.append(shared[1:], -1)
    edge_left[0] = -1
    above = np.maximum(edge_left[first], edge_right[last])
    # below the last branch: rows by themselves
    alone = np.maximum(edge_left[:m], edge_right)
    own = np.flatnonzero(n > np.maximum(alone, 0))
    node_first, node_last = np.append(first, own), np.append(last, own)
    low, high = np.append(above, np.maximum(alone[own], 0)), np.append(depth, n[own])

    # children at the lowest depth: groups of rows that go on there
    count = high - low
    of = np.repeat(np.arange(len(count)), count)
    d = np.repeat(low, count) + 1 + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    left, right = node_first[of], node_last[of]
    bottom = d == high[of]
    n_convs = right - left + 1
    level_rows = np.zeros(len(of), np.int64)  # rows that end here, at the start of the interval
    level_rows[bottom] = _ending(n, left[bottom], right[bottom], d[bottom])
    groups = np.ones(len(of), np.int64)
    groups[bottom] = _branches(shared, left[bottom], right[bottom], d[bottom]) + 1 - level_rows[bottom]
    saved = pairs[right + 1] - pairs[left + 1] - (n_convs - 1) * chars[start[left] + np.maximum(d - 1, 0)]
    least = _range_least(ids, left, right)
    edge = (left == 0) + 2 * (right == m - 1)
    ends_text, ends_hash = [""] * len(of), [_EMPTY] * len(of)
    for i in np.flatnonzero(level_rows):
        text = ",".join(map(str, np.sort(ids[left[i] : left[i] + level_rows[i]]).tolist()))
        ends_text[i] = text if edge[i] else ""
        ends_hash[i] = hashlib.sha256(text.encode()).hexdigest()
    # the parent is the node one higher over the interval, found by its first row among nodes of its depth
    order = np.lexsort((left, d))
    place = np.searchsorted(d[order] * (m + 1) + left[order], (d - 1) * (m + 1) + left, "right") - 1
    parent = order[np.maximum(place, 0)]
    columns = {"block": np.full(len(of), block), "depth": d, "edge": edge, "up_edge": np.where(d > 0, edge[parent], 0), "conv_id": least}
    columns |= {"parent_conv_id": pa.array(least[parent], mask=d == 0), "n_convs": n_convs, "n_children": groups, "n_leaves": leaves[right + 1] - leaves[left]}
    return columns | {"saved_tokens": saved, "chars": chars[start[left] + d], "ends": ends_text, "ends_sha256": ends_hash}


_EMPTY = hashlib.sha256(b"").hexdigest()


def _ending(n: np.ndarray, first: np.ndarray, last: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Rows of each interval with exactly `depth` turns; they come first."""
    row = np.lexsort((np.arange(len(n)), n))  # by number of turns, then place
    code = n[row] * (len(n) + 1) + row
    return np.searchsorted(code, depth * (len(n) + 1) + last, "right") - np.searchsorted(code, depth * (len(n) + 1) + first)


def _branches(shared: np.ndarray, first: np.ndarray, last: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Pairs of neighbours inside each interval that share exactly `depth` turns."""
    return _ending(shared, first + 1, last, depth)


def block_tables(convs: DataFrame, blocks: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of conversations: all nodes of every block, and per block its first and last row's digests."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, keys, sizes = -1, [], [], []
        for batch in batches:
            if batch.num_rows:
                block = batch.column("block")[0].as_py()
                ids.append(batch.column("conv_id").to_numpy())
                keys += batch.column("key").to_pylist()
                sizes += [np.asarray(x.values) for x in batch.column("sizes")]
        if not keys:
            return
        columns = _block_nodes(block, np.concatenate(ids), keys, sizes)
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        arrays = [pa.array(columns[c.split()[0]], kinds[c.split()[1]]) for c in NODE.split(", ")]
        nodes = pa.RecordBatch.from_arrays([*arrays, *[pa.nulls(len(arrays[0]), pa.binary())] * 2], names=[*_NAMES, "first_key", "last_key"])
        for at in range(0, nodes.num_rows, 10_000):
            yield nodes.slice(at, 10_000)
        rest = [pa.array([block], pa.int32()), *[pa.nulls(1, a.type) for a in arrays[1:]]]
        yield pa.RecordBatch.from_arrays([*rest, pa.array([keys[0]], pa.binary()), pa.array([keys[-1]], pa.binary())], names=[*_NAMES, "first_key", "last_key"])

    dealt = convs.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = dealt.select(F.spark_partition_id().alias("block"), "conv_id", "key", "sizes").mapInArrow(build, f"{NODE}, first_key binary, last_key binary")
    found = scratch.table(found, "nodes")
    return found.filter("depth IS NOT NULL").select(*_NAMES), found.filter("depth IS NULL").select("block", "first_key", "last_key")


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(k, np.int64).reshape(-1, 2)[:n] for k in (a, b))
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if len(other) else n


def _met(edges: list, paths: list) -> list[tuple]:
    """edges: per block, in order, what its last row shares with the next block's first row and whether it ends
    there.  paths: the nodes at the blocks' edges.  Nodes of neighbouring blocks that are one: per part its
    block, depth and edge with the number, least id, parent's least id and sums of the whole node."""
    node = {(p["block"], p["depth"], side): p for p in paths for side in (1, 2) if p["edge"] & side}
    held: dict[int, dict] = {}  # open nodes by depth
    done = []

    def close(above: int) -> None:
        for d in sorted(d for d in held if d > above):
            if len(held[d]["parts"]) > 1:
                done.append(held[d])
            del held[d]

    for block, common, ended, after in edges:
        close(common)
        text = node[block, common, 2]["chars"]
        for d in range(common + 1):
            one = held.get(d) or dict(parts=[(block, d, node[block, d, 2]["edge"])], depth=d, **{c: node[block, d, 2][c] for c in ("conv_id", *_SUMS)})
            two = node[after, d, 1]
            one["parts"].append((after, d, two["edge"]))
            one["conv_id"] = min(one["conv_id"], two["conv_id"])
            one["saved_tokens"] += two["saved_tokens"] + text - (node[block, d - 1, 2]["chars"] if d else 0)
            one["n_convs"] += two["n_convs"]
            one["n_children"] += two["n_children"] - (d < common)
            one["n_leaves"] += two["n_leaves"] - ended
            held[d] = one
        # what doesn't reach the next block's last row ends there
        close(max([d for d in held if node[after, d, 1]["edge"] == 3], default=-1))
    close(-1)
    by_part = {part[:2]: x for x in done for part in x["parts"] if part[2] & 2}
    out = []
    for i, x in enumerate(done):
        block, d, _ = x["parts"][0]
        up = by_part[block, d - 1]["conv_id"] if d else None
        out += [(part[0], d, part[2], i, x["conv_id"], up, j == 0, *[x[c] for c in _SUMS[:-1]]) for j, part in enumerate(x["parts"])]
    return out


def prefix_trie(turns: DataFrame) -> DataFrame:
    """turns: (conv_id, turn, role, text).  Per node of the trie of rebuilt conversations: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    spark = turns.sparkSession
    scratch = Scratch(spark)
    convs = scratch.table(rebuilt(turns, scratch), "conversations")
    size = convs.agg(F.count("*").alias("rows"), F.sum(F.size("sizes")).alias("turns")).first()
    blocks = int(max(1, -(-size["rows"] // BLOCK_ROWS), -(-(size["turns"] or 0) // BLOCK_TURNS)))
    return trie_of(convs, blocks, scratch)


def trie_of(convs: DataFrame, blocks: int, scratch: Scratch) -> DataFrame:
    """convs: a written table of `rebuilt`."""
    spark = convs.sparkSession
    nodes, keys = block_tables(convs, blocks, scratch)
    found = sorted(keys.collect())  # a row a block
    edges = []
    for one, two in zip(found, found[1:], strict=False):
        common = _common(one["last_key"], two["first_key"])
        edges.append((one["block"], common, common == len(one["last_key"]) // DIGEST, two["block"]))
    scratch.drop("own-turns", "conversations")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not edges:
        return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), *out[2:])
    reach: dict[int, int] = {}
    for block, common, _, after in edges:
        reach[block], reach[after] = max(reach.get(block, 0), common), common
    deep = spark.createDataFrame(list(reach.items()), "block int, reach int")
    paths = nodes.filter("edge > 0").join(deep, "block").filter("depth <= reach").select("block", "depth", "edge", "conv_id", *_SUMS).collect()
    met = spark.createDataFrame(_met(edges, paths), "block int, depth int, edge int, node long, m_conv_id long, m_parent long, first boolean, " + ", ".join(f"m_{c} long" for c in _SUMS[:-1]))
    met = written(met, "met")

    # the ids that end at a node of several blocks are hashed block after block
    texts = nodes.filter("edge > 0 AND ends <> ''").join(met, ["block", "depth", "edge"]).select("node", "block", "ends")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], names=["node", "m_ends"])
        for batch in batches:
            for own, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if own != node:
                    if state:
                        yield row()
                    node, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
        if state:
            yield row()

    hashed = texts.repartition("node").sortWithinPartitions("node", "block").mapInArrow(digest, "node long, m_ends string")
    whole = met.filter("first").join(hashed, "node", "left")
    whole = whole.select(F.col("m_conv_id").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("m_parent").alias("parent_conv_id"), *[F.col(f"m_{c}").alias(c) for c in _SUMS[:-1]], F.coalesce("m_ends", F.lit(_EMPTY)).alias("ends_sha256"))

    # all other nodes; a parent of several blocks has another least id
    rest = nodes.join(met.select("block", "depth", "edge"), ["block", "depth", "edge"], "left_anti")
    up = met.select("block", (F.col("depth") + 1).alias("depth"), F.col("edge").alias("up_edge"), F.col("m_conv_id").alias("up"))
    rest = rest.join(up, ["block", "depth", "up_edge"], "left").withColumn("parent_conv_id", F.coalesce("up", "parent_conv_id"))
    return rest.select("conv_id", F.col("depth").cast("long").alias("depth"), *out[2:]).unionByName(whole)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = r"""
WITH said AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s, length(coalesce(text, ''))::BIGINT AS z
   FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(s ORDER BY turn NULLS FIRST, s) AS s, list(z ORDER BY turn NULLS FIRST, s) AS z FROM said GROUP BY c),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
   lambda x, y: list_reduce(list_prepend(xor(x, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384::BIGINT) ELSE u // 2 END)), 4294967295::BIGINT) % 6 AS h FROM own),
conv AS MATERIALIZED (SELECT a.c, coalesce(b.s, [])[1:a.h] || a.s[a.h + 1:] AS s, coalesce(b.z, [])[1:a.h] || a.z[a.h + 1:] AS z FROM crc a LEFT JOIN own b ON b.c = a.c - a.c % 100),
node AS MATERIALIZED (SELECT d, p, min(c) AS id, count(*) AS n, any_value(size) AS size, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (l = d), '') AS ends
   FROM (SELECT c, len(s) AS l, d, array_to_string(s[1:d], '') AS p, CASE WHEN d = 0 THEN 0 ELSE z[d] END AS size FROM conv, LATERAL (SELECT unnest(range(len(s) + 1)) AS d)) GROUP BY d, p),
kids AS (SELECT d - 1 AS d, left(p, 32 * (d - 1)) AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
both_ AS MATERIALIZED (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (d, p)),
sub AS (SELECT e AS d, left(p, 32 * e) AS p, count(*) FILTER (k = 0) AS leaves, sum((n - 1) * size) AS saved FROM both_, LATERAL (SELECT unnest(range(d + 1)) AS e) GROUP BY ALL)
SELECT x.id AS conv_id, x.d::BIGINT AS depth, up.id AS parent_conv_id, x.n AS n_convs, x.k AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM both_ x JOIN sub USING (d, p) LEFT JOIN node up ON up.d = x.d - 1 AND up.p = left(x.p, 32 * (x.d - 1))
"""
