"""Jaccard join of documents on word n-grams by filters under several global token orders.

A document's set holds the hashes of its distinct n-grams.  An order of all tokens goes by their
frequencies, the rarest first, and among equally rare ones by a hash that differs from order to
order.  Sets that are similar enough share a token among the first |set| - ceil(threshold * |set|)
+ 1 of every order, so:

1. A pass over the texts gives each set's size and digests, and sketches how often tokens occur
   (one row of a count-min sketch).  Any frequencies give right results, as long as all tasks use the same.
2. Equal sets become one class, whose smallest doc_id stands for it.
3. A second pass over those gives each set's prefix under every order.  Tokens that occur once in all
   the table are left out of the prefixes: no other set has them.  Few sets have any token left.
4. Sets that share a prefix token of the first order with the smallest of the token's list are candidates,
   and so are, in another round, all pairs that share one but lie in different components so far.
   In both rounds a candidate must also share a prefix token under every other order, and what is
   left is compared exactly.

So no pair is lost that joins components, and no group of copies is expanded into pairs.  In the second
round parity bitmaps keep near copies apart that are alike, but not enough: a bitmap has, per bit, whether
an odd number of the set's tokens hash to it, so sets differ in at least as many tokens as bits.
A token's list is joined with itself in blocks of a bounded size.

What grows with the table: 24 bytes a document, and for those with prefix tokens left the prefixes, the
tokens (8 bytes each) and the bitmap.  The sketch has a fixed size, at most 2 ** (MOST_CELLS - 1) bytes;
beyond a few hundred million tokens it no longer tells which occur once, so that all prefixes (a tenth of
the tokens at 0.9) go to the join on tokens, but it still puts frequent tokens last.

Defined results: a null or empty text has an empty set and is linked with nothing; with fewer words
than the n-gram, the whole sequence is the one token; very long texts are sets like others; a null doc_id
is linked with nothing and has no component; rows with one doc_id and some words share what links any of
them; an empty table gives no rows; other columns are ignored, and kept as they are by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch, free_name, maybe_among, written
from .sketch import PARTS, Gathered, log2_cells, merged
from .wordhash import mix, row_chunks, run_hashes, word_hashes

#: Orders that candidates must agree in.
ORDERS = 3
#: Cells of the sketch, as powers of two.  There is one a token, by so many bytes of text, of which half
#: are counted: so some cells stay without any, and most tokens that occur once are known to.
LEAST_CELLS, MOST_CELLS = 16, 27
BYTES_A_TOKEN = 6
#: Longs of a parity bitmap.
PARITY = 32
#: Documents of a token's list that are compared with as many others in one group.
BLOCK = 1024

SIGNS = "n long, one long, two long"


def token_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per chunk of rows: its first row, distinct tokens sorted by row and hash, and their rows."""
    for a, b in row_chunks(texts):
        words, rows = word_hashes(texts.slice(a, b - a), lower=True)
        tokens, at = run_hashes(words, rows, width)
        of = rows[at]
        count = np.bincount(rows, minlength=b - a)
        for short in range(1, width):  # the whole sequence is the token
            which = np.flatnonzero(count == short)
            if len(which):
                begin = np.searchsorted(rows, which)
                whole = np.zeros(len(which), np.uint64)
                for i in range(short):
                    whole = whole * np.uint64(0x9FB21C651E98DF25) + words[begin + i]
                tokens, of = np.append(tokens, mix(whole, short)), np.append(of, which)
        order = np.lexsort((tokens, of))
        tokens, of = tokens[order], of[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
        yield a, tokens[new], of[new]


def _digests(tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each set."""
    return np.add.reduceat(mix(tokens, 11), begin), np.add.reduceat(mix(tokens, 12), begin)


def _counted(tokens: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are counted (half of them, by hash) and the cells of all."""
    return tokens < np.uint64(1 << 63), ((tokens << np.uint64(1)) >> np.uint64(64 - log2)).astype(np.int64)


def signed(docs: DataFrame, width: int, log2: int) -> DataFrame:
    """Rows of two kinds.  Per document: doc_id, set size n and two digests of the set.  Of the sketch of
    tokens: shard, cells and counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "one", "two", "shard", "cells", "counts"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key_type = Gathered(1, log2), None

        def flushed() -> pa.RecordBatch:
            parts = held.flush()
            return pa.RecordBatch.from_arrays([pa.nulls(len(parts[0]), t) for t in (key_type, *[pa.int64()] * 3)] + parts, names=names)

        for batch in batches:
            key_type, rows = batch.column("doc_id").type, batch.num_rows
            n, one, two = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            for a, tokens, of in token_sets(batch.column("text"), width):
                if not len(tokens):
                    continue
                begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                row = of[begin] + a
                n[row] = np.diff(np.append(begin, len(of)))
                one[row], two[row] = _digests(tokens, begin)
                counted, cell = _counted(tokens, log2)
                held.add(0, cell[counted])
                if held.full():
                    yield flushed()
            columns = [batch.column("doc_id"), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns + [pa.nulls(rows, t) for t in (pa.int32(), pa.binary(), pa.binary())], names=names)
        if held.many:
            yield flushed()

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, {SIGNS}, {PARTS}")


def frequencies(parts: DataFrame, log2: int) -> np.ndarray:
    """Per cell half a byte: 0 for none or one, else the logarithm of the count to base 2, at most 15."""

    def pack(counts: np.ndarray) -> np.ndarray:
        level = np.log2(np.maximum(counts, 1)).clip(0, 15).astype(np.uint8)
        return level[::2] | level[1::2] << np.uint8(4)

    return merged(parts, 1, log2, pack)[0]


def prefixes(docs: DataFrame, width: int, num: int, den: int, log2: int, levels: Broadcast) -> DataFrame:
    """Per document with a token left in its prefixes: size n, two digests, how many tokens it may share
    with others at most, its parity bitmap, its tokens and its prefix under each order.  Tokens in the
    join are keys of the order: frequency first, then a hash; the same token has the same key."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_cell = np.frombuffer(levels.value, np.uint8)  # bytes, which workers load without a second copy
        for batch in batches:
            for a, tokens, of in token_sets(batch.column("text"), width):
                if not len(tokens):
                    continue
                begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                n = np.diff(np.append(begin, len(of)))
                counted, cell = _counted(tokens, log2)
                level = np.where(counted, of_cell[cell >> 1] >> ((cell & 1) << 2).astype(np.uint8) & 15, np.uint8(16))
                free = n - np.add.reduceat((level == 0).astype(np.int64), begin)
                length = n - (n * num + den - 1) // den + 1
                some = n - free < length
                if not some.any():
                    continue
                keep = np.repeat(some, n)
                tokens, of, level = tokens[keep], of[keep], level[keep]
                row, n, free, length = of[np.flatnonzero(np.append(True, of[1:] != of[:-1]))], n[some], free[some], length[some]
                begin = np.cumsum(n) - n
                which = np.repeat(np.arange(len(n)), n)
                one, two = _digests(tokens, begin)
                bit = mix(tokens, 13)
                parity = np.zeros(len(n) * PARITY, np.uint64)
                np.bitwise_xor.at(parity, which * PARITY + ((bit >> np.uint64(6)) % np.uint64(PARITY)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
                place, lists = np.arange(len(tokens)) - np.repeat(begin, n), []
                for k in range(ORDERS):
                    key = (level.astype(np.uint64) << np.uint64(58)) | (mix(tokens, 20 + k) >> np.uint64(6))
                    key = key[np.lexsort((key, which))]
                    taken = (place < np.repeat(length, n)) & (key >= np.uint64(1 << 58))
                    ends = np.append(0, np.cumsum(np.bincount(which[taken], minlength=len(n))))
                    lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(key[taken].view(np.int64))))
                whole = pa.ListArray.from_arrays(pa.array(np.append(begin, len(tokens)).astype(np.int32)), pa.array(tokens.view(np.int64)))
                bitmap = pa.FixedSizeListArray.from_arrays(pa.array(parity.view(np.int64)), PARITY).cast(pa.list_(pa.int64()))
                columns = [batch.column("doc_id").take(pa.array(row + a)), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(free), bitmap, whole, *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "one", "two", "free", "parity", "tokens", *[f"prefix{k}" for k in range(ORDERS)]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"prefix{k} array<long>" for k in range(ORDERS))
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, {SIGNS}, free long, parity array<long>, tokens array<long>, {lists}")


def _may_be_similar(x: str, y: str, num: int, den: int) -> Column:
    """Whether sets can have a similarity of num / den, by their sizes and what they may share."""
    n, m = f"{x}n", f"{y}n"
    return F.expr(f"{n} * {den} >= {m} * {num} AND {m} * {den} >= {n} * {num} AND ({n} + {m}) * {num} <= {num + den} * least({x}free, {y}free)")


def _near_enough(x: str, y: str, num: int, den: int) -> Column:
    """Whether sets can have a similarity of num / den, by their bitmaps: they may have as many tokens
    apart as their sizes allow beside the tokens they must share."""
    apart = " + ".join(f"bit_count({x}parity[{i}] ^ {y}parity[{i}])" for i in range(PARITY))
    both = f"({x}n + {y}n)"
    return F.expr(f"{apart} <= {both} - 2 * (({both} * {num} + {num + den - 1}) div {num + den})")


def linked(pairs: DataFrame, signs: DataFrame, num: int, den: int) -> DataFrame:
    """pairs: a written table (a, b).  Those near enough by their bitmaps that share a prefix token under
    every order and, last, enough of all their tokens."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    own = maybe_among(signs, F.col("doc_id"), ids, "wanted").filter("wanted")

    def with_columns(df: DataFrame, columns: list[str]) -> DataFrame:
        for side in "ab":
            df = df.join(own.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
        return df

    others = [f"prefix{k}" for k in range(1, ORDERS)]
    left = with_columns(pairs, ["n", "parity", *others]).filter(_near_enough("a_", "b_", num, den))
    for c in others:
        left = left.filter(F.arrays_overlap(f"a_{c}", f"b_{c}"))
    left = with_columns(left.select("a", "b"), ["tokens"])
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return left.filter(common * den >= (F.size("a_tokens") + F.size("b_tokens") - common) * num).select("a", "b")


def star_pairs(signs: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Each set with the smallest of the lists that its prefix tokens of the first order are in."""
    posts = signs.select(F.explode("prefix0").alias("token"), "doc_id", "n", "free")
    hubs = posts.groupBy("token").agg(F.min(F.struct("doc_id", "n", "free")).alias("h"), F.max("doc_id").alias("last")).filter("h.doc_id < last")
    hubs = scratch.table(hubs.select("token", F.col("h.doc_id").alias("hub"), F.col("h.n").alias("h_n"), F.col("h.free").alias("h_free")), "hubs")
    # written, so that Spark splits a token with a long list
    stars = posts.withColumnsRenamed({"n": "p_n", "free": "p_free"}).join(hubs, "token").filter("doc_id > hub").filter(_may_be_similar("p_", "h_", num, den))
    return scratch.table(stars.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct(), "star-pairs")


def pairs_between(signs: DataFrame, so_far: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """so_far: a written table (id, component_id).  All pairs of sets of different components that share a
    prefix token of the first order, are close enough in size and near enough by their bitmaps."""
    signs = signs.join(so_far.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component_id", "doc_id"))
    own = scratch.table(signs.select("doc_id", "c", "n", "free", "parity", "prefix0"), "of-components")
    lists = own.select(F.explode("prefix0").alias("token"), "c").groupBy("token").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("many"))
    lists = scratch.table(lists.filter("least < most").select("token", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks")), "split-lists")
    posts = own.select(F.explode("prefix0").alias("token"), "doc_id", "c", "n", "free", "parity")
    posts = maybe_among(posts, F.col("token"), lists.select("token"), "wanted").filter("wanted").drop("wanted").join(lists, "token")
    posts = scratch.table(posts, "split-postings")
    block, every = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x, y = (posts.withColumn(mine, block).withColumn(other, every).drop("blocks").alias(s) for s, mine, other in (("x", "i", "j"), ("y", "j", "i")))
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    both = x.join(y, same & (F.col("x.c") < F.col("y.c")) & _may_be_similar("x.", "y.", num, den) & _near_enough("x.", "y.", num, den))
    pairs = scratch.table(both.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), "pairs")
    scratch.drop("of-components", "split-lists", "split-postings")
    return pairs


def jaccard_components(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """docs: (doc_id, text).  Per row: doc_id, n_shingles and component_id under links of a Jaccard
    similarity of num / den or more between sets of `width`-word shingles."""
    spark = docs.sparkSession
    scratch, docs, same = Scratch(spark), docs.select("doc_id", "text"), ["n", "one", "two"]
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    log2 = log2_cells(size / BYTES_A_TOKEN, 1.0, LEAST_CELLS, MOST_CELLS)
    first = scratch.table(signed(docs, width, log2), "signed")
    levels = spark.sparkContext.broadcast(frequencies(first.filter("shard IS NOT NULL").select("shard", "cells", "counts"), log2).tobytes())

    member = first.filter("shard IS NULL").select("doc_id", *same)
    sound = member.filter("n > 0 AND doc_id IS NOT NULL")
    # written, so that Spark splits the class of a text that is copied a lot
    classes = written(sound.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("many")), "classes")
    alone = maybe_among(docs, F.col("doc_id"), classes.select("rep"), "wanted").filter("wanted")
    found = prefixes(alone, width, num, den, log2, levels)
    signs = scratch.table(found.join(classes.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same], "left_semi").dropDuplicates(["doc_id", *same]), "prefixes")
    levels.unpersist()

    stars = scratch.table(linked(star_pairs(signs, scratch, num, den), signs, num, den), "star-links")
    so_far = scratch.table(components(stars, scratch), "components")
    scratch.drop("hubs", "star-pairs")
    more = linked(pairs_between(signs, so_far, scratch, num, den), signs, num, den)
    groups = classes.filter("many > 1").select(*same, "rep")
    again = sound.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = sound.join(again, "doc_id", "left_semi").join(groups, same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = so_far.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more).unionByName(again)
    final = written(components(links, scratch), "components")
    scratch.drop("prefixes", "star-links", "components", "pairs")

    out = sound.join(groups, same, "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(final.withColumnRenamed("id", "rep"), "rep", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))
    rest = member.filter("NOT (n > 0 AND doc_id IS NOT NULL)")
    return out.unionByName(rest.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, 3, 90, 100)


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents of which none with a smaller doc_id is in their component; of rows with one
    doc_id and one text, one stays.  Texts without words and null doc_ids stay.  Only documents
    that may go are shuffled."""
    found = jaccard_components(docs, width, num, den)
    gone = written(found.filter("doc_id > component_id").select("doc_id").distinct(), "gone")
    again = written(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    name = free_name("wanted", docs)
    marked = maybe_among(docs, F.col("doc_id"), gone.union(again), name)
    some = marked.filter(name).drop(name).join(gone, "doc_id", "left_anti")
    once = some.join(again, "doc_id", "left_anti").unionByName(some.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return marked.filter(~F.col(name)).select(*docs.columns).unionByName(once.select(*docs.columns))


OP9_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM t),
p AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
   GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.c, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = s.doc_id
"""
