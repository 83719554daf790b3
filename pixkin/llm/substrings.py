"""Substring dedup with a count-min prefilter.

A window is `width` consecutive words.  Every partition counts its windows in the cells of a sketch with
DEPTH rows; the sketches are merged by ranges of cells into one bitmap a row that tells which cells were
counted twice or more.  They overestimate: a window in two documents is always among them.  A second pass
groups exactly the windows that all rows estimate repeated, by 96 bits of hash, and a word is removed if
such a window covers it and starts in a document with a smaller doc_id.

The sketch has four cells a window, at most 2 ** MOST_CELLS in a row, so its bitmaps take at most
DEPTH * 2 ** MOST_CELLS bits, 128 MB.  From about a thousand million windows (6 GB of text) on, the
prefilter lets more and more through, in the end all windows: the exact pass then shuffles 28 bytes a
window, in proportion to the input, and the result stays the same.

Defined results: a null or empty text has no words; very long texts are treated as others; a null doc_id
is smaller than nothing, so its words stay and count for no other; rows with one doc_id never remove each
other's words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, maybe_among, written
from .sketch import PARTS, Gathered, log2_cells, merged
from .wordhash import mix, row_chunks, run_hashes, word_hashes

WIDTH = 13
DEPTH = 2
LEAST_CELLS, MOST_CELLS = 16, 29
#: Cells of a sketch row by bytes of text: a window starts at each word, of about so many bytes.
WINDOWS_A_CELL, BYTES_A_WINDOW = 0.25, 6


def _cells(windows: np.ndarray, row: int, log2: int) -> np.ndarray:
    return (mix(windows, 101 + row) >> np.uint64(64 - log2)).astype(np.int64)


def repeated_cells(docs: DataFrame, width: int, log2: int, depth: int = DEPTH) -> list[np.ndarray]:
    """Per sketch row a bitmap of the cells whose count is two or more."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = Gathered(depth, log2), [c.split()[0] for c in PARTS.split(", ")]
        for batch in batches:
            texts = batch.column("text")
            for a, b in row_chunks(texts):
                words, rows = word_hashes(texts.slice(a, b - a))
                windows, at = run_hashes(words, rows, width)
                order = np.argsort(windows, kind="stable")  # and so by rows among equal ones
                windows, of = windows[order], rows[at[order]]
                again = (windows[1:] == windows[:-1]) & (of[1:] == of[:-1])
                windows = windows[np.append(True, ~again)[: len(windows)]]  # once a document
                for row in range(depth):
                    held.add(row, _cells(windows, row, log2))
                if held.full():
                    yield pa.RecordBatch.from_arrays(held.flush(), names=names)
        if held.many:
            yield pa.RecordBatch.from_arrays(held.flush(), names=names)

    return merged(docs.select("text").mapInArrow(sketch, PARTS), depth, log2, lambda counts: np.packbits(counts > 1))


def _second_hash(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Another hash, of 32 bits, of the runs of words that start at `at`."""
    out = np.zeros(len(at), np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD1342543DE82EF95) + words[at + i]
    return (mix(out, 64 + width) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def repeated_windows(docs: DataFrame, scratch: Scratch, width: int, log2: int, depth: int = DEPTH) -> DataFrame:
    """docs: (doc_id, text, text_crc32).  Per window that also starts in a document with a smaller
    doc_id: the document, its text's checksum and the number of the window's first word."""
    # as bytes, which workers load without a second copy
    shared = docs.sparkSession.sparkContext.broadcast([x.tobytes() for x in repeated_cells(docs, width, log2, depth)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [np.frombuffer(x, np.uint8) for x in shared.value]
        for batch in batches:
            texts = batch.column("text")
            for a, b in row_chunks(texts):
                words, rows = word_hashes(texts.slice(a, b - a))
                windows, at = run_hashes(words, rows, width)
                keep = np.arange(len(windows))
                for row in range(depth):
                    cell = _cells(windows[keep], row, log2)
                    keep = keep[(bitmaps[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0]
                if len(keep):
                    at = at[keep]
                    first = np.searchsorted(rows, rows[at])  # of the row
                    take = pa.array(rows[at] + a)
                    columns = [pa.array(windows[keep].view(np.int64)), pa.array(_second_hash(words, at, width))]
                    columns += [batch.column("doc_id").take(take), batch.column("text_crc32").take(take), pa.array((at - first).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["one", "two", "doc_id", "text_crc32", "at"])
        vars(shared).pop("_value", None)  # a worker would hold the bitmaps until its next task of another stage

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.filter("doc_id IS NOT NULL").mapInArrow(emit, f"one long, two int, doc_id {kind}, text_crc32 int, at int")
    found, window = scratch.table(found, "windows"), ["one", "two"]
    shared.unpersist()
    firsts = found.groupBy(*window).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id")
    # written, so that Spark splits a window that very many documents share
    firsts = scratch.table(firsts.drop("last_id"), "first-windows")
    return found.join(firsts, window).filter("doc_id > first_id").select("doc_id", "text_crc32", "at")


def _cut(width: int, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of doc_id, text in UTF-8 and starts: null (nothing goes), or the first words of the windows
    to remove, -1 alone standing for all."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            starts = batch.column("starts")
            for i, text in enumerate(batch.column("text")):
                words = text.as_py().split()  # bytes: at space and 9 to 13
                n, at = len(words), starts[i]
                if at.is_valid and len(at):
                    at = at.values.to_numpy()
                    if at[0] < 0:
                        at = np.arange(max(0, n - width + 1))
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + width, -1)
                    words = [w for w, c in zip(words, np.cumsum(cover), strict=False) if not c]
                n_words.append(n)
                n_removed.append(n - len(words))
                joined = b" ".join(words)
                kept.append(joined.decode() if texts else hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return cut


def deduped(docs: DataFrame, width: int = WIDTH, texts: bool = True, most_cells: int = MOST_CELLS) -> DataFrame:
    """docs: (doc_id, text).  Per document: doc_id, n_words, n_removed and the kept words joined by
    one space, or without texts their SHA-256.

    Of equal texts only the one with the smallest doc_id goes into the sketch and the windows: it
    stands for the others, which lose everything that lies in a window.  Only texts that lose
    something are shuffled."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text", (F.crc32(F.encode("text", "UTF-8")) - (1 << 31)).cast("int").alias("text_crc32"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    log2 = log2_cells(size / BYTES_A_WINDOW, WINDOWS_A_CELL, LEAST_CELLS, most_cells)
    keys = docs.filter("doc_id IS NOT NULL").select("doc_id", "text_crc32", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.length("text").alias("l"))
    keys, same = scratch.table(keys, "texts"), ["h", "g", "l"]
    firsts = keys.groupBy(*same).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    firsts = scratch.table(firsts, "first-texts")
    copies = keys.join(firsts.filter("first_id < last_id"), same).filter("doc_id > first_id").select("doc_id", "text_crc32").distinct()
    copies = scratch.table(copies, "copies")
    alone = maybe_among(docs, F.col("doc_id"), firsts.select("first_id"), "wanted").filter("wanted").drop("wanted")
    gone = repeated_windows(alone, scratch, width, log2).join(copies, ["doc_id", "text_crc32"], "left_anti")
    gone = gone.groupBy("doc_id", "text_crc32").agg(F.array_distinct(F.collect_list("at")).alias("starts"))
    gone = written(gone.unionByName(copies.withColumn("starts", F.array(F.lit(-1)))), "removed")
    scratch.drop("texts", "first-texts", "copies", "windows", "first-windows")
    marked = maybe_among(docs, F.col("doc_id"), gone.select("doc_id"), "wanted")
    spare = marked.filter("NOT wanted").withColumn("starts", F.lit(None).cast("array<int>"))
    hit = marked.filter("wanted").join(gone, ["doc_id", "text_crc32"], "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = []
    for rows in (spare, hit):
        rows = rows.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"), "starts")
        out.append(rows.mapInArrow(_cut(width, texts), f"doc_id {kind}, n_words long, n_removed long, kept string"))
    return out[0].unionByName(out[1]).withColumnRenamed("kept", "kept_text" if texts else "kept_sha256")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


OP10_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, unnest(range(len(w) - 12)) AS st, unnest(list_transform(range(len(w) - 12), lambda i: array_to_string(w[i + 1 : i + 13], ' '))) AS win FROM t WHERE len(w) >= 13),
gone AS (SELECT r, st FROM p QUALIFY doc_id > min(doc_id) OVER (PARTITION BY win)),
cover AS (SELECT DISTINCT r, unnest(range(st, st + 13)) AS i FROM gone),
word AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM t),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS s, count(*) AS n FROM word ANTI JOIN cover USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
"""
