"""Best-fit packing of tokenised documents into sequences.

Documents are tokenised in Arrow batches and cut into pieces of at most `capacity` tokens.  Best-fit
decreasing looks only at lengths, and there are at most `capacity` different ones: the counts per
length (a table of at most `capacity` rows) decide the whole packing, which is worked out as runs
of equal decisions with a segment tree over remaining capacities.  Pieces are then numbered within
their length in salted groups and look up their run, so no task ever holds a length's pieces.

Defined results: a null or empty text is the one end token; a null doc_id is packed like any other;
repeated rows are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import running_sum, written

CAPACITY = 1024
END_TOKEN = 2
#: Groups that the pieces of one length are numbered in, and pieces a group from which there are more.
SALTS, PIECES_A_SALT = 256, 200_000
#: Entries of a task's table of parts, after which it starts anew, keeping what the new one asks for.
CACHE_ENTRIES = 500_000


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Runs of letters, parts of a text whose ends are ends of pre-tokens, and what makes a text too odd for that:
    apostrophes (contractions), and characters that Python's classes and Unicode's L and N, or
    white space, disagree about.  All know the first 65,536 characters, which makes them fast."""
    all_ = [chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
    letters = "".join(re.escape(c) for c in all_ if c.isalpha())
    letter, other = f"[{letters}]", rf"[^\s{letters}]"
    odd = "".join(re.escape(c) for c in all_ if c.isalnum() and not c.isalpha() and not c.isdecimal())
    part = re.compile(rf" ?{letter}+|\s(?={letter})|{other}+(?=\s?{letter})|(?:(?! ?{letter}|\s{letter}).)+", re.DOTALL)
    return re.compile(f" ?{letter}+"), part, re.compile("['\x1c-\x1f" + odd + "]")


@cache
def _byte_letters() -> dict[int, int]:
    """The character that byte-level models write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class PartIds(dict):
    """Token ids of texts, as the bytes of little-endian unsigned 32-bit numbers.  Texts are cut into
    runs of letters (with a space before) and what lies between, which is where pre-tokens end; the
    ids of each part are looked up here.  New runs of letters, which are one pre-token each, go straight to the
    tokenizer's model, other new parts to the tokenizer.  Texts that hold an added token's literal go there whole,
    and so do all texts if it isn't a plain byte-level one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.old: dict[str, bytes] = {}
        self.run, self.part, self.odd = _patterns()
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        self.plain = plain and not spec["normalizer"] and not spec["truncation"] and all(re.search(r"[^\w\s]", x) for x in self.added)

    def parts(self, text: str) -> list[str]:
        beyond = len(text.encode("utf-16-le")) > 2 * len(text)  # the first 65,536 characters
        whole = not self.plain or beyond or self.odd.search(text) or any(x in text for x in self.added)
        return [text] if whole else self.part.findall(text)

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            if self.plain and self.run.fullmatch(part):
                shown = part.replace(" ", "\u0120") if part.isascii() else part.encode().decode("latin-1").translate(_byte_letters())
                found = [x.id for x in self.model.tokenize(shown)]
            else:
                found = self.tokenizer.encode(part, add_special_tokens=False).ids
            ids = pack(f"<{len(found)}I", *found)
        if len(part) <= 64:  # whole texts aren't worth keeping
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            yield b"".join(map(self.__getitem__, self.parts(text))) if text else b""

    def forget(self) -> None:
        """Gives the memory of the table and of Arrow's batches back: a worker lives on after its task, beside those of
        other operators."""
        self.clear()
        self.old = {}
        pa.default_memory_pool().release_unused()


@cache
def _part_ids(path: str) -> PartIds:
    """One tokenizer a worker, for all its tasks, which leave its table empty; it starts no threads beside them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PartIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_token: int = END_TOKEN, digest: bool = False) -> DataFrame:
    """docs: (doc_id, text).  Per piece: doc_id, piece, start, length and its ids, or with digest
    their CRC-32 instead.  All pieces of a document but the first have `capacity` tokens."""
    last = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.IntegerType()))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), last])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = _part_ids(tokenizer), np.array([end_token], "<u4").tobytes()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    keys, rows = part.column("doc_id"), ([], [], [], [], [])
                    for i, ids in enumerate(ids_of([t or "" for t in part.column("text").to_pylist()])):
                        ids += end
                        n = len(ids) // 4
                        bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                            own = ids[4 * a : 4 * b]
                            for column, value in zip(rows, (i, k, a, b - a, zlib.crc32(own) if digest else np.frombuffer(own, "<i4")), strict=True):
                                column.append(value)
                    take, piece, start, length, tail = rows
                    tail = pa.array(tail, pa.int64()) if digest else pa.array(tail, pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(take, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), tail], names=["doc_id", "piece", "start", "length", last.name])
        finally:
            ids_of.forget()

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class TightestBin:
    """Open bins by remaining capacity.  The leaves of a segment tree are the capacities, each with
    its groups of bins (first bin, number of bins); a node tells whether any group is below it, so
    the smallest capacity that fits is found by going up and down once."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, group: tuple[int, int], sign: int = 1) -> None:
        node = self.size + capacity
        while node:
            self.some[node] += sign
            node //= 2
        if sign > 0:
            self.groups[capacity].append(group)

    def pop(self, least: int) -> tuple[int, tuple[int, int]] | None:
        node = self.size + least
        while not self.some[node]:
            while node & 1:  # a right child: nothing to the right below its parent
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node + (not self.some[2 * node])
        capacity = node - self.size
        self.add(capacity, (), -1)
        return capacity, self.groups[capacity].pop()


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs of best-fit decreasing over counts per length, in the order the pieces are placed: rows
    (number of the first piece, first bin, pieces per bin, offset in the bin, length).  Bins of equal
    remaining capacity are treated together: the tightest bin stays the tightest until the length
    no longer fits, so a group of bins takes the same number of pieces each."""
    tree, runs, placed, bins = TightestBin(capacity), [], 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room, group = tree.pop(length) or (capacity, None)
            each = room // length
            if group is None:
                group = (bins, -(-left // each))
                bins += group[1]
            first, many = group
            full, rest = divmod(min(left, many * each), each)
            if full:
                runs.append((placed, first, each, capacity - room, length))
                placed += full * each
                if room - each * length:
                    tree.add(room - each * length, (first, full))
            if rest:
                runs.append((placed, first + full, rest, capacity - room, length))
                placed += rest
                tree.add(room - rest * length, (first + full, 1))
            if many > full + bool(rest):
                tree.add(room, (first + full + bool(rest), many - full - bool(rest)))
            left -= full * each + rest
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces: a written table with `length`.  Adds sequence_id and offset."""
    others = [c for c in pieces.columns if c not in ("length", "ids")]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    salts = max(SALTS, max(counts.values(), default=0) // PIECES_A_SALT)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"))
    runs = best_fit_decreasing(counts, capacity)
    earlier, total = {}, 0
    for length in sorted(counts, reverse=True):
        earlier[length], total = total, total + counts[length]
    ahead = np.zeros(capacity + 1, np.int64)
    for length, n in earlier.items():
        ahead[length] = n

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):
        import pandas as pd

        number = ahead[length.to_numpy()] + rank.to_numpy()
        run = runs[np.searchsorted(runs[:, 0], number, side="right") - 1]
        bin_, at = np.divmod(number - run[:, 0], run[:, 2])
        return pd.DataFrame({"sequence_id": run[:, 1] + bin_, "offset": run[:, 3] + at * run[:, 4]})

    ranked = running_sum(salted, ["length"], "salt", others, None, "rank")
    return ranked.withColumn("place", place("length", "rank")).select(*pieces.columns, "place.sequence_id", "place.offset")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The token sequences: sequence_id, ids of its pieces in order and the pieces' documents."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(inside.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = written(token_pieces(docs, tokenizer or default_tokenizer(), digest=True), "pieces")
    return packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
