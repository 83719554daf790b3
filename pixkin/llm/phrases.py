"""Collocations: phrases whose words occur together far more often than apart.

Texts are lower-cased, split into pieces at punctuation and line ends, and pieces into words.

1. A count-min sketch counts words and pairs of words, of each language by themselves.  A second one counts
   runs of three and four words, of which all pairs reach the least count in the first.  Tasks send the cells they have
   counted, which are merged by ranges of cells to a bit a cell: whether it reaches the least count.
   Sketches only overestimate, so no phrase is lost.
2. Texts are dealt into shards of a bounded size, of one language each.  The phrases of a shard that the
   sketches let through are its candidates; they are compiled into an automaton with a guard of one space before and after each, so that they match whole words only, also
   where matches overlap.  The automaton counts them in the shard, in those stretches of text where all
   pairs may reach the least count: candidates lie in no others.  Words, which the scores need, are counted
   beside it.
3. The counts of all shards are summed, first within a task, and only then come the least count, the scores and
   the ranks.  A task hands on a row for each phrase, so there are as many tasks as cores, not more with more text:
   the rows grow as the phrases do, until a task can't hold the counts of all of them, and from there on as the text.

An automaton holds what occurs in its shard, so it doesn't grow with the corpus.  The sketches have 24
bytes of text a cell up to 2 ** MOST_CELLS cells a row; from about 20 GB of text on they let through more
than they should, and with far more text nearly every run: the shards then count phrases that are dropped
after summing, in proportion to the input, and the result stays the same.

Defined results: a null or empty text has no words; a null lang counts as `und`; very long texts are cut
between pieces; repeated rows count each; ties of rank fall to the phrase in the order of its bytes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, written
from .sketch import PARTS, Gathered, log2_cells, merged
from .wordhash import mix, run_hashes, word_hashes

LONGEST = 4
LEAST_COUNT = 30
DEPTH = 2
LEAST_CELLS, MOST_CELLS = 16, 28
#: Bytes of text to a word, and words and pairs to a cell.
BYTES_A_WORD, RUNS_A_CELL = 6, 8
#: Bytes of text that are hashed together, and that one automaton is for.
HASHED_BYTES, SHARD_BYTES = 1 << 18, 4 << 20
#: Bytes of text that one task counts at most, and cells that a task gathers at a time.
COUNT_BYTES, FLUSH = 512 << 20, 1 << 21
#: Bytes of counts that a task holds to sum those of its shards.
HELD_BYTES = 64 << 20

_BREAK = re.compile(rb"[.,;:!?\n-\r]")
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """The text, cut at the first end of a piece after each `most` bytes."""
    at = 0
    while len(text) - at > most and (end := _BREAK.search(text, at + most)):
        yield text[at : end.start()]
        at = end.end()
    yield text[at:] if at else text


def _plain(texts: list[bytes]) -> bytes:
    """Texts in lower case, with line ends between pieces and spaces between words."""
    return b"\n".join(texts).translate(_TABLE)


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """lang and texts in plain form, about `size` bytes of one language together."""
    held: dict[str, list[bytes]] = {}
    many: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            if text.is_valid:
                for part in _parts(text.as_py().encode(), size):
                    held.setdefault(lang, []).append(part)
                    many[lang] += len(part) + 1
                    if many[lang] >= size:
                        yield lang, _plain(held.pop(lang))
                        del many[lang]
            if many.total() >= 4 * size:  # of many languages
                yield from ((x, _plain(held[x])) for x in held)
                held, many = {}, Counter()
    yield from ((x, _plain(held[x])) for x in held)


class Words:
    """Words of texts in plain form: hashes, pieces they are in, and where they start and end."""

    def __init__(self, lang: str, plain: bytes):
        data = np.frombuffer(plain, np.uint8)
        inside = np.concatenate(([False], (data != 32) & (data != 10), [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        lines = np.flatnonzero(data == 10)
        self.data, self.piece = data, np.searchsorted(lines, self.start)
        self.seed = np.array([zlib.crc32(lang.encode()) + (len(lang) << 32)], np.uint64)
        bounds = np.append(np.flatnonzero(np.diff(self.piece)) + 1, len(self.start))  # between pieces
        hashes, i = [], 0
        while i < len(self.start):  # a bounded number of bytes at a time
            j = int(bounds[min(np.searchsorted(bounds, np.searchsorted(self.start, self.start[i] + HASHED_BYTES)), len(bounds) - 1)])
            part = pa.array([plain[self.start[i] : self.end[j - 1]]], pa.binary()).cast(pa.string())
            hashes.append(word_hashes(part)[0])
            i = j
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Per run of `width` words of a piece: its hash with the language's, and its first word."""
        value, at = run_hashes(self.hash, self.piece, width)
        return mix(value ^ mix(self.seed, 5), 6), at


class Sketch:
    """A bit a cell and row: whether the cell's count reaches the least one.  Bytes, that workers share."""

    def __init__(self, rows: list[np.ndarray], log2: int):
        self.rows, self.log2 = [x.tobytes() for x in rows], log2

    def may_reach(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for row, bits in enumerate(self.rows):
            at = np.flatnonzero(out)
            cell = _cells(values[at], row, self.log2)
            out[at] = (np.frombuffer(bits, np.uint8)[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
        return out


def _cells(values: np.ndarray, row: int, log2: int) -> np.ndarray:
    return (mix(values, 101 + row) >> np.uint64(64 - log2)).astype(np.int64)


def _passing(words: Words, short: Sketch, longer: Sketch | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """width, hashes and first words of the runs whose shorter runs all may reach the least count, and which
    may themselves, as far as there is a sketch of theirs."""
    good = np.ones(len(words.hash) + 1, bool)
    for width in range(1, LONGEST + 1):
        value, at = words.runs(width)
        some = good[at] & good[at + 1] if width > 1 else good[at]
        value, at = value[some], at[some]
        sketch = short if width < 3 else longer
        if sketch:
            reach = sketch.may_reach(value)
            value, at = value[reach], at[reach]
        yield width, value, at
        good = np.zeros(len(good), bool)
        good[at] = True


def sketched(docs: DataFrame, least: int, log2: int, short: Sketch | None = None) -> Sketch:
    """Of words and pairs of words, or given those of longer runs."""
    shared = docs.sparkSession.sparkContext.broadcast(short)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = Gathered(DEPTH, log2, FLUSH, zipped=True), [c.split()[0] for c in PARTS.split(", ")]
        for lang, plain in shards(batches, HASHED_BYTES):
            words = Words(lang, plain)
            runs = [v for k, v, _ in _passing(words, shared.value, None) if k > 2] if shared.value else [words.runs(k)[0] for k in (1, 2)]
            for row in range(DEPTH):
                held.add(row, _cells(np.concatenate(runs), row, log2))
            if held.full():
                yield pa.RecordBatch.from_arrays(held.flush(), names=names)
        if held.many:
            yield pa.RecordBatch.from_arrays(held.flush(), names=names)

    rows = merged(docs.mapInArrow(gather, PARTS), DEPTH, log2, lambda counts: np.packbits(counts >= least), zipped=True)
    shared.unpersist()
    return Sketch(rows, log2)


def _guarded(words: Words, whole: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The stretches of words in which each pair, by its first word, is `whole`: a space before each word and after
    each stretch, line ends between stretches.  Also where each word starts and ends; others are empty."""
    taken = np.zeros(len(words.start), bool)
    taken[:-1] |= whole[: len(taken) - 1]
    taken[1:] |= whole[: len(taken) - 1]
    length = np.where(taken, words.end - words.start, 0)
    cut = taken & ~whole[: len(taken)]  # the last word of a stretch
    after = np.cumsum(length + taken + 2 * cut)
    start = after - length - 2 * cut
    out = np.full(after[-1] if len(after) else 0, 32, np.uint8)
    at = np.repeat(words.start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    out[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())] = words.data[at]
    out[after[cut] - 1] = 10
    return out.tobytes(), start, start + length


def _counts(words: Words, plain: bytes, short: Sketch, longer: Sketch, exact: bool = False) -> tuple[list[str], list[int]]:
    """The words and phrases of a shard that may reach the least count, with their counts in it.

    Phrases are found by hashes, which also count them.  Two with one hash would make these differ from the
    automaton's counts: then all is done again by strings."""
    import ahocorasick

    found = list(_passing(words, short, longer))
    each = Counter(plain.split())
    one = found[0][2][np.unique(found[0][1], return_index=True)[1]] if not exact else found[0][2]
    single = {plain[a:b] for a, b in zip(words.start[one].tolist(), words.end[one].tolist(), strict=True)}
    out, many = [x.decode() for x in single], [each[x] for x in single]
    pair = np.zeros(len(words.hash), bool)
    pair[found[1][2]] = True
    text, start, end = _guarded(words, pair)
    phrases, hashed = [], []
    for width, value, at in found[1:]:
        first, n = (at, np.ones(len(at), np.int64)) if exact else (at[(u := np.unique(value, return_index=True, return_counts=True))[1]], u[2])
        phrases += [text[a:b] for a, b in zip(start[first].tolist(), end[first + width - 1].tolist(), strict=True)]
        hashed += n.tolist()
    if exact:
        phrases = list(set(phrases))
    if phrases:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, phrase in enumerate(phrases):
            automaton.add_word(f" {phrase.decode()} ", i)
        automaton.make_automaton()
        seen = Counter(map(itemgetter(1), automaton.iter(text.decode())))
        counts = [seen[i] for i in range(len(phrases))]
        if not exact and counts != hashed:
            return _counts(words, plain, short, longer, exact=True)
        out, many = out + [x.decode() for x in phrases], many + counts
    return out, many


def _summed(tables: list[pa.Table]) -> pa.Table:
    """phrase, f: a row a phrase."""
    return pa.concat_tables(tables).group_by("phrase", use_threads=False).aggregate([("f", "sum")]).select(["phrase", "f_sum"]).rename_columns(["phrase", "f"])


def partial_counts(batches: Iterator[pa.RecordBatch], short: Sketch, longer: Sketch) -> Iterator[pa.RecordBatch]:
    """lang, phrase, f: the counts of a task's shards, summed as long as they fit in HELD_BYTES, as most phrases
    come again in every shard."""
    held: dict[str, list[pa.Table]] = {}
    size = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for lang, tables in held.items():
            for part in _summed(tables).to_batches(10_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * part.num_rows), *part.columns], names=["lang", "phrase", "f"])

    for lang, plain in shards(batches, SHARD_BYTES):
        words = Words(lang, plain)
        phrases, many = _counts(words, plain, short, longer)
        own = pa.table({"phrase": pa.array(["", *phrases]), "f": pa.array([len(words.hash), *many], pa.int64())})
        held.setdefault(lang, []).append(own)
        size += own.nbytes
        if size >= HELD_BYTES:
            held = {k: [_summed(v)] for k, v in held.items()}
            size = sum(v[0].nbytes for v in held.values())
            if size > HELD_BYTES // 2:
                yield from handed()
                held, size = {}, 0
    yield from handed()


def counting_tasks(size: int, cores: int) -> int:
    """For so many bytes of text: one a core, but none for less than a shard, and more where they would get too long."""
    return max(1, min(cores, -(-size // SHARD_BYTES)), -(-size // COUNT_BYTES))


def counted(docs: DataFrame, short: Sketch, longer: Sketch, least: int, tasks: int, scratch: Scratch) -> DataFrame:
    """In so many tasks at most, per language and candidate that reaches the least count this count, and with an empty
    phrase the number of words."""
    shared = docs.sparkSession.sparkContext.broadcast((short, longer))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from partial_counts(batches, *shared.value)

    found = docs.coalesce(tasks).mapInArrow(scan, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    found = scratch.table(found.filter((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")
    shared.unpersist()
    return found


def ranked(counts: DataFrame, most: int, share: int, scratch: Scratch) -> DataFrame:
    """counts: a written table (lang, phrase, f).  Per language the first `most` phrases by score."""
    enough = counts.filter("phrase <> ''")
    words = F.split("phrase", " ")
    phrases = scratch.table(enough.withColumn("k", F.size(words)).filter("k > 1").withColumnRenamed("f", "a"), "candidates")

    joined = lambda a, b: F.array_join(F.slice(words, a, b), " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    cuts = phrases.withColumn("cut", cut).withColumns({"head": joined(F.lit(1), F.col("cut")), "tail": joined(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    heads = enough.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = enough.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    cuts = cuts.withColumn("by", big("l") + big("r")).withColumn("top", big("a") * 2_000_000).withColumn("score", F.expr("top div by"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")

    # phrases inside a longer one that is nearly as frequent
    span = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: joined(i, n)))))
    inner = phrases.filter("k > 2").select("lang", F.col("a").alias("f"), span.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    best = best.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (big("longer") * 100 < big("a") * share))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    total = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, most: int = 2000, share: int = 80) -> DataFrame:
    """docs: (text, lang).  Per language the `most` best phrases of two to four words that occur `least` times
    or more, but for those that lie in a longer one with `share` percent of their count."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    log2 = log2_cells(2 * size / BYTES_A_WORD, RUNS_A_CELL, LEAST_CELLS, MOST_CELLS)
    short = sketched(docs, least, log2)
    longer = sketched(docs, least, log2, short)
    counts = counted(docs, short, longer, least, counting_tasks(size, docs.sparkSession.sparkContext.defaultParallelism), scratch)
    out = written(ranked(counts, most, share, scratch), "collocations")
    scratch.drop("phrases", "candidates")
    return out


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
gram AS (SELECT lang, k, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS phrase FROM w, range(1, 5) t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.*, i, array_to_string(w[1:i], ' ') AS head, array_to_string(w[i + 1:], ' ') AS tail FROM c, range(1, 4) t(i) WHERE i < k),
best AS (SELECT cut.lang, cut.phrase, a, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f + t.f))::BIGINT AS score FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head JOIN f t ON t.lang = cut.lang AND t.phrase = tail
   QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, i) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 4) t(n), range(1, 4) u(i) WHERE n < k AND i + n - 1 <= k GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN inner_ USING (lang, phrase) JOIN total USING (lang) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a QUALIFY rank <= 2000
"""
