"""Scores of texts by a hashed maximum-entropy language model.

A token's probability given those before it is that of its class times that of the token in its class.
The vocabulary's words, the most frequent ones of the training texts, are dealt by rank into CLASSES - 1
classes of WORDS; the last class is that of all other words, which in it have the probability that their
count gives them.  Both factors are softmaxes whose logits are a fixed bias, the unigram model's, plus a weight
vector for each feature of the context: the word before, the two before and the one before that (a skip).
A feature is hashed to a row of the class weights, and with the class to a row of the word weights.

Training: counts of words over all training texts are sums by key, and give the bias.  Then come ROUNDS
updates, each from another share of the training texts: a task adds up, per row and output, how often the
output was seen and how often the model expected it.  These sums are added by ranges of rows, and the
gradient, seen - expected, is divided by FEATURES times the logarithmic mean of the two: the step that
can't overshoot when all features of a token move at once.  Scoring works on batches of tokens in numpy.

What is broadcast has a fixed size: weights 3 MB, vocabulary and the counts of at most TOP words 4 MB.  Words
beyond those meet their counts in a join by hash.  Words are told apart by 64-bit hashes.  A task hands on
the rows that its texts touch, at most 3 MB, and takes TRAIN_BYTES of text if there is as much.

Defined results: a null or empty text has one token, its end; a null doc_id is held out; very long texts are
scored in full; repeated rows train and are scored once each; with no training text all counts are 0 and
every score is 0; an empty table gives no rows; other columns are ignored.  Sums of floats differ in their
last places with the order in which tasks end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, small_batches, written
from .wordhash import mix, row_chunks, word_hashes

CLASSES, WORDS = 32, 64
#: Rows of the class and of the word weights, as powers of two, 16 at most.
CLASS_ROWS, WORD_ROWS = 13, 13
FEATURES, ROUNDS = 3, 6
#: Added to what was seen and expected; and the step as a share of the one that can't overshoot.
PRIOR, STEP = 1.0, 1.5
#: Words whose counts are broadcast, at most.
TOP = 1 << 18
#: Tokens that are worked on together, tokens counted together, bytes of text of a training task.
BATCH, COUNTED, TRAIN_BYTES = 1 << 15, 1 << 20, 48 << 20
#: Ranges of rows that sums are added in.
RANGES = 16
EXTRA = 0.1
BEGIN, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per chunk of rows: the first row, the number of rows, tokens and their rows in the chunk."""
    for a, b in row_chunks(texts):
        words, rows = word_hashes(texts.slice(a, b - a), lower=True)
        count = np.bincount(rows, minlength=b - a)
        out = np.empty(len(words) + b - a, np.uint64)
        out[np.arange(len(words)) + rows] = words
        out[np.cumsum(count) + np.arange(b - a)] = END
        yield a, b - a, out, np.repeat(np.arange(b - a), count + 1)


def _contexts(tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes of each token's features, a row a feature."""
    before = []
    for back in (1, 2):
        x = np.full(len(tokens), BEGIN)
        same = rows[back:] == rows[:-back]
        x[back:][same] = tokens[:-back][same]
        before.append(x)
    one, two = before
    return np.stack([mix(one, 1), mix(one ^ mix(two, 2), 3), mix(two, 4)])


class Model:
    """Counts, bias and weights.  vocabulary: word hashes by rank; top: words and counts, sorted by word."""

    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, np.ndarray], tokens: int, distinct: int):
        self.tokens, self.distinct, self.top = tokens, distinct, top
        order = np.argsort(vocabulary)
        self.words, self.rank = vocabulary[order], order
        self.rare = tokens - int(counts.sum()), distinct - len(counts)
        mass = np.zeros((CLASSES, WORDS))
        mass.ravel()[: len(counts)] = counts + EXTRA
        mass[-1, 0] = self.rare[0] + EXTRA * (self.rare[1] + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_bias = np.maximum(np.log(mass.sum(1)), -1e9).astype(np.float32)
            self.word_bias = np.nan_to_num(np.log(mass / mass.sum(1, keepdims=True)), nan=0.0, neginf=-1e9).astype(np.float32)
        self.class_bias -= np.log(mass.sum()).astype(np.float32)
        self.class_weights = np.zeros((1 << CLASS_ROWS, CLASSES), np.float32)
        self.word_weights = np.zeros((1 << WORD_ROWS, WORDS), np.float32)

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Rank in the vocabulary, or the first place of the last class."""
        at = np.minimum(np.searchsorted(self.words, tokens), max(len(self.words) - 1, 0))
        known = self.words[at] == tokens if len(self.words) else np.zeros(len(tokens), bool)
        return np.where(known, self.rank[at] if len(self.rank) else 0, (CLASSES - 1) * WORDS)

    def batches(self, tokens: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        """Twice a batch: which tokens, the weights' number, rows of their features, targets, and the
        exponents of the logits less their maximum with the log-probability of the target."""
        context, place = _contexts(tokens, rows), self.places(tokens)
        for a in range(0, len(tokens), BATCH):
            which = np.arange(a, min(a + BATCH, len(tokens)))
            own = place[which] // WORDS
            at = (mix(context[:, which], 31) >> np.uint64(64 - CLASS_ROWS)).astype(np.int64)
            yield which, 0, at, own, *_softmax(self.class_bias, self.class_weights, at, own)
            which, own = which[own < CLASSES - 1], own[own < CLASSES - 1]
            at = (mix(context[:, which] ^ mix(own.astype(np.uint64), 41), 42) >> np.uint64(64 - WORD_ROWS)).astype(np.int64)
            inside = place[which] % WORDS
            yield which, 1, at, inside, *_softmax(np.take(self.word_bias, own, axis=0), self.word_weights, at, inside)

    def counts(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token its count, and whether it is among the top words."""
        words, many = self.top
        if not len(words):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
        known = words[at] == tokens
        return np.where(known, many[at], 0), known

    def unigram(self) -> tuple[float, float]:
        """What log10(count + EXTRA) is lessened by: of all words, and of a rare one in its class."""
        return tuple(float(np.log10(n + EXTRA * (v + 1))) for n, v in ((self.tokens, self.distinct), self.rare))


def _softmax(bias: np.ndarray, weights: np.ndarray, at: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    logits = np.take(weights, at[0], axis=0)
    logits += bias
    for k in range(1, len(at)):
        logits += np.take(weights, at[k], axis=0)
    logits -= logits.max(axis=1, keepdims=True) if len(logits) else 0
    own = logits[np.arange(len(target)), target]
    np.exp(logits, out=logits)
    total = logits.sum(axis=1)
    return logits, total, own - np.log(total)


def _group_sums(rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the groups of rows that start at `begin`: most are small, so rows are added place by place in all
    groups at once, and only what is left of large groups one by one."""
    many, out = np.diff(np.append(begin, len(rows))), np.take(rows, begin, axis=0)
    place, open_ = 1, np.flatnonzero(many > 1)
    while len(open_) and place < 16:
        out[open_] += np.take(rows, begin[open_] + place, axis=0)
        place += 1
        open_ = open_[many[open_] > place]
    for g in open_:
        out[g] += rows[begin[g] + place : begin[g] + many[g]].sum(axis=0)
    return out


#: Sums over rows of weights: weights' number and range, rows, what was expected in them, places seen and how often.
SUMS = "range int, rows binary, expected binary, at binary, seen binary"


def sums(model: Model, texts: Iterator[pa.Array]) -> pa.RecordBatch:
    """What the model expected and what was seen in the texts."""
    shapes = model.class_weights.shape, model.word_weights.shape
    expected, seen = [np.zeros(s) for s in shapes], [np.zeros(s[0] * s[1]) for s in shapes]
    held: list[list[np.ndarray]] = [[], []]

    def count(k: int, least: int) -> None:
        if sum(map(len, held[k])) >= least:
            seen[k] += np.bincount(np.concatenate(held[k]), minlength=len(seen[k]))
            held[k].clear()

    for column in texts:
        for _, _, tokens, rows in tokens_of(column):
            for _, k, at, target, raised, total, _ in model.batches(tokens, rows):
                raised /= total[:, None]
                for own in at if len(target) else ():
                    held[k].append((own * shapes[k][1] + target).astype(np.int32))
                    count(k, COUNTED)
                    order = np.argsort(own.astype(np.uint16), kind="stable")
                    begin = np.flatnonzero(np.append(True, np.diff(own[order])))
                    expected[k][own[order[begin]]] += _group_sums(np.take(raised, order, axis=0), begin)
    out = []
    for k, (rows, width) in enumerate(shapes):
        count(k, 1)
        step = rows // RANGES
        for r in range(RANGES):
            part, own = expected[k][r * step : (r + 1) * step], seen[k][r * step * width : (r + 1) * step * width]
            some, at = np.flatnonzero(part.any(axis=1)), np.flatnonzero(own)
            if len(some):
                out.append((k * RANGES + r, some.astype("<i4").tobytes(), part[some].astype("<f4").tobytes(), at.astype("<i4").tobytes(), own[at].astype("<f4").tobytes()))
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in SUMS.split(", ")])


def stepped(model: Model, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """parts: SUMS in the order of range.  The new weights of each range."""

    def update(of: int, expected: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        old = (model.class_weights, model.word_weights)[of // RANGES].reshape(RANGES, *expected.shape)[of % RANGES]
        new = old + STEP / FEATURES * np.log((seen + PRIOR) / (expected + PRIOR))
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([new.astype("<f4").tobytes()], pa.binary())], names=["range", "weights"])

    of = None
    for batch in parts:
        for r in batch.to_pylist():
            if r["range"] != of:
                if of is not None:
                    yield update(of, expected, seen)
                of = r["range"]
                rows, width = (model.class_weights, model.word_weights)[of // RANGES].shape
                expected, seen = np.zeros((rows // RANGES, width)), np.zeros((rows // RANGES, width))
            expected[np.frombuffer(r["rows"], "<i4")] += np.frombuffer(r["expected"], "<f4").reshape(-1, width)
            seen.ravel()[np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["seen"], "<f4")
    if of is not None:
        yield update(of, expected, seen)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (its hash) and c of all tokens of docs: (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def counted() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "c"])

        for batch in batches:
            for _, _, tokens, _ in tokens_of(batch.column("text")):
                held.append(tokens)
                many += len(tokens)
                if many >= COUNTED:
                    yield counted()
                    held, many = [], 0
        if many:
            yield counted()

    return docs.select("text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fresh_model(counts: DataFrame) -> Model:
    """counts: a written table (word, c).  The unigram model."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)  # a thousand at most
    least, many = None, 0
    for r in levels:
        many += r["count"]
        if many > TOP:
            break
        least = r["level"]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if least is None:
        return Model(*none, none, total["n"] or 0, total["v"])
    found = counts.filter(level >= least).toArrow()
    words, c = found.column("word").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.lexsort((words, -c))[: (CLASSES - 1) * WORDS]
    by_word = np.argsort(words)
    return Model(words[order], c[order], (words[by_word], c[by_word]), total["n"], total["v"])


def train(docs: DataFrame, model: Model, size: int) -> Model:
    """docs: (text, round).  size: bytes of all texts."""
    spark = docs.sparkSession
    tasks = max(1, -(-size // TRAIN_BYTES))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield sums(shared.value, (b.column("text") for b in batches))

        def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from stepped(shared.value, parts)

        with small_batches(spark, 200):
            parts = docs.filter(F.col("round") == turn).select("text").coalesce(tasks).mapInArrow(gather, SUMS)
            found = parts.repartition("range").sortWithinPartitions("range").mapInArrow(step, "range int, weights binary").collect()  # 2 * RANGES rows
        for r in found:
            weights = (model.class_weights, model.word_weights)[r["range"] // RANGES]
            part = weights.reshape(RANGES, -1, weights.shape[1])[r["range"] % RANGES]
            part[:] = np.frombuffer(r["weights"], "<f4").reshape(part.shape)
        shared.unpersist()
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null doc_id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs: (doc_id, text, held_out).  Per row its tokens, those that the top words hold, both scores as far as
    they are known from these, and the other words with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "words", "times"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        less, less_rare = own.unigram()
        for batch in batches:
            n = batch.num_rows
            tokens_n, known_n, base, model_score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            lists, ends, times = [], [np.zeros(1, np.int64)], []
            for first, many, tokens, rows in tokens_of(batch.column("text")):
                here = slice(first, first + many)
                c, known = own.counts(tokens)
                per = lambda values, which=rows: np.bincount(which, values, many)  # noqa: E731, B023
                log = np.log10(c + EXTRA)
                tokens_n[here], known_n[here] = per(None), np.bincount(rows[known], minlength=many)
                base[here] = per(np.where(known, log - less, 0.0))
                rare = known & (own.places(tokens) == (CLASSES - 1) * WORDS)
                model_score[here] = per(np.where(rare, log - less_rare, 0.0))
                for which, _, _, _, _, _, logp in own.batches(tokens, rows):
                    model_score[here] += np.bincount(rows[which], logp / np.log(10), many)
                # the other words of each row, once each
                word, row = tokens[~known], rows[~known]
                order = np.lexsort((word, row))
                word, row = word[order], row[order]
                begin = np.flatnonzero(np.append(True, (np.diff(word) != 0) | (np.diff(row) != 0))) if len(word) else np.zeros(0, np.int64)
                lists.append(word[begin].view(np.int64))
                times.append(np.diff(np.append(begin, len(word))))
                ends.append(ends[-1][-1] + np.cumsum(np.bincount(row[begin], minlength=many)))
            offsets = pa.array(np.concatenate(ends).astype(np.int32))
            words = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))
            often = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*times, np.zeros(0, np.int64)]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(tokens_n), pa.array(known_n), pa.array(base), pa.array(model_score), words, often], names=fields)

    return docs.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double, words array<long>, times array<long>")


def scores(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text).  Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    scratch = Scratch(docs.sparkSession)
    share = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 10) % ROUNDS
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), share.alias("round"))
    training = docs.filter(~F.col("held_out"))
    size = training.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    with small_batches(docs.sparkSession):
        counts = written(word_counts(training), "word-counts")
    model = train(training, fresh_model(counts), size)
    part = scored(docs.select("doc_id", "text", "held_out"), model)
    part = written(part.withColumn("row", F.monotonically_increasing_id()), "scored")

    # the words that aren't among the top ones meet their counts
    less, less_rare = model.unigram()
    least = int(model.top[1].min()) if len(model.top[1]) else None
    others = counts if least is None else counts.filter(F.col("c") < least)
    rest = part.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    rest = scratch.table(rest, "other-words")  # written, so that Spark splits a word of very many rows
    log = F.log10(F.coalesce("c", F.lit(0)) + EXTRA)
    rest = rest.join(others, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * (log - less)).alias("more_base"), F.sum(F.col("n") * (log - less_rare)).alias("more_model"))
    rest = written(rest, "of-other-words")
    scratch.drop("other-words")
    both = part.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model").join(rest, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return both.select("doc_id", "held_out", "n_tokens", plus("n_known", "more").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("model", "more_model").alias("score"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
