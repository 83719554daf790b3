"""Quality rules by weak supervision.

Rules over counts of a document vote good (+1), bad (-1) or abstain (0).  Expectation-maximisation
over the table of vote patterns (at most 3 ** rules rows, whatever the number of documents)
estimates how often each rule votes how on good and on bad documents, and a document is kept if its
posterior probability of being good is at least one half.  Only DataFrame functions are used; the
driver sees one row of sums an iteration.

Defined results: a null or empty text has no words, so it fails the base rule; a null doc_id is
judged like any other; repeated rows count as often as they occur; an empty table gives no rows; very
long texts are counted whole.  A column of the documents with the name of one that `judged` adds comes
back with "_" after its name; `good_documents` adds none and returns them as they were.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, free_name, written

#: Bits of a packed window that hold its position.
POSITION_BITS = 28
ITERATIONS = 12
SMOOTHING = 1.0
#: First guess: the chance of being good with no bad vote, and with one at least.
FIRST_GUESS = (0.95, 0.1)
#: Most documents count as good until the votes tell them apart.
LEAST_PRIOR = 0.6

#: name: (bad if, good if) over the counts; whole numbers only, so any engine decides alike.
RULES = {
    "symbols": ("10 * n_symbols > 3 * n_words", "50 * n_symbols <= n_words"),
    "repeats": ("100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    "lines": ("n_dup_lines >= 2 AND 3 * n_dup_lines > n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    "capitals": ("2 * n_upper > word_chars", "8 * n_upper <= word_chars"),
    "shouting": ("5 * n_shouts > n_words", "n_shouts = 0"),
    "word_length": ("word_chars > 12 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 8 * n_words"),
    "sentences": ("n_stops * 300 < n_words", "n_stops * 40 >= n_words"),
}
VOTES = (-1, 0, 1)
#: Documents that fail this are out whatever the votes; they teach the rules nothing either.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _window_at(words: Column, i: Column, seed: int) -> Column:
    """Hash of the three words from i on."""
    return F.xxhash64(F.lit(seed), F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _packed(window: Column, i: Column) -> Column:
    """The window's hash in the high bits, its position in the low ones."""
    return window.bitwiseAND(F.lit(~((1 << POSITION_BITS) - 1))).bitwiseOR(i.cast("long"))


def _shared(packed: str) -> Column:
    """Of sorted packed windows, those whose hash another one has."""
    c = F.col(packed)
    same = lambda x, y: F.shiftright(x.bitwiseXOR(y), POSITION_BITS) == 0
    return F.filter(c, lambda x, i: same(x, F.get(c, i - 1)) | same(x, F.get(c, i + 1)))


def text_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts that the rules look at.  Repeated windows are found inside the row: if their
    hashes aren't all distinct, they are packed with their positions, sorted and compared with their
    neighbours, twice with independent hashes (72 bits)."""
    none = F.array().cast("array<long>")
    text = F.col("_text")
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    low = lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    steps = (
        docs.withColumn("_text", F.coalesce("text", F.lit("")))
        .withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
        .withColumn("_lines", F.filter(F.split(text, "\n"), has_word))
        .withColumn("_marks", F.regexp_replace(text, r"[^#*$%&|<>A-Z!.?]+", ""))
        .withColumn("n_words", F.size("_words").cast("long"))
    )
    starts = F.sequence(F.lit(0), F.size("_words") - 3)
    steps = steps.withColumn("_windows", F.when(F.col("n_words") >= 3, F.transform(starts, lambda i: _window_at(F.col("_words"), i, 1))).otherwise(none))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    steps = steps.withColumn("_first", F.when(repeats, F.sort_array(F.transform("_windows", _packed))).otherwise(none))
    steps = steps.withColumn("_first", _shared("_first"))
    again = lambda x: _packed(_window_at(F.col("_words"), low(x).cast("int"), 2), low(x))
    steps = steps.withColumn("_second", F.sort_array(F.transform("_first", again)))
    steps = steps.withColumn("_second", _shared("_second"))
    steps = steps.withColumn("_starts", F.sort_array(F.transform("_second", low)))
    reach = F.transform("_starts", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(F.col("_starts"), i + 1) - p, F.lit(3).cast("long"))))
    return steps.select(
        *docs.columns,
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count("#*$%&|<>").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _count("!").alias("n_shouts"),
        _count(".!?").alias("n_stops"),
    )


def _count(characters: str) -> Column:
    return (F.length("_marks") - F.length(F.translate("_marks", characters, ""))).cast("long")


def with_votes(counts: DataFrame) -> DataFrame:
    """Adds votes: an array of -1, 0 or 1 in the order of RULES."""
    return counts.withColumn("votes", F.array(*[F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for bad, good in RULES.values()]))


def _posterior(prior: float, table: list[list[tuple[float, float]]]) -> Column:
    """table: per rule and vote, its probability on good and on bad documents."""
    evidence = F.array(*[F.lit(math.log(good / bad)) for rule in table for good, bad in rule])
    each = F.transform("votes", lambda v, i: F.get(evidence, i * len(VOTES) + v + 1))
    return 1 / (1 + F.exp(-F.aggregate(each, F.lit(math.log(prior / (1 - prior))), lambda a, x: a + x)))


def fit_rules(patterns: DataFrame, iterations: int = ITERATIONS) -> tuple[float, list]:
    """patterns: a small table of votes and their number n.  The share of good documents and the
    vote probabilities, by expectation-maximisation.  An iteration returns a row a rule and vote."""
    guess = F.when(F.array_min("votes") == -1, F.lit(FIRST_GUESS[1])).otherwise(F.lit(FIRST_GUESS[0]))
    prior, table = 0.5, [[(1 / 3, 1 / 3)] * len(VOTES)] * len(RULES)
    for _ in range(iterations):
        rows = patterns.select("n", (F.col("n") * guess).alias("good"), F.posexplode("votes").alias("rule", "vote"))
        sums = {(r["rule"], r["vote"]): (r["good"], r["n"] - r["good"]) for r in rows.groupBy("rule", "vote").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()}
        if not sums:
            break
        good, bad = (sum(sums.get((0, v), (0, 0))[k] for v in VOTES) for k in (0, 1))
        prior = max(LEAST_PRIOR, (good + SMOOTHING) / (good + bad + 2 * SMOOTHING))
        parts = [[sums.get((i, v), (0, 0)) for v in VOTES] for i in range(len(RULES))]
        table = [[((g + SMOOTHING) / (good + 3 * SMOOTHING), (b + SMOOTHING) / (bad + 3 * SMOOTHING)) for g, b in rule] for rule in parts]
        guess = _posterior(prior, table)
    return prior, table


#: Columns that `judged` adds.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_stops"]
ADDED = [*COUNTS, "votes", "base_failed", "quality", "kept"]


def _judged(docs: DataFrame) -> DataFrame:
    """docs: (row, text).  row with ADDED; what is judged is written once, with the votes."""
    votes = written(with_votes(text_counts(docs)).drop("text"), "quality-votes")
    failed = F.expr(BASE_FAILED)
    patterns = votes.filter(~failed).groupBy("votes").agg(F.count("*").alias("n")).coalesce(1)
    prior, table = fit_rules(written(patterns, "quality-patterns"))
    return (
        votes.withColumn("base_failed", failed)
        .withColumn("quality", _posterior(prior, table))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    )


def judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs: any columns, among them text.  The columns named in keep (None: all) with ADDED."""
    names = docs.columns if keep is None else keep
    rows = _judged(docs.select(F.struct(*names).alias("row"), "text"))
    taken, out = rows.select(*ADDED), []
    for c in names:
        out.append(F.col("row")[c].alias(free_name(c, taken)))
    return rows.select(*out, *ADDED)


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    return _judged(docs.select(F.struct(*docs.columns).alias("row"), "text")).filter("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 4).alias("quality"))


def _sql() -> str:
    names = list(RULES)
    vote = ",\n".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{n}" for n, (bad, good) in RULES.items())
    cols = ", ".join(f"v_{n}" for n in names)
    s = SMOOTHING
    sums = ["sum(n * g) AS good", "sum(n) AS total"]
    for n in names:
        for k, v in enumerate(VOTES):
            sums += [f"coalesce(sum(n * g) FILTER (v_{n} = {v}), 0) AS {n}_{k}_g", f"coalesce(sum(n * (1 - g)) FILTER (v_{n} = {v}), 0) AS {n}_{k}_b"]
    prior = f"greatest({LEAST_PRIOR}, (s.good + {s}) / (s.total + {2 * s}))"
    logit = f"ln({prior} / (1 - {prior}))"
    for n in names:
        for k, v in enumerate(VOTES):
            logit += f"\n + CASE WHEN v_{n} = {v} THEN ln((s.{n}_{k}_g + {s}) / (s.good + {3 * s}) / ((s.{n}_{k}_b + {s}) / (s.total - s.good + {3 * s}))) ELSE 0 END"
    steps = [f"g0 AS (SELECT *, CASE WHEN least({cols}) = -1 THEN {FIRST_GUESS[1]} ELSE {FIRST_GUESS[0]} END AS g FROM patterns)"]
    for i in range(ITERATIONS):
        steps.append(f"s{i} AS MATERIALIZED (SELECT {', '.join(sums)} FROM g{i})")
        if i + 1 < ITERATIONS:
            steps.append(f"g{i + 1} AS MATERIALIZED (SELECT p.*, 1 / (1 + exp(-({logit}))) AS g FROM patterns p, s{i} s)")
    g = f"(1 / (1 + exp(-({logit}))))"
    windows = "list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
pos AS (SELECT r, unnest({windows}) AS win, unnest(range(len(w) - 2)) AS p FROM t WHERE len(w) >= 3),
rep AS (SELECT r, p FROM pos QUALIFY count(*) OVER (PARTITION BY r, win) >= 2),
cover AS (SELECT r, sum(d)::BIGINT AS n_repeat_words FROM (
   SELECT r, least(3, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 3)) AS d FROM rep) GROUP BY r),
c AS (SELECT t.r, doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(l)::BIGINT AS n_lines,
         len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper, len(regexp_extract_all(text, '!'))::BIGINT AS n_shouts,
         len(regexp_extract_all(text, '[.!?]'))::BIGINT AS n_stops
      FROM t LEFT JOIN cover USING (r)),
v AS MATERIALIZED (SELECT *, {vote} FROM c),
patterns AS MATERIALIZED (SELECT {cols}, count(*) AS n FROM v WHERE NOT ({BASE_FAILED}) GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {BASE_FAILED} AS base_failed, NOT ({BASE_FAILED}) AND {g} >= 0.5 AS kept, round({g}, 4) AS quality
FROM v, s{ITERATIONS - 1} s
"""


OP1_SQL = _sql()
