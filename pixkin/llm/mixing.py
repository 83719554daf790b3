"""Mixing sources to target weights.

Every document gets a hash-random key.  Within each source documents are sorted by that key in
ranges (so a source with a third of all rows is spread over many tasks), the ranges' word counts
are summed up and each source is cut at its exact budget; a budget beyond the source's size repeats
whole epochs first.  Only DataFrame functions are used.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
null doc_id takes part like any other, its key drawn from its text; repeated rows are separate documents
that share a key, so their sizes decide their order; an empty table gives no rows; very long texts are
documents like others.  Other columns are ignored by `mix_plan`, and carried along, whatever their names,
by `mixed_documents`.  Targets are worked out in one task over a row a source, of which a corpus has
thousands at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, free_name, running_sum, source_key, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hex digits of the key that name a range: 4096 ranges a source.
RANGE_DIGITS = 3
#: Groups that rows alike are numbered in.
SALTS = 256


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: (src, source_size).  Adds target: the sources share the total by their weights, given
    in turn in the order of src; none gets more than max_epochs times its size, and what exceeds
    that goes to the others by weight.  The table has a row a source, so it is small."""
    by_src = Window.partitionBy(F.lit(0)).orderBy("src")
    turn = F.pmod(F.row_number().over(by_src) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    filled = Window.partitionBy(F.lit(0)).orderBy("ratio", "src")
    ahead = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0))) / F.sum(
        "weight"
    ).over(onward)
    free = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("free", F.coalesce(F.first(free, ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
        .select("src", "source_size", F.least(F.col("cap").cast("double"), F.col("free") * F.col("weight")).alias("target"))
    )


def _placed(docs: DataFrame, seed: str, keep: list) -> DataFrame:
    draw = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null/"), F.md5(F.coalesce("text", F.lit("")))))))
    narrow = docs.select(
        "doc_id",
        *keep,
        source_key().alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        draw.alias("draw"),
        F.substring(draw, 1, RANGE_DIGITS).alias("range"),
    )
    return written(narrow, "mix-sizes")


def mix_plan(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "", keep: tuple = ()
) -> DataFrame:
    """docs: (doc_id, text, source).  Per document: size in words, its source's size and target,
    `epochs` whole repeats, `rest` words of the last, cut repeat and taken = epochs * size + rest."""
    narrow = _placed(docs, seed, list(keep))
    order = ["draw", "doc_id", "size", *[c for c in narrow.columns if c.startswith("_row")]]
    placed = running_sum(narrow, ["src"], "range", order, "size", "before")
    sizes = narrow.groupBy("src").agg(F.sum("size").alias("source_size"))
    budget = F.round("target").cast("long")
    targets = (
        source_targets(sizes, weights, max_epochs)
        .withColumn("budget", budget)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("cut", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - F.col("before")))
    return placed.join(targets, "src").withColumn("rest", rest).withColumn("taken", F.col("epochs") * F.col("size") + F.col("rest"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents the mix takes, as often as it takes them.  Here documents stay whole: the one
    at a source's cut is taken when at least half of it lies inside the budget.  Documents without
    words are worth nothing to a budget and are kept once."""
    text_key = F.xxhash64("text", "source")
    plan = mix_plan(docs.select("doc_id", "text", "source"), weights, max_epochs, keep=(text_key.alias("_row"),))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs") + (F.col("rest") * 2 >= F.col("size")).cast("long"))
    # rows alike in doc_id, text and source are interchangeable: their copies add up
    key, who, mine, total, rows, line, salt, rank, n = (free_name(x, docs) for x in ("mix_key", "mix_who", "mix_row", "mix_copies", "mix_rows", "mix_line", "mix_salt", "mix_rank", "mix_n"))
    plan = plan.groupBy(F.col("doc_id").alias(who), F.col("_row").alias(key)).agg(F.sum(copies).alias(total), F.count("*").alias(rows))
    plan = written(plan, "mix-copies")
    left = docs.withColumn(mine, text_key)
    same = F.col("doc_id").eqNullSafe(F.col(who)) & (F.col(mine) == F.col(key))
    out = left.join(plan.filter(F.col(rows) == 1), same).select(*docs.columns, F.col(total).alias(n))
    if not plan.filter(F.col(rows) > 1).isEmpty():
        # n of them are numbered and given their share each; what doesn't divide goes to the first by one more copy
        alike = left.join(plan.filter(F.col(rows) > 1), same).withColumn(who, source_key(F.col("doc_id").cast("string"))).withColumn(line, F.monotonically_increasing_id())
        alike = written(alike.withColumn(salt, F.pmod(line, F.lit(SALTS)).cast("int")), "mix-alike")
        ranked = running_sum(alike, [who, mine], salt, [line], None, rank)
        more = (F.col(rank) < F.col(total) % F.col(rows)).cast("long")
        out = out.unionByName(ranked.select(*docs.columns, (F.floor(F.col(total) / F.col(rows)) + more).alias(n)))
    return out.filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null/' || md5(coalesce(text, '')))) AS draw
  FROM documents),
sources AS (
  SELECT src, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::BIGINT] AS weight
  FROM sized GROUP BY src),
levels AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size) / weight AS ratio,
         ((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER before, 0))
           / sum(weight) OVER onward AS level
  FROM sources
  WINDOW before AS (ORDER BY (3 * source_size) / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY (3 * source_size) / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT src, source_size,
         least(cap::DOUBLE, coalesce((SELECT arg_min(level, (ratio, src)) FROM levels WHERE level <= ratio), 0) * weight) AS target
  FROM levels),
cuts AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs
  FROM targets),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY draw, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM placed JOIN cuts USING (src)
"""
