"""The batch run: all near duplicates of a corpus, what was left out on the way, and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pixkin.config import VECTOR, ScoringConfig
from pixkin.functions import report
from pixkin.operators.knn import candidate_pairs, knn_self
from pixkin.operators.pairs import score_pairs
from pixkin.operators.ranking import numbered, paged
from pixkin.sources.scratch import written

COUNTS = ("skipped_coarse", "skipped_missing", "checked", "matches")


def run_batch(vectors: DataFrame, features: DataFrame, config: ScoringConfig = VECTOR) -> tuple[DataFrame, dict[str, int]]:
    """vectors: (id, cls) of all songs; features: rows of those that have them.  The matches, written, and, from
    the same pass, how many neighbours lie below the coarse cut, how many pairs lack features of a side, how
    many were checked and how many reach the threshold.  A pair that the bound on its composite leaves
    out before its patches are met counts as checked."""
    near, paired, scored = (Observation(x) for x in ("neighbours", "pairs", "scored"))
    hits = knn_self(vectors, config.neighbours).observe(near, F.count_if(F.col("coarse") < config.coarse).alias("n"))
    known = features.select(F.col("id").alias("known"))
    pairs = candidate_pairs(hits, config.coarse)
    for side in ("id_a", "id_b"):
        pairs = pairs.join(known.withColumnRenamed("known", side).withColumn(f"has_{side}", F.lit(True)), side, "left")
    both = F.coalesce(F.col("has_id_a") & F.col("has_id_b"), F.lit(False))
    pairs = pairs.withColumn("both", both).observe(paired, F.count_if(~F.col("both")).alias("missing"), F.count_if("both").alias("checked"))
    pairs = written(pairs.filter("both").select("id_a", "id_b", "coarse"), "pairs")
    matches = written(score_pairs(pairs, features, config, "batch", config.threshold).observe(scored, F.count("*").alias("n")), "matches")
    found = (near.get["n"], paired.get["missing"], paired.get["checked"], scored.get["n"])
    return matches, dict(zip(COUNTS, found, strict=True))


def best_first(matches: DataFrame) -> DataFrame:
    """Adds the place by composite, then ids."""
    return numbered(matches, [F.desc("composite"), F.col("id_a"), F.col("id_b")])


def write_report(matches: DataFrame, folder: str, title: str = "Near duplicates", page_rows: int = 500) -> DataFrame:
    """matches: with id_a, id_b, composite, verdict and any of the scores, labels and grid matrix.  Tasks write the
    pages, best first: folder/html/page=N holds a page as one text file, folder/json the rows as JSON lines
    in order.  Returns a row a page: page, rows, best and worst composite."""
    placed = written(paged(best_first(matches), page_rows), "placed")
    pages = placed.agg(F.count("*").alias("rows"), F.max("composite").alias("best"), F.max("page").alias("pages")).first()
    head, tail = report.page_frame(title, pages["rows"], pages["best"])
    rows = placed.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", report.table_row(placed.columns).alias("html")))).alias("rows"))  # page_rows of them
    links = report.page_links(F.col("page"), pages["pages"] or 0)
    text = F.concat(F.lit(head), links, F.lit(report.TABLE_HEAD), F.array_join("rows.html", ""), F.lit(tail))
    rows.select("page", text.alias("value")).write.partitionBy("page").mode("overwrite").text(f"{folder}/html")
    placed.drop("page").repartitionByRange("place").sortWithinPartitions("place").write.mode("overwrite").json(f"{folder}/json")
    return placed.groupBy("page").agg(F.count("*").alias("rows"), F.max("composite").alias("best"), F.min("composite").alias("worst"))
