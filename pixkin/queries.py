"""The registered queries of the near-duplicate engine and their SQL.

Vectors of `embeddings` stand for images (label: level), and other tables for the songs' metadata
and the change feed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixkin.config import VECTOR, ScoringConfig
from pixkin.functions import ids, imaging, records, transform
from pixkin.functions import scores as S
from pixkin.functions.signatures import packed, unpacked
from pixkin.operators import features as image_features
from pixkin.operators import knn, matching, pairs, radius
from pixkin.operators.cells import usable
from pixkin.operators.embedding import Provider
from pixkin.operators.vector_proxy import vector_features
from pixkin.plans import batch, duplicates, ingest, live
from pixkin.service import DESCRIPTIONS
from pixkin.sources.feature_table import FeatureTable, ImageCache
from pixkin.sources.scratch import shared_folder, written
from pixkin.sources.store import IndexStore
from pixkin.streaming.feed import follow, latest_changes
from pixkin.streaming.progress import Progress

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table, as the joins of a pair's sides read it several times."""
    return written(vector_features(table(spark, sf_dir, "embeddings")), "features")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("cls"))


def places(df: DataFrame, *columns: str, n: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


#: Vectors that can be searched: as long as most, without null or non-finite components.
V = """v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: isfinite(y))) = 64)"""
KNN = f"""{V}, n AS (SELECT a.id AS id_a, b.id AS id_b, list_inner_product(a.x, b.x) AS coarse,
  row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.x, b.x) DESC, b.id) AS rank
  FROM v a JOIN v b ON a.id <> b.id QUALIFY rank <= 20)"""
PAIRS = f"""{KNN}, c AS (SELECT least(id_a, id_b) AS id_a, greatest(id_a, id_b) AS id_b, max(coarse) AS coarse FROM n WHERE coarse >= 0.30 GROUP BY ALL)"""
FEATURES = """m AS (SELECT *, list_median(x) AS med, list_avg(x) AS mean,
    list_transform(range(16), lambda i: list_avg(x[i * 4 + 1 : i * 4 + 4])) AS means,
    list_transform(range(16), lambda i: x[i * 4 + 1 : i * 4 + 4]) AS blocks,
    [list_inner_product(x[1:16], x[1:16]), list_inner_product(x[17:32], x[17:32]), list_inner_product(x[33:64], x[33:64])] AS e FROM v),
  f AS (SELECT id, x, list_transform(x, lambda y: (y > med)::INT) AS phash, list_transform(x, lambda y: (y > mean)::INT) AS ahash,
    list_transform(range(64), lambda i: (x[(i + 1) % 64 + 1] > x[i + 1])::INT) AS dhash,
    list_transform(range(64), lambda i: (means[i // 4 + 1] > list_median(means))::INT) AS whash,
    list_transform(e, lambda y: y / (list_sum(e) + 1e-9)) AS bands,
    list_transform(blocks, lambda b: list_transform(b, lambda y: y / sqrt(list_inner_product(b, b)))) AS patches FROM m)"""


def _bits(h: str) -> str:
    return f"(1 - list_sum(list_transform(range(64), lambda i: (a.{h}[i + 1] <> b.{h}[i + 1])::INT)) / 64.0)"


STAGES = f"""s0 AS (SELECT c.*, 0.35 * {_bits("phash")} + 0.35 * {_bits("dhash")} + 0.15 * {_bits("ahash")} + 0.15 * {_bits("whash")} AS hash_ensemble,
    greatest(0, least(1, list_inner_product(a.bands, b.bands) / (sqrt(list_inner_product(a.bands, a.bands)) * sqrt(list_inner_product(b.bands, b.bands)) + 1e-9))) AS dct_spectrum,
    list_transform(range(16), lambda i: 1 - ((a.phash[i*4+1] <> b.phash[i*4+1])::INT + (a.phash[i*4+2] <> b.phash[i*4+2])::INT + (a.phash[i*4+3] <> b.phash[i*4+3])::INT + (a.phash[i*4+4] <> b.phash[i*4+4])::INT) / 4.0::DOUBLE) AS cells,
    greatest(0, least(1, list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))))) AS global_semantic,
    greatest(0, least(1, list_avg(list_transform(range(16), lambda i: list_max(list_transform(range(16), lambda j:
      list_inner_product(a.patches[i + 1], b.patches[j + 1]) * exp(-((i // 4 - j // 4) * (i // 4 - j // 4) + (i % 4 - j % 4) * (i % 4 - j % 4)) / (2 * (4.0 / 3) * (4.0 / 3))))))))) AS patch_spatial
    FROM c JOIN f a ON a.id = c.id_a JOIN f b ON b.id = c.id_b),
  s1 AS (SELECT *, list_avg(cells) AS sector_grid, list_min(cells) AS grid_min_cell, list_position(cells, list_min(cells)) - 1 AS coldest_cell, list_var_pop(cells) AS grid_variance FROM s0),
  s AS (SELECT *, 0.25 * hash_ensemble + 0.30 * sector_grid + 0.05 * dct_spectrum + 0.20 * global_semantic AS cheap,
     greatest(0, least(1, 0.25 * hash_ensemble + 0.30 * sector_grid + 0.05 * dct_spectrum + 0.20 * global_semantic + 0.20 * patch_spatial - 1.2 * grid_variance)) AS batch FROM s1)"""
SCORED = f"WITH {PAIRS}, {FEATURES}, {STAGES}"
VERDICT = "CASE WHEN {0} >= 0.97 THEN 'EXACT' WHEN {0} >= 0.88 THEN 'MICRO_VARIANT' WHEN {0} >= 0.70 THEN 'MODIFIED_VARIANT' WHEN {0} >= 0.50 THEN 'DISTANT' ELSE 'DISTINCT' END"


@query("""WITH k AS (SELECT doc_id, sha256(text) AS key FROM documents WHERE text IS NOT NULL), f AS (SELECT key, min(doc_id) AS id_a FROM k GROUP BY key)
SELECT id_a, doc_id AS id_b FROM k JOIN f USING (key) WHERE doc_id > id_a""")
def exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-equal items: every copy with the first of its kind (a link a copy, not all pairs)."""
    keyed = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("key"))
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("id_a"))
    return keyed.join(first, "key").filter("doc_id > id_a").select("id_a", F.col("doc_id").alias("id_b"))


@query("SELECT doc_id, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT & 9223372036854775807)::BIGINT AS vec_id FROM documents")
def stable_vec_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.stable_vec_id(F.col("doc_id")).alias("vec_id"))


@query("SELECT page_id, url FROM pages WHERE url IS NOT NULL AND url <> '' AND regexp_matches(url, '^https?://')")
def eligible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(ids.eligible(F.col("url")) & ids.valid_url(F.col("url"))).select("page_id", "url")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def indexed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT vec_id, label FROM embeddings WHERE list_has_any([label], [0, 1, 2]) AND vec_id <> 7")
def level_filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return rows.filter(ids.any_level(F.array("label"), [0, 1, 2]) & (F.col("vec_id") != 7))


@query(f"WITH {KNN} SELECT id_a, id_b, round(coarse, 9) AS coarse, rank FROM n")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(knn.knn_self(vectors(spark, sf_dir), 20), "coarse")


def _restricted_each(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return places(knn.restricted_each(rows.filter("id % 20 = 0"), rows, rows.filter("label IN (0, 1, 2)").select("id"), 20, mode), "coarse")


_EACH = f"""{V}, r AS (SELECT a.id AS id_a, b.id AS id_b, b.label, list_inner_product(a.x, b.x) AS coarse,
  row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.x, b.x) DESC, b.id) AS place FROM v a, v b WHERE a.id % 20 = 0),
w AS (SELECT id_a, greatest(count(*) FILTER (label IN (0, 1, 2) AND id_b <> id_a), 80) AS wide FROM r GROUP BY id_a),
n AS (SELECT id_a, id_b, coarse, row_number() OVER (PARTITION BY id_a ORDER BY coarse DESC, id_b) AS rank
  FROM r JOIN w USING (id_a) WHERE place <= wide AND label IN (0, 1, 2) AND id_b <> id_a QUALIFY rank <= 20)"""


@query(f"WITH {_EACH} SELECT id_a, id_b, round(coarse, 9) AS coarse, rank FROM n")
def knn_restricted_postfilter_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all allowed rows but itself."""
    return _restricted_each(spark, sf_dir, "postfilter")


@query(f"WITH {_EACH.replace('place <= wide AND ', '')} SELECT id_a, id_b, round(coarse, 9) AS coarse, rank FROM n")
def knn_restricted_prefilter_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restricted_each(spark, sf_dir, "prefilter")


@query(f"WITH {PAIRS} SELECT id_a, id_b, round(coarse, 9) AS coarse FROM c")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(knn.candidate_pairs(knn.knn_self(vectors(spark, sf_dir), 20), VECTOR.coarse), "coarse")


@query(f"WITH {V} SELECT a.id AS id_a, b.id AS id_b, round(list_inner_product(a.x, b.x), 9) AS coarse FROM v a JOIN v b ON a.id < b.id WHERE list_inner_product(a.x, b.x) >= 0.30")
def all_pairs_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(knn.pairs_above(vectors(spark, sf_dir), 0.30), "coarse")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.candidate_pairs(knn.knn_self(vectors(spark, sf_dir), VECTOR.neighbours), VECTOR.coarse)


def _cheap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.cheap_scores(_pairs(spark, sf_dir), features(spark, sf_dir), VECTOR)


def _scored(spark: SparkSession, sf_dir: str, profile: str = "batch") -> DataFrame:
    return pairs.score_pairs(_pairs(spark, sf_dir), features(spark, sf_dir), VECTOR, profile)


@query(f"{SCORED} SELECT id_a, id_b, round(hash_ensemble, 9) AS hash_ensemble FROM s")
def hash_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(_cheap(spark, sf_dir).select("id_a", "id_b", "hash_ensemble"), "hash_ensemble")


@query(f"{SCORED} SELECT id_a, id_b, round(dct_spectrum, 9) AS dct_spectrum FROM s")
def dct_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(_cheap(spark, sf_dir).select("id_a", "id_b", "dct_spectrum"), "dct_spectrum")


@query(f"{SCORED} SELECT id_a, id_b, round(sector_grid, 9) AS sector_grid, round(grid_min_cell, 9) AS grid_min_cell, round(grid_variance, 9) AS grid_variance, coldest_cell FROM s")
def sector_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cheap(spark, sf_dir).select("id_a", "id_b", "sector_grid", "grid_min_cell", "grid_variance", "coldest_cell")
    return places(df, "sector_grid", "grid_min_cell", "grid_variance")


@query(f"{SCORED} SELECT id_a, id_b, round(patch_spatial, 9) AS patch_spatial FROM s")
def patch_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(_scored(spark, sf_dir).select("id_a", "id_b", "patch_spatial"), "patch_spatial")


_OUT = ("id_a", "id_b", "composite", "verdict")


@query(f"{SCORED} SELECT id_a, id_b, round(batch, 9) AS composite, {VERDICT.format('batch')} AS verdict FROM s")
def composite_verdict_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(_scored(spark, sf_dir).select(*_OUT), "composite")


_VETO = "CASE WHEN sector_grid < 0.65 THEN least(batch, 1.1 * sector_grid) ELSE batch END"


@query(f"{SCORED} SELECT id_a, id_b, round({_VETO}, 9) AS composite, {VERDICT.format(_VETO)} AS verdict FROM s")
def composite_verdict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(_scored(spark, sf_dir, "query").select(*_OUT), "composite")


@query(f"{SCORED} SELECT id_a, id_b, round(batch, 9) AS composite, {VERDICT.format('batch')} AS verdict, round(coarse, 9) AS coarse FROM s WHERE batch >= 0.5")
def find_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(duplicates.find_duplicates(features(spark, sf_dir)).select(*_OUT, "coarse"), "composite", "coarse")


@query(f"{SCORED} SELECT id_a, id_b, round(cheap + 0.20 - 1.2 * grid_variance, 9) AS bound FROM s WHERE cheap + 0.20 - 1.2 * grid_variance >= 0.55")
def prune_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"hash": F.col("hash_ensemble"), "grid": F.col("sector_grid"), "dct": F.col("dct_spectrum"), "global": F.col("global_semantic")}
    bound = S.upper_bound(named, F.col("grid_variance"), VECTOR)
    return places(_cheap(spark, sf_dir).withColumn("bound", bound).filter("bound >= 0.55").select("id_a", "id_b", "bound"), "bound")


@query(f"""{SCORED} SELECT id_a, id_b, round(batch, 9) AS composite FROM s WHERE batch >= 0.5
QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY batch DESC, coarse DESC, id_b) = 1""")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(duplicates.best_match(duplicates.find_duplicates(features(spark, sf_dir))).select("id_a", "id_b", "composite"), "composite")


@query(f"""{SCORED} SELECT id_a, id_b, coalesce(nullif(a.source, ''), nullif(a.lang, ''), id_a::VARCHAR) AS label_a,
coalesce(nullif(b.source, ''), nullif(b.lang, ''), id_b::VARCHAR) AS label_b, round(batch, 9) AS composite
FROM s LEFT JOIN documents a ON a.doc_id = id_a LEFT JOIN documents b ON b.doc_id = id_b WHERE batch >= 0.5""")
def match_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("song_id"), F.col("source").alias("song_name"), F.col("lang").alias("name"))
    out = duplicates.with_metadata(duplicates.find_duplicates(features(spark, sf_dir)), songs)
    return places(out.select("id_a", "id_b", "label_a", "label_b", "composite"), "composite")


#: DuckDB's levenshtein counts bytes, so each character beyond ASCII is first replaced by a control character
#: of its own: there are fewer of them in `benchmark` than control characters.
_TEXTS = """WITH c AS (SELECT string_agg(c, '' ORDER BY c) AS beyond FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark) WHERE ascii(c) > 127),
k AS (SELECT list_aggregate(list_transform(range(1, 9), lambda i: chr(i::INT)) || list_transform(range(14, 28), lambda i: chr(i::INT)), 'string_agg', '') AS control),
b AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS next, row_number() OVER (ORDER BY item_id DESC) AS n FROM benchmark),
s AS (SELECT item_id, trim(coalesce(text, '')) AS x, trim(coalesce(next, '')) AS y FROM b WHERE n > 1),
t AS (SELECT item_id, translate(x, coalesce(beyond, ''), control) AS a, translate(y, coalesce(beyond, ''), control) AS b FROM s, c, k),
r AS (SELECT item_id, CASE WHEN length(a) = 0 AND length(b) = 0 THEN 1.0::DOUBLE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END AS ratio FROM t)"""


def in_turn(rows: DataFrame, ranges: int = 64) -> DataFrame:
    """rows: (item_id, text).  Every row but the last with the next one's text, in the order of item_id.
    Rows are numbered range by range of ids, so that no task has to sort them all."""
    cuts = rows.agg(F.percentile_approx("item_id", [i / ranges for i in range(1, ranges)])).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c < F.col("item_id")))
    rows = rows.select("item_id", "text", part.alias("part"))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row a range
    base = counts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("base"))
    number = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("item_id", "text"))
    rows = rows.join(F.broadcast(base), "part").select("item_id", "text", number.alias("number"))
    return rows.join(rows.select((F.col("number") - 1).alias("number"), F.col("text").alias("next")), "number").select("item_id", "text", "next")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_turn(table(spark, sf_dir, "benchmark"))
    return rows.select("item_id", S.text_similarity(F.col("text"), F.col("next")).alias("ratio"))


@query(f"{_TEXTS} SELECT item_id, round(ratio, 9) AS ratio FROM r")
def levenshtein_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(_texts(spark, sf_dir), "ratio")


@query(f"{_TEXTS} SELECT item_id, round(CASE WHEN 1 - ratio > 0.3 THEN greatest(0, 0.9 - 0.15 * (1 - ratio)) ELSE 0.9 END, 9) AS composite FROM r")
def ocr_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _texts(spark, sf_dir).select("item_id", S.ocr_penalised(F.lit(0.9), F.col("ratio"), VECTOR).alias("composite"))
    return places(df, "composite")


@query(f"""{SCORED}, k AS (SELECT id_a, id_b, hash_ensemble FROM s UNION ALL SELECT id, id, 1.0 FROM f)
SELECT id_a, id_b, CASE WHEN hash_ensemble >= 0.99 THEN 'high' WHEN hash_ensemble <= 0.05 THEN 'low' ELSE 'full' END AS branch FROM k""")
def short_circuit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stages a pair still needs, with every row against itself too."""
    own = features(spark, sf_dir)
    pair = _pairs(spark, sf_dir).select("id_a", "id_b").unionByName(own.select(F.col("id").alias("id_a"), F.col("id").alias("id_b")))
    h = F.col("hash_ensemble")
    branch = F.when(h >= VECTOR.short_high - 1e-12, "high").when(h <= VECTOR.short_low, "low").otherwise("full")
    return pairs.cheap_scores(pair, own, VECTOR).select("id_a", "id_b", branch.alias("branch"))


_H = """h AS (SELECT vec_id, 1 + 3 * embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, 2 * embedding[3]::DOUBLE AS c, 1 + 3 * embedding[4]::DOUBLE AS d, vec_id % 40 AS inliers FROM embeddings),
p AS (SELECT vec_id, inliers, (sqrt(a * a + c * c) + sqrt(b * b + d * d)) / 2 AS scale, degrees(atan2(c, a)) AS rotation FROM h)"""


@query(f"""WITH {_H} SELECT vec_id, round(scale, 9) AS scale, round(rotation, 9) AS rotation,
CASE WHEN inliers < 12 THEN 'few_inliers' WHEN scale < 0.4 OR scale > 2.5 THEN 'scale' WHEN abs(rotation) > 30 THEN 'rotation' ELSE 'applied' END AS reason,
CASE WHEN scale > 1.005 THEN 'zoomed in' WHEN scale < 0.995 THEN 'zoomed out' ELSE 'identical' END AS zoom FROM p""")
def homography_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    scale, rotation = S.homography_parts(1 + 3 * F.get("e", F.lit(0)), F.get("e", F.lit(1)), 2 * F.get("e", F.lit(2)), 1 + 3 * F.get("e", F.lit(3)))
    rows = rows.withColumn("scale", scale).withColumn("rotation", rotation)
    reason = S.alignment_reason(F.col("vec_id") % 40, F.col("scale"), F.col("rotation"), VECTOR)
    return places(rows.select("vec_id", "scale", "rotation", reason.alias("reason"), S.zoom_label(F.col("scale")).alias("zoom")), "scale", "rotation")


@query(f"""WITH {V}, {FEATURES}, d AS (SELECT a.id AS id_a, b.id AS id_b, list_sum(list_transform(range(64), lambda i: (a.phash[i + 1] <> b.phash[i + 1])::INT)) AS d FROM f a JOIN f b ON a.id <> b.id),
w AS (SELECT id_a, id_b, d AS d1, lead(d) OVER (PARTITION BY id_a ORDER BY d, id_b) AS d2, row_number() OVER (PARTITION BY id_a ORDER BY d, id_b) AS n FROM d)
SELECT id_a, id_b, d1::BIGINT AS d1, d2::BIGINT AS d2, d1 < 0.75 * d2 AS good FROM w WHERE n = 1""")
def ratio_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each descriptor's two nearest others by differing bits.  As vectors of 1 and -1, fewer
    differing bits are a larger inner product, so this is a nearest-neighbour search for two."""
    rows = features(spark, sf_dir).select("id", F.transform(unpacked(F.col("phash")), lambda b: (2 * b - 1).cast("double")).alias("cls"))
    near = knn.knn_self(rows, 2).withColumn("d", ((64 - F.col("coarse")) / 2).cast("long"))
    return near.groupBy("id_a").agg(F.min_by("id_b", "rank").alias("id_b"), F.min_by("d", "rank").alias("d1"), F.max_by("d", "rank").alias("d2")).withColumn("good", F.col("d1") < VECTOR.ratio * F.col("d2"))


@query(f"""WITH {V}, {FEATURES}, h AS (SELECT id, list_transform(range(16), lambda i: whash[i * 4 + 1]) AS h FROM f), c AS (SELECT h, min(id) AS id FROM h GROUP BY h),
d AS (SELECT a.id AS id_a, b.id AS id_b, list_sum(list_transform(range(16), lambda i: (a.h[i + 1] <> b.h[i + 1])::INT))::BIGINT AS apart FROM c a JOIN c b ON a.id < b.id)
SELECT * FROM d WHERE apart <= 2""")
def hash_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct block hashes (16 bits) that differ in at most two, each by the first row that has it."""
    blocks = transform.let(F.get("whash", F.lit(0)), lambda w: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.getbit(w, i * 4)))
    classes = radius.signature_classes(features(spark, sf_dir).select("id", packed(blocks).alias("signature")))
    return radius.within_radius(classes, 16, 2)


@query(f"""WITH {V}, {FEATURES}, k AS (SELECT id // 8 AS image, id % 8 AS point, phash FROM f), n AS (SELECT DISTINCT image FROM k),
d AS (SELECT x.image AS id_a, y.image AS id_b, x.point AS point_a, y.point AS point_b, list_sum(list_transform(range(64), lambda i: (x.phash[i + 1] <> y.phash[i + 1])::INT))::BIGINT AS d
  FROM k x JOIN k y ON y.image BETWEEN x.image + 1 AND x.image + 3),
w AS (SELECT *, lead(d) OVER p AS d2, row_number() OVER p AS n FROM d WINDOW p AS (PARTITION BY id_a, id_b, point_b ORDER BY d, point_a))
SELECT id_a, id_b, point_a, point_b, d AS d1, d2, d < 0.75 * d2 AS good FROM w WHERE n = 1 AND d2 IS NOT NULL""")
def descriptor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors in turn are an image's descriptors; each image is matched with the next three."""
    own = features(spark, sf_dir).select(F.expr("id div 8").alias("id"), (F.col("id") % 8).alias("point"), F.col("phash").alias("descriptor"))
    image = own.select("id").distinct()
    pair = image.select(F.col("id").alias("id_a"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 3)).alias("id_b")).join(image.withColumnRenamed("id", "id_b"), "id_b", "left_semi")
    return matching.descriptor_matches(pair, own, 64, VECTOR.ratio)


@query(f"{SCORED} SELECT row_number() OVER (ORDER BY batch DESC, id_a, id_b) AS place, id_a, id_b, round(batch, 9) AS composite FROM s WHERE batch >= 0.5 ORDER BY place LIMIT 20")
def report_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 of the report, which is what it shows."""
    placed = batch.best_first(duplicates.find_duplicates(features(spark, sf_dir)))
    return places(placed.filter("place <= 20").select("place", "id_a", "id_b", "composite"), "composite")


@query(f"""{SCORED}, r AS (SELECT row_number() OVER (ORDER BY batch DESC, id_a, id_b) AS place, batch FROM s WHERE batch >= 0.5)
SELECT ((place - 1) // 100 + 1)::BIGINT AS page, count(*) AS rows, round(max(batch), 9) AS best, round(min(batch), 9) AS worst FROM r GROUP BY 1""")
def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report, written by tasks a hundred rows a page."""
    found = duplicates.find_duplicates(features(spark, sf_dir))
    return places(batch.write_report(found, f"{shared_folder(spark)}/report-{uuid.uuid4().hex}", page_rows=100), "best", "worst")


@query(f"""{SCORED.replace("WHERE coarse >= 0.30 GROUP", "WHERE coarse >= 0.30 AND id_a % 50 <> 3 AND id_b % 50 <> 3 GROUP")},
miss AS (SELECT DISTINCT least(id_a, id_b) AS a, greatest(id_a, id_b) AS b FROM n WHERE coarse >= 0.30)
SELECT (SELECT count(*) FROM n WHERE coarse < 0.30) AS skipped_coarse, (SELECT count(*) FROM miss WHERE a % 50 = 3 OR b % 50 = 3) AS skipped_missing,
(SELECT count(*) FROM s) AS checked, (SELECT count(*) FROM s WHERE batch >= 0.5) AS matches""")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batch run leaves out and finds, counted in its own pass; every fiftieth song lacks features."""
    own = features(spark, sf_dir)
    _, counts = batch.run_batch(vectors(spark, sf_dir), own.filter("id % 50 <> 3"))
    return spark.createDataFrame([tuple(counts[c] for c in batch.COUNTS)], ", ".join(f"{c} long" for c in batch.COUNTS))


_M = [[float(x) for x in row] for row in imaging.dct_matrix(8)]


@query(f"""WITH {V}, m AS (SELECT {_M}::DOUBLE[][] AS m), r AS (SELECT id, m, list_transform(range(8), lambda i: x[i * 8 + 1 : i * 8 + 8]) AS r FROM v, m),
a AS (SELECT id, m, list_transform(r, lambda y: list_transform(m, lambda w: list_inner_product(y, w))) AS a FROM r),
c AS (SELECT id, list_transform(range(8), lambda u: list_transform(range(8), lambda k: list_sum(list_transform(range(8), lambda i: m[u + 1][i + 1] * a[i + 1][k + 1])))) AS c FROM a),
p AS (SELECT id, list_sum(list_transform(flatten(c), lambda y: y * y)) + 1e-9 AS whole, list_sum(list_transform(flatten(list_transform(c[1:2], lambda y: y[1:2])), lambda y: y * y)) AS low,
  list_sum(list_transform(flatten(list_transform(c[5:8], lambda y: y[5:8])), lambda y: y * y)) AS high FROM c)
SELECT id, round(low / whole, 9) AS low, round((whole - low - high) / whole, 9) AS middle, round(high / whole, 9) AS high FROM p""")
def dct_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectrum's bands of every vector as a picture of 8 x 8, from the transform in column expressions."""
    rows = vectors(spark, sf_dir).filter(usable("cls", 64))
    bands = transform.band_energies(transform.dct2(transform.split_rows(F.col("cls"), 8, 8), 8, 8), 8)
    rows = rows.select("id", bands.alias("bands"))
    return places(rows.select("id", *[F.get("bands", F.lit(i)).alias(c) for i, c in enumerate(("low", "middle", "high"))]), "low", "middle", "high")


_LINES = """CASE doc_id % 5 WHEN 1 THEN left(line, length(line) - 1) WHEN 2 THEN '[' || line || ']' WHEN 3 THEN '' ELSE line END"""


@query("""SELECT doc_id AS line, CASE WHEN doc_id % 5 IN (0, 4) THEN doc_id END AS id, CASE WHEN doc_id % 5 IN (0, 4) THEN lang END AS lang, CASE WHEN doc_id % 5 IN (0, 4) THEN n_chars END AS n_chars,
doc_id % 5 NOT IN (0, 4) AS corrupt FROM documents""")
def sidecar_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines, of which some are cut off, some no objects and some empty, read leniently."""
    docs = table(spark, sf_dir, "documents").withColumn("line", F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", "n_chars")))
    lines = docs.select(F.col("doc_id").alias("number"), F.expr(_LINES).alias("line"))
    rows = records.parsed(lines, "line", "id long, lang string, n_chars long")
    return rows.select(F.col("number").alias("line"), "id", "lang", "n_chars", F.col(records.CORRUPT).isNotNull().alias("corrupt"))


@query("SELECT doc_id AS id, lang, n_chars FROM documents")
def sidecar_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to JSON lines and back, where a bad line would fail the job."""
    lines = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", "n_chars")).alias("line"))
    return records.parsed(lines, "line", "id long, lang string, n_chars long", strict=True)


def _case(c: str, steps: tuple, rest) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {c} >= {cut} THEN {show(v)}" for cut, v in steps) + f" ELSE {show(rest)} END"


@query(f"""WITH {V}, y AS (SELECT id, abs(x[1]) * 4 AS score FROM v), z AS (SELECT *, greatest(0, least(1, (score - 0.80) / 0.20)) AS t FROM y)
SELECT id, {_case('score', S.HEAT, S.COLDEST)} AS heat, {_case('score', S.SHADES, S.LIGHTEST)} AS shade, {VERDICT.format('score')} AS verdict,
'rgb(' || floor(255 * (1 - t))::INT || ',' || floor(200 * t + 55)::INT || ',60)' AS colour,
CASE {VERDICT.format('score')} WHEN 'EXACT' THEN '#ff4444' WHEN 'MICRO_VARIANT' THEN '#ff8800' WHEN 'MODIFIED_VARIANT' THEN '#ffcc00' WHEN 'DISTANT' THEN '#88aaff' ELSE '#888888' END AS badge FROM z""")
def heat_and_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.abs(F.get("cls", F.lit(0))) * 4
    rows = vectors(spark, sf_dir).select("id", score.alias("score"))
    x = F.col("score")
    return rows.select("id", S.bucket(x, S.HEAT, S.COLDEST).alias("heat"), S.bucket(x, S.SHADES, S.LIGHTEST).alias("shade"), S.verdict(x).alias("verdict"), S.score_colour(x).alias("colour"), S.badge_colour(S.verdict(x)).alias("badge"))


_OPS = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'add' WHEN event_type IN ('click', 'view') THEN 'edit' ELSE 'delete' END"
_LATEST = f"WITH l AS (SELECT user_id, event_id, {_OPS} AS op FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"


@query(f"{_LATEST} SELECT user_id, event_id, op FROM l WHERE op <> 'delete'")
def index_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr(_OPS).alias("op"))
    return latest_changes(events, "user_id", ["ts", "event_id"]).filter("op <> 'delete'").select("user_id", "event_id", "op")


@query("SELECT count(*) FILTER (vec_id IN (SELECT vec_id FROM embeddings)) AS removed, count(*) FILTER (vec_id NOT IN (SELECT vec_id FROM embeddings)) AS unknown FROM (SELECT doc_id AS vec_id FROM labels)")
def bulk_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    known = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(True).alias("known"))
    return wanted.join(known, "vec_id", "left").agg(F.count_if("known").alias("removed"), F.count_if(F.col("known").isNull()).alias("unknown"))


@query("SELECT 'vectors' AS part, count(*) AS n FROM embeddings UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'processed', count(*) FROM labels")
def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, t in (("vectors", "embeddings"), ("documents", "documents"), ("processed", "labels"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Scores to four places; halves are rounded up, so SQL rounds decimals.
_PLACES = ", ".join(f"round({c}::DECIMAL(22, 17), 4)::DOUBLE AS {c}" for c in ("composite", "hash_ensemble", "dct_spectrum", "sector_grid", "global_semantic", "patch_spatial", "grid_min_cell", "grid_variance"))
_CHECKED = f"""WITH {_EACH}, c AS (SELECT id_a, id_b, coarse FROM n), {FEATURES}, {STAGES}, z AS (SELECT *, {_VETO} AS composite FROM s)
SELECT id_a, id_b, {VERDICT.format('z.composite')} AS verdict, {_PLACES} FROM z WHERE composite >= 0.45 QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY z.composite DESC, coarse DESC, id_b) = 1"""


@query(_CHECKED)
def check_duplicate_json_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duplicate check for every vector whose id is divisible by 20, among the levels 0 to 2."""
    own = features(spark, sf_dir)
    config = ScoringConfig(**{**VECTOR.__dict__, "threshold": 0.45})
    return duplicates.check_duplicate(own.filter("id % 20 = 0"), own, own.filter("label IN (0, 1, 2)").select("id"), config)


_SAYS = "CASE verdict " + " ".join(f"WHEN '{code}' THEN '{text}'" for code, text in DESCRIPTIONS.items()) + " END"


@query(f"""WITH r AS ({_CHECKED}) SELECT id_a, true AS duplicate, id_b::VARCHAR AS mongo_id, composite, verdict, {_SAYS} AS verdict_description, hash_ensemble, dct_spectrum, sector_grid,
global_semantic, patch_spatial, grid_min_cell AS min_cell, grid_variance AS variance FROM r""")
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each check's response as JSON, read again strictly: its fields as columns."""
    found = check_duplicate_json_each(spark, sf_dir)
    said = found.select("id_a", records.response_json(F.expr(_SAYS)).alias("json"))
    scores = "hash_ensemble double, dct_spectrum double, sector_grid double, global_semantic double, patch_spatial double"
    rows = records.parsed(said, "json", f"duplicate boolean, mongo_id string, composite double, verdict string, verdict_description string, scores struct<{scores.replace(' double', ':double')}>, grid struct<min_cell:double,variance:double>", strict=True)
    return rows.select("id_a", "duplicate", "mongo_id", "composite", "verdict", "verdict_description", "scores.*", "grid.*")


@query(f"WITH {PAIRS} SELECT id_a AS id FROM c UNION SELECT id_b FROM c")
def path_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = _pairs(spark, sf_dir)
    return pair.select(F.col("id_a").alias("id")).union(pair.select(F.col("id_b").alias("id"))).distinct()


@query(f"""{_LATEST} SELECT user_id::VARCHAR AS song_id, (('0x' || substr(sha256(user_id::VARCHAR), 1, 16))::UBIGINT & 9223372036854775807)::BIGINT AS vec_id,
len(embedding)::INT AS size, round(embedding[1]::DOUBLE, 9) AS first FROM l LEFT JOIN embeddings e ON e.vec_id = user_id WHERE op <> 'delete'""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a change feed into a new store, with the users' vectors where there are any."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    song = F.col("user_id").cast("string")
    known = vectors(spark, sf_dir).select(F.col("id").alias("user_id"), "cls")
    changes = stream.join(known, "user_id", "left").select(song.alias("song_id"), F.expr(_OPS).alias("op"), F.struct("ts", "event_id").alias("number"), ids.stable_vec_id(song).alias("vec_id"), F.sha2(song, 256).alias("emb_key"), "cls")
    store, name = IndexStore(spark, path), f"ingest-{uuid.uuid4().hex}"
    state = Progress(name, events.count()).watch(lambda: follow(changes, store, f"{path}-progress", name), spark)
    if state["error"]:
        raise RuntimeError(state["error"])
    return store.entries().select("song_id", "vec_id", F.when(F.col("cls").isNotNull(), F.size("cls")).alias("size"), F.round(F.get("cls", F.lit(0)), 9).alias("first"))


def _rasters(rows: DataFrame, turn: float = 0.0) -> DataFrame:
    """An image from each vector that can be searched: smooth shades between its components, BGR.  turn: adds its
    pixels as turned by so many degrees."""
    names = ["id", "data", "width", "height", "nChannels"] + (["turned"] if turn else [])
    inked = lambda grey: np.repeat(grey.round().astype(np.uint8)[:, :, None], 3, 2).tobytes()

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for pdf in batches:
            for row in pdf.itertuples():
                small = np.asarray(row.embedding, float).reshape(8, -1)
                grey = imaging.resized((small - small.min()) / np.ptp(small) * 255, 160, 120)
                done = {"id": row.id, "data": inked(grey), "width": 160, "height": 120, "nChannels": 3}
                if turn:
                    c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
                    done["turned"] = inked(imaging.warped(grey, np.array([[c, -s, 20], [s, c, -10], [0, 0, 1]]), 160, 120))
                yield done

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return image_features.framed(drawn(batches), names)

    rows = rows.filter(usable("embedding", 64)).select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return rows.mapInPandas(draw, "id string, data binary, width int, height int, nChannels int" + (", turned binary" if turn else ""))


@query()
def image_features_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of an image drawn from each vector."""
    return image_features.extract_features(_rasters(table(spark, sf_dir, "embeddings").repartition(spark.sparkContext.defaultParallelism)))


@query()
def warp_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each drawn image against itself turned by 8 degrees; both are drawn in one place, so pixels aren't joined."""
    rows = _rasters(table(spark, sf_dir, "embeddings").repartition(spark.sparkContext.defaultParallelism), 8.0)
    image = lambda data: F.struct(F.col(data).alias("data"), "width", "height", "nChannels")
    return image_features.align_pairs(rows.select(F.col("id").alias("pair_id"), image("data").alias("a"), image("turned").alias("b")))


def _embed(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shades of 14 x 14 cells, whole and as patches, in place of a model's vectors."""
    cells = np.stack([imaging.resized(rgb[:, :, c].astype(float), 14, 14) for c in range(3)], 2)
    return cells.ravel() - cells.mean() + 1e-3, cells.reshape(196, 3) + 1.0


@query()
def live_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each drawn image and its vector's nearest neighbour, aligned and scored from pixels."""
    work = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "embeddings").repartition(spark.sparkContext.defaultParallelism)
    images = _rasters(rows).select("id", F.sha2("data", 256).alias("file_key"), *live.IMAGE, F.lit(None).cast("string").alias("text"))
    images.write.option("compression", "zstd").parquet(f"{work}/images")
    images = spark.read.parquet(f"{work}/images")
    image_features.extract_features(images, embed=_embed).write.option("compression", "zstd").parquet(f"{work}/features")
    near = knn.candidate_pairs(knn.knn_self(vectors(spark, sf_dir), 1), -1.0)
    near = near.select(F.col("id_a").cast("string").alias("id_a"), F.col("id_b").cast("string").alias("id_b"))
    return live.analyze_pairs(near, images, spark.read.parquet(f"{work}/features"), embed=_embed, work=work)


def _embed_batch(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = [_embed(x) for x in images]
    return np.stack([c for c, _ in both]), np.stack([p for _, p in both])


def _drawn(url: str) -> tuple[int, bytes]:
    """An image that depends on nothing but its address, in place of a server's."""
    small = np.random.default_rng(list(url.encode())).uniform(0, 255, (9, 12))
    grey = imaging.resized(small, 160, 120).round().astype(np.uint8)
    return 200, b"P6\n160 120\n255\n" + np.repeat(grey[:, :, None], 3, 2).tobytes()


@query("SELECT vec_id::VARCHAR AS song_id, (('0x' || substr(sha256(vec_id::VARCHAR), 1, 16))::UBIGINT & 9223372036854775807)::BIGINT AS vec_id FROM embeddings WHERE vec_id IS NOT NULL")
def ingest_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors' ids as songs with a video each, fetched, decoded and added to a new index in two
    batches; joined with the stored features, so that a song without them would be missing."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    song = F.col("vec_id").cast("string")
    songs = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL").select(song.alias("song_id"), song.alias("video_id"))
    store, features_, cache = IndexStore(spark, f"{path}/store"), FeatureTable(spark, f"{path}/features"), ImageCache(spark, f"{path}/images")
    ingest.build_index(songs, store, features_, cache, _drawn, image_features.ppm, Provider(lambda: _embed_batch, VECTOR.embed_batch), batches=2)
    return store.entries().join(features_.read(["phash"]).filter("phash IS NOT NULL"), "emb_key").select("song_id", "vec_id")
