"""The live scorer over images: byte equality, hashes, alignment, and the other scores with the second
image warped onto the first."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixkin.config import PROFILES, ScoringConfig
from pixkin.functions import scores as S
from pixkin.functions.signatures import unpacked
from pixkin.operators.features import Embedder, align_pairs, deflated, extract_features
from pixkin.operators.knn import pairs_above
from pixkin.operators.pairs import NARROW, patch_score, with_features
from pixkin.sources.images import image_files, images

IMAGE = ("data", "width", "height", "nChannels")
HASHES = ("phash", "dhash", "ahash", "whash")
SCORES = ("hash_ensemble", "dct_spectrum", "sector_grid", "global_semantic", "patch_spatial")


def hash_vector(config: ScoringConfig) -> Column:
    """The four hashes as one vector of which the inner product is 2 * hash_ensemble - 1."""
    part = lambda h, w: F.transform(F.slice(unpacked(F.col(h)), 1, config.hash_size**2), lambda b: (2 * b - 1) * F.lit((w / config.hash_size**2) ** 0.5))
    return F.concat(*[part(h, w) for h, w in config.hash_weights.items()])


def _text_similarity(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), None).otherwise(S.text_similarity(a, b))


def analyze_pairs(pairs: DataFrame, images: DataFrame, features: DataFrame, config: ScoringConfig = ScoringConfig(), embed: Embedder | None = None, full: bool = False, work: str | None = None) -> DataFrame:
    """pairs: (id_a, id_b); images: (id, file_key, data, width, height, nChannels, text); features:
    rows of `extract_features` of the images.

    Per pair the scores, composite, verdict, the grid's matrix and how b was aligned.  Files of equal
    bytes score 1 throughout; a hash score from `short_high` on decides alone, and one up to
    `short_low` leaves the vectors' scores 0, unless full is set.  Without embed the vectors' scores are 0 and
    the composite is that of the others.  text, null if unknown, stands for what OCR would read.
    Pairs with an image that couldn't be worked on are left out, as are those with an unknown id.
    work: a folder that all executors share; with it each pair is aligned once, without it twice."""
    kind = PROFILES["live"]
    narrow = images.select("id", "file_key", "text").join(features.filter("error IS NULL").select("id", *HASHES), "id")
    df = with_features(pairs.select("id_a", "id_b"), narrow, ["file_key", "text", *HASHES])
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    df = df.select(
        "id_a", "id_b", S.hash_ensemble(a, b, config).alias("hash_ensemble"), F.coalesce(a("file_key") == b("file_key"), F.lit(False)).alias("same"),
        _text_similarity(a("text"), b("text")).alias("ocr"), F.concat_ws("\x01", F.col("id_a").cast("string"), F.col("id_b").cast("string")).alias("pair_id"),
    )
    decided = F.col("same") | (F.lit(not full) & (F.col("hash_ensemble") >= config.short_high))
    quick = df.filter(decided)
    quick = quick.select(
        "id_a", "id_b", F.when(F.col("same"), 1.0).otherwise(F.col("hash_ensemble")).alias("hash_ensemble"),
        *[F.when(F.col("same"), 1.0).otherwise(0.0).alias(c) for c in SCORES[1:]],
        F.when(F.col("same"), 1.0).otherwise(F.col("hash_ensemble")).alias("composite"),
        F.when(F.col("same"), F.array(F.lit("metadata_exact_match"))).otherwise(F.array(F.lit("metadata"), F.lit("hash_ensemble"))).alias("stages_run"),
    )

    # the rest: b as seen from a; features of b alone are used where it couldn't be aligned
    rest = df.filter(~decided)
    pixels = deflated(images.select("id", *IMAGE), "data").select("id", F.struct(*IMAGE).alias("image"))
    both = with_features(rest.select("id_a", "id_b", "pair_id"), pixels, ["image"])
    aligned = align_pairs(both.select("pair_id", F.col("a_image").alias("a"), F.col("b_image").alias("b")), config, warp=True, inflate=True)
    if work is not None:
        aligned.write.option("compression", "zstd").parquet(path := f"{work}/aligned-{uuid.uuid4().hex}")
        aligned = aligned.sparkSession.read.schema(aligned.schema).parquet(path)
    seen = extract_features(aligned.filter("applied").select(F.col("pair_id").alias("id"), *IMAGE), config, embed)
    wide = [*NARROW, "patches"]
    own = features.filter("error IS NULL").select("id", *wide)
    row = rest.join(aligned.drop(*IMAGE), "pair_id")
    row = row.join(seen.filter("error IS NULL").select(F.col("id").alias("pair_id"), *[F.col(c).alias(f"w_{c}") for c in wide]), "pair_id", "left")
    row = with_features(row, own, wide).withColumn("applied", F.col("applied") & F.col("w_phash").isNotNull())
    row = row.withColumns({f"b_{c}": F.when(F.col("applied"), F.col(f"w_{c}")).otherwise(F.col(f"b_{c}")) for c in wide}).drop(*[f"w_{c}" for c in wide])
    row = row.withColumn("cells", S.grid_cells(a("grid"), b("grid"), config))
    skipped = (F.lit(not full) & (F.col("hash_ensemble") <= config.short_low)) | F.lit(embed is None)
    patch = F.lit(0.0) if embed is None else patch_score(F.when(~skipped, a("patches")), F.when(~skipped, b("patches")), config.patch_side)
    cells = F.col("cells")
    row = row.withColumns({
        "dct_spectrum": S.dct_spectrum(a("dct_bands"), b("dct_bands")),
        "sector_grid": S.mean(cells),
        "grid_min_cell": F.array_min(cells),
        "grid_variance": S.variance(cells),
        "grid_matrix": F.transform(F.sequence(F.lit(0), F.lit(config.grid_side - 1)), lambda i: F.slice(cells, i * config.grid_side + 1, F.lit(config.grid_side))),
        "global_semantic": F.when(skipped, 0.0).otherwise(S.clamp(S.cosine(a("cls"), b("cls")))),
        "patch_spatial": patch,
    })
    # an image without a usable vector or patch scores 0 there
    row = row.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("global_semantic", "patch_spatial")})
    named = {"hash": F.col("hash_ensemble"), "grid": F.col("sector_grid"), "dct": F.col("dct_spectrum"), "global": F.col("global_semantic"), "patch": F.col("patch_spatial")}
    whole = S.composite(named, F.col("grid_variance"), config, kind, F.col("ocr"))
    # `full` also switches off that a high hash score decides alone
    plain = S.ocr_penalised(S.clamp(S.weighted(named, config) - config.variance_penalty * F.col("grid_variance")), F.col("ocr"), config)
    stage = lambda name, when=None: F.array(F.lit(name)) if when is None else F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    row = row.withColumn("composite", plain if full else whole).withColumn(
        "stages_run",
        F.concat(stage("metadata"), stage("hash_ensemble"), F.array(F.concat(F.lit("align["), F.when(F.col("applied"), "").otherwise("skipped:"), "reason", F.lit("]"))),
                 stage("dct_spectrum"), stage("sector_grid"), stage("global_semantic", ~skipped), stage("patch_spatial", ~skipped), stage("ocr_text", F.col("ocr").isNotNull())),
    )
    row = row.select(
        "id_a", "id_b", *SCORES, F.col("ocr").alias("ocr_text_delta"), "composite", "grid_matrix", "grid_min_cell", "grid_variance",
        F.col("applied").alias("align_applied"), F.col("reason").alias("align_reason"), F.col("scale").alias("align_scale"), F.col("rotation").alias("align_rotation_deg"), F.col("inliers").alias("align_inliers"), "stages_run",
    )
    out = row.unionByName(quick.withColumn("align_applied", F.lit(False)), allowMissingColumns=True)
    return out.withColumn("verdict", S.verdict(F.col("composite")))


def _origin(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def folder_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a folder that Spark can decode, with the digest of their bytes; no text."""
    keys = image_files(spark, folder).select(_origin(F.col("path")).alias("id"), F.sha2("content", 256).alias("file_key"))
    found = images(spark, folder).withColumn("id", _origin(F.col("id")))
    return found.join(keys, "id").select("id", "file_key", *IMAGE, F.lit(None).cast("string").alias("text"))


def scan_directory(spark: SparkSession, folder: str, work: str, config: ScoringConfig = ScoringConfig(), embed: Embedder | None = None, threshold: float = 0.50, texts: DataFrame | None = None) -> DataFrame:
    """All pairs of a folder's images that reach the threshold, best first.  work: a folder that all
    executors share, where images and features are kept while the result is read.  texts: (id, text).

    Pairs up to `short_low` by hashes score 0 for the vectors, so at most that share of the hashes and
    all of grid and spectrum: below such a threshold they're never compared."""
    at = f"{work}/scan-{uuid.uuid4().hex}"
    found = folder_images(spark, folder)
    if texts is not None:
        found = found.drop("text").join(texts.select("id", "text"), "id", "left").select("id", "file_key", *IMAGE, "text")
    found.write.option("compression", "zstd").parquet(f"{at}/images")
    found = spark.read.parquet(f"{at}/images")
    extract_features(found, config, embed).write.parquet(f"{at}/features")
    own = spark.read.parquet(f"{at}/features")
    most = config.weights["hash"] * config.short_low + config.weights["grid"] + config.weights["dct"]
    least = 2 * config.short_low - 1 if most < threshold else -2.0
    pairs = pairs_above(own.filter("error IS NULL").select("id", hash_vector(config).alias("cls")), least - 1e-9)
    scored = analyze_pairs(pairs, found, own, config, embed, work=at)
    return scored.filter(F.col("composite") >= threshold).orderBy(F.desc("composite"), "id_a", "id_b")
