"""JSON lines to rows and back, strictly or leniently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt_record"


def parsed(lines: DataFrame, column: str, schema: str, strict: bool = False) -> DataFrame:
    """lines with the fields of their JSON object in place of `column`.  Leniently, what is no object of the schema
    has null fields and stands itself in `_corrupt_record`; null and empty lines too are no object.  Strictly
    the first of these fails the job.  Fields that the schema lacks are ignored, missing ones are null."""
    kind = StructType.fromDDL(f"{schema}, {CORRUPT} string")
    text = F.coalesce(F.col(column), F.lit(""))
    row = F.from_json(text, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    bad = F.when(F.trim(text) == "", text).otherwise(F.col("_row")[CORRUPT])
    rest = [c for c in lines.columns if c != column]
    out = lines.withColumn("_row", row).select(*rest, *[F.col("_row")[c].alias(c) for c in kind.names if c != CORRUPT], bad.alias(CORRUPT))
    if not strict:
        return out
    checked = F.when(F.col(CORRUPT).isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no object of the schema: "), F.col(CORRUPT))))
    return out.filter(checked.cast("boolean")).drop(CORRUPT)


def response_json(verdict_text: Column) -> Column:
    """The response of a duplicate check, from the columns of a match with scores that are rounded."""
    scores = ("hash_ensemble", "dct_spectrum", "sector_grid", "global_semantic", "patch_spatial")
    fields = [
        F.lit(True).alias("duplicate"), F.col("id_b").cast("string").alias("mongo_id"), "composite", "verdict", verdict_text.alias("verdict_description"),
        F.struct(*scores).alias("scores"), F.struct(F.col("grid_min_cell").alias("min_cell"), F.col("grid_variance").alias("variance")).alias("grid"),
    ]
    return F.to_json(F.struct(*fields))
