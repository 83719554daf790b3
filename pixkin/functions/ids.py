"""Ids and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_vec_id(song_id: Column) -> Column:
    """63-bit id: the first 8 bytes of the id's SHA-256, the sign bit cleared."""
    digest = F.sha2(song_id.cast("string"), 256)
    top = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)
    return F.shiftleft(top, 32).bitwiseOR(F.conv(F.substring(digest, 9, 8), 16, 10).cast("long"))


def label(song_name: Column, name: Column, song_id: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(F.nullif(song_name, F.lit("")), F.nullif(name, F.lit("")), song_id.cast("string"))


def thumbnail_url(video_id: Column) -> Column:
    return F.format_string("https://img.youtube.com/vi/%s/hqdefault.jpg", video_id)


def eligible(column: Column) -> Column:
    return column.isNotNull() & (column != "")


def valid_url(column: Column) -> Column:
    return F.coalesce(column.rlike("^https?://"), F.lit(False))


def any_level(levels: Column, wanted: list) -> Column:
    return F.arrays_overlap(levels, F.array(*[F.lit(w) for w in wanted]))
