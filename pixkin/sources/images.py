"""Images from folders and thumbnails from a fetcher."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = r"(?i)\.(jpg|jpeg|png|webp)$"
ATTEMPTS = 3
#: Size of a placeholder and the least size worked on.
PLACEHOLDER = (120, 90)
LEAST_SIDE = 64
#: Files that a task hands on at a time.
FETCHED = 64


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the image files below a folder, in the order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(F.col("path").rlike(SUFFIXES)).select("path", "content").orderBy("path")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(id, data, width, height, nChannels) of the files Spark can decode."""
    found = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("image.origin").alias("id"), "image.data", "image.width", "image.height", "image.nChannels")


def usable(width: Column, height: Column) -> Column:
    placeholder = (width == PLACEHOLDER[0]) & (height == PLACEHOLDER[1])
    return ~placeholder & (width >= LEAST_SIDE) & (height >= LEAST_SIDE)


def backoff(attempt: int) -> float:
    return 0.5 * (attempt + 1)


def attempted(get: Callable[[str], tuple[int, bytes]], url: str, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> bytes | None:
    """Bytes of a 200; null for a 404 at once, and for anything else after all attempts."""
    for attempt in range(attempts):
        try:
            status, content = get(url)
        except OSError:
            status, content = 0, b""
        if status == 200:
            return content
        if status == 404:
            return None
        wait(backoff(attempt))
    return None


def fetched(urls: DataFrame, get: Callable[[str], tuple[int, bytes]], partitions: int = 100) -> DataFrame:
    """urls: (id, url).  Adds content, null where it can't be had; partitions bound the connections."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), FETCHED):
                some = pdf.iloc[at : at + FETCHED]
                yield some.assign(content=[attempted(get, u) for u in some["url"]])

    return urls.select("id", "url").repartition(partitions).mapInPandas(work, "id string, url string, content binary")
