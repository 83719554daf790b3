"""Batched embeddings, the thumbnail source, bucketed features and the progress of a stream."""

import json
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pixkin.config import ScoringConfig
from pixkin.functions import imaging
from pixkin.operators.embedding import Provider
from pixkin.operators.features import extract_features
from pixkin.operators.pairs import with_features
from pixkin.sources.bucketed import bucketed
from pixkin.sources.thumbnails import ThumbnailSource
from pixkin.streaming.progress import Progress

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def picture(seed, width=160, height=120):
    small = np.random.default_rng(seed).uniform(0, 255, (9, 12))
    grey = imaging.resized(small, width, height).round().astype(np.uint8)
    return np.repeat(grey[:, :, None], 3, 2)


def test_batched_embeddings(spark):
    sizes = spark.sparkContext.accumulator(0)
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def model(images):
            assert len(images) <= 4 and images.dtype == np.uint8 and images.shape[1:] == (360, 480, 3)
            if (images[:, 0, 0, 0] == 7).any():
                raise ValueError("bad image")
            sizes.add(len(images))
            return images.mean(axis=(1, 2)) + [1, 2, 3], images[:, :4, :2].reshape(len(images), 4, 6) + 1.0

        return model

    images = [picture(i) for i in range(12)]
    images[5] = np.full((120, 160, 3), 7, np.uint8)
    rows = [(str(i), x[:, :, ::-1].tobytes(), 160, 120, 3) for i, x in enumerate(images)] + [("broken", b"12", 160, 120, 3)]
    df = spark.createDataFrame(rows, "id string, data binary, width int, height int, nChannels int").coalesce(1)
    got = {r.id: r for r in extract_features(df, embed=Provider(load, 4)).collect()}
    assert got["5"].error == "no embedding" and got["5"].cls is None and got["broken"].error.startswith("ValueError")
    config = ScoringConfig()
    for i, x in enumerate(images):
        if i == 5:
            continue
        canonical = imaging.resized(x, *config.canonical).round().astype(np.uint8)
        want = canonical.mean(axis=(0, 1)) + [1, 2, 3]
        assert np.allclose(got[str(i)].cls, want / np.linalg.norm(want)) and len(got[str(i)].patches) == 24
        assert np.allclose(np.linalg.norm(np.array(got[str(i)].patches).reshape(4, 6), axis=1), 1)
    assert sizes.value == 11 and loads.value <= 2  # once a worker's task, not once a batch


class Stub(ThumbnailSource):
    @classmethod
    def name(cls):
        return "stub_thumbnails"

    @staticmethod
    def get(url):
        if url.endswith("/gone"):
            return 404, b""
        if url.endswith("/down"):
            raise OSError("no route")
        return 200, url.encode()

    wait = staticmethod(lambda s: None)


def test_thumbnail_source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Stub)
    ids = [f"v{i}" for i in range(23)] + ["gone", "down", "v1"]
    df = spark.read.format("stub_thumbnails").option("ids", json.dumps(ids)).option("template", "https://x/{id}").option("per_partition", 5).load()
    assert df.rdd.getNumPartitions() == 5
    got = {r.id: r.content and bytes(r.content).decode() for r in df.collect()}
    assert got == {i: None if i in ("gone", "down") else f"https://x/{i}" for i in ids}
    some = df.filter(F.col("id").isin("v3", "v4", "other"))
    assert some.rdd.getNumPartitions() == 1 and {r.id for r in some.collect()} == {"v3", "v4"}
    assert [r.url for r in df.filter("id = 'v7' AND url LIKE 'https%'").collect()] == ["https://x/v7"]
    assert df.filter("id = 'none'").count() == 0


def test_bucketed_features_are_not_shuffled(spark):
    rows = spark.range(500).select("id", (F.col("id") * 2).alias("x"))
    own = bucketed(rows)
    pairs = spark.range(400).select(F.col("id").alias("id_a"), (F.col("id") + 100).alias("id_b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_features(pairs, own, ["x"])
        assert {(r.id_a, r.a_x, r.b_x) for r in out.collect()} == {(i, 2 * i, 2 * i + 200) for i in range(400)}
        plan = out._jdf.queryExecution().executedPlan().toString()
        final = plan.split("Initial Plan")[0]
        assert final.count("Bucketed: true") == 2 and final.count("Exchange hashpartitioning") == 2  # of the pairs alone
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_progress_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    start = lambda: stream.writeStream.queryName("watched").foreachBatch(lambda b, _: b.count()).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    state = Progress("watched", 30, seen.append).watch(start, spark)
    assert state["processed"] == 30 and state["batches"] == 3 and state["seconds_left"] == 0 and state["error"] is None
    assert [x["processed"] for x in seen] == [10, 20, 30] and all(x["rate"] > 0 for x in seen) and seen[0]["seconds_left"] > 0
