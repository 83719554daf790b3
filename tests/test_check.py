"""A duplicate check from request to response, the configuration's sources, and tables under several writers."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pixkin.config import ScoringConfig, configured
from pixkin.functions import imaging
from pixkin.operators import pairs
from pixkin.operators.features import extract_features, ppm
from pixkin.operators.vector_proxy import vector_features
from pixkin.plans.check import check_duplicate, query_image
from pixkin.service import ServiceError
from pixkin.sources.feature_table import FeatureTable
from pixkin.sources.store import IndexStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def picture(seed, width=240, height=180):
    small = np.random.default_rng(seed).uniform(0, 255, (12, 16, 3))
    return np.stack([imaging.resized(small[:, :, c], width, height) for c in range(3)], 2).round().astype(np.uint8)


def pixmap(rgb):
    return b"P6\n%d %d\n255\n" % (rgb.shape[1], rgb.shape[0]) + rgb.tobytes()


def embed(rgb):
    cells = np.stack([imaging.resized(rgb[:, :, c].astype(float), 14, 14) for c in range(3)], 2)
    return cells.ravel() - cells.mean() + 1e-3, cells.reshape(196, 3) + 1.0


def test_check_from_request_to_response(spark, tmp_path):
    store, table = IndexStore(spark, str(tmp_path / "s")), FeatureTable(spark, str(tmp_path / "f"))
    songs = spark.createDataFrame([(f"s{i}", f"Song {i}" if i % 2 else None, f"name {i}", f"v{i}", ["1"] if i < 4 else ["2", "3"]) for i in range(8)] + [("new", "x", "x", "v", ["1"]), ("alone", "x", "x", "v", ["9"])], "song_id string, song_name string, name string, video_id string, levels array<string>")
    get = lambda url: (200, pixmap((picture(int(url[-1])) * 0.97).round().astype(np.uint8)))
    ask = lambda **more: json.dumps({"image_url": "http://x/2", "level_ids": ["1"], **more})
    run = lambda body: check_duplicate(body, songs, store, table, ppm, embed, get)
    with pytest.raises(ServiceError) as e:
        run(ask())
    assert e.value.code == "INDEX_NOT_FOUND"
    images = spark.createDataFrame([(f"s{i}", pixmap(picture(i))) for i in range(8)], "id string, content binary")
    from pixkin.operators.features import decoded

    rows = store.scratch(extract_features(decoded(images, ppm), embed=embed))
    table.add(rows)
    store.upsert(rows.select(F.col("id").alias("song_id"), F.xxhash64("id").alias("vec_id"), "emb_key", "cls"))

    body = run(ask())
    assert body["duplicate"] and (body["mongo_id"], body["song_name"], body["yt_video_id"]) == ("s2", "name 2", "v2")
    grey = [imaging.luma(imaging.resized(x, 480, 360)) for x in (ppm(get("2")[1]), picture(2))]
    cells = (np.array([imaging.cell_hashes(g, 8, 8) for g in grey]).reshape(2, 64, 64)[0] == np.array([imaging.cell_hashes(g, 8, 8) for g in grey]).reshape(2, 64, 64)[1]).mean(1)
    assert np.allclose(np.array(body["grid"]["matrix"]).ravel(), cells) and body["scores"]["sector_grid"] == round(cells.mean(), 4)
    assert body["composite"] > 0.9 and body["elapsed_ms"] > 0 and not body["alignment"]["applied"]
    assert run(ask(level_ids=["2"])) == {} and run(ask(exclude_id="s2")) == {}
    for more, code in (({"level_ids": ["none"]}, "NO_SONGS_FOR_LEVEL"), ({"level_ids": "9"}, "NO_INDEXED_SONGS"), ({"level_ids": []}, "INVALID_LEVEL_ID")):
        with pytest.raises(ServiceError) as e:
            run(ask(**more))
        assert e.value.code == code
    found = query_image(picture(5), "3", songs, store, table, embed, threshold=0.0, most=3).collect()
    assert [r.place for r in found] == [1, 2, 3] and found[0].song_id == "s5" and found[0].verdict == "EXACT" and {r.song_id for r in found} <= {"s4", "s5", "s6", "s7"}


def test_configuration(spark):
    assert configured(spark, environ={}) == ScoringConfig()
    spark.conf.set("pixkin.threshold", "0.7")
    try:
        env = {"PIXKIN_THRESHOLD": "0.6", "PIXKIN_NEIGHBOURS": "7"}
        assert (configured(spark, environ=env).threshold, configured(spark, environ=env).neighbours) == (0.7, 7)
        assert configured(spark, {"threshold": 0.9}, env).threshold == 0.9 and configured(None, environ=env).threshold == 0.6
        assert configured(spark, environ=env).coarse == max(0.7 - 0.05, 0.65)
    finally:
        spark.conf.unset("pixkin.threshold")
    with pytest.raises(ValueError, match="unknown"):
        configured(options={"treshold": 1})
    with pytest.raises(ValueError, match="number"):
        configured(environ={"PIXKIN_THRESHOLD": "high"})


def test_a_lost_marker_stops_no_writer(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    row = lambda i: spark.createDataFrame([(i, 1, "k", [1.0])], "song_id string, vec_id long, emb_key string, cls array<double>")
    store.add(row("a"))
    (tmp_path / "s" / "log" / f"{store._number() + 1:012d}.json").touch()  # its writer was lost
    store.add(row("b"))
    store.upsert(row("c"))
    assert {r.song_id for r in store.entries().collect()} == {"a", "b", "c"} and store.delete_one("b") is None
    assert "cls" not in store.ids()._jdf.queryExecution().executedPlan().toString()


def test_rows_appended_during_compaction(spark, tmp_path):
    path, late = str(tmp_path / "f"), []

    class Racing(FeatureTable):
        def _live(self, rows):
            if late:  # another writer appends after the files were listed
                FeatureTable(spark, path).add(late.pop())
            return super()._live(rows)

    images = lambda *seeds: extract_features(spark.createDataFrame([(str(i), picture(i)[:, :, ::-1].tobytes(), 240, 180, 3) for i in seeds], "id string, data binary, width int, height int, nChannels int"))
    FeatureTable(spark, path).add(images(1, 2))
    late.append(images(3))
    Racing(spark, path).compact()
    ids = lambda: sorted(r.id for r in FeatureTable(spark, path).read(["id"]).collect())
    assert ids() == ["1", "2", "3"]
    FeatureTable(spark, path).add(images(4, 1))
    FeatureTable(spark, path).compact()
    FeatureTable(spark, path).compact()
    assert ids() == ["1", "2", "3", "4"]


def test_low_pairs_never_meet_their_patches(spark):
    draw = np.random.default_rng(4)
    own = vector_features(spark.createDataFrame([(i, draw.normal(size=64).tolist()) for i in range(12)], "vec_id long, embedding array<double>"))
    from dataclasses import replace

    from pixkin.config import VECTOR

    pair = own.select(F.col("id").alias("id_a")).crossJoin(own.select(F.col("id").alias("id_b"))).filter("id_a < id_b")
    config = replace(VECTOR, short_low=0.5)
    got = pairs.score_pairs(pair, own, config, "live").collect()
    assert len(got) == 66 and {r.patch_spatial == 0 for r in got} == {True, False}
    assert all((r.patch_spatial == 0 and r.global_semantic == 0) == (r.hash_ensemble <= 0.5) for r in got if r.hash_ensemble <= 0.5)
    # without patches for anyone, those below the cut still have their row
    bare = own.withColumn("patches", F.lit(None).cast("array<double>"))
    left = pairs.score_pairs(pair, bare, config, "live").collect()
    assert {(r.id_a, r.id_b) for r in left} == {(r.id_a, r.id_b) for r in got if r.hash_ensemble <= 0.5}
