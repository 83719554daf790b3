"""The near-duplicate engine: scores, boundaries, store, feed, pixels and requests."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixkin.config import VECTOR, ScoringConfig
from pixkin.functions import imaging, report
from pixkin.functions import scores as S
from pixkin.operators import features, knn, pairs
from pixkin.operators.vector_proxy import vector_features
from pixkin.service import ServiceError, change_request, check_request, response
from pixkin.sources.images import attempted
from pixkin.sources.store import IndexStore, SongExists, SongNotFound, WriteConflict


def test_config_weights():
    with pytest.raises(ValueError):
        ScoringConfig(weights={"hash": 0.5, "grid": 0.1, "dct": 0.1, "global": 0.1, "patch": 0.1})
    assert ScoringConfig().coarse == 0.75


def test_verdict_cuts(spark):
    rows = [(0.97, "EXACT"), (0.9699, "MICRO_VARIANT"), (0.88, "MICRO_VARIANT"), (0.70, "MODIFIED_VARIANT"), (0.5, "DISTANT"), (0.4999, "DISTINCT")]
    df = spark.createDataFrame(rows, "x double, v string")
    assert df.filter(S.verdict(F.col("x")) != F.col("v")).count() == 0


def test_text_similarity(spark):
    rows = [("", " ", 1.0), ("", "a", 0.0), (" ab ", "ab", 1.0), ("é", "e", 0.0), ("abcd", "abce", 0.75), (None, None, 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, s double")
    assert df.filter(F.abs(S.text_similarity(F.col("a"), F.col("b")) - F.col("s")) > 1e-9).count() == 0


@pytest.fixture(scope="module")
def proxy(spark):
    draw = np.random.default_rng(4)
    v = draw.normal(size=(40, 64))
    v[20:] = v[:20] + 0.3 * draw.normal(size=(20, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def test_neighbours_are_exact(proxy):
    v, df = proxy
    rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("cls"))
    got = {(r.id_a, r["rank"]): r.id_b for r in knn.knn(rows, rows, 3, block=16).collect()}
    score = v @ v.T - 9 * np.eye(40)
    assert got == {(i, k + 1): int(j) for i in range(40) for k, j in enumerate(np.argsort(-score[i], kind="stable")[:3])}
    close = {(r.id_a, r.id_b) for r in knn.pairs_above(rows, 0.5, block=16).collect()}
    assert close == {(i, j) for i in range(40) for j in range(i + 1, 40) if score[i, j] >= 0.5}


def test_prune_loses_nothing(proxy):
    _, df = proxy
    own = vector_features(df)
    pair = knn.pairs_above(own, 0.2)
    whole = pairs.score_pairs(pair, own, VECTOR).filter("composite >= 0.6").count()
    assert whole and pairs.score_pairs(pair, own, VECTOR, threshold=0.6).count() == whole
    self_pairs = own.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    assert pairs.score_pairs(self_pairs, own, VECTOR).filter("verdict <> 'EXACT'").count() == 0


def test_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    row = lambda i, k: spark.createDataFrame([(i, 1, k, [1.0])], "song_id string, vec_id long, emb_key string, cls array<double>")
    store.add(row("a", "x"))
    with pytest.raises(SongExists):
        store.add(row("a", "y"))
    store.upsert(row("a", "y"))
    store.upsert(row("b", "y"))
    assert {(r.song_id, r.emb_key) for r in store.entries().collect()} == {("a", "y"), ("b", "y")}
    assert store.delete(spark.createDataFrame([("a",), ("z",)], "song_id string")) == (1, 1)
    with pytest.raises(SongNotFound):
        store.delete_one("a")
    assert store.orphans(row("q", "y")).count() == 0 and store.info().first().vectors == 1
    store.upsert(row("c", "z"), spark.createDataFrame([("d",), ("b",)], "song_id string"))
    state = lambda: ({r.song_id for r in store.entries().collect()}, {(r.song_id, r.status) for r in store.progress().collect()})
    before = state()
    assert before == ({"b", "c"}, {("b", "failed"), ("c", "done"), ("d", "failed")})
    assert store.compact() and state() == before and len(store._log()) == 1
    # another writer claims the next number first: what was read no longer holds
    base = store._number()
    store.upsert(row("e", "z"))
    with pytest.raises(WriteConflict):
        store.apply(row("f", "z"), base=base)
    assert state()[0] == {"b", "c", "e"}


def test_pixels(spark):
    y, x = np.mgrid[:120, :160]
    image = ((np.sin(x / 9) + np.cos(y / 7 + x / 20) + 2) * 63).astype(np.uint8)
    grey = image.astype(float)
    assert np.allclose(imaging.resized(grey, 160, 120), grey) and abs(imaging.band_energies(grey).sum() - 1) < 1e-6
    for h in ("phash", "dhash", "ahash", "whash"):
        bits = getattr(imaging, h)(grey, 16)
        assert len(bits) == 256 and (getattr(imaging, h)(imaging.resized(grey, 320, 240), 16) == bits).mean() > 0.9
    data = np.repeat(image[:, :, None], 3, 2).tobytes()
    df = spark.createDataFrame([("a", data, 160, 120, 3), ("b", b"12", 160, 120, 3)], "id string, data binary, width int, height int, nChannels int")
    got = {r.id: r for r in features.extract_features(df).collect()}
    assert got["a"].error is None and len(got["a"].grid) == 64 and got["b"].error


def test_homography():
    draw = np.random.default_rng(1)
    src = draw.uniform(0, 200, (60, 2))
    h = np.array([[0.9, -0.2, 5], [0.2, 0.9, -3], [0, 0, 1]])
    dst = imaging.mapped(h, src)
    dst[:15] += 80
    found, good = imaging.ransac(src, dst)
    assert good.sum() == 45 and np.allclose(found, h, atol=1e-6)


def test_requests():
    assert check_request(json.dumps({"image_url": "https://x/y", "level_ids": [" a ", ""], "exclude_id": " "})) == ("https://x/y", ["a"], None)
    for body, code in (("{", "MISSING_FIELDS"), ('{"image_url": "ftp://x", "level_ids": "a"}', "INVALID_IMAGE_URL"), ('{"image_url": "http://x", "level_ids": [" "]}', "INVALID_LEVEL_ID"), ('{"image_url": "http://x"}', "MISSING_FIELDS")):
        with pytest.raises(ServiceError) as e:
            check_request(body)
        assert e.value.code == code
    assert change_request('{"doc_id": "a"}', needs_image=False) == (None, "a") and response(None) == {}


def test_fetch_attempts():
    waits = []
    assert attempted(lambda u: (404, b""), "u", wait=waits.append) is None and waits == []
    assert attempted(lambda u: (500, b""), "u", wait=waits.append) is None and waits == [0.5, 1.0, 1.5]


def test_reports_escape():
    row = {"id_a": "<a>", "id_b": "b", "composite": 0.9, "verdict": "MICRO_VARIANT", "hash_ensemble": 0.5}
    assert "&lt;a&gt;" in report.html_report([row]) and "No near duplicates" in report.html_report([])
    assert "MICRO_VARIANT" in report.terminal_report(row)
