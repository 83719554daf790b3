"""Image files, the live scorer, the feature table and building the index."""

import json
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle

from pixkin.config import ScoringConfig
from pixkin.functions import imaging
from pixkin.operators.features import SCHEMA, decoded, extract_features, ppm
from pixkin.plans.changes import add_song, delete_song, edit_song
from pixkin.plans.ingest import build_index
from pixkin.plans.live import scan_directory
from pixkin.service import ServiceError, request_image, response
from pixkin.sources.feature_table import FeatureTable, ImageCache
from pixkin.sources.store import IndexStore

#: workers can't import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def picture(seed: int, width: int = 240, height: int = 180) -> np.ndarray:
    draw = np.random.default_rng(seed)
    small = draw.uniform(0, 255, (12, 16, 3))
    return np.stack([imaging.resized(small[:, :, c], width, height) for c in range(3)], 2).round().astype(np.uint8)


def png(rgb: np.ndarray) -> bytes:
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def pixmap(rgb: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (rgb.shape[1], rgb.shape[0]) + rgb.tobytes()


def embed(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """14 x 14 patches by their mean colours, and the mean of the image's coarse cells."""
    cells = np.stack([imaging.resized(rgb[:, :, c].astype(float), 14, 14) for c in range(3)], 2)
    return cells.ravel() - cells.mean() + 1e-3, cells.reshape(196, 3) + 1.0


def turned(rgb: np.ndarray, degrees: float) -> np.ndarray:
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    h = np.array([[c, -s, 18], [s, c, -12], [0, 0, 1]])
    return imaging.warped(rgb.astype(float), h, rgb.shape[1], rgb.shape[0]).round().astype(np.uint8)


def test_scan_directory(spark, tmp_path):
    folder = tmp_path / "images"
    (folder / "below").mkdir(parents=True)
    one, two = picture(1), picture(2)
    files = {"a.png": one, "below/copy.png": one, "light.png": (one * 0.97).round().astype(np.uint8), "turned.png": turned(one, 6), "other.PNG": two}
    for name, rgb in files.items():
        (folder / name).write_bytes(png(rgb))
    (folder / "broken.png").write_bytes(b"nothing")
    (folder / "note.txt").write_text("no image")
    config = ScoringConfig()
    got = {tuple(str(x).rsplit("/images/")[-1] for x in (r.id_a, r.id_b)): r for r in scan_directory(spark, str(folder), str(tmp_path), config, embed, threshold=0.0).collect()}
    names = sorted(files)
    assert set(got) == {(a, b) for a in names for b in names if a < b}
    same = got["a.png", "below/copy.png"]
    assert same.verdict == "EXACT" and same.composite == 1.0 and same.stages_run == ["metadata_exact_match"]
    assert got["a.png", "light.png"].composite > 0.95
    seen = got["a.png", "turned.png"]
    assert seen.align_applied and abs(abs(seen.align_rotation_deg) - 6) < 1 and seen.composite > got["a.png", "other.PNG"].composite

    # all scores of the turned image once more, from its pixels alone
    grey = [imaging.luma(imaging.resized(x, *config.canonical)) for x in (one, files["turned.png"])]
    hashes = sum(w * (getattr(imaging, h)(grey[0], 16) == getattr(imaging, h)(grey[1], 16)).mean() for h, w in config.hash_weights.items())
    assert abs(seen.hash_ensemble - hashes) < 1e-9
    points = [imaging.corners(imaging.luma(x)) for x in (one, files["turned.png"])]
    marks = [imaging.descriptors(imaging.luma(x), p) for x, p in zip((one, files["turned.png"]), points, strict=True)]
    match = imaging.ratio_matches(*marks)
    h, good = imaging.ransac(points[1][match[:, 1]], points[0][match[:, 0]])
    assert seen.align_inliers == good.sum()
    back = imaging.resized(imaging.warped(files["turned.png"].astype(float), h, 240, 180).round().astype(np.uint8), *config.canonical)
    cells = [imaging.cell_hashes(imaging.luma(x), 8, 8).reshape(64, 64) for x in (imaging.resized(one, *config.canonical), back)]
    matrix = (cells[0] == cells[1]).mean(1)
    assert np.allclose(np.array(seen.grid_matrix).ravel(), matrix) and abs(seen.sector_grid - matrix.mean()) < 1e-9
    bands = [imaging.band_energies(imaging.luma(x)) for x in (imaging.resized(one, *config.canonical), back)]
    dct = min(1.0, bands[0] @ bands[1] / (np.linalg.norm(bands[0]) * np.linalg.norm(bands[1]) + 1e-9))
    vectors = [embed(x) for x in (imaging.resized(one, *config.canonical), back)]
    whole = vectors[0][0] @ vectors[1][0] / (np.linalg.norm(vectors[0][0]) * np.linalg.norm(vectors[1][0]))
    p, q = (v[1] / np.linalg.norm(v[1], axis=1, keepdims=True) for v in vectors)
    place = np.array([(i, j) for i in range(14) for j in range(14)], float)
    near = np.exp(-((place[:, None] - place[None]) ** 2).sum(-1) / (2 * (14 / 3) ** 2))
    patch = (p @ q.T * near).max(1).mean()
    assert np.allclose([seen.dct_spectrum, seen.global_semantic, seen.patch_spatial], [dct, whole, patch])
    composite = 0.25 * hashes + 0.30 * matrix.mean() + 0.05 * dct + 0.20 * whole + 0.20 * patch - 1.2 * matrix.var()
    assert abs(seen.composite - min(1.0, max(0.0, composite))) < 1e-9

    # a threshold only leaves out what lies below it
    above = scan_directory(spark, str(folder), str(tmp_path), config, embed).collect()
    assert {(r.id_a, r.id_b) for r in above} == {(r.id_a, r.id_b) for r in got.values() if r.composite >= 0.5}
    assert [r.composite for r in above] == sorted((r.composite for r in above), reverse=True)


def test_feature_table(spark, tmp_path):
    images = [("b", picture(1)), ("a", picture(1)), ("c", picture(2))]
    rows = decoded(spark.createDataFrame([(i, pixmap(x)) for i, x in images] + [("d", b"P6 bad"), ("e", None)], "id string, content binary"), ppm)
    assert {r.id for r in rows.filter("data IS NULL").collect()} == {"d", "e"}
    features = extract_features(rows, embed=embed)
    table = FeatureTable(spark, str(tmp_path / "features"))
    assert table.read().count() == 0
    for _ in range(2):  # the second time nothing is new
        table.add(features)
        assert sorted(r.id for r in table.read(["id"]).collect()) == ["a", "c"]
    assert table.read(["dct_bands"]).columns == ["emb_key", "dct_bands"]
    keys = {r.id: r.emb_key for r in table.read(["id"]).collect()}
    table.remove_unreferenced(spark.createDataFrame([(keys["a"],)], "emb_key string"))
    assert [r.id for r in table.read(["id"]).collect()] == ["a"]
    table.compact()
    assert [r.id for r in table.read(["id"]).collect()] == ["a"]
    table.add(features)  # what was removed can come back
    assert sorted(r.id for r in table.read(["id"]).collect()) == ["a", "c"] and len(table.read().columns) == len(SCHEMA.split(", "))


def test_build_index(spark, tmp_path):
    seen = str(tmp_path / "asked")

    def get(url: str) -> tuple[int, bytes]:
        name = url.split("/")[-2]
        with open(seen, "a") as f:
            f.write(name + "\n")
        if name == "gone":
            return 404, b""
        if name == "odd":
            return 200, b"no image"
        if name == "blank":
            return 200, pixmap(picture(9, 120, 90))
        return 200, pixmap(picture(int(name[1:])))

    asked = lambda: sorted(open(seen).read().split())
    store, table, cache = IndexStore(spark, str(tmp_path / "s")), FeatureTable(spark, str(tmp_path / "f")), ImageCache(spark, str(tmp_path / "c"))
    songs = spark.createDataFrame([("s1", "v1"), ("s2", "v2"), ("s3", "v1"), ("s4", "gone"), ("s5", "odd"), ("s6", "blank"), ("s7", ""), ("s8", None), ("s1", "v1")], "song_id string, video_id string")
    reports = []
    done = build_index(songs, store, table, cache, get, ppm, embed, batches=2, report=reports.append)
    assert (done["pending"], done["processed"], done["failed"], done["left"]) == (6, 3, 3, 0) and reports[-1] == done and len(reports) == 2
    assert asked() == ["blank", "gone", "odd", "v1", "v1", "v2"]
    entries = {r.song_id: r for r in store.entries().collect()}
    assert set(entries) == {"s1", "s2", "s3"} and entries["s1"].emb_key == entries["s3"].emb_key and table.read(["id"]).count() == 2
    expected = embed(imaging.resized(picture(2), *ScoringConfig().canonical))[0]
    assert np.allclose(entries["s2"].cls, expected / np.linalg.norm(expected))

    more = songs.union(spark.createDataFrame([("s9", "v3")], songs.schema))
    done = build_index(more, store, table, cache, get, ppm, embed)
    assert done["processed"] == 1 and done["failed"] == 0 and store.entries().count() == 4
    assert asked().count("v1") == 2 and asked().count("gone") == 1  # neither fetched again
    assert build_index(more, store, table, cache, get, ppm, embed)["pending"] == 0
    # of the failed ones, on request
    assert build_index(more, store, table, cache, get, ppm, embed, retry_failed=True)["failed"] == 3


def test_requested_changes(spark, tmp_path):
    store, table = IndexStore(spark, str(tmp_path / "s")), FeatureTable(spark, str(tmp_path / "f"))
    get = lambda u: (200, pixmap(picture(int(u[-1]))))
    body = lambda i, n: json.dumps({"doc_id": i, "image_url": f"http://x/{n}"})
    keys = lambda: {r.emb_key for r in table.read(["id"]).collect()}
    one = add_song(store, table, body("a", 1), ppm, embed, get)
    assert one["action"] == "added" and one["mongo_id"] == "a" and one["faiss_id"] == store.entries().first().vec_id
    with pytest.raises(ServiceError) as e:
        add_song(store, table, body("a", 2), ppm, embed, get)
    assert e.value.code == "DOC_ALREADY_INDEXED" and keys() == {one["emb_key"]}
    two = edit_song(store, table, body("b", 1), ppm, embed, get)
    assert two["action"] == "added" and two["emb_key"] == one["emb_key"]
    three = edit_song(store, table, body("a", 2), ppm, embed, get)  # b still has the old image
    assert three["action"] == "updated" and three["faiss_id"] == one["faiss_id"] and keys() == {one["emb_key"], three["emb_key"]}
    assert delete_song(store, table, '{"doc_id": "b"}') == {"action": "deleted", "mongo_id": "b", "faiss_id": two["faiss_id"]}
    assert keys() == {three["emb_key"]} and [r.song_id for r in store.entries().collect()] == ["a"]
    for call, code in ((lambda: delete_song(store, table, '{"doc_id": "b"}'), "DOC_NOT_FOUND"), (lambda: add_song(store, table, body("c", 3), ppm, None, get), "EMBEDDER_NOT_READY")):
        with pytest.raises(ServiceError) as e:
            call()
        assert e.value.code == code


def test_corrupt_cache_entry(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("a", b"corrupt", 1), ("b", pixmap(picture(1)), 1)], "id string, content binary, number long").write.parquet(path)
    urls = spark.createDataFrame([("a", "http://x/v2"), ("b", "http://x/v9")], "id string, url string")
    got = ImageCache(spark, path).images(urls, lambda u: (200, pixmap(picture(int(u[-1])))), ppm).collect()
    data = {r.id: bytes(r.data) for r in got}
    assert data == {"a": picture(2)[:, :, ::-1].tobytes(), "b": picture(1)[:, :, ::-1].tobytes()}


def test_request_image():
    def late(url: str) -> tuple[int, bytes]:
        raise TimeoutError

    def refused(url: str) -> tuple[int, bytes]:
        raise ConnectionRefusedError("refused")

    cases = [(late, "IMAGE_FETCH_FAILED"), (refused, "IMAGE_FETCH_FAILED"), (lambda u: (500, b""), "IMAGE_FETCH_FAILED"), (lambda u: (200, b"x"), "IMAGE_DECODE_FAILED"), (lambda u: (200, pixmap(picture(1, 63, 80))), "IMAGE_TOO_SMALL")]
    for get, code in cases:
        with pytest.raises(ServiceError) as e:
            request_image("http://x/y", ppm, get)
        assert e.value.code == code
    dark = np.full((64, 64, 3), 32, np.uint8)  # pixels that look like spaces
    assert (ppm(pixmap(dark)) == dark).all()
    assert request_image("http://x/y", ppm, lambda u: (200, pixmap(picture(1)))).shape == (180, 240, 3)
    match = {"id_b": "b", "composite": 0.91234, "verdict": "MICRO_VARIANT", "grid_matrix": [[1.0]], "stages_run": ["metadata"], "elapsed_ms": 1.26}
    body = response(match)
    assert body["grid"]["matrix"] == [[1.0]] and body["stages_run"] == ["metadata"] and body["elapsed_ms"] == 1.3 and body["verdict_description"]


def test_image_functions_against_plain_ones():
    """Resizing, cell hashes and corners as their definitions say, sample by sample, on several sizes."""

    def weights(n_in: int, n_out: int) -> np.ndarray:
        stretch = max(n_in / n_out, 1.0)
        x = (np.arange(n_in)[None] + 0.5 - (np.arange(n_out)[:, None] + 0.5) * n_in / n_out) / stretch
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        return w / w.sum(1, keepdims=True)

    def resized(x: np.ndarray, width: int, height: int) -> np.ndarray:
        return np.einsum("hi,wj,ijc->hwc", weights(x.shape[0], height), weights(x.shape[1], width), x.astype(float), optimize=True).clip(0, 255)

    def corners(grey: np.ndarray) -> set:
        gy, gx = np.gradient(grey)
        near = lambda a, y, x: a[y - 2 : y + 3, x - 2 : x + 3].mean()
        strength = np.zeros(grey.shape)
        for y in range(16, grey.shape[0] - 16):
            for x in range(16, grey.shape[1] - 16):
                m = np.array([[near(gx * gx, y, x), near(gx * gy, y, x)], [0, near(gy * gy, y, x)]])
                strength[y, x] = np.linalg.eigvalsh(m, UPLO="U")[0]
        least = max(strength.max() * 0.01, 1e-6)
        return {(x, y) for y, x in zip(*np.nonzero(strength > least), strict=True) if strength[y, x] >= strength[y - 1 : y + 2, x - 1 : x + 2].max()}

    for seed, (width, height) in enumerate(((70, 90), (97, 61), (32, 40), (20, 90))):
        rgb = picture(seed, width, height)
        grey = imaging.luma(rgb)
        for x in (rgb, np.repeat(rgb[:, :, :1], 3, 2)):
            assert np.allclose(imaging.resized(x, 111, 45), resized(x, 111, 45)) and imaging.resized(x, 111, 45).shape == (45, 111, 3)
        assert np.allclose(imaging.resized(grey, 33, 200), resized(grey[:, :, None], 33, 200)[:, :, 0])
        assert {tuple(p) for p in imaging.corners(grey).astype(int)} == corners(grey)
        h, w = height // 4, width // 4
        each = [imaging.phash(grey[i * h : (i + 1) * h, j * w : (j + 1) * w], 4) for i in range(4) for j in range(4)]
        assert (imaging.cell_hashes(grey, 4, 4) == np.concatenate(each)).all()


def test_images_are_handed_on_a_few_at_a_time():
    from pixkin.operators.features import HANDED_BYTES, framed

    made = []
    rows = ({"id": i, "data": made.append(i) or b"x" * (HANDED_BYTES // 4), "note": None} for i in range(10))
    first = next(frames := framed(rows, ["id", "data", "note"]))
    assert len(made) == len(first) == 4  # the others aren't made yet
    assert [*first.id, *(i for f in frames for i in f.id)] == list(range(10))


def test_weights_are_made_once_a_size():
    assert imaging._lanczos(45, 32) is imaging._lanczos(45, 32) and imaging.dct_matrix(32) is imaging.dct_matrix(32)


def test_warp_align_takes_each_row_once(spark, tmp_path):
    """Rows of one id aren't crossed, and an unknown id doesn't change how the others are written."""
    from pixkin.queries import QUERIES

    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(size=64)]) for i in (1, 2, 2, None)] + [(3, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["warp_align"](spark, str(tmp_path)).collect()
    assert sorted(str(r.pair_id) for r in got) == ["1", "2", "2", "None"]
    assert not any(r.reason.startswith("error") for r in got) and any(r.applied and abs(abs(r.rotation) - 8) < 1 for r in got)


def test_maps_of_fours_are_those_of_least_squares():
    draw = np.random.default_rng(3)
    src = draw.integers(0, 120, (200, 4, 2)).astype(float)
    dst = src + draw.integers(-9, 10, src.shape)
    src[::10, 1] = src[::10, 0]  # two in one place
    for h, a, b in zip(imaging._of_fours(src, dst), src, dst, strict=True):
        plain = imaging.homography(a, b)
        assert (plain is None) == (not np.isfinite(h).all()) and (plain is None or np.allclose(h, plain, rtol=1e-5, atol=1e-8))
    # a shift that most points agree with
    far = np.where(np.arange(60)[:, None] % 5, src[1:16].reshape(60, 2) + [7, -4], 300.0)
    h, good = imaging.ransac(src[1:16].reshape(60, 2), far)
    assert (good == (np.arange(60) % 5 > 0)).all() and np.allclose(h, [[1, 0, 7], [0, 1, -4], [0, 0, 1]], atol=1e-8)


def test_fetched_images_are_kept_once(spark, tmp_path):
    """The last row of an id counts, and no second copy of what was fetched stays beside the cache."""
    cache = ImageCache(spark, str(tmp_path / "c"))
    urls = spark.createDataFrame([(i, f"http://x/v{i}") for i in "1234"], "id string, url string")
    small, odd = pixmap(picture(9, 120, 90)), b"no image"
    get = lambda u: (200, {"3": small, "4": odd}.get(u[-1], pixmap(picture(int(u[-1])))))
    for _ in range(2):
        got = {r.id: r.data for r in cache.images(urls, get, ppm, 2).collect()}
        assert {i for i in got if got[i] is not None} == {"1", "2"} and bytes(got["1"]) == picture(1)[:, :, ::-1].tobytes()
        assert sorted(r.id for r in spark.read.parquet(cache.path).collect()) == ["1", "2"]
    newer = spark.createDataFrame([("1", pixmap(picture(7)), 2**62), ("1", pixmap(picture(7)), 2**62)], "id string, content binary, number long")
    newer.write.mode("append").parquet(cache.path)
    assert sorted((r.id, bytes(r.content)) for r in cache.read().collect()) == [("1", pixmap(picture(7))), ("2", pixmap(picture(2)))]
    assert [p.name for p in tmp_path.iterdir()] == ["c"]


def test_pixels_go_deflated_through_joins(spark):
    from pixkin.operators.features import deflated

    data = picture(1).tobytes()
    rows = spark.createDataFrame([(1, data), (2, None), (3, b"")], "id int, data binary")
    got = {r.id: r.data for r in deflated(rows, "data").collect()}
    assert got[2] is None and {i: zlib.decompress(got[i]) for i in (1, 3)} == {1: data, 3: b""} and len(got[1]) < len(data)


def test_canonical_pixels_stay_where_they_are_embedded(spark):
    from pixkin.operators.embedding import Provider

    def load():
        return lambda images: (images.mean(axis=(1, 2)), images[:, :2, :3].reshape(len(images), 2, 9) + 1.0)

    df = spark.createDataFrame([("a", picture(1)[:, :, ::-1].tobytes(), 240, 180, 3), ("b", b"1", 240, 180, 3)], "id string, data binary, width int, height int, nChannels int")
    out = extract_features(df, embed=Provider(load, 3))
    assert "pixels" not in out._jdf.queryExecution().toString() and "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    got = {r.id: r for r in out.collect()}
    assert len(got["a"].cls) == 3 and len(got["a"].patches) == 18 and got["a"].error is None and got["b"].error.startswith("ValueError") and got["b"].cls is None
