"""The batch run's report and counts, places without one task for all, transforms and JSON records."""

import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixkin.functions import imaging, records, report, transform
from pixkin.operators.ranking import numbered
from pixkin.plans import batch


def test_places_in_a_total_order(spark):
    draw = random.Random(3)
    rows = [(i, 1.0 if i % 3 == 0 else round(draw.random(), 2), draw.choice(["a", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, composite double, other string").repartition(5)
    order = [F.desc("composite"), F.col("id")]
    for tasks in (1, 7, None):
        got = sorted((r.place, r.id, r.other) for r in numbered(df, order, tasks=tasks).collect())
        assert got == [(n + 1, i, o) for n, (i, _, o) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))]
    assert numbered(df.limit(0), order).count() == 0


def test_report_pages(spark, tmp_path):
    rows = [(f"<{i}>", f"b{i}", i / 100, "MICRO_VARIANT" if i % 2 else "DISTANT", 0.5, [[0.1, 1.0]], f"https://x/{i}?a&b", i % 2 == 0, 1.5, -3.0, "scale") for i in range(57)]
    kind = "id_a string, id_b string, composite double, verdict string, hash_ensemble double, grid_matrix array<array<double>>, thumb_a string, align_applied boolean, align_scale double, align_rotation_deg double, align_reason string"
    pages = batch.write_report(spark.createDataFrame(rows, kind).repartition(4), str(tmp_path), "A & B", page_rows=20)
    assert sorted(tuple(r) for r in pages.collect()) == [(1, 20, 0.56, 0.37), (2, 20, 0.36, 0.17), (3, 17, 0.16, 0.0)]
    for page, first in ((1, 56), (2, 36), (3, 16)):
        (file,) = Path(tmp_path, "html", f"page={page}").glob("part-*")
        text = file.read_text()
        assert text.startswith("<!DOCTYPE html>") and "A &amp; B" in text and "57 pairs, best 0.5600" in text
        assert text.count("<tr><td>") == (20 if page < 3 else 17)
        assert text.index(f"&lt;{first}&gt;") < text.index(f"&lt;{first - 1}&gt;") and "<5" not in text
        assert ("../page=2/" in text) == (page != 2) and f"https://x/{first}?a&amp;b" in text and "scale 1.500, -3.0 degrees" in text and "hsl(12,70%,50%)" in text
    lines = [json.loads(x) for f in sorted(Path(tmp_path, "json").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["id_b"] for x in lines] == [f"b{i}" for i in range(56, -1, -1)]
    none = batch.write_report(spark.createDataFrame([], kind), str(tmp_path / "none"))
    assert none.count() == 0


def test_coldest_cell():
    assert report.coldest([[0.9, 0.5 + 5e-7], [0.5, 0.7]]) == (0, 1, 0.5 + 5e-7)
    assert report.coldest([[0.9, 0.8]]) is None
    row = {"id_a": "a", "id_b": "b", "composite": 0.9, "verdict": "DISTANT", "grid_matrix": [[0.2, 1.0]], "align_applied": False, "align_reason": "scale", "stages_run": ["metadata"]}
    text = report.terminal_report(row)
    assert "coldest cell (0, 0): 0.200" in text and "alignment: scale" in text and "stages: metadata" in text


def test_transform(spark):
    draw = np.random.default_rng(1)
    x = draw.uniform(0, 255, (20, 8, 8))
    df = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    spectrum = transform.dct2(transform.split_rows(F.col("x"), 8, 8), 8, 8)
    out = df.select("id", spectrum.alias("c"), transform.band_energies(spectrum, 8).alias("b"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        assert np.allclose(np.array(r.c).T, imaging.dct2(x[r.id])) and np.allclose(r.b, imaging.band_energies(x[r.id], 8))


def test_records(spark):
    lines = ['{"id": 1, "name": "a"}', '{"id": 2', "[1]", "", None, '{"id": "x"}', '{"name": "b", "more": 3}', "null"]
    df = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    got = {r.n: (r.id, r.name, r[records.CORRUPT] is not None) for r in records.parsed(df, "line", "id long, name string").collect()}
    assert got[0] == (1, "a", False) and got[6] == (None, "b", False)
    assert all(got[i][2] for i in (1, 3, 4, 5)) and all(got[i][0] is None for i in (1, 2, 3, 4, 5, 7))
    good = df.filter("n IN (0, 6)")
    assert records.parsed(good, "line", "id long, name string", strict=True).count() == 2
    for bad in (1, 3, 5):
        with pytest.raises(Exception, match="no object of the schema"):
            records.parsed(df.filter(F.col("n").isin(0, bad)), "line", "id long, name string", strict=True).collect()
