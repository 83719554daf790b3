"""Cases that the engine's queries once left out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixkin import queries
from pixkin.operators import knn


@pytest.mark.parametrize("mode", ["postfilter", "prefilter"])
@pytest.mark.parametrize("share", [0.05, 0.4])
def test_restricted_search_of_every_query(spark, mode, share):
    draw, k = np.random.default_rng(4), 3
    x = draw.standard_normal((200, 8)).round(2)
    x[150:] = x[:50]  # ties
    ok = draw.random(200) < share
    rows = spark.createDataFrame([(i, v.tolist(), bool(ok[i])) for i, v in enumerate(x)], "id long, cls array<double>, ok boolean")
    got = knn.restricted_each(rows.filter("id % 20 = 0"), rows, rows.filter("ok").select("id"), k, mode, block=64)
    want = set()
    for a in range(0, 200, 20):
        order = sorted(range(200), key=lambda b: (-round(float(x[a] @ x[b]), 9), b))
        if mode == "postfilter":
            order = order[: max(sum(ok) - int(ok[a]), 4 * k)]
        want |= {(a, b, n + 1) for n, b in enumerate([b for b in order if ok[b] and b != a][:k])}
    assert {(r.id_a, r.id_b, r.rank) for r in got.collect()} == want


def test_every_twentieth_row_is_a_query(spark, tmp_path):
    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 1) for _ in range(64)], i % 4) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("embedding", F.transform("embedding", lambda v: (v / 8).cast("float"))).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("knn_restricted_postfilter_each", "knn_restricted_prefilter_each", "check_duplicate_json_each"):
        got = {r.id_a for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got <= set(range(0, 120, 20)) and len(got) > 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_texts_beyond_ascii_are_compared(spark, tmp_path):
    draw = random.Random(2)
    texts = ["", None, "  ", "é", "naïve café", "naive cafe", "日本語", "日本", "😀 a", "plain"]
    texts += ["".join(draw.choice("abéü日😀") for _ in range(draw.randint(0, 12))) for _ in range(150)]
    rows = list(zip(draw.sample(range(1000), len(texts)), texts, strict=True))
    spark.createDataFrame(rows, "item_id long, text string").repartition(5).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, want = sorted(rows), {}
    for (i, a), (_, b) in zip(rows, rows[1:], strict=False):
        a, b = (a or "").strip(), (b or "").strip()
        want[i] = 1.0 if not a and not b else 0.0 if not a or not b else 1 - distance(a, b) / max(len(a), len(b))
    got = {r.item_id: r.ratio for r in queries.QUERIES["levenshtein_ratio"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) == len(texts) - 1
    got = {r.item_id: r.composite for r in queries.QUERIES["ocr_penalty"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({i: max(0, 0.9 - 0.15 * (1 - r)) if 1 - r > 0.3 else 0.9 for i, r in want.items()}, abs=1e-9)
