"""Pruned neighbour search, joins of signatures within a radius, and descriptor matching, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixkin import queries
from pixkin.functions.signatures import differing, differing_in_runs, pack, packed, unpacked
from pixkin.operators import knn, matching, radius


def rows_of(spark, x, ids=None, kind="long"):
    return spark.createDataFrame([(i, None if v is None else [float(c) if c is not None else None for c in v]) for i, v in zip(ids or range(len(x)), x, strict=True)], f"id {kind}, cls array<double>").repartition(3)


def clustered(n, clusters, seed=3, d=16):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(clusters, d))
    return (middle[draw.integers(0, clusters, n)] + 0.05 * draw.normal(size=(n, d))).round(3)


def best(x, k, ids, asked=None):
    out = set()
    for a in range(len(x)) if asked is None else asked:
        score = [(-float((x[a] * x[b]).sum()), ids[b]) for b in range(len(x)) if b != a]
        out |= {(ids[a], b, n + 1) for n, (_, b) in enumerate(sorted(score)[:k])}
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_neighbours_with_ties_and_copies(spark, kind):
    x = clustered(300, 6)
    x[200:] = x[3]  # a third is one vector
    ids = [str(i) for i in range(300)] if kind == "string" else list(range(300))
    rows = rows_of(spark, x, ids, kind)
    got = {(r.id_a, r.id_b, r.rank) for r in knn.knn_self(rows, 5, block=24).collect()}
    assert got == best(x, 5, ids)
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(300) for j in range(i) if float((x[i] * x[j]).sum()) >= 12}
    pairs = [(r.id_a, r.id_b) for r in knn.pairs_above(rows, 12.0, block=24).collect()]
    assert set(pairs) == want and len(pairs) == len(want)


def test_far_blocks_are_not_met(spark):
    met = {}
    for n in (500, 2000):
        x, report = clustered(n, n // 50), {}
        got = {(r.id_a, r.id_b, r.rank) for r in knn.knn_self(rows_of(spark, x), 5, block=50, report=report).collect()}
        assert got == best(x, 5, list(range(n)))
        assert report["queries"] == n and report["blocks"] >= n // 50
        met[n] = report["met"] / (report["blocks"] * n)
        above: dict = {}
        knn.pairs_above(rows_of(spark, x), float(np.sort((x**2).sum(1))[-20]), block=50, report=above)
        assert above["met"] < 0.3 * above["blocks"] * n
    # the share that is met falls as clusters are added: the work grows less than quadratically
    assert met[2000] < 0.6 * met[500] and met[500] < 0.5


def test_missing_vectors(spark):
    x = [list(v) for v in clustered(60, 4)]
    odd = {3: None, 7: [], 11: x[11][:5], 20: [None] + x[20][1:], 21: [float("nan")] + x[21][1:], 22: [float("inf")] + x[22][1:]}
    all_rows = rows_of(spark, [odd.get(i, v) for i, v in enumerate(x)])
    kept = [i for i in range(60) if i not in odd]
    good = np.array([x[i] for i in kept])
    assert {(r.id_a, r.id_b, r.rank) for r in knn.knn_self(all_rows, 3, block=8).collect()} == best(good, 3, kept)
    pairs = {(r.id_a, r.id_b) for r in knn.pairs_above(all_rows, 5.0, block=8).collect()}
    assert pairs == {(kept[j], kept[i]) for i in range(len(kept)) for j in range(i) if (good[i] * good[j]).sum() >= 5.0}
    near = knn.restricted_each(all_rows, all_rows, all_rows.filter("id < 30").select("id"), 3, block=8)
    assert {r.id_a for r in near.collect()} <= set(kept)
    for none in (all_rows.limit(0), all_rows.filter("id = 3")):
        assert knn.knn_self(none, 3).count() == 0 and knn.pairs_above(none, 0.0).count() == 0


def test_queries_without_some_vectors(spark, tmp_path):
    """The queries' SQL on a table with null, empty, odd and broken vectors."""
    import duckdb

    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 1) / 8 for _ in range(64)], i % 4) for i in range(120)]
    broken = {2: None, 5: [], 9: [1.0] * 3, 40: [None] + rows[40][1][1:], 41: [float("nan")] + rows[41][1][1:]}
    rows = [(i, broken.get(i, v), label) for i, v, label in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("knn_topk", "all_pairs_coarse", "candidate_pairs", "knn_restricted_prefilter_each", "knn_restricted_postfilter_each", "find_duplicates", "hash_radius", "descriptor_matches", "composite_verdict_query"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        show = lambda found: sorted(tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in found)
        assert show(got.select(columns).collect()) == show(sql.sql(queries.SQL[name]).project(", ".join(columns)).fetchall()), name


def test_signatures(spark):
    draw = np.random.default_rng(5)
    bits = draw.integers(0, 2, (40, 2, 128))
    df = spark.createDataFrame([(a.tolist(), b.tolist(), pack(a).tolist()) for a, b in bits], "a array<int>, b array<int>, p array<long>")
    a, b = packed(F.col("a")), packed(F.col("b"))
    out = df.select("p", a.alias("q"), unpacked(a).alias("u"), "a", differing(a, b, 128).alias("d"), *[F.array(*differing_in_runs(a, b, 128 // n, n)).alias(f"r{n}") for n in (4, 64, 128)]).collect()
    for r, (x, y) in zip(out, bits, strict=True):
        assert r.p == r.q and r.u == r.a and r.d == (x != y).sum()
        for n in (4, 64, 128):
            assert r[f"r{n}"] == (x != y).reshape(-1, n).sum(1).tolist()


@pytest.mark.parametrize("radius_", [0, 1, 3, 9])
def test_radius_join(spark, radius_):
    draw = np.random.default_rng(7)
    base = draw.integers(0, 2, (12, 128))
    bits = np.array([b ^ (draw.random(128) < share) for b in base for share in (0, 0, 0.01, 0.02, 0.05, 0.1)])
    rows = spark.createDataFrame([(i, pack(x).tolist()) for i, x in enumerate(bits)] + [(900, None)], "id long, signature array<long>").repartition(3)
    classes = radius.signature_classes(rows)
    first = {}
    for i, x in enumerate(bits):
        first.setdefault(x.tobytes(), i)
    assert sorted((r.class_id, r.rows) for r in classes.collect()) == sorted((i, sum(x.tobytes() == k for x in bits)) for k, i in first.items())
    want = {(i, j, int((bits[i] != bits[j]).sum())) for i in first.values() for j in first.values() if i < j and (bits[i] != bits[j]).sum() <= radius_}
    found = [tuple(r) for r in radius.within_radius(classes, 128, max(radius_, 2)).filter(f"apart <= {radius_}").collect()]
    assert set(found) == want and len(found) == len(want)


def test_descriptor_matches(spark):
    draw = np.random.default_rng(2)
    points = {i: draw.integers(0, 2, (n, 256)) for i, n in enumerate((6, 5, 1, 0, 7))}
    points[1][:3] = points[0][:3] ^ (draw.random((3, 256)) < 0.05)
    rows = [(i, p, pack(x).tolist()) for i, marks in points.items() for p, x in enumerate(marks)] + [(0, 99, None)]
    marks = spark.createDataFrame(rows, "id long, point long, descriptor array<long>").repartition(3)
    pair = spark.createDataFrame([(a, b) for a in range(5) for b in range(5) if a != b], "id_a long, id_b long")
    got = {(r.id_a, r.id_b, r.point_b): (r.point_a, r.d1, r.d2, r.good) for r in matching.descriptor_matches(pair, marks, 256, 0.75).collect()}
    want = {}
    for a, x in points.items():
        for b, y in points.items():
            for j, v in enumerate(y) if a != b and len(x) > 1 else ():
                (d1, i), (d2, _), *_ = sorted((int((u != v).sum()), i) for i, u in enumerate(x))
                want[a, b, j] = (i, d1, d2, d1 < 0.75 * d2)
    assert got == want and sum(v[3] for k, v in want.items() if k[:2] == (0, 1)) == 3
    counts = {(r.id_a, r.id_b): (r.good_matches, r.alignable) for r in matching.match_counts(matching.descriptor_matches(pair, marks, 256, 0.75), 3).collect()}
    assert counts[0, 1] == (3, True) and not counts[0, 4][1]
