"""The language model: base columns against brute force, a proper distribution, sums of gradients against a
plain loop over tokens, and better scores on held-out texts than the unigram model's."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixkin.llm import lm


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def is_held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    follow = {w: [f"v{draw.randrange(120)}" for _ in range(3)] for w in (f"v{i}" for i in range(120))}

    def prose(n):
        out = ["v0"]
        for _ in range(n):
            out.append(draw.choice(follow[out[-1]]) if draw.random() < 0.9 else f"Rare{draw.randrange(3000)}")
            if out[-1] not in follow:
                out.append("v1")
        return " ".join(out)

    out = [(i, prose(draw.randint(1, 120))) for i in range(400)] + [(7, prose(10)), (7, prose(10)), (None, "v1 V2 lost"), (1000, None), (1001, ""), (1002, "é" * 50_000), (1003, prose(30_000))]
    return out + [(8, "the same row")] * 5


def test_scores(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "word", "words", "c", "n", "base", "model", "round", "held_out")}).repartition(3)
    got = lm.scores(docs)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    c = Counter(w for i, t in rows if not is_held_out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), is_held_out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t in rows)
    found = got.collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    out = [r for r in found if r.held_out and r.n_tokens > 5]
    assert len(out) > 20 and sum(r.score - r.base_score for r in out) > 0.3 * sum(r.n_tokens for r in out)
    assert all(r.score <= 0 for r in found)
    assert lm.scores(docs.limit(0)).count() == 0
    assert [tuple(r)[1:] for r in lm.scores(docs.filter("doc_id IS NULL")).collect()] == [(True, 4, 0, 0, 0.0, 0.0)]


def test_few_top_words(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    whole = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.scores(docs).collect())
    monkeypatch.setattr(lm, "TOP", 50)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.scores(docs).collect()) == whole


def model_of(texts):
    tokens = np.concatenate([t for _, _, t, _ in lm.tokens_of(pa.array(texts))])
    found, c = np.unique(tokens, return_counts=True)
    order = np.lexsort((found, -c))[:400]
    return lm.Model(found[order], c[order], (found, c), int(c.sum()), len(c))


def test_distribution_and_sums(rows):
    texts = [t for _, t in rows[:60]]
    model = model_of(texts)
    draw = np.random.default_rng(1)
    model.class_weights += draw.normal(0, 0.5, model.class_weights.shape).astype(np.float32)
    model.word_weights += draw.normal(0, 0.5, model.word_weights.shape).astype(np.float32)
    # of all classes and words in them after one context, and the unigram model without weights
    (_, _, tokens, of), *_ = lm.tokens_of(pa.array(texts[:1]))
    context = lm._contexts(tokens, of)[:, 3]
    at = (lm.mix(context, 31) >> np.uint64(64 - lm.CLASS_ROWS)).astype(int)
    logits = model.class_bias + model.class_weights[at].sum(0)
    classes = np.exp(logits) / np.exp(logits).sum()
    total = 0.0
    for k in range(lm.CLASSES - 1):
        at = (lm.mix(context ^ lm.mix(np.array([k], np.uint64), 41), 42) >> np.uint64(64 - lm.WORD_ROWS)).astype(int)
        logits = model.word_bias[k] + model.word_weights[at].sum(0)
        if logits.max() > -1e8:
            total += (classes[k] * np.exp(logits) / np.exp(logits).sum()).sum()
    assert abs(total + classes[-1] - 1) < 1e-4
    batch = lm.sums(model, iter([pa.array(texts[:30]), pa.array(texts[30:60])]))
    expected, seen = np.zeros(model.class_weights.shape), np.zeros(model.class_weights.shape)
    for r in batch.to_pylist():
        if r["range"] < lm.RANGES:
            first = r["range"] * (len(expected) // lm.RANGES)
            expected[first + np.frombuffer(r["rows"], "<i4")] += np.frombuffer(r["expected"], "<f4").reshape(-1, lm.CLASSES)
            seen[first:].reshape(-1)[np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["seen"], "<f4")
    want, want_seen = np.zeros_like(expected), np.zeros_like(seen)
    for text in texts:
        (_, _, tokens, of), *_ = lm.tokens_of(pa.array([text]))
        context, place = lm._contexts(tokens, of), model.places(tokens)
        for i in range(len(tokens)):
            at = (lm.mix(context[:, i], 31) >> np.uint64(64 - lm.CLASS_ROWS)).astype(int)
            logits = (model.class_bias + model.class_weights[at].sum(0)).astype(float)
            p = np.exp(logits - logits.max())
            for row in at:
                want[row] += p / p.sum()
                want_seen[row, place[i] // lm.WORDS] += 1
    assert np.allclose(expected, want, rtol=1e-3, atol=1e-4) and (seen == want_seen).all()
    (update,) = [b for b in lm.stepped(model, iter([batch])) if b.column("range")[0].as_py() == 0]
    new = np.frombuffer(update.column("weights")[0].as_py(), "<f4").reshape(-1, lm.CLASSES)
    part = slice(0, len(expected) // lm.RANGES)
    assert np.allclose(new, model.class_weights[part] + lm.STEP / lm.FEATURES * np.log((seen[part] + lm.PRIOR) / (want[part] + lm.PRIOR)), atol=1e-3)
