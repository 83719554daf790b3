"""The pipeline's stages one by one against brute-force versions, on a table with nulls, empty and very long
texts, copies, near copies, secrets, ties and repeated rows; and rules of planted accuracies."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pixkin.llm import packing, quality
from pixkin.llm.shared import written

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def rows():
    draw = random.Random(12)
    vocabulary = [a + b + c for a in "bdflmt" for b in ("a", "en", "or") for c in ("ing", "ed", "s", "ly")]
    prose = lambda n: " ".join(draw.choice(vocabulary) + ("." if i % 12 == 11 else "") for i in range(n))
    texts = [prose(draw.randint(55, 220)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[4] + " tail", texts[5].replace(" ", "\n", 3), texts[6] + " " + prose(200), texts[7].upper()]
    texts += [prose(30), "", None, "same words here " * 40, prose(6000), prose(80) + " password: hunter2222 and AKIA" + "Q7" * 10, prose(70) + " " + "ab12" * 8]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return out + [(None, prose(90), "en", "s1", 1)] * 2 + [out[8], (9, prose(60), "en", "s2", 3)]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame(rows(), KIND).repartition(3)
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], ""), "stage"))
    return [[r.asDict() for r in x.collect()] for x in kept]


def key(r):
    return tuple(str(r[c]) for c in ("doc_id", "text", "lang", "source", "n_chars"))


def test_quality_rules(stages):
    before, after = stages[:2]
    left = Counter(map(key, before))
    assert not Counter(map(key, after)) - left
    gone = left - Counter(map(key, after))
    for r in before:
        w = words(r["text"])
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        if len(w) < 50 or 100 * len(cover) > 50 * len(w):
            assert gone[key(r)] == left[key(r)]
    # plain prose stays, all of it
    assert {key(r) for r in before if r["doc_id"] is not None and r["doc_id"] < 60} <= {key(r) for r in after}


def test_near_duplicates(stages):
    before, after = stages[1:3]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = [(r, {tuple(words(low(r["text"]))[i : i + 5]) for i in range(len(words(r["text"])) - 4)}) for r in before]
    least = {r["doc_id"]: r["doc_id"] for r, _ in sets if r["doc_id"] is not None}
    links = [(a["doc_id"], b["doc_id"]) for a, x in sets for b, y in sets if None not in (a["doc_id"], b["doc_id"]) and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    want = {key(r) for r, _ in sets if r["doc_id"] is None or least[r["doc_id"]] == r["doc_id"]}
    assert {key(r) for r in after} == want
    assert Counter(key(r) for r in after if r["doc_id"] is not None).most_common(1)[0][1] == 1


def test_secrets(stages):
    before, after = stages[2:4]
    assign = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
    clean = lambda t: re.sub(r"[0-9a-f]{24,}", "[hex]", re.sub(r"AKIA[A-Z0-9]{16,}", "[access]", re.sub(assign, "[assign]", t)))
    want = Counter((r["doc_id"], clean(r["text"]), len(clean(r["text"]))) for r in before)
    assert Counter((r["doc_id"], r["text"], r["n_chars"] if clean(r["text"]) == r["text"] else -1) for r in after) == want
    texts = [r["text"] for r in after]
    assert sum("[assign]" in t and "[access]" in t for t in texts) == 1 and sum("[hex]" in t for t in texts) == 1


def test_mixing(stages):
    before, after = stages[3:5]
    size = lambda rs: {s: sum(len(words(r["text"])) for r in rs if r["source"] == s) for s in {r["source"] for r in rs}}
    had, has = size(before), size(after)
    order = sorted(had, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # shares above three times a source's size are cut and the rest is dealt anew
        left = sum(had.values()) - sum(target.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * had[s]}
        if not over:
            break
        target |= {s: 3 * had[s] for s in over}
        open_ -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    longest = max(len(words(r["text"])) for r in before)
    for s in order:
        assert abs(has.get(s, 0) - target[s]) <= longest
    copies, rows_ = Counter(map(key, after)), Counter(map(key, before))
    assert set(copies) <= set(rows_) and all(n <= 3 * rows_[k] for k, n in copies.items())


def test_packing(stages):
    before, after = stages[4:6]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in before:
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        want[str(r["doc_id"]), len(ids), zlib.crc32(ids.tobytes()) if len(ids) <= 1024 else None] += 1
    whole = Counter()
    pieces = defaultdict(list)
    for r in after:
        if r["piece"] == 0 and r["length"] < 1024 and not any(x["doc_id"] == r["doc_id"] and x["piece"] for x in after):
            whole[str(r["doc_id"]), r["length"], r["ids_crc32"]] += 1
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(want[k] == n for k, n in whole.items()) and sum(r["length"] for r in after) == sum(k[1] * n for k, n in want.items())
    for placed in pieces.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))] and sum(n for _, n in placed) <= 1024
    assert len(pieces) <= -(-sum(r["length"] for r in after) // 1024) * 1.25 + 1


def test_planted_accuracies(spark):
    """Votes drawn with known accuracies: EM finds the classes and how often each rule is right."""
    draw = np.random.default_rng(6)
    names = list(quality.RULES)
    accuracy = {n: a for n, a in zip(names, (0.95, 0.9, 0.9, 0.85, 0.8, 0.8, 0.75), strict=True)}
    good = draw.random(6000) < 0.7
    votes = []
    for g in good:
        own = [0 if draw.random() < 0.2 else (1 if g else -1) * (1 if draw.random() < accuracy[n] else -1) for n in names]
        votes.append((*own, bool(g)))
    df = spark.createDataFrame([(*map(int, v[:-1]), v[-1]) for v in votes], ", ".join(f"v{i} int" for i in range(len(names))) + ", good boolean")
    patterns = df.groupBy(F.array(*[F.col(f"v{i}") for i in range(len(names))]).alias("votes")).agg(F.count("*").alias("n"), F.count_if("good").alias("good"))
    prior, table = quality.fit_rules(patterns.drop("good"))
    judged = patterns.select("n", "good", quality._posterior(prior, table).alias("p")).collect()
    right = sum(r.good if r.p >= 0.5 else r.n - r.good for r in judged)
    assert abs(prior - 0.7) < 0.05 and right / 6000 > 0.95


def test_empty_table(spark):
    docs = spark.createDataFrame([], KIND)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "stage")
        assert docs.count() == 0, name
