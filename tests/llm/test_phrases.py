"""Collocations against a brute-force count, with a low least count so that small texts have some."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pixkin.llm import phrases


def brute(rows, least, most, share=80):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f[lang].update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        kept = {p: a for p, a in n.items() if " " in p and a >= least}
        longer = Counter()
        for p, a in kept.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    inner = " ".join(w[i : i + k])
                    longer[inner] = max(longer[inner], a)
        found = []
        for p, a in kept.items():
            w = p.split(" ")
            cuts = [(2_000_000 * a // (n[" ".join(w[:k])] + n[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if 100 * longer[p] < share * a:
                found.append((-score, -a, p.encode(), p, n[" ".join(w[:k])], n[" ".join(w[k:])]))
        out += [(lang, i, p, -a, left, right, total[lang], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    words = ["New", "york", "los", "ánge", "x", "xx", "of", "the", "a-b", "日本"]
    prose = lambda n: "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ", ", " \r\n ", "\x0b"]) for _ in range(n))
    out = [(prose(draw.randint(0, 60)), draw.choice(["en", "de", None, "und", ""])) for _ in range(80)]
    out += [("new york city " * 40, "en"), ("aa " * 50, "de"), ("aa aa. aa aa aa", "de"), (None, "en"), ("", "fr"), (" . ", None), (prose(20_000), "long")]
    out += [("the same row of words", "rep")] * 7 + [("t" * 50_000 + " end " + "t" * 50_000 + " end", "long")] * 3
    return out


def test_collocations(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("x") for c in ("phrase", "f", "a", "k", "n", "rank", "doc_id")}).repartition(3)
    for least, most in ((3, 2000), (5, 4)):
        got = phrases.collocations(docs, least, most)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, most)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_counts_of_several_tasks(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 1000)
    tasks, counted = [], phrases.counted
    monkeypatch.setattr(phrases, "counted", lambda *a: tasks.append(a[4]) or counted(*a))
    assert sorted(tuple(r) for r in phrases.collocations(docs, 3).collect()) == brute(rows, 3, 2000)
    assert tasks == [spark.sparkContext.defaultParallelism]


def test_small_shards(spark, rows):
    texts = [t.encode() for t, _ in rows if t]
    for size in (10, 1000):
        assert sum(len(phrases.Words("en", phrases._plain([p])).hash) for t in texts for p in phrases._parts(t, size)) == sum(len(phrases.Words("en", phrases._plain([t])).hash) for t in texts)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "lang": [x or "und" for _, x in rows]})
    count = lambda size: Counter((lang, p.strip(" ")) for lang, plain in phrases.shards(iter([batch]), size) for p in plain.decode().split("\n") if p.strip(" "))
    assert count(50) == count(1 << 22)
