"""Counts of phrases that a task hands on: one row a phrase, however many shards its text is dealt into."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pixkin.llm import phrases


def test_one_row_a_phrase(monkeypatch):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["a", "bb", "é", "the"]) + draw.choice(["", "", "", "."]) for _ in range(20)) for _ in range(200)]
    langs = [draw.choice(["en", "de", "und"]) for _ in texts]
    batch = pa.RecordBatch.from_pydict({"text": texts + [None], "lang": [*langs, "en"]})
    every = phrases.Sketch([np.full(1 << 13, 255, np.uint8)] * phrases.DEPTH, 16)  # lets all through
    want = Counter()
    for text, lang in zip(texts, langs, strict=True):
        for piece in text.split("."):
            w = piece.split()
            want[lang, ""] += len(w)
            want.update((lang, " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))

    def rows():
        return [(r["lang"], r["phrase"], r["f"]) for x in phrases.partial_counts(iter([batch, batch]), every, every) for r in x.to_pylist()]

    monkeypatch.setattr(phrases, "SHARD_BYTES", 500)
    got = rows()
    assert len(got) == len(want) and {(a, b): f for a, b, f in got} == {k: 2 * f for k, f in want.items()}
    monkeypatch.setattr(phrases, "HELD_BYTES", 4000)  # handed on again and again
    few, total = rows(), Counter()
    for lang, phrase, f in few:
        total[lang, phrase] += f
    assert len(few) > len(want) and total == {k: 2 * f for k, f in want.items()}
    assert list(phrases.partial_counts(iter([]), every, every)) == []


def test_tasks_follow_cores_not_the_text():
    few, many = (phrases.counting_tasks(x << 20, 6) for x in (160, 800))
    assert few == many == 6  # five times the text, and no more rows a phrase
    assert [phrases.counting_tasks(x, 6) for x in (0, 1, phrases.SHARD_BYTES, phrases.SHARD_BYTES + 1)] == [1, 1, 1, 2]
    huge = 100 * 6 * phrases.COUNT_BYTES
    assert phrases.counting_tasks(huge, 6) == 600  # none gets longer than that
