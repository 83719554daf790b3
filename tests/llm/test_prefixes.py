"""The trie of rebuilt conversations against a brute-force one, in one block and in many."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pixkin.llm import prefixes
from pixkin.llm.shared import Scratch

KIND = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    conv = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        conv[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in conv.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = {p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in nodes}
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if len(conv[c]) == len(p))))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    draw = random.Random(4)
    yield [(c, t, draw.choice(["user", "system"]), draw.choice("abé") * draw.randint(1, 2)) for c in range(0, 260, 3) for t in range(draw.randint(1, 7))]
    # a hot conversation, a hot first turn, prefixes of others, null and empty turns, ties, repeated rows
    rows = [(c, t, "user", f"turn {t}") for c in range(40, 90) for t in range(3)] + [(c, t, "user", "hi" if t == 0 else f"{c} {t}") for c in range(200, 240) for t in range(4)]
    rows += [(300, None, None, None), (300, None, "", ""), (300, 0, "user", None), (301, 1, "a", "x"), (301, 1, "a", "x"), (301, 1, "b", "w"), (None, 1, "user", "lost"), (401, 0, "user", "é" * 100_000)]
    yield rows + [(500, t, "user", str(t % 2)) for t in range(300)] + [(501, t, "user", str(t % 2)) for t in range(290)]
    yield [(0, 0, "user", "one"), (1, 0, "user", "one")]
    yield [(c, t, None, None) for c in range(30) for t in range(c % 4 + 1)]


@pytest.mark.parametrize("case", range(4))
def test_trie(spark, case):
    rows = list(cases())[case]
    want = brute(rows)
    turns = spark.createDataFrame(rows, KIND).repartition(3)
    assert sorted((tuple(r) for r in prefixes.prefix_trie(turns).collect()), key=str) == want
    for blocks in (2, 7, 40):
        scratch = Scratch(spark)
        convs = scratch.table(prefixes.rebuilt(turns, scratch), "conversations")
        assert sorted((tuple(r) for r in prefixes.trie_of(convs, blocks, scratch).collect()), key=str) == want, blocks


def test_empty_and_other_columns(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], KIND)
    assert prefixes.prefix_trie(none).count() == 0
    rows = list(cases())[2]
    turns = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("sign", "size", "key", "base", "h", "block", "depth", "edge")})
    assert sorted((tuple(r) for r in prefixes.prefix_trie(turns).collect()), key=str) == brute(rows)
