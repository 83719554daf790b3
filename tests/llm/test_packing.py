"""Token ids of the packing operator against the tokenizer's own."""

import json
import random
from struct import unpack

import pytest
from tokenizers import Tokenizer

from pixkin.llm import packing

PATH = packing.default_tokenizer()


def ids_of(table, texts):
    return [list(unpack(f"<{len(x) // 4}I", x)) for x in table(texts)]


def plain(path, texts):
    return [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    odd = ["the", "Straße", "日本", " ", "  ", "\n", "\t", " ", "Ġ", "ñu", "x" * 80, "...", "!?", "123", "²", "½", "'s", "don't", "\U00010330", "😀", "<|endoftext|>", "\x1c", " ", "é", "١٢"]
    out = ["".join(draw.choice(odd[:20] if i % 2 else odd[:14]) + draw.choice(["", "", " ", ", "]) for _ in range(draw.randint(0, 40))) for i in range(300)]
    out += ["".join(draw.choice(odd) for _ in range(20)) for _ in range(100)]
    every = [chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
    return out + odd + ["a".join(every[i : i + 32]) for i in range(0, len(every), 32)] + [" ".join(every[i : i + 32]) for i in range(0, len(every), 32)] + [""]


def test_ids(texts, monkeypatch):
    want = plain(PATH, texts)
    assert ids_of(packing.PartIds(PATH), texts) == want
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 20)  # the table starts anew again and again
    table = packing.PartIds(PATH)
    assert ids_of(table, texts) == want and len(table) <= 20 and len(table.old) <= 20


def test_new_words_take_the_short_way():
    words = "Bonjour the Straße ñandú 日本 oumentier".split()
    want = plain(PATH, [" ".join(words)])
    table = packing.PartIds(PATH)
    table.tokenizer = None
    assert ids_of(table, [" ".join(words)]) == want


def test_other_tokenizers(texts, tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    byte_level = spec["pre_tokenizer"]
    for i, change in enumerate(({"pre_tokenizer": byte_level | {"add_prefix_space": True}}, {"pre_tokenizer": byte_level | {"use_regex": False}}, {"normalizer": {"type": "Lowercase"}})):
        path = str(tmp_path / f"{i}.json")
        json.dump(spec | change, open(path, "w", encoding="utf-8"))
        some = [*texts[:100], "The same, the Same."]
        assert ids_of(packing.PartIds(path), some) == plain(path, some)


def test_a_task_leaves_no_table_behind(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:200])], "doc_id long, text string").repartition(3)
    pieces = packing.token_pieces(docs, PATH).sort("doc_id", "piece").collect()
    assert [r["ids"][:-1] for r in pieces if r["piece"] == 0] == plain(PATH, texts[:200])
    path = PATH

    def held(batches):
        import pyarrow as pa

        table = packing._part_ids(path)
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"held": [len(table) + len(table.old)]})

    after = spark.range(8, numPartitions=8).mapInArrow(held, "held long").collect()
    assert len(after) == 8 and not any(r["held"] for r in after)
