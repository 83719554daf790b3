"""Further columns whose names an operator uses itself come back as they were."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixkin.llm import jaccard, mixing, quality, secrets

NAMES = """n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_shouts n_stops votes base_failed quality kept row
_text _words _lines sha256 some blob found run start end kind path mix_key mix_who mix_row mix_copies mix_rows mix_line mix_salt mix_rank mix_n
own_sum base_sum src size draw range before epochs rest taken target _row _n _key _id wanted bitmap_part bitmap_at bitmap_bits
n one two free parity tokens rep component_id n_shingles""".split()


@pytest.fixture(scope="module")
def docs(spark):
    word = lambda i, k: f"w{(i * 7919 + k * 104729) % 997}"
    texts = [" ".join(word(i, k) + ("." if k % 9 == 8 else "") for k in range(80)) for i in range(6)]
    rows = [(i, t, "s0") for i, t in enumerate(texts)] + [(6, texts[0], "s1"), (7, texts[1] + " password: hunter22", "s1"), (None, texts[2], None), (8, None, "s1"), (9, "", "s0"), (3, texts[3], "s0")]
    out = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return out.select("*", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), *[F.concat(F.lit(c + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in NAMES])


def unchanged(out, docs):
    assert out.columns == docs.columns
    wrong = [F.count_if(~F.col(c).eqNullSafe(F.concat(F.lit(c + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))).alias(c) for c in NAMES]
    assert set(out.agg(*wrong).first()) == {0}


def test_quality(docs):
    unchanged(quality.good_documents(docs), docs)
    judged = quality.judged(docs)
    assert judged.filter("kept_ <> concat('kept/', coalesce(cast(doc_id as string), '-'))").count() == 0 and judged.schema["kept"].dataType.simpleString() == "boolean"


def test_near_duplicates(docs):
    out = jaccard.one_of_each(docs)
    unchanged(out, docs)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.select("doc_id").collect()) == [-1, 0, 1, 2, 3, 4, 5, 8, 9]


def test_secrets(spark, docs):
    ledger = secrets.new_ledger(spark)
    ledger.update(docs)
    out = secrets.without_secrets(docs, ledger)
    unchanged(out, docs)
    assert out.filter("doc_id = 7").first().text.endswith("[assign]") and out.count() == docs.count()


def test_mixing(docs):
    unchanged(mixing.mixed_documents(docs), docs)


def test_stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs_out = stage(spark, docs, "")
        assert docs_out.columns == docs.columns, name
