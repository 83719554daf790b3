"""A corpus pipeline over `documents`: quality rules, near duplicates, secrets, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents, whatever further columns
there are, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixkin.llm import jaccard, mixing, packing, quality, secrets
from pixkin.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what fails the base rule or is more likely bad than good.

    Null and empty texts have no words and go; a null doc_id is judged like any other; very long texts are
    counted whole; repeated rows stay as often as they occur; of a tie (one half) the document stays."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 on five-word shingles, the one with
    the smallest doc_id.

    Null and empty texts and rows with a null doc_id are linked with nothing and stay; of rows with one
    doc_id and one text one stays; very long texts are sets like others."""
    return jaccard.one_of_each(docs, width=5, num=80, den=100)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by its kind; n_chars follows the text, and a null one's is null.

    Null and empty texts have no findings; very long texts are scanned whole; repeated rows are cleaned each;
    overlapping findings become one, under the first one's kind."""
    ledger = secrets.new_ledger(spark)
    ledger.update(docs)
    return secrets.without_secrets(docs, ledger).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's target asks for.

    A null source is one of its own; null and empty texts have no size and stay once; the order within a
    source is drawn by hash of doc_id (of the text where that is null), so reruns agree; rows alike share
    their copies as evenly as they divide; a very long text is taken if half of it lies inside the budget."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a document, with its place in a sequence.

    A null or empty text is its end token alone; only texts of more than 1,024 tokens are cut; repeated rows
    and null doc_ids are packed each; which of equally long pieces shares a sequence with which is left open."""
    pieces = packing.token_pieces(docs, packing.default_tokenizer(), digest=True)
    return packing.packed(written(pieces, "pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express expectation-maximisation, components and tokenisation in one query.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return docs
