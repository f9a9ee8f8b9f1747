"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows as Parquet in
the shared folder and reads them back for the next.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestore.llm.langid import known_language
from lodestore.llm.mixing import mix
from lodestore.llm.packing import pack_documents
from lodestore.llm.simhash import row_mark, simhash_survivors
from lodestore.llm.substring_dedup import substring_dedup
from lodestore.session import run_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Sources by code point weigh these, repeating; a document may be repeated up to three times.
WEIGHTS = (1, 2, 3)
SEQUENCE = 1024


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is not rejected.

    Null and letterless texts go, and texts that look like no language of the labelled ones; rows are judged one by one.
    """
    return known_language(_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that with the smallest doc_id, null last; of rows equal in doc_id and text one."""
    first = simhash_survivors(docs)
    rows = docs.withColumn("mark", row_mark()).join(first, "mark", "left_semi")
    one = F.row_number().over(Window.partitionBy("mark").orderBy("lang", "source", "n_chars"))
    return _columns(rows.withColumn("_one", one).where("_one = 1"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the words under repeated 13-word windows out of the texts; texts without a word left go.

    A null doc_id counts as the largest; rows of one doc_id do not count as earlier than each other.
    """
    rows = substring_dedup(docs, with_text=True, keep=("lang", "source")).where("n_words > n_removed")
    return rows.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in training order: by part file, and by row in it.

    Null texts have no size; rows of a null source are a source of their own; repeated rows are taken one by one.
    """
    return _columns(mix(docs, weights=WEIGHTS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with ids, sequence and offset; those of a length take its places in training order.

    The order is that of the files the stage before wrote: the number of the part, and the row in it.  A null text is
    empty and still has its end id; repeated rows are documents of their own; an empty table gives no pieces.
    """
    part = F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).cast("long")
    rows = docs.select("doc_id", "text", F.coalesce(part, F.lit(0)).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return pack_documents(rows, sequence=SEQUENCE, order=("_file", "_row"), with_ids=True)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("curriculum_mix", mixture),
    ("pattern_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Subword models, XXH64 fingerprints and tokenizer ids are beyond SQL; tests/llm/test_pipeline.py has a plain model.
ORACLE_SQL = None
