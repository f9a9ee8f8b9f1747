"""Readers and writers: records, manifests, label files, vectors, compressed JSON lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "dataset string, split string, index long, question string, choices array<string>, options array<string>, answer string, context string, hint string, lecture string, subject string, topic string, category string, image string, image_path string"
ENTRY = "id string, canvas_path string, text string, metadata map<string,string>, image_embedding_path string, text_embedding_path string, access_count long, quality_level int, deleted boolean"


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """JSON lines, plain or gzipped; blank lines are passed over."""
    return spark.read.schema(schema).json(path).where(F.coalesce(*[F.col(f"`{c}`").cast("string") if not t.startswith(("array", "map")) else F.to_json(c) for c, t in _fields(spark, schema)]).isNotNull())


def _fields(spark: SparkSession, schema: str) -> list[tuple[str, str]]:
    return spark.createDataFrame([], schema).dtypes


def read_json_document(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """One JSON document: a list of records, or an object with the list under train, data or examples."""
    text = spark.read.text(path, wholetext=True).select(F.col("value"))
    item = f"array<struct<{', '.join(f'{c}:{t}' for c, t in _fields(spark, schema))}>>"
    wrapped = F.from_json("value", f"train {item}, data {item}, examples {item}")
    plain = F.from_json("value", item)
    rows = F.when(F.ltrim("value").startswith("["), plain).otherwise(F.coalesce(wrapped["train"], wrapped["data"], wrapped["examples"], F.raise_error(F.lit("no list of records")).cast(item)))
    return text.select(F.inline(rows))


def load_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    return read_jsonl(spark, path, schema) if path.rstrip("/").endswith((".jsonl", ".jsonl.gz")) else read_json_document(spark, path, schema)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Bank entries, a JSON object a line; the last of a repeated id counts, at the place of the first."""
    from lodestore.operators.memory import last_wins

    lines = spark.read.text(path).where(F.trim("value") != "")
    # ordinals by file and position: only needed to order repeated ids and listings
    rows = lines.select(F.monotonically_increasing_id().alias("ord"), F.from_json("value", ENTRY).alias("e")).select("ord", "e.*")
    rows = rows.select("id", "canvas_path", "text", "metadata", "image_embedding_path", "text_embedding_path", F.coalesce("access_count", F.lit(0)).alias("access_count"), F.coalesce("quality_level", F.lit(0)).alias("quality_level"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "ord")
    return last_wins(rows)


def write_manifest(bank: DataFrame, path: str) -> None:
    bank.orderBy("ord").drop("ord").write.mode("overwrite").json(path)


def parse_labels(lines: DataFrame, strict: bool = True) -> DataFrame:
    """dataset, split, index, labels from lines (ord, value) like `(dataset, split:index, a, b)`.

    Lines without parentheses, with fewer than four fields or (strict) without a colon are ignored; of a
    repeated key the last line counts.
    """
    body = F.regexp_extract(F.trim("value"), r"^\((.*)\)$", 1)
    parts = F.transform(F.split(body, ","), lambda x: F.trim(x))
    rows = lines.select("ord", parts.alias("p")).where(F.size("p") >= 4)
    if not strict:
        return rows.select("ord", F.get("p", F.lit(2)).alias("a"), F.get("p", F.lit(3)).alias("b"))
    key = F.split(F.get("p", F.lit(1)), ":", 2)
    rows = rows.where(F.get("p", F.lit(1)).contains(":")).select("ord", F.get("p", F.lit(0)).alias("dataset"), F.get(key, F.lit(0)).alias("split"), F.get(key, F.lit(1)).alias("index"), F.slice("p", 3, F.size("p")).alias("labels"))
    w = Window.partitionBy("dataset", "split", "index").orderBy(F.desc("ord"))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "ord")


def read_labels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_labels(spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value"), strict)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, vec from .npy matrices (two dimensions, C order); pickled arrays are refused."""

    def f(batches):
        import io

        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                m = np.load(io.BytesIO(data.as_buffer()), allow_pickle=False).astype(np.float32)
                for i in range(0, len(m), 4096):
                    part = m[i : i + 4096]
                    flat = pa.array(part.ravel())
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, max(part.shape[1], 1)), pa.int32()), flat)
                    yield pa.record_batch([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), vec], names=["file", "ord", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(f, "file string, ord long, vec array<float>")


def write_index(vectors: DataFrame, path: str, metric: str = "cosine") -> None:
    """A vector index is its rows (id, ord, vec) and its configuration."""
    vectors.withColumn("metric", F.lit(metric)).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_canvas_manifest(records: DataFrame, path: str) -> None:
    """index, canvas and text of each record; canvases are named by a five-digit index."""
    records.select("index", F.format_string("%05d.png", "index").alias("canvas"), "text").write.mode("overwrite").json(path)
