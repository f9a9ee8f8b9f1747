"""Memories with their tokens: rows with defaults, looked up, listed and deleted by filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.operators.memory import Bank, delete, insert_new, upsert
from lodestore.operators.retrieval import matches

TOKENS = {
    "memory_id": "string",
    "category": "string",
    "ord": "long",
    "created_at": "timestamp",
    "source": "array<string>",
    "modalities": "array<string>",
    "canvas_size": "struct<w:int,h:int>",
    "num_patches": "int",
    "total_tokens": "int",
    "extra": "string",
    "is_aligned": "boolean",
    "compress_mode": "string",
    "tokens": "array<array<float>>",
    "key_embedding": "array<float>",
    "valid_mask": "array<boolean>",
}
META = ("memory_id", "created_at", "source", "modalities", "canvas_size", "num_patches", "total_tokens", "extra", "is_aligned", "compress_mode")
#: What a missing column or value stands for.
DEFAULTS = {"category": "default", "extra": "{}", "is_aligned": False, "compress_mode": "none"}


def token_rows(rows: DataFrame) -> DataFrame:
    """rows with all columns of TOKENS: missing ones null, or their default; extra is JSON text."""
    there = {c.lower() for c in rows.columns}
    cell = lambda c: F.col(c) if c.lower() in there else F.lit(None)
    return rows.select(*[(F.coalesce(cell(c).cast(t), F.lit(DEFAULTS[c])) if c in DEFAULTS else cell(c).cast(t)).alias(c) for c, t in TOKENS.items()])


def save_tokens(bank: Bank, new: DataFrame, overwrite: bool = False) -> int:
    """A version with the new memories in folders by category; a known id is an error unless overwrite."""
    rows = token_rows(new)
    if bank.versions():
        rows = (upsert if overwrite else insert_new)(token_rows(bank.read()), rows, "memory_id")
    return bank.write(rows, "category")


def by_category(bank: Bank, category: str | None = None) -> DataFrame:
    """The memories of a category, read from its folder alone, or all."""
    rows = token_rows(bank.read())
    return rows if category is None else rows.where(F.col("category") == category)


def load(index: DataFrame, store: DataFrame, asked: DataFrame, key: str = "memory_id") -> tuple[DataFrame, DataFrame]:
    """The asked rows that are there, and the index without the asked entries whose row is gone."""
    known = index.join(asked.select(key).distinct(), key, "left_semi")
    gone = known.join(store.select(key), key, "left_anti")
    return store.join(known.select(key), key, "left_semi"), index.join(gone.select(key), key, "left_anti")


def listing(rows: DataFrame, category: str | None = None) -> DataFrame:
    """memory_id, created_at (ISO), source, modalities, total_tokens."""
    rows = rows if category is None else rows.where(F.col("category") == category)
    return rows.select("memory_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "source", "modalities", "total_tokens")


def meta_json() -> Column:
    return F.to_json(F.struct(*META))


def description() -> Column:
    """What is said about a memory that has no picture."""
    return F.concat_ws("", F.lit("Memory "), F.col("memory_id"), F.lit(" ("), F.array_join("modalities", ", "), F.lit(") from "), F.array_join("source", ", "))


def chosen_by_filter(rows: DataFrame, start=None, end=None, meta: dict[str, object] | None = None, category: str | None = None, most: int = 10_000) -> DataFrame:
    """The newest rows, `most` of them, in an inclusive time range, whose metadata (JSON text in `extra`) matches."""
    for bound, test in ((start, F.col("created_at") >= start), (end, F.col("created_at") <= end)):
        rows = rows if bound is None else rows.where(test)
    rows = rows if category is None else rows.where(F.col("category") == category)
    if meta:
        rows = rows.where(matches(F.try_parse_json("extra"), meta))
    return rows.orderBy(F.desc("created_at"), "ord").limit(most)


def delete_by_filter(rows: DataFrame, key: str = "memory_id", **wanted) -> DataFrame:
    """rows without those of chosen_by_filter()."""
    return delete(rows, chosen_by_filter(rows, **wanted), key)
