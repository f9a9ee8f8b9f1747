"""Vectors of a corpus that are computed once: kept by encoder and content.

A content is known by its SHA-256, so rows of one content are encoded once, whatever their ids, and a row is encoded
again only when its content changes.  Each encoder has a table of its own with row-level changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.operators.delta import DeltaBank
from lodestore.session import small_batches


#: Contents that go to Python at a time, or a batch of the encoder if that is more.
ROWS = 256


@dataclass(frozen=True)
class Encoder:
    """encode(list of contents) gives a list of vectors of `dims` numbers; a null content has the vector of `blank`."""

    name: str
    dims: int
    encode: Callable[[list], list]
    batch: int = 32
    blank: str = ""


@dataclass(frozen=True)
class Counts:
    encoded: int
    kept: int
    dropped: int


def _hash() -> F.Column:
    return F.sha2(F.col("content").cast("binary"), 256).alias("hash")


class EncodingCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _table(self, name: str) -> DeltaBank:
        return DeltaBank(self.spark, f"{self.path}/encoder={name}", "hash", self.buckets)

    def _contents(self, rows: DataFrame, encoder: Encoder) -> DataFrame:
        return rows.select("id", F.coalesce("content", F.lit(encoder.blank)).alias("content"))

    def refresh(self, rows: DataFrame, encoder: Encoder, drop: bool = True) -> Counts:
        """Encode the contents of rows(id, content) that are new and, with drop, forget those that are gone.

        A vector of another size than the encoder's is an error, and so is a table of another size.
        """
        wanted = self._contents(rows, encoder).select(_hash(), "content").dropDuplicates(["hash"])
        table = self._table(encoder.name)
        if not table.versions():
            table.write(self.spark.createDataFrame([], "hash string, vec array<float>"), {"dims": encoder.dims})
        if table.note().get("dims") != encoder.dims:
            raise ValueError(f"{encoder.name} has vectors of {table.note().get('dims')} numbers, not {encoder.dims}")
        known = table.read().select("hash")
        before = known.count()

        def f(batches):
            for b in batches:
                for i in range(0, b.num_rows, encoder.batch):
                    part = b.slice(i, encoder.batch)
                    vectors = encoder.encode(part.column("content").to_pylist())
                    for v in vectors:
                        if len(v) != encoder.dims:
                            raise ValueError(f"{encoder.name} gave {len(v)} numbers, not {encoder.dims}")
                    yield pa.record_batch([part.column("hash"), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], names=["hash", "vec"])

        # contents are whole texts: a task holds a few of them at a time
        with small_batches(self.spark, max(encoder.batch, ROWS)):
            table.upsert(wanted.join(known, "hash", "left_anti").mapInArrow(f, "hash string, vec array<float>"))
        both = table.read().count()
        if drop:
            table.delete(known.join(wanted.select("hash"), "hash", "left_anti"))
        after = table.read().count() if drop else both
        table.compact()
        return Counts(both - before, after - (both - before), both - after)

    def vectors(self, rows: DataFrame, encoder: Encoder) -> DataFrame:
        """id, vec for every row of rows(id, content); null where a content has not been encoded."""
        return self._contents(rows, encoder).select("id", _hash()).join(self._table(encoder.name).read(), "hash", "left").select("id", "vec")

    def sets(self, rows: DataFrame, encoders: list[Encoder], missing: str = "error") -> dict[str, DataFrame]:
        """The vectors of each encoder; one without a table, or with contents not encoded, is an error or, with "skip", left out."""
        if missing not in ("error", "skip"):
            raise ValueError(f"missing is error or skip, not {missing}")
        out = {}
        for e in encoders:
            there = bool(self._table(e.name).versions())
            found = self.vectors(rows, e) if there else None
            if there and found.where("vec is null").isEmpty():
                out[e.name] = found
            elif missing == "error":
                raise FileNotFoundError(f"no complete set of {e.name}")
        return out
