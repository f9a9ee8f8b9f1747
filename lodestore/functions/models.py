"""Encoders and answer models behind one interface, with deterministic stand-ins.

A model is a function from Column to Column, so it may be a built-in expression or an Arrow UDF that holds its
weights once per worker.  No trained model is shipped: the stand-ins make vectors and answers from hashes, for
tests and for trying out plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestore.functions.text import format_choices
from lodestore.functions.vector import normalize

Model = Callable[..., Column]
_models: dict[str, Model] = {}


def register(name: str, model: Model) -> None:
    _models[name] = model


def get(name: str) -> Model:
    if name not in _models:
        raise KeyError(f"no model {name}; there are {sorted(_models)}")
    return _models[name]


def _number(text: Column) -> Column:
    """32 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_embedding(text: Column, dim: int = 64, unit: bool = True) -> Column:
    """A vector from the hashes of a text, of unit length if wanted; equal texts have equal vectors, a null text the zero vector."""
    at = lambda i: _number(F.concat(F.coalesce(text, F.lit("")), F.lit(":"), i.cast("string"))) % 2001 / F.lit(1000.0) - 1.0
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(text.isNull(), F.lit(0.0)).otherwise(at(i)))
    return normalize(raw).cast("array<float>") if unit else raw


def first_choice(question: Column, choices: Column) -> Column:
    """An answer letter from the hash of the question and its choices."""
    n = F.greatest(F.size(choices), F.lit(1))
    return F.char(F.lit(65) + _number(F.concat_ws("\n", question, format_choices(choices))) % n)


register("hash_embedding", hash_embedding)
register("first_choice", first_choice)
