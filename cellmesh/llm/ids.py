"""Ids of any kind as whole numbers in the same order, for operators that compute on numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .merkle import numbered
from .shared import stash


def names_of(docs: DataFrame, doc_id: str) -> DataFrame | None:
    """``name, number`` of each id but null, numbers in the order of ids; None where ids are whole numbers themselves."""
    if isinstance(docs.schema[doc_id].dataType, IntegralType):
        return None
    names = docs.where(F.col(doc_id).isNotNull()).select(F.lit("").alias("g"), F.col(doc_id).alias("name")).distinct()
    return stash(numbered(names, ["name"]).select("name", F.col("idx").alias("number")), "ids")


def numbers(docs: DataFrame, doc_id: str, names: DataFrame) -> DataFrame:
    """``docs`` with numbers for ids; a null id stays null."""
    number, others = "number", [c for c in docs.columns if c != doc_id]
    return docs.join(names, F.col(doc_id) == F.col("name"), "left").select(F.col(number).alias(doc_id), *others)


def named(found: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """``found`` with ids for the numbers in ``columns``."""
    for c in columns:
        own = names.select(F.col("number").alias("_number"), F.col("name").alias("_name"))
        found = found.join(own, F.col(c) == F.col("_number"), "left").select(*(F.col("_name").alias(c) if x == c else F.col(x) for x in found.columns))
    return found
