"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.shared import discard, shared_dir, stash

__all__ = ["GAP", "WORD", "discard", "n_words", "scratch", "shared_dir", "sized", "stash", "table"]

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tracewright/{tag}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: Bytes beyond which a stashed table is joined by a shuffle instead of broadcast.
BROADCAST_BYTES = 16_000_000


def row_bytes(df: DataFrame) -> Column:
    """About how much memory a row takes."""
    sizes = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)))
        elif kind == "array":
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)))
    return sum(sizes, F.lit(16 + 8 * len(df.schema.fields))).cast("long")


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of df, a stash, are few enough bytes to be broadcast."""
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("n")).first()["n"] <= most


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a stash, broadcast if all its rows together are small."""
    return F.broadcast(df) if is_small(df, most) else df
