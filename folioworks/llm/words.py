"""Words and keys that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A word: a longest run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words in ``text`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*columns: str) -> Column:
    """96 bits from the values of ``columns``: equal rows have equal keys, null or not."""
    cols = [F.col(c) for c in columns]
    return F.struct(F.xxhash64(*cols).alias("a"), F.hash(*reversed(cols)).alias("b"))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
