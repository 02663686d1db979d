"""The corpus pipeline: documents in, encoded documents out, one stage after another.

Every stage works on all rows that the one before kept. SQL expresses neither the trees of
the first stage nor the fingerprints and draws of later ones, so ORACLE_SQL is None and
tests hold small inputs against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioworks.llm import bpe, lines, mixing, simhash, toxicity
from folioworks.llm.queries import VOCABULARY
from folioworks.llm.words import table
from folioworks.session import staged

ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose calibrated score stays below the cut. The model learns from the labelled
    rows of the documents table that are not held out, whatever ``docs`` holds.

    Null and empty texts are scored like any other, repeated rows alike, and an empty table
    gives no rows; columns named like the model's own pass."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.learnable())
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    scored = model.score(docs.select(rest.alias("row"), "text"), keep_text=True).where(F.col("score") < toxicity.CUT)
    return scored.select(*("text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without later repeated runs of lines; n_chars follows the text. Null texts
    stay null, whole copies become empty, repeated rows lose the same lines."""
    cut = lines.dedup_lines(docs).drop("n_removed")
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest id, null ids last. Null
    texts and those without words are one class; repeated rows count once."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in the order of its shards; those without words
    with the passes of their source. A null source is a source of its own."""
    return mixing.mixed(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids (little-endian unsigned 32-bit integers)
    and decoded (the ids decoded again). Null and empty texts have no ids; every row is encoded,
    repeated ones alike."""
    return bpe.with_tokens(docs, VOCABULARY, decoded=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_alike),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
