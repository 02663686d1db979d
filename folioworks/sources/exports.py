"""Records in and out: JSON entries, statutes, reference keys, relation maps, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioworks.functions.text import clean_label, renumber, short_key, strip

ENTRY = "kind string, branch string, court string, appealNo string, circuitNo string, sessionDate string, meta string, body string, createdAt long"
# What a missing field of an imported entry becomes.
DEFAULTS = {"kind": "مبدأ", "branch": "عام", "court": "محكمة التمييز", "appealNo": "", "circuitNo": "", "sessionDate": "", "meta": "", "body": ""}


def export_json(entries: DataFrame, path: str) -> None:
    """S-15: a JSON line an entry."""
    entries.write.json(path)


def parsed_entries(texts: DataFrame, value: str = "value") -> DataFrame:
    """S-15: whole JSON texts, an array of entries or an object that holds one, to entries with
    defaults; entries with a blank body and texts of another form give no rows."""
    entry = f"array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>"
    as_array, as_object = F.from_json(value, entry), F.from_json(value, f"entries {entry}")["entries"]
    rows = texts.select(F.explode(F.when(F.ltrim(value).startswith("["), as_array).otherwise(as_object)).alias("e")).select("e.*")
    return rows.withColumns({c: F.coalesce(F.nullif(c, F.lit("")), F.lit(d)) for c, d in DEFAULTS.items()}).where(F.length(strip(F.col("body"))) > 0)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    return parsed_entries(spark.read.text(path, wholetext=True))


def statute_index(articles: DataFrame, law: str = "law_id", number: str = "number", pos: str = "pos") -> DataFrame:
    """S-16: per statute its article count and its articles in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(number).alias("number"))))
    return articles.groupBy(law).agg(F.count("*").alias("article_count"), F.array_join(F.transform(listed, lambda x: x["number"]), ",").alias("articles"))


def reference_keys(spark: SparkSession, path: str) -> DataFrame:
    """S-17: [{k, r}, ...] to (k, reference)."""
    return spark.read.schema("k string, r string").json(path, multiLine=True).select("k", F.col("r").alias("reference"))


RELATION_MAP = "batch_id string, status string, relations array<struct<from:string,relation:string,to:array<string>>>, reassessment_flags array<struct<objects:array<string>,flag:string,reason:string>>"


def relation_edges(maps: DataFrame) -> DataFrame:
    """S-18: nested relation maps to edges."""
    each = maps.select("batch_id", F.explode("relations").alias("r"))
    return each.select("batch_id", F.col("r.from").alias("from_id"), F.col("r.relation").alias("relation_type"), F.explode("r.to").alias("to_id"))


def relation_flags(maps: DataFrame) -> DataFrame:
    return maps.select(F.explode("reassessment_flags").alias("f")).select("f.*")


def regrouped(records: DataFrame, path: tuple[str, ...] = ("topic", "subtopic", "micro_issue"), pos: str = "pos", text: str = "text") -> DataFrame:
    """S-19: records by cleaned path to new sources: stem, title, body (texts in order,
    numbered anew, a blank line between), n_records."""
    named = records.withColumns({c: F.nullif(clean_label(F.col(c)), F.lit("")) for c in path})
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    groups = named.groupBy(*path).agg(ordered.alias("_rows"), F.min(pos).alias("first_pos"))
    body = F.array_join(F.transform("_rows", lambda x, i: renumber(x["t"], i + 1)), "\n\n")
    stem = F.coalesce(F.nullif(short_key(F.concat_ws("__", *path)), F.lit("")), F.concat(F.lit("group_"), F.col("first_pos").cast("string")))
    return groups.select(*path, stem.alias("stem"), F.concat_ws(" / ", *path).alias("title"), body.alias("body"), F.size("_rows").alias("n_records"))
