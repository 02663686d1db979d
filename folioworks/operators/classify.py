"""What a source is, what authority it has, and which objects a filter keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioworks.operators import segment
from folioworks.schemas import CITABLE, STATUSES

# Source types by how they are split.
PRINCIPLE_TYPES = ("judicial_principles_collection", "single_judicial_principle", "judicial_principle", "principles")
WHOLE_TYPES = {"full_judgment": "JUD-1", "judicial_template": "TPL-1", "legal_memorandum": "TPL-1"}


def object_type(source_type: Column, text: Column, given: Column, heading: str = segment.ARTICLE) -> Column:
    """D-01: an article heading makes a text without a type legislation."""
    law = (source_type == "legislation") | (source_type.isNull() & text.rlike(segment.FLAGS + heading))
    return F.when(law, "legislation").when(source_type.isin(*PRINCIPLE_TYPES), "judicial_principle").when(source_type.isin(*WHOLE_TYPES), source_type).otherwise(F.coalesce(given, F.lit("legal_document")))


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", heading: str = segment.ARTICLE, item: str = segment.PRINCIPLE) -> DataFrame:
    """D-01 with G-01 and G-02: documents (source_type, object_type, title) to sections: key,
    object_type, pos, local_id, title, body. Legislation without articles is one section."""
    typed = docs.withColumn("kind", object_type(F.col("source_type"), F.col(text), F.col("object_type"), heading)).withColumn("_law", F.coalesce(F.col(text).rlike(segment.FLAGS + heading), F.lit(False)))
    articles = segment.split_articles(typed.where("kind = 'legislation' and _law"), text, key, heading)
    articles = articles.select(key, F.lit("legislation").alias("object_type"), "pos", "local_id", F.concat(F.lit("المادة "), "article_number").alias("title"), "body")
    principles = segment.split_principles(typed.where("kind = 'judicial_principle'"), text, key, item)
    principles = principles.select(key, F.lit("judicial_principle").alias("object_type"), "pos", "local_id", F.concat(F.lit("المبدأ "), F.col("principle_number").cast("string")).alias("title"), "body")
    ids = F.create_map(*(F.lit(x) for k, v in WHOLE_TYPES.items() for x in (k, v)))
    rest = typed.where(~(((F.col("kind") == "legislation") & F.col("_law")) | (F.col("kind") == "judicial_principle")))
    whole = rest.select(key, F.col("kind").alias("object_type"), F.lit(0).alias("pos"), F.coalesce(ids[F.col("kind")], F.lit("DOC-1")).alias("local_id"), "title", F.col(text).alias("body"))
    return articles.unionByName(principles).unionByName(whole)


def authority_status(kind: Column, status: Column) -> Column:
    """D-02."""
    derived = F.when(status == "source_verified", "source_authority").when(status == "operationally_accepted", "human_verified_authority").otherwise("non_authoritative")
    return F.when(kind == "synthesized_rule", "non_authoritative").otherwise(derived)


def citable(kind: Column, status: Column) -> Column:
    """D-02, D-16: verified or accepted, and not a derived rule."""
    return F.coalesce((kind != "synthesized_rule") & status.isin(*CITABLE), F.lit(False))


def with_status(rows: DataFrame, status: str = "verification_status", default: str = "source_verified") -> tuple[DataFrame, DataFrame]:
    """D-03: rows with a known status (null: the default), and rows to reject."""
    filled = rows.withColumn(status, F.coalesce(status, F.lit(default)))
    return filled.where(F.col(status).isin(*STATUSES)), filled.where(~F.col(status).isin(*STATUSES))


def optional(column: str, wanted: str | None) -> Column:
    """D-08: an empty parameter filters nothing; Catalyst folds the other branch away."""
    return F.lit(wanted or "").eqNullSafe(F.lit("")) | (F.col(column) == F.lit(wanted))


def contains_any_column(columns: list[str], query: str, fold: bool = True) -> Column:
    """D-10: a substring of the columns with spaces between."""
    text = F.concat_ws(" ", *columns)
    return (F.lower(text) if fold else text).contains(query.lower() if fold else query)


def title_with_number(title: str, phrase: str, number: int) -> Column:
    """D-11: the phrase in either case, and the number with no digit beside it."""
    return F.col(title).ilike(f"%{phrase}%") & F.col(title).rlike(f"(^|[^0-9]){number}([^0-9]|$)")


def pending_review(meta: str = "metadata", status: str = "verification_status", batch: str = "batch_id") -> Column:
    """D-13: pending, not edited by a human (no mark is no edit), of a known batch."""
    return (F.col(status) == "machine_pending_human") & (F.coalesce(F.col(meta)["human_edited"], F.lit("")) != "true") & F.col(batch).isNotNull()


def human_edited(meta: str = "metadata") -> Column:
    """D-14."""
    return F.coalesce(F.col(meta)["human_edited"].isin("true", "1"), F.lit(False))


def section_head(title: Column, number: Column, heads: list[str]) -> Column:
    """D-15: no article number, and one of the head words in the title."""
    return number.isNull() & F.exists(F.array(*map(F.lit, heads)), lambda h: F.contains(title, h))


def confidence_gate(confidence: Column, accept: float = 0.75, verified: float = 0.8) -> Column:
    """D-18."""
    return F.when(confidence >= verified, "verified").when(confidence >= accept, "accepted").otherwise("left")


def recent(at: Column, now: Column, minutes: int = 55) -> Column:
    """D-19: within the minutes before ``now``, which is given so that reruns agree."""
    return at > now - F.expr(f"interval {minutes} minutes")


def of_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """D-20."""
    return rows.join(ids.select(key), key, "left_semi")
