"""Texts to sections: headings, numbered items, parts, windows and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioworks.functions.text import clean_label, fold_digits, strip
from folioworks.operators.numbering import row_numbers

# An article's heading line, and how a numbered principle begins.
ARTICLE = r"^\s*(?:المادة|مادة)\s+([0-9٠-٩]+(?:\s+مكرر(?:اً|ا|ة)?(?:\s*\([^)]*\))?)?)\s*$"
PRINCIPLE = r"^\s*(\d+)\s*[-–.)]\s+"
MARK = "\u0001"
FLAGS = "(?mdU)"


def _numbered(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def split_articles(docs: DataFrame, text: str = "text", key: str = "doc_id", heading: str = ARTICLE, occurrences: bool = True) -> DataFrame:
    """G-01, G-03, W-04: one row per heading line: ``key``, pos, article_number, number (folded), local_id, body.

    A body reaches to the next heading; what stands before the first is dropped. With
    ``occurrences`` a number that comes again in a document gets -OCC-n.
    """
    marked = F.regexp_replace(F.col(text), FLAGS + heading, MARK)
    parts = F.arrays_zip(F.slice(F.split(marked, MARK), 2, 1 << 30).alias("body"), F.regexp_extract_all(F.col(text), F.lit(FLAGS + heading), F.lit(1)).alias("raw"))
    rows = docs.where(F.col(text).rlike(FLAGS + heading)).select(key, F.posexplode(parts).alias("pos", "part"))
    raw = strip(F.col("part.raw"))
    rows = rows.select(key, "pos", raw.alias("article_number"), F.regexp_replace(fold_digits(raw), r"(?U)\s+", "-").alias("number"), strip(F.col("part.body")).alias("body"))
    nth = F.row_number().over(Window.partitionBy(key, "number").orderBy("pos"))
    suffix = F.when(nth > 1, F.concat(F.lit("-OCC-"), nth.cast("string"))).otherwise("") if occurrences else F.lit("")
    return rows.withColumn("local_id", F.concat(F.lit("ART-"), F.col("number"), suffix))


def without_articles(docs: DataFrame, text: str = "text", heading: str = ARTICLE) -> DataFrame:
    """G-03: the documents that the splitter must reject."""
    return docs.where(~F.coalesce(F.col(text).rlike(FLAGS + heading), F.lit(False)))


def split_principles(docs: DataFrame, text: str = "text", key: str = "doc_id", item: str = PRINCIPLE) -> DataFrame:
    """G-02: one row per numbered item, its number kept in the body; a text without any is
    item 1 as a whole, and otherwise what stands before the first item is dropped."""
    pieces = F.split(F.regexp_replace(F.col(text), FLAGS + item, MARK + "$0"), MARK)
    none = F.size(pieces) == 1
    bodies = F.when(none, F.array(F.col(text))).otherwise(F.slice(pieces, 2, 1 << 30))
    rows = docs.where(F.col(text).isNotNull()).select(key, none.alias("_none"), F.posexplode(bodies).alias("pos", "body"))
    number = F.when(F.col("_none"), 1).otherwise(fold_digits(F.regexp_extract("body", FLAGS + item, 1)).try_cast("int"))
    return rows.select(key, "pos", number.alias("principle_number"), F.concat(F.lit("PR-"), number.cast("string")).alias("local_id"), strip(F.col("body")).alias("body"))


def heading_stack(rows: DataFrame, key: str = "doc_id", pos: str = "pos", text: str = "text", level: str = "level", is_item: str = "is_item") -> DataFrame:
    """G-04, W-06: ordered rows with a heading ``level`` (1 to 3, null: no heading) and items,
    to one row per item: its headings (a heading clears those at or below its level) and its
    text with the lines up to the next heading or item. Lines under no open item are dropped."""
    order = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    level_at = lambda n: F.max(F.when(F.col(level) == n, F.col(pos))).over(order)
    cleared = lambda n: F.max(F.when(F.col(level) < n, F.col(pos))).over(order)
    named = rows
    for n in (1, 2, 3):
        last = F.last(F.when(F.col(level) == n, clean_label(F.col(text))), ignorenulls=True).over(order)
        named = named.withColumn(f"heading_{n}", F.when(F.coalesce(level_at(n), F.lit(-1)) > F.coalesce(cleared(n), F.lit(-1)), last))
    opened = F.sum(F.when(F.col(is_item) | F.col(level).isNotNull(), 1).otherwise(0)).over(order)
    grouped = named.withColumn("_open", opened).where(F.col(level).isNull())
    lines = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"), F.col(is_item).alias("i"))))
    items = grouped.groupBy(key, "_open").agg(lines.alias("_lines"), *(F.max(f"heading_{n}").alias(f"heading_{n}") for n in (1, 2, 3)))
    held = items.where(F.col("_lines")[0]["i"])
    return held.select(key, F.col("_lines")[0]["p"].alias(pos), "heading_1", "heading_2", "heading_3", F.array_join(F.transform("_lines", lambda x: x["t"]), "\n").alias("body"))


def pack_parts(docs: DataFrame, most: int, slack: int = 15_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """G-05: lines packed into parts that close once they reach ``most`` characters; texts of
    up to most + slack stay whole. Lengths alone are summed up to find where parts end."""
    lines = F.split(text, "\n")
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(-1).alias("size"), F.lit(0).alias("n"))

    def add(acc: Column, line: Column) -> Column:
        size, n = acc["size"] + 1 + F.length(line), acc["n"] + 1
        full = size >= most
        return F.struct(F.when(full, F.concat(acc["ends"], F.array(n))).otherwise(acc["ends"]).alias("ends"), F.when(full, -1).otherwise(size).alias("size"), n.alias("n"))

    last = lambda acc: F.when(acc["size"] >= 0, F.concat(acc["ends"], F.array(acc["n"]))).otherwise(acc["ends"])
    ends = F.aggregate(lines, start, add, last)
    cut = docs.where(F.col(text).isNotNull()).select(key, F.col(text), lines.alias("_lines"), F.when(F.length(text) > most + slack, ends).alias("_ends"))
    since = F.concat(F.array(F.lit(0)), F.slice("_ends", 1, F.size("_ends") - 1))
    packed = F.zip_with(since, "_ends", lambda a, b: F.array_join(F.slice("_lines", a + 1, b - a), "\n"))
    return cut.select(key, F.posexplode(F.when(F.col("_ends").isNull(), F.array(F.col(text))).otherwise(packed)).alias("part", "body"))


def text_windows(docs: DataFrame, width: int = 90_000, stride: int = 80_000, most: int | None = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """G-06: overlapping windows, at most ``most`` a text (None: as many as it takes), none of
    them empty."""
    n = F.ceil(F.length(text) / stride).cast("int")
    n = n if most is None else F.least(n, F.lit(most))
    rows = docs.where(F.col(text).isNotNull()).select(key, text, F.explode(_numbered(n)).alias("window"))
    return rows.select(key, (F.col("window") - 1).alias("window"), F.substring(text, (F.col("window") - 1) * stride + 1, F.lit(width)).alias("body"))


def page_plan(parts: DataFrame, size: int = 15, before: int = 4, after: int = 6, key: str = "doc_id", part: str = "part", pages: str = "pages") -> DataFrame:
    """G-07: for part p of a document of ``pages`` pages: its pages (p-1)*size+1 .. p*size,
    widened for a second try and clipped to the document; one row a page."""
    first, last = (F.col(part) - 1) * size, F.col(part) * size
    low, high = F.greatest(first - before, F.lit(0)), F.least(last + after, F.col(pages))
    rows = parts.where(low < high).select(key, part, first.alias("_f"), last.alias("_l"), F.explode(F.sequence(low + 1, high)).alias("page"))
    return rows.select(key, part, "page", ((F.col("page") > F.col("_f")) & (F.col("page") <= F.col("_l"))).alias("own"))


def work_batches(rows: DataFrame, size: int, group: list[str], key: str) -> DataFrame:
    """G-08: adds batch_no: ``size`` rows of a group at a time, in order of an integer key."""
    numbered = row_numbers(rows, group, key, "_n")
    return numbered.withColumn("batch_no", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


# How well a source was read, best first.
READING = ("clean", "degraded", "partial")


def merge_parts(parts: DataFrame, key: str = "doc_id", part: str = "part") -> DataFrame:
    """G-09: rows (chunks: array of id and text; warnings; reading) to one per document: ids
    with P{part}- before them, chunks one after another, all warnings once, the worst reading."""
    named = F.transform("chunks", lambda c: F.struct(F.concat(F.lit("P"), F.col(part).cast("string"), F.lit("-"), c["id"]).alias("id"), c["text"].alias("text")))
    worst = F.max(F.array_position(F.array(*map(F.lit, READING)), F.col("reading"))).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(part).alias("p"), named.alias("c"), F.coalesce("warnings", F.array().cast("array<string>")).alias("w"))))
    rows = parts.groupBy(key).agg(ordered.alias("_p"), worst.alias("_r"))
    return rows.select(key, F.flatten(F.transform("_p", lambda p: p["c"])).alias("chunks"), F.array_distinct(F.flatten(F.transform("_p", lambda p: p["w"]))).alias("warnings"), F.get(F.array(*map(F.lit, READING)), F.col("_r") - 1).alias("reading"))


def context_tail(chunks: DataFrame, n: int = 3, key: str = "doc_id", part: str = "part", pos: str = "pos", title: str = "title") -> DataFrame:
    """G-10: for each part the titles of the last ``n`` chunks of the parts before it."""
    every = chunks.groupBy(key, part).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(title).alias("t")))).alias("own"))
    own = every.withColumn("own", F.transform("own", lambda x: x["t"])).withColumn("own", F.slice("own", F.greatest(F.size("own") - (n - 1), F.lit(1)), n))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(-n, -1)  # each part before has a chunk at least
    joined = F.flatten(F.collect_list("own").over(before))
    return own.select(key, part, F.when(F.size(joined) > 0, F.slice(joined, F.greatest(F.size(joined) - (n - 1), F.lit(1)), n)).otherwise(joined).alias("tail"))


def split_embedded(objects: DataFrame, pattern: str, key: str = "id", title: str = "title", text: str = "text") -> DataFrame:
    """G-11: objects whose text holds an embedded heading (a line that ``pattern`` matches, not
    the first) become two rows: the host up to it and the new one from it; others stay. A new
    title that another object has is not made again, and then the host stays whole."""
    at = F.regexp_instr(F.col(text), F.lit("(?m)" + pattern))
    heading = F.regexp_extract(text, "(?m)" + pattern, 0)
    marked = objects.withColumn("_at", F.coalesce(at, F.lit(0))).withColumn("_new", F.when(F.col("_at") > 1, heading))
    taken = objects.select(F.col(title).alias("_taken")).where(F.col(title).isNotNull()).distinct()
    known = marked.join(taken, F.col("_new") == F.col("_taken"), "left")
    split = F.col("_new").isNotNull() & F.col("_taken").isNull()
    host = F.struct(F.col(key).alias(key), F.col(title).alias(title), F.when(split, strip(F.substring(text, F.lit(1), F.col("_at") - 1))).otherwise(F.col(text)).alias(text), F.lit(False).alias("is_new"))
    new = F.struct(F.concat(F.col(key).cast("string"), F.lit("-SPLIT")).alias(key), F.col("_new").alias(title), strip(F.substring(text, F.col("_at"), F.lit(1 << 30))).alias(text), F.lit(True).alias("is_new"))
    return known.withColumn(key, F.col(key).cast("string")).select(F.explode(F.when(split, F.array(host.withField(key, F.col(key).cast("string")), new)).otherwise(F.array(host.withField(key, F.col(key).cast("string"))))).alias("o")).select("o.*")
