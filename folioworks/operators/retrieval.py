"""Retrieval: exact search, vector search, merging, and the ordering of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioworks.functions.text import search_word
from folioworks.operators.nearest import vector_top_k  # noqa: F401  one of this module's operators
from folioworks.operators.numbering import row_numbers
from folioworks.session import staged


def top_newest(rows: DataFrame, at: str, key: str, n: int, most: int) -> DataFrame:
    """K-01: the newest ``n`` rows, at least one and at most ``most``; ties by key."""
    return rows.orderBy(F.desc(at), F.col(key)).limit(max(1, min(n, most)))


def newest_batch(batches: DataFrame, least: int = 400) -> DataFrame:
    """K-02: the newest completed batch with more than ``least`` objects, as one row."""
    return batches.where((F.col("status") == "completed") & (F.col("object_count") > least)).orderBy(F.desc("completed_at"), "batch_id").limit(1)


def cosine(a: Column, b: Column) -> Column:
    """In double precision, products summed up in order; null for a zero vector."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when(norm > 0, total(a, b) / norm)


#: Tasks that the objects of one word of one number are dealt over.
SALTS = 8


def exact_search(objects: DataFrame, queries: DataFrame, k: int = 3, key: str = "id", title: str = "title", fields: tuple[str, ...] = ("title",)) -> DataFrame:
    """K-04: queries (query_id, number, tokens) to the objects whose title holds the number
    with no digit beside it, by how many tokens stand in the fields as whole words: none are
    dropped if there are tokens, only the best tier stays, of it the first ``k`` by id.

    A query's tokens are taken from the rarest on. Objects with the rarest one are counted
    first; the most that one of them matches bounds the tier from below. An object that matches
    as many of n tokens has one of the n - tier + 1 rarest, so frequent words bring in no
    candidates of their own. Candidates are counted on the asked words that they hold. Queries
    without tokens meet the first ``k`` objects of their number only."""
    words = F.array_distinct(F.split(F.concat_ws(" ", *fields), r"\s+"))
    numbers = F.array_distinct(F.regexp_extract_all(F.col(title), F.lit(r"(\d+)"), F.lit(1)))
    rows = objects.select(F.col(key).alias("id"), words.alias("_words"), F.explode(numbers).alias("number"))
    asked = queries.select("query_id", F.col("number").cast("string").alias("number"), F.array_distinct("tokens").alias("tokens"))
    told = asked.select("query_id", "number", F.explode("tokens").alias("word"))
    # Words are made plain as rows, where that is compiled code; of one object some become alike.
    every = rows.select("id", "number", F.explode("_words").alias("word")).withColumn("word", search_word(F.col("word")))
    posted = staged(every.join(told.select("number", "word").distinct(), ["number", "word"], "left_semi").distinct(), "postings")
    held = posted.groupBy("number", "id").agg(F.collect_set("word").alias("held"))
    often = posted.groupBy("number", "word").agg(F.count("*").alias("n"))
    rarity = F.row_number().over(Window.partitionBy("query_id").orderBy("n", "word"))
    found = told.join(often, ["number", "word"]).withColumn("nth", rarity).withColumn("of", F.count("*").over(Window.partitionBy("query_id")))
    found = staged(found.select("query_id", "number", "word", "nth", "of"), "tokens")
    salted = posted.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    counted = F.size(F.array_intersect("held", "tokens")).alias("matched")

    def matches(some: DataFrame) -> DataFrame:
        each = some.select("query_id", "number", "word", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        candidates = salted.join(each, ["number", "word", "salt"]).select("query_id", "number", "id").distinct()
        return candidates.join(held, ["number", "id"]).join(asked.select("query_id", "tokens"), "query_id").select("query_id", "id", counted)

    tier = matches(found.where("nth = 1")).groupBy("query_id").agg(F.max("matched").alias("tier"))
    matched = matches(found.join(tier, "query_id").where("nth <= of - tier + 1"))
    first = rows.select("id", "number").withColumn("_n", F.row_number().over(Window.partitionBy("number").orderBy("id"))).where(F.col("_n") <= k)
    plain = asked.where(F.size("tokens") == 0).join(first, "number").select("query_id", "id", F.lit(0).alias("matched"))
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), "id")
    top = matched.unionByName(plain).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = F.max("matched").over(Window.partitionBy("query_id"))
    return top.withColumn("_best", best).where("matched = _best").select("query_id", "id", "matched", "rank", F.lit(1.0).alias("score"))


def hybrid_merge(exact: DataFrame, semantic: DataFrame, key: str = "id") -> DataFrame:
    """K-05: exact results first, then semantic ones that they don't hold."""
    rest = semantic.join(exact.select("query_id", key), ["query_id", key], "left_anti")
    both = exact.select("query_id", key, "score", "rank", F.lit(0).alias("tier")).unionByName(rest.select("query_id", key, "score", "rank", F.lit(1).alias("tier")))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank", key)))


def multi_axis(hits: DataFrame, per_axis: dict[str, int], full: dict[str, int], cut: dict[str, int], key: str = "object_id", family: str = "family") -> DataFrame:
    """K-06: hits (query_id, axis, family, score; axis 0 is the whole query) to each family's
    best: a number for every axis, others for the whole query only; an object counts once, with
    its best score, and families are cut at the end."""
    def limit(wanted: dict[str, int]) -> Column:
        pairs = [F.lit(x) for kv in wanted.items() for x in kv]
        return F.coalesce(F.create_map(*pairs)[F.col(family)], F.lit(0)) if pairs else F.lit(0)

    order = Window.partitionBy("query_id", "axis", family).orderBy(F.desc("score"), key)
    allowed = limit(per_axis) + F.when(F.col("axis") == 0, limit(full)).otherwise(0)
    best = hits.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= allowed)
    once = best.groupBy("query_id", family, key).agg(F.max("score").alias("score"))
    last = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", family).orderBy(F.desc("score"), key)))
    return last.where(F.col("rank") <= limit(cut))


def with_family(objects: DataFrame, families: DataFrame, kind: str = "object_type") -> DataFrame:
    """K-07: adds family by a mapping table (object_type, family); unknown types are their own."""
    return objects.join(families, kind, "left").withColumn("family", F.coalesce("family", kind))


def staged_scope(objects: DataFrame, queries: DataFrame, levels: list[str], key: str = "id") -> DataFrame:
    """P-01: for each query the objects that agree on the most levels, the first of which is
    required; a level counts only if those above it agree. Rows: query_id, ``key``, depth and
    the objects' other columns.

    Queries meet objects at the deepest level first; only those that find none there go on to
    the next wider one, so wide scopes are made for no other query."""
    rest = [c for c in objects.columns if c not in levels]
    open_, found = queries, None
    for depth in range(len(levels), 0, -1):
        on = levels[:depth]
        here = objects.groupBy(*on).agg(F.lit(1).alias("_here")).drop("_here")
        met = open_.join(here, on, "left_semi") if depth > 1 else open_
        hits = met.select("query_id", *on).join(objects, on).select("query_id", *rest, F.lit(depth).alias("depth"))
        found = hits if found is None else found.unionByName(hits)
        open_ = open_.join(here, on, "left_anti")
    return found.select("query_id", key, "depth", *(c for c in rest if c != key))


def tier_order(results: DataFrame, tiers: DataFrame, kind: str = "object_type") -> DataFrame:
    """P-02: adds position by a table of tiers (object_type, tier), unknown kinds last."""
    ranked = results.join(tiers, kind, "left")
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("tier"), F.desc("score"), "id")))


def _bitmaps(rows: DataFrame, key: str) -> DataFrame:
    """(key, word, bits): the queries (n: their numbers) of each key, 64 to a word."""
    return rows.groupBy(key, F.floor(F.col("n") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("n", F.lit(64)).cast("int"))).alias("bits"))


def controlled_expansion(objects: DataFrame, seeds: DataFrame, negative: DataFrame) -> DataFrame:
    """P-03: objects that share a tag with a query's seeds, but for those that a negative link
    names (query_id and id; without a query_id column: for every query) or that are not for use.

    Queries are numbered and kept as bits: a tag has the queries whose seeds bear it, an object
    the union over its tags, less those of which it is a seed or that a link forbids. There
    is a row for every object and 64 queries, none for each query, tag and object. Query ids
    are integers."""
    queries = staged(row_numbers(seeds.select("query_id").distinct(), [], "query_id", "n").withColumn("n", F.col("n") - 1), "queries")
    numbered = seeds.join(queries, "query_id")
    tags = _bitmaps(numbered.select("n", F.explode("tags").alias("tag")), "tag")
    usable = objects.where(~F.coalesce("not_for_use", F.lit(False)))
    if "query_id" not in negative.columns:
        usable = usable.join(negative.select("id"), "id", "left_anti")
    near = usable.select("id", F.explode(F.array_distinct("tags")).alias("tag")).join(tags, "tag").groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    out = numbered.select("id", "n")
    if "query_id" in negative.columns:
        out = out.unionByName(negative.join(queries, "query_id").select("id", "n"))
    left = near.join(_bitmaps(out, "id").withColumnRenamed("bits", "_out"), ["id", "word"], "left")
    bits = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_out", F.lit(0).cast("long"))))
    each = left.select("id", F.col("word") * 64, bits.alias("bits")).toDF("id", "base", "bits").where("bits <> 0")
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1))
    return each.select("id", "base", at.alias("bit")).select("id", (F.col("base") + F.col("bit")).alias("n")).join(queries, "n").select("query_id", "id")


def eligibility(results: DataFrame, rules: dict[str, str]) -> DataFrame:
    """P-04: adds reasons: the names of exclusion rules (SQL predicates) that hold, and eligible."""
    reasons = F.array_compact(F.array(*(F.when(F.expr(p), F.lit(n)) for n, p in rules.items())))
    return results.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def in_force(objects: DataFrame, edges: DataFrame, on: Column) -> DataFrame:
    """P-05: objects valid at a date and not superseded, repealed or amended by then."""
    ends = edges.where(F.col("relation_type").isin("supersedes", "repeals", "amends")).where(F.coalesce(F.col("valid_from") <= on, F.lit(True))).select(F.col("to_id").alias("id")).distinct()
    valid = objects.where(F.coalesce(F.col("valid_from") <= on, F.lit(True)) & F.coalesce(F.col("valid_to") > on, F.lit(True)))
    return valid.join(ends, "id", "left_anti")


def regression_report(results: DataFrame, expectations: DataFrame) -> DataFrame:
    """P-08: expectations (query_id, id, wanted) with whether results meet them."""
    met = expectations.join(results.select("query_id", "id", F.lit(True).alias("_hit")).distinct(), ["query_id", "id"], "left")
    found = F.coalesce("_hit", F.lit(False))
    return met.withColumn("found", found).withColumn("passed", F.col("found") == F.col("wanted")).drop("_hit")


def reasoning_trace(judged: DataFrame, size: int = 1000) -> DataFrame:
    """P-09: per query what was used and what was excluded with its reasons, by id, in numbered
    chunks of ``size``: (query_id, chunk, used, excluded), one of both lists empty where the
    other one goes on. Ids are integers."""
    told = row_numbers(judged.select("query_id", "id", "reasons", "eligible"), ["query_id", "eligible"], "id", "nth")
    item = F.struct("id", "reasons")
    used = F.array_sort(F.collect_list(F.when(F.col("eligible"), F.col("id"))))
    excluded = F.array_sort(F.collect_list(F.when(~F.col("eligible"), item)))
    return told.groupBy("query_id", F.floor((F.col("nth") - 1) / size).cast("int").alias("chunk")).agg(used.alias("used"), excluded.alias("excluded"))


def entry_strategy(queries: DataFrame, strategy: DataFrame, objects: DataFrame) -> DataFrame:
    """P-10: a question type's ordered families (families: array) joined with their objects."""
    steps = queries.join(strategy, "question_type").select("query_id", F.posexplode("families").alias("step", "family"))
    return steps.join(objects.select("id", "family"), "family")
