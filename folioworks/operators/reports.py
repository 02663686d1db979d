"""Counts, coverage, gaps, retention and the other reports over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioworks.operators.numbering import WIDTH, carried, met_by, row_numbers, with_cells
from folioworks.session import staged


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """A-01, A-02, A-10, A-13: rows by the keys; sort what is shown, largest first."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def topic_tree(rows: DataFrame, levels: list[str]) -> DataFrame:
    """A-03: counts by path, null levels last."""
    return rows.groupBy(*levels).agg(F.count("*").alias("n")).orderBy(*(F.asc_nulls_last(c) for c in levels))


def topics_of_branches(rows: DataFrame, branch: str, topic: str, default: str = "unclassified") -> DataFrame:
    """A-04: per branch (a missing one has a default) its topics with counts, as one array."""
    counts = rows.groupBy(F.coalesce(branch, F.lit(default)).alias(branch), topic).agg(F.count("*").alias("n"))
    return counts.groupBy(branch).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(topic, "n"))).alias("topics"))


def preview_tree(rows: DataFrame, path: list[str], pos: str, clean) -> DataFrame:
    """A-05: cleaned paths with counts, in the order in which they are first seen."""
    named = rows.select(*(clean(F.col(c)).alias(c) for c in path), pos)
    return named.groupBy(*path).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos")).orderBy("first_pos")


def coverage_gate(cases: DataFrame, objects: DataFrame, keys: list[str], kinds: dict[str, Column]) -> DataFrame:
    """A-06, A-07: cases with the number of each kind of object (legislation, principles,
    templates ...) that share their keys, missing kinds, and whether drafting may start."""
    counts = objects.groupBy(*keys).agg(*(F.sum(F.when(cond, 1).otherwise(0)).alias(name) for name, cond in kinds.items()))
    met = cases.join(counts, keys, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in kinds})
    missing = F.array_compact(F.array(*(F.when(F.col(n) == 0, F.lit(n)) for n in kinds)))
    return met.withColumn("missing", missing).withColumn("gate", F.when(F.size("missing") == 0, "ready_for_grounded_draft").otherwise("blocked_missing_authorities"))


def reading_trigger(chunks: DataFrame, key: str, parts: str = "part", low: float = 0.65) -> DataFrame:
    """A-08: sources to read again: reading ``partial``, or too little confidence: the mean
    over several parts, the most within one; without chunks it is 0."""
    mean, most = F.coalesce(F.avg("confidence"), F.lit(0.0)), F.coalesce(F.max("confidence"), F.lit(0.0))
    seen = chunks.groupBy(key).agg(F.count_distinct(parts).alias("n_parts"), mean.alias("mean"), most.alias("most"), F.max(F.when(F.col("reading") == "partial", 1).otherwise(0)).alias("partial"))
    again = (F.col("partial") == 1) | F.when(F.col("n_parts") > 1, F.col("mean") < low).otherwise(F.col("most") < low)
    return seen.withColumn("read_again", again)


def sequence_report(rows: DataFrame, group: str, number: str, chunk: int = 1000) -> DataFrame:
    """A-09: per group least, greatest, number of distinct and of repeated numbers, how many are
    missing in between, and the gaps, ``chunk`` to a row (chunk: 0, 1, ...; a group without gaps
    has one row). Gaps are found between neighbours: within cells of the numbers by one window,
    over their borders from the cells' least numbers, so no group is sorted in one task."""
    per = rows.where(F.col(number).isNotNull()).groupBy(group, F.col(number).cast("long").alias("n")).agg(F.count("*").alias("copies"))
    celled = staged(with_cells(staged(per, "numbers"), "n"), "numbers")
    firsts = celled.groupBy(group, "_cell").agg(F.min("n").alias("_n"))
    over = firsts.select(group, "_cell", F.lead("_n").over(Window.partitionBy(group).orderBy("_cell")).alias("_over"))
    inside = celled.withColumn("_after", F.lead("n").over(Window.partitionBy(group, "_cell").orderBy("n")))
    met = met_by(inside, over, [group, "_cell"]).withColumn("_after", F.coalesce("_after", "_over"))
    stats = met.groupBy(group).agg(
        F.min("n").alias("least"), F.max("n").alias("greatest"), F.count("*").alias("n_distinct"), F.sum(F.when(F.col("copies") > 1, 1).otherwise(0)).alias("n_repeated"),
        F.sum(F.coalesce(F.col("_after") - F.col("n") - 1, F.lit(0))).alias("n_missing"),
    )
    gaps = row_numbers(met.where(F.col("_after") - F.col("n") > 1).select(group, "n", "_after"), [group], "n", "nth")
    shown = F.concat((F.col("n") + 1).cast("string"), F.lit("-"), (F.col("_after") - 1).cast("string"))
    chunks = gaps.groupBy(group, F.floor((F.col("nth") - 1) / chunk).cast("int").alias("chunk")).agg(_joined(F.array_sort(F.collect_list(F.struct("n", shown.alias("x"))))).alias("gaps"))
    on = F.col(f"s.{group}").eqNullSafe(F.col(f"c.{group}"))
    return stats.alias("s").join(chunks.alias("c"), on, "left").select("s.*", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("gaps", F.lit("")).alias("gaps"))


def _joined(pairs: Column) -> Column:
    """The second parts of (order, text) pairs."""
    return F.array_join(F.transform(pairs, lambda p: p["x"]), ",")


def keyword_presence(rows: DataFrame, words: list[str], text: str, key: str, examples: int = 2) -> DataFrame:
    """A-11: for each word the number of rows that hold it and the smallest keys as examples,
    counted in one scan. ``words`` is a list of parameters, not a table."""
    found = rows.select(key, F.explode(F.array_compact(F.array(*(F.when(F.col(text).contains(w), F.lit(w)) for w in words)))).alias("word"))
    nth = found.withColumn("rn", F.row_number().over(Window.partitionBy("word").orderBy(key))).where(F.col("rn") <= examples)
    firsts = nth.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("examples"))
    return found.groupBy("word").agg(F.count("*").alias("n")).join(firsts, "word")


def retention(files: DataFrame, name: str, duplicate: str, stamp: str, size: str) -> tuple[DataFrame, DataFrame]:
    """A-12: per original name the newest original stays, else the newest duplicate; files
    with keep, and the bytes that each name frees. A name's files are never brought together:
    its best one is a maximum, joined back. Rows alike in every column are one file."""
    place = F.struct((~F.col(duplicate)).alias("own"), F.col(stamp).alias("stamp"), F.xxhash64(*files.columns).alias("row"))
    best = files.groupBy(F.col(name).alias("_name")).agg(F.max(place).alias("_best"))
    met = files.withColumn("_place", place).join(best, F.col(name).eqNullSafe(F.col("_name")))
    ranked = met.withColumn("keep", F.col("_place").eqNullSafe(F.col("_best"))).select(*files.columns, "keep")
    return ranked, ranked.groupBy(name).agg(F.sum(F.when(F.col("keep"), 0).otherwise(F.col(size))).alias("freed"), F.sum(F.when(F.col("keep"), 0).otherwise(1)).alias("files"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A-14: rows of many tables, and whether they are empty."""
    each = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n", (F.col("n") == 0).alias("is_empty")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, each)


def id_list(rows: DataFrame, group: str, key: str, chunk: int = 1000) -> DataFrame:
    """A-16: per group its ids (integers) in order, ``chunk`` to a row: (group, chunk, ids, n),
    so that a group of any size is read and written by many tasks."""
    numbered = row_numbers(rows.where(F.col(key).isNotNull()).select(group, key), [group], key, "nth")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",")
    return numbered.groupBy(group, F.floor((F.col("nth") - 1) / chunk).cast("int").alias("chunk")).agg(ids.alias("ids"), F.count(key).alias("n"))


def whole_id_list(rows: DataFrame, group: str, key: str, chunk: int = 1000) -> DataFrame:
    """A-16: per group all its ids in order, in one string (null: it has none), and its number of
    rows. Ids are sorted and joined in the chunks of ``id_list``, so that who puts a group's
    string together meets a row for every ``chunk`` ids, already in text."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", F.col("ids").alias("x"))))
    lists = id_list(rows, group, key, chunk).groupBy(group).agg(_joined(parts).alias("ids"))
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    on = F.col(f"c.{group}").eqNullSafe(F.col(f"l.{group}"))
    return counts.alias("c").join(lists.alias("l"), on, "left").select(f"c.{group}", "ids", "n")


def facet(rows: DataFrame, column: str) -> DataFrame:
    """A-17."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct()


def prefix_total(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """A-18."""
    return rows.agg(F.sum(F.when(F.col(column).startswith(prefix), 1).otherwise(0)).alias("n"))


def size_estimate(rows: DataFrame) -> DataFrame:
    """A-19: bytes of the rows in JSON, and their number."""
    return rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes"), F.count("*").alias("n"))


def write_back_counts(batches: DataFrame, objects: DataFrame, key: str = "batch_id") -> DataFrame:
    """A-20: batches with the number of their objects."""
    counts = objects.groupBy(key).agg(F.count("*").alias("_n"))
    return batches.drop("object_count").join(counts, key, "left").withColumn("object_count", F.coalesce("_n", F.lit(0))).drop("_n")


def folder_counts(manifest: DataFrame, folder: str = "folder", path: str = "path") -> DataFrame:
    """A-21: files by folder, sidecars apart."""
    return manifest.where(~F.col(path).endswith(".json")).groupBy(folder).agg(F.count("*").alias("n"))


def first_and_last(rows: DataFrame, group: str, order: str, value: str, n: int = 3) -> DataFrame:
    """W-01: the first and last ``n`` values of a group; both cuts happen before the shuffle."""
    up, down = Window.partitionBy(group).orderBy(order), Window.partitionBy(group).orderBy(F.desc(order))
    low = rows.withColumn("rn", F.row_number().over(up)).where(F.col("rn") <= n).select(group, F.lit("first").alias("side"), "rn", value)
    high = rows.withColumn("rn", F.row_number().over(down)).where(F.col("rn") <= n).select(group, F.lit("last").alias("side"), "rn", value)
    return low.unionByName(high)


def neighbourhood(rows: DataFrame, group: str, order: str, matches: Column, reach: int = 3, width: int = WIDTH) -> DataFrame:
    """W-02: rows within ``reach`` places of a match in their group's order (an integer), with
    the distance to the nearest one. Places are numbered over cells and cut into cells of
    ``width`` places again; matches are carried over the cells' borders."""
    placed = row_numbers(rows.withColumn("_hit", F.coalesce(matches, F.lit(False))), [group], order, "_rn", width)
    celled = staged(placed.withColumn("_cell", F.floor((F.col("_rn") - 1) / width)), "places")
    near = carried(celled, [group], "_cell", "_rn", F.when(F.col("_hit"), F.col("_rn")), "_before", "_after")
    told = near.withColumn("distance", F.least(F.col("_rn") - F.col("_before"), F.col("_after") - F.col("_rn")))
    return told.where(F.col("distance") <= reach).drop("_rn", "_hit", "_cell", "_before", "_after")


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """W-03, W-07: the latest row of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def file_status(files: DataFrame, batches: DataFrame, folders: DataFrame) -> DataFrame:
    """W-03: a file's status: its newest batch's, else by the folder where it lies, else unknown."""
    newest = latest(batches, ["file_name"], "started_at", "batch_id").select("file_name", F.col("status").alias("_batch"))
    where = folders.groupBy("file_name").agg(F.min("folder").alias("_folder"))
    by_folder = F.when(F.col("_folder") == "inbox", "queued").when(F.col("_folder") == "failed", "failed")
    met = files.join(newest, "file_name", "left").join(where, "file_name", "left")
    return met.withColumn("status", F.coalesce(F.col("_batch"), by_folder, F.lit("unknown"))).drop("_batch", "_folder")


def best_two(scores: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """W-05: best and second best score of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    two = scores.withColumn("_rn", F.row_number().over(order)).where("_rn <= 2")
    pick = lambda n, c: F.max(F.when(F.col("_rn") == n, F.col(c)))
    return two.groupBy(key).agg(pick(1, tie).alias("best"), pick(1, score).alias("best_score"), pick(2, score).alias("second_score"))
