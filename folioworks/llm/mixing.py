"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash of its rows, and its target fixes exactly how often
blocks are taken. The counts of all sources are split down a binary tree over the output
shards, each node drawing from its counts without replacement, so every shard gets a random
share and the shares add up to the counts. Shards then take disjoint runs of the permuted
block takings, and rows are shuffled within their shard. All draws are seeded by their place:
reruns and retried tasks agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioworks.llm.words import word_count
from folioworks.session import staged

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Output shards at least, and the words that one holds at most, about.
SHARDS, SHARD_WORDS = 8, 1 << 21
#: Words in a block, about; larger where the corpus would have over 2**20 blocks.
BLOCK_WORDS = 1 << 16
SEED = 20
_UNIT = float(1 << 53)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size) to source_no, weight and target besides.

    Sources in order of code points, null last, weigh ``weights`` by turns and share the sum
    of sizes; a target stops at ``most`` times its source's size and the rest is shared again.
    In order of size over weight, those stop whose bound lies within their share of what the
    ones before leave over; the others share the rest. The sources' table has one row for each
    source and is the only thing ordered as a whole.
    """
    by_name, by_room, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", "source_no"), Window.partitionBy()
    no = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long")
    left = lambda c: F.sum(c).over(all_rows) - F.coalesce(F.sum(c).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = lambda c: F.sum(F.when(~F.col("stops"), F.col(c)).otherwise(0)).over(all_rows)
    ranked = sizes.withColumn("source_no", no).withColumn("weight", w).withColumn("room", F.col("source_size") / F.col("weight"))
    before = F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = ranked.withColumn("words_left", before).withColumn("weight_left", left("weight"))
    stopped = shared.withColumn("stops", most * F.col("source_size") * F.col("weight_left") <= F.col("weight") * F.col("words_left"))
    rest = F.sum("source_size").over(all_rows) - most * F.sum(F.when(F.col("stops"), F.col("source_size")).otherwise(0)).over(all_rows)
    parts = stopped.withColumn("rest", rest).withColumn("rest_weight", over("weight"))
    target = F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("rest")).cast("double") / F.col("rest_weight"))
    return parts.select("source", "source_size", "source_no", "weight", target.alias("target"))


def split_counts(counts: np.ndarray, shard: int, shards: int, seed: int = SEED) -> np.ndarray:
    """The leaf ``shard``'s share of ``counts``: one path down the splitting tree."""
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        n = int(counts.sum()) * (middle - low) // (high - low)
        drawn = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(counts, n, method="marginals") if n else np.zeros_like(counts)
        low, high, counts = (low, middle, drawn) if shard < middle else (middle, high, counts - drawn)
    return counts


def _shares(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, takings) to (source_no, shard, n): every shard walks its own path."""

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_no")
        n = split_counts(rows["takings"].to_numpy(np.int64), int(key[0]), shards, seed)
        return pd.DataFrame({"source_no": rows["source_no"], "shard": int(key[0]), "n": n})

    each = quotas.select("source_no", "takings", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    return each.groupBy("shard").applyInPandas(walk, "source_no int, shard int, n long")


def _walk(blocks: pd.DataFrame) -> pd.DataFrame:
    """One source's blocks in permuted order: those that fit whole are taken, up to the next
    one of which only some rows fit ('now'); blocks that no row fits of are passed over, and
    so are those without a word, of which a last pass takes nothing. The room left is on every row."""
    blocks = blocks.sort_values(["order", "block"], ignore_index=True)
    room, last, past = float(blocks["room"].iloc[0]), blocks["last"].tolist(), blocks["past"].tolist()
    for i, (words, least) in enumerate(zip(blocks["words"], blocks["least"])):
        if past[i]:
            continue
        past[i] = True
        if not words:
            continue
        if words <= room:
            last[i] = "whole"
            room -= words
        elif least <= room:
            last[i] = "now"
            break
    return blocks.assign(room=room, last=last, past=past)


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the rows of one source's block, each with at least a word: those that still fit, in
    permuted order."""
    whole = rows.sort_values("u", ignore_index=True)
    left, taken = float(rows["room"].iloc[0]), []
    for size in whole["size"]:
        taken.append(size <= left)
        left -= size * taken[-1]
    return whole.loc[taken, ["source_no", "u", "size"]]


def _at(u: Column, blocks: Column) -> Column:
    """The block of a row's hash."""
    return F.least(F.floor(F.shiftrightunsigned(u, 11) / _UNIT * blocks), blocks - 1).cast("long")


class Mix:
    """What a mix takes from ``docs``; ``on(docs)`` tells it row by row."""

    def __init__(self, docs: DataFrame, id_col="doc_id", source="source", text="text", weights=WEIGHTS, shards=SHARDS, block_words=BLOCK_WORDS, seed=SEED):
        self.names = (id_col, source, text)
        self.seed = seed
        self.rows = staged(self._hashed(docs).select("id", "source", "size", "u"), "sizes")
        sizes = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        targets = source_targets(sizes, weights)
        per_block = F.greatest(F.lit(float(block_words)), F.sum("source_size").over(Window.partitionBy()) / float(1 << 20))
        passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_TIMES))).otherwise(0).cast("int")
        targets = targets.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / per_block), F.lit(1)).cast("long")).withColumn("passes", passes)
        self.sources = staged(targets.withColumn("room", F.col("target") - F.col("passes") * F.col("source_size")), "sources")
        self._plan(max(shards, (self.sources.agg(F.sum("source_size").alias("n")).first().n or 0) // SHARD_WORDS))

    def _hashed(self, docs: DataFrame) -> DataFrame:
        i, s, t = (F.col(f"`{c}`") for c in self.names)
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        return docs.select(row.alias("row"), i.alias("id"), s.alias("source"), word_count(t).alias("size"), F.xxhash64(F.lit(self.seed), i, t).alias("u"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        known = self.sources.withColumnRenamed("source", "_source")
        return rows.join(known, rows["source"].eqNullSafe(known["_source"]), "inner").drop("_source").withColumn("block", _at(F.col("u"), F.col("blocks")))

    def _plan(self, shards: int) -> None:
        placed = self._placed(self.rows)
        order = F.xxhash64(F.lit(self.seed), F.lit("last"), "source_no", "block").alias("order")
        words = placed.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"), F.first("passes").alias("passes"), F.first("room").alias("room"))
        blocks = staged(words.select("*", order, F.lit(None).cast("string").alias("last"), F.lit(False).alias("past")), "blocks")
        chosen = self.rows.sparkSession.createDataFrame([], "source_no int, u long")
        while True:
            blocks = staged(blocks.groupBy("source_no").applyInPandas(_walk, blocks.schema), "blocks")
            now = blocks.where("last = 'now'")
            if now.isEmpty():
                break
            edge = placed.drop("room").join(now.select("source_no", "block", "room"), ["source_no", "block"])
            alike = edge.where("size > 0").groupBy("source_no", "u").agg(F.sum("size").alias("size"), F.first("room").alias("room"))  # taken together
            filled = staged(alike.groupBy("source_no").applyInPandas(_fill, "source_no int, u long, size long"), "chosen")
            chosen = chosen.union(filled.select("source_no", "u"))
            used = filled.groupBy("source_no").agg(F.sum("size").alias("used"))
            last = F.when(F.col("last") == "now", "part").otherwise(F.col("last"))
            blocks = blocks.join(used, "source_no", "left").withColumns({"room": F.col("room") - F.coalesce("used", F.lit(0)), "last": last}).select(blocks.columns)
        turns = F.sequence(F.lit(0), F.col("passes") - F.when(F.col("last").isNull(), 1).otherwise(0))
        takings = blocks.where("passes > 0 or last is not null").select("source_no", "block", "passes", "last", F.explode(turns).alias("turn"))
        drawn = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(self.seed), F.lit("draw"), "source_no", "block", "turn"), "block", "turn")
        takings = takings.withColumn("at", F.row_number().over(drawn))
        shares = _shares(takings.groupBy("source_no").agg(F.count("*").alias("takings")), shards, self.seed)
        runs = shares.withColumn("to", F.sum("n").over(Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)))
        slots = runs.where("n > 0").select("source_no", "shard", F.explode(F.sequence(F.col("to") - F.col("n") + 1, F.col("to"))).alias("at"))
        part = (F.col("last") == "part") & (F.col("turn") == F.col("passes"))
        shard = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("shard"))))
        self.blocks = staged(takings.join(slots, ["source_no", "at"]).groupBy("source_no", "block").agg(shard(~F.coalesce(part, F.lit(False))).alias("shards"), F.max(F.when(part, F.col("shard"))).alias("part_shard")), "takings")
        self.chosen = staged(chosen.withColumn("chosen", F.lit(True)), "chosen")

    def on(self, docs: DataFrame | None = None) -> DataFrame:
        """Rows (row: the row of ``docs``, id, source, size, u, source_size, target, shards):
        shards has the output shard of each time that the row is taken."""
        rows = self._placed(self.rows if docs is None else self._hashed(docs))
        known = rows.join(self.blocks, ["source_no", "block"], "left").join(self.chosen, ["source_no", "u"], "left")
        none = F.array().cast("array<int>")
        shards = F.concat(F.coalesce("shards", none), F.when(F.coalesce("chosen", F.lit(False)) & F.col("part_shard").isNotNull(), F.array("part_shard")).otherwise(none))
        return known.withColumn("shards", shards)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, the words that the mix
    takes of it, repeats counted, and shards, the output shard of each time that it is taken.

    Sizes are words (null and empty texts: 0); a null source is a source of its own. Rows
    with equal id and text are decided alike. A source's taken words stay below its target
    by less than the smallest row that its last pass does not take (rows alike in id and text
    count as one); no row is taken more than three times. Texts without words are taken as
    often as all others of their source at least. An empty table gives no rows; other columns play no part.
    """
    mix = Mix(docs, **options)
    return mix.on().select(F.col("id").alias(mix.names[0]), "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them, each row as often as it is taken, with ``_shard``;
    shards are together and in random order within."""
    mix = Mix(docs, **options)
    taken = mix.on(docs).select("row", "u", F.posexplode("shards").alias("_turn", "_shard"))
    order = F.xxhash64(F.lit(mix.seed), "_shard", "_turn", "u")
    shuffled = taken.withColumn("_order", order).repartition("_shard").sortWithinPartitions("_shard", "_order")
    return shuffled.select("row.*", "_shard")
