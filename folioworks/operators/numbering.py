"""Places in an order, and what is carried along it, without bringing a group together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a cell, about: what one task sorts.
WIDTH = 1 << 16


def with_cells(rows: DataFrame, key: str, out: str = "_cell", width: int = WIDTH) -> DataFrame:
    """``rows`` with a number that grows with the integer ``key`` (null for null): the span of
    the keys in as many equal parts as there are ``width`` rows, whether keys are dense or hashes."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    parts = max(1, -(-n // width))
    if parts == 1:
        return rows.withColumn(out, F.when(F.col(key).isNotNull(), F.lit(0).cast("long")))
    step = -(-(high - low + 1) // parts)
    return rows.withColumn(out, F.floor((F.col(key).cast("decimal(20,0)") - F.lit(str(low)).cast("decimal(20,0)")) / step).cast("long"))


def met_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with ``right``'s other columns, null keys meeting null keys."""
    on = F.lit(True)
    for c in keys:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    added = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), on).select("l.*", *added)


def row_numbers(rows: DataFrame, groups: list[str], key: str, out: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``out``: 1, 2, ... in order of the integer ``key`` within each group
    (none: the whole table), nulls first, ties in any order.

    Rows are sorted in cells of neighbouring keys; only the cells' counts are summed up in
    order, so a group of any size is spread over as many tasks as it fills cells.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    celled = with_cells(rows.drop(out), key, width=width).withColumns({n: F.col(g) for n, g in zip(names, groups)})
    counts = celled.groupBy(*names, "_cell").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*names).orderBy(F.asc_nulls_first("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*names, "_cell", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(*names, "_cell").orderBy(F.asc_nulls_first(key)))
    numbered = met_by(celled.withColumn("_within", within), offsets, [*names, "_cell"])
    return numbered.withColumn(out, F.col("_offset") + F.col("_within")).select(*(c for c in rows.columns if c != out), out)


def carried(rows: DataFrame, groups: list[str], cell: str, order: str, value: Column, before: str, after: str) -> DataFrame:
    """``rows`` with the nearest value that isn't null at or before each row of its group, and
    at or after it, in order of ``order`` (null: there is none).

    Values must grow along the order. Each cell (a part of the order, by number) carries only
    its first and its last value over its borders; within a cell the running last value goes
    forth in one window and back in another, neither of which looks ahead.
    """
    valued = rows.withColumn("_value", value)
    ends = valued.groupBy(*groups, cell).agg(F.min("_value").alias("_first"), F.max("_value").alias("_last"))
    forth, back = Window.partitionBy(*groups).orderBy(cell), Window.partitionBy(*groups).orderBy(F.desc(cell))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    borders = ends.select(*groups, cell, F.max("_last").over(up_to(forth)).alias("_from"), F.min("_first").over(up_to(back)).alias("_to"))
    forth, back = Window.partitionBy(*groups, cell).orderBy(order), Window.partitionBy(*groups, cell).orderBy(F.desc(order))
    running = valued.withColumn(before, F.max("_value").over(forth.rowsBetween(Window.unboundedPreceding, 0)))
    running = running.withColumn(after, F.min("_value").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    met = met_by(running, borders, [*groups, cell])
    return met.withColumn(before, F.coalesce(before, "_from")).withColumn(after, F.coalesce(after, "_to")).select(*rows.columns, before, after)
