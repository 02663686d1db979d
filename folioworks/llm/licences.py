"""License scans in DataFrame operations alone: MinHash bands retrieve, shingles verify.

A text is its five-word shingles, hashed once. Long templates (LONG shingles or more) are
retrieved by windows of WINDOW shingles, one at every STRIDE: one permutation hashing parts a
window's shingles into ROWS bins by their lowest bits, the least hash of a bin is a row, and
two rows are a band. A window that shares J of what it and a template window hold together
collides in a band with probability J * J, so in any of the BANDS with 1 - (1 - J * J) ** BANDS:
0.70 for half, 0.98 for four fifths, and for certain where a window lies within a copy, as
templates are cut at every shingle. A place that holds LEAST of LONG shingles has several such
windows: of the worst case, 32 shingles with one changed word amid them, 27 are left, and the two
or three windows of 13 or 14 of them each collide with probability 0.9.

Of a short template a window would hold little but its neighbours, so there every shingle is a
window of its own with one row, which collides for certain wherever one of them stands. Every
collision gives a place where the template may lie, and there exact shingle containment decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioworks.llm.words import row_key
from folioworks.session import staged

SHINGLE, WINDOW, STRIDE, ROWS, BANDS = 5, 16, 8, 8, 4
#: Shingles from which on a template is long, and the share of them that a match holds.
LONG, LEAST = 32, 0.8
#: Words by which a match may lie off, besides a quarter of the template.
OFF = 1
#: Bands of template windows that one scan sends to tasks; more templates go in several scans.
MOST_BAND_VALUES = 200_000
WORDS = r"[^\p{L}\p{N}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Notices by which public licences are named or granted.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "mit-short": "Released under the MIT License.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words(text: Column) -> Column:
    """A-Z lower-cased, runs of letters and digits."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(plain, WORDS), lambda w: w != "")


def _numbers(n: Column, step: int = 1) -> Column:
    """0, step, ... below n."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column) -> Column:
    return F.transform(_numbers(F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))


def shingles(w: Column, low: Column, high: Column) -> Column:
    """The shingles that start at words low (or 0) to high - 1, as strings."""
    start, end = F.greatest(low, F.lit(0)), F.least(high, F.size(w) - (SHINGLE - 1))
    places = F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " "))


def _least(hashes: Column) -> Column:
    """A row for each bin: the least of the hashes in it, null where there is none."""
    bin_of = lambda b: F.array_min(F.filter(hashes, lambda h: F.pmod(h, F.lit(ROWS)) == b))
    return F.array(*map(bin_of, range(ROWS)))


def _bands_of(rows: Column) -> Column:
    """A value for each band of two rows, null where both are."""
    pairs = [(F.get(rows, F.lit(2 * b)), F.get(rows, F.lit(2 * b + 1))) for b in range(BANDS)]
    return F.array(*(F.when(x.isNotNull() | y.isNotNull(), F.xxhash64(F.lit(b), x, y)) for b, (x, y) in enumerate(pairs)))


def text_bands(hashes: Column) -> Column:
    """Of a text's windows at every STRIDE, the values of their bands. Windows are two blocks, so
    each shingle is looked at once."""
    blocks = F.transform(_numbers(F.size(hashes), STRIDE), lambda at: _least(F.slice(hashes, at + 1, STRIDE)))
    after = lambda bs: F.concat(F.slice(bs, 2, F.greatest(F.size(bs) - 1, F.lit(0))), F.array(F.array_repeat(F.lit(None).cast("long"), ROWS)))
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y))
    windows = F.flatten(F.flatten(F.transform(F.array(blocks), lambda bs: F.zip_with(bs, after(bs), lambda a, b: _bands_of(joined(a, b))))))
    return F.when(F.size(hashes) >= LONG * LEAST, windows).otherwise(F.array().cast("array<long>"))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "licence string, notice string")


def template_bands(templates: DataFrame) -> DataFrame:
    """(licence, n, set of shingles, is_long, at, value): of long templates the bands of the
    windows at every shingle, of short ones every shingle's hash. Notices below five words
    have no shingle and are never found."""
    known = templates.withColumn("_w", words(F.col("notice"))).withColumn("_h", shingle_hashes(F.col("_w")))
    known = known.withColumn("wanted", F.array_distinct(shingles(F.col("_w"), F.lit(0), F.size("_w")))).withColumn("n", F.size("_h"))
    short = known.where(F.col("n") < LONG).select("licence", "wanted", "n", F.lit(False).alias("is_long"), F.posexplode("_h").alias("at", "value"))
    rows = known.where(F.col("n") >= LONG).select("licence", "wanted", "n", "_h", F.explode(_numbers(F.col("n") - (WINDOW - 1))).alias("at"))
    each = F.explode(_bands_of(_least(F.slice("_h", F.col("at") + 1, WINDOW))))
    return short.unionByName(rows.select("licence", "wanted", "n", F.lit(True).alias("is_long"), "at", each.alias("value")).where("value is not null"))


def scan_licences(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, licence, start, containment): places where at least LEAST of a template's
    shingles stand, start being the word where it would begin. Whole texts are scanned.

    Null, empty and short texts have none. Rows with equal id and text have one key and the
    same places, given once. Empty tables give no rows; other columns play no part.
    """
    each = [_scan(_windowed(docs, part, id_col, text), part).select("id", "key", "licence", "start", "containment") for part in _parts(docs.sparkSession, templates)]
    return reduce(DataFrame.unionByName, each)


def _parts(spark: SparkSession, templates: DataFrame | None) -> list[DataFrame]:
    """The templates in as many parts as keep each to about half of MOST_BAND_VALUES values."""
    known = staged((default_templates(spark) if templates is None else templates).select("licence", "notice"), "templates")
    n = -(-2 * known.agg(F.sum(F.greatest(F.size(words(F.col("notice"))) - SHINGLE + 1, F.lit(0)) * BANDS).alias("n")).first().n // MOST_BAND_VALUES) if not known.isEmpty() else 1
    return [known.where(F.pmod(F.xxhash64("licence", "notice"), F.lit(n)) == i) for i in range(n)] if n > 1 else [known]


def _bands(spark: SparkSession, templates: DataFrame | None) -> DataFrame:
    return template_bands(default_templates(spark) if templates is None else templates)


def _windowed(docs: DataFrame, templates: DataFrame | None, id_col: str, text: str) -> DataFrame:
    """Every row's id and key; of rows with a window that collides, words and those windows'
    places and band values."""
    values: dict[bool, set[int]] = {True: set(), False: set()}
    for r in _bands(docs.sparkSession, templates).select("is_long", "value").distinct().collect():  # a part's, bounded
        values[r.is_long].add(r.value)
    known = lambda x, which: x.isin(sorted(values[which]) or [0])
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text).alias("key"), words(F.col(text)).alias("words"))
    rows = rows.withColumn("hashes", shingle_hashes(F.col("words"))).withColumn("bands", text_bands(F.col("hashes")))
    lone = F.filter(F.transform("hashes", lambda h, i: F.when(known(h, False), F.struct(i.alias("at"), h.alias("value"), F.lit(False).alias("is_long")))), lambda x: x.isNotNull())
    place = lambda i: (F.floor(i / BANDS) * STRIDE).cast("int")
    wide = F.filter(F.transform("bands", lambda v, i: F.when(known(v, True), F.struct(place(i).alias("at"), v.alias("value"), F.lit(True).alias("is_long")))), lambda x: x.isNotNull())
    rows = rows.withColumn("signs", F.concat(lone, wide)).drop("hashes", "bands")
    some = F.size("signs") > 0
    return staged(rows.select("id", "key", F.when(some, F.col("words")).alias("words"), F.when(some, F.col("signs")).alias("signs")), "windows")


def _scan(windowed: DataFrame, templates: DataFrame | None) -> DataFrame:
    bands = _bands(windowed.sparkSession, templates)
    held = windowed.where("signs is not null").dropDuplicates(["key"])
    lows = held.select("key", F.inline("signs"))
    met = lows.join(bands.select("is_long", "value", "licence", F.col("at").alias("t_at"), "n", "wanted"), ["is_long", "value"])
    anchors = met.select("key", "licence", (F.col("at") - F.col("t_at")).alias("start"), "n", "wanted").dropDuplicates(["key", "licence", "start"])
    placed = held.select("id", "key", "words").join(anchors, "key")
    slack = F.floor(F.col("n") / 4).cast("int") + OFF  # windows that collide may lie apart by that much
    there = F.array_intersect("wanted", shingles(F.col("words"), F.col("start") - slack, F.col("start") + F.col("n") + slack))
    verified = placed.withColumn("containment", F.size(there) / F.size("wanted"))
    return verified.where(F.col("containment") >= LEAST)


def licence_report(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_licences and licences (names, sorted, with commas).

    Null, empty and short texts have none, repeated rows have theirs each, and an empty table
    gives no rows. Other columns play no part.
    """
    scans = [(part, _windowed(docs, part, id_col, text)) for part in _parts(docs.sparkSession, templates)]
    found = reduce(DataFrame.unionByName, [_scan(windowed, part).select("key", "licence") for part, windowed in scans])
    per_key = found.groupBy("key").agg(F.sort_array(F.collect_set("licence")).alias("names"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    return scans[0][1].select("id", "key").join(per_key, "key", "left").select(F.col("id").alias(id_col), F.size(names).alias("n_licences"), F.array_join(names, ",").alias("licences"))


def _sql() -> str:
    """In DuckDB's SQL: every shingle of every text against every template's."""
    notices = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    split = lambda c: f"list_filter(string_split_regex(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '{WORDS}'), lambda x: x <> '')"
    grams = lambda s: f"select {s}, i - 1 as pos, array_to_string(w[i:i+4], ' ') as g from (select {s}, w, unnest(range(1, len(w) - 3)) as i from {{}})"
    return f"""
    with t as (select licence, {split('notice')} as w from (values {notices}) as v(licence, notice)),
    d as (select doc_id, {split('text')} as w from documents),
    tg as ({grams('licence').format('t')}),
    dg as ({grams('doc_id').format('d')}),
    size as (select licence, count(*) as n, count(distinct g) as kinds from tg group by licence),
    hits as (select doc_id, licence, dg.pos, tg.pos as t_pos, g from dg join tg using (g)),
    anchors as (select distinct doc_id, licence, pos - t_pos as first_pos from hits),
    held as (
      select a.doc_id, a.licence, a.first_pos
      from anchors a join size s using (licence) join hits h on h.doc_id = a.doc_id and h.licence = a.licence and h.pos >= a.first_pos - s.n // 4 - {OFF} and h.pos < a.first_pos + s.n + s.n // 4 + {OFF}
      group by a.doc_id, a.licence, a.first_pos, s.kinds having count(distinct h.g) >= {LEAST} * s.kinds
    ),
    found as (select distinct doc_id, licence from held)
    select d.doc_id, count(f.licence)::int as n_licences, coalesce(string_agg(f.licence, ',' order by f.licence), '') as licences
    from d left join found f on f.doc_id = d.doc_id group by d.doc_id
    """


ORACLE_SQL = _sql()
