"""Line dedup by winnowing over line hashes.

A window starts at every line and reaches as far as it needs to hold LEAST_WORDS words, and
one reaches as far back from every line. The line with the smallest hash in a window is its fingerprint, so two runs of equal lines of
that many words are sure to share one, and a text has few of them. A fingerprint goes with
the hashes of the lines around it, as far as its windows reach. Positions are joined on
fingerprints that occur more than once: each position meets the earliest one that has the
same window around the same fingerprint, one partner and not all of them. From there the
lines are compared one by one, to the left and to the right, and the longest equal run goes
if it has LEAST_WORDS words; runs of neighbouring fingerprints chain to any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from folioworks.llm.batches import map_texts
from folioworks.llm.words import row_key
from folioworks.session import staged

#: Words that a run must have to count as repeated.
LEAST_WORDS = 20
#: Tasks that the places of one fingerprint or window are dealt over: one line may stand in a third of all texts.
SALTS = 16

MARKS = "array<struct<print:long,mark:struct<at:int,offset:int,around:array<long>,windows:array<struct<start:int,a:long,b:long>>>>>"


def _signed(digest: bytes, at: int = 0) -> int:
    return int.from_bytes(digest[at : at + 8], "little", signed=True)


def full_lines(data: bytes) -> tuple[list[int], list[int], list[bytes]]:
    """Numbers, words and digests of the lines that are not blank; white space at a line's
    ends doesn't count."""
    at, sizes, digests = [], [], []
    for n, line in enumerate(data.split(b"\n")):
        if size := len(line.split()):
            at.append(n)
            sizes.append(size)
            digests.append(xxhash.xxh3_128_digest(line.strip()))
    return at, sizes, digests


def window_spans(sizes: list[int], least_words: int) -> Iterable[tuple[int, int]]:
    """(start, end), end exclusive: the shortest window from every line on, and the shortest
    one back from every line."""
    spans: dict[tuple[int, int], None] = {}
    end, words = 0, 0
    for start, size in enumerate(sizes):
        while end < len(sizes) and words < least_words:
            words += sizes[end]
            end += 1
        if words < least_words:
            break
        spans[start, end] = None
        words -= size
    start, words = len(sizes), 0
    for end in range(len(sizes), 0, -1):
        while start and words < least_words:
            start -= 1
            words += sizes[start]
        if words < least_words:
            break
        spans[start, end] = None
        words -= sizes[end - 1]
    return spans


def marks(data: bytes, least_words: int = LEAST_WORDS) -> list[tuple]:
    """Fingerprints of a text: (hash, (number among its full lines, how many lines of those
    around come before it, hashes of the lines around, windows whose minimum it is)). Windows
    are (first full line, 128 bits of all their lines)."""
    _, sizes, digests = full_lines(data)
    found: dict[int, list[tuple[int, int]]] = {}
    for start, end in window_spans(sizes, least_words):
        found.setdefault(min(range(start, end), key=digests.__getitem__), []).append((start, end))
    out = []
    for least, spans in found.items():
        low, high = min(s for s, _ in spans), max(e for _, e in spans)
        wholes = ((s, xxhash.xxh3_128_digest(b"".join(digests[s:e]))) for s, e in spans)
        mark = (least, least - low, [_signed(d) for d in digests[low:high]], [(s, _signed(w), _signed(w, 8)) for s, w in wholes])
        out.append((_signed(digests[least]), mark))
    return out


def extended(own: list[int], at: int, around: list[int], offset: int) -> tuple[int, int]:
    """The longest run (start, end) of ``own`` about ``at`` that equals lines about ``offset``
    of ``around``; empty if not even those two are equal."""
    if own[at] != around[offset]:
        return at, at
    left = right = 0
    while left < min(at, offset) and own[at - left - 1] == around[offset - left - 1]:
        left += 1
    while right < min(len(own) - at, len(around) - offset) and own[at + right] == around[offset + right]:
        right += 1
    return at - left, at + right


def repeated_lines(data: bytes, anchors: Iterable[tuple[int, int, list[int]]], least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Line ranges (start, end: numbers of the first and last line) that repeat what stands
    around ``anchors``: (full line, offset of its equal in around, around)."""
    numbers, sizes, digests = full_lines(data)
    own, out = [_signed(d) for d in digests], []
    for start, end in {extended(own, at, around, offset) for at, offset, around in anchors}:
        if sum(sizes[start:end]) >= least_words:
            out.append((numbers[start], numbers[end - 1]))
    return sorted(out)


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, anchors): for each row with fingerprints that an earlier place has, where they
    are and which lines stand around that place.

    Earlier is by id (null last), then by a hash of the row, then by line.
    """

    def run(texts: Iterable[bytes]) -> Iterable[tuple]:
        return ((marks(x, least_words),) for x in texts)

    rows = docs.select(row_key(id_col, text).alias("key"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    marked = staged(map_texts(rows, run, f"marks {MARKS}").select("key", "id", F.explode("marks").alias("m")).select("key", "id", "m.print", "m.mark.*"), "marks")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    often = marked.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print", salts)
    spread = marked.withColumn("salt", F.pmod(F.hash("key", F.lit(1)), F.lit(SALTS)))
    shared = spread.join(often, ["print", "salt"], "left_semi").select("key", "id", "salt", "at", "offset", "around", F.explode("windows").alias("w")).select("*", "w.*")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key", "start")
    windows = shared.withColumn("place", place)
    first = windows.groupBy("a", "b").agg(F.min(F.struct("place", "offset", "around")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first", salts)
    later = windows.select("key", "at", "place", "a", "b", "salt").join(first, ["a", "b", "salt"]).where("first.place <> place")
    return later.groupBy("key").agg(F.collect_set(F.struct("at", "first.offset", "first.around")).alias("anchors"))


def _without(least_words: int) -> Callable:
    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.IntegerType())]))
    def cut(texts: pd.Series, anchors: pd.Series) -> pd.DataFrame:
        kept, gone = [], []
        for text, places in zip(texts, anchors):
            if text is None:
                kept.append(None)
                gone.append(0)
                continue
            lines, out, upto, n = text.split("\n"), [], 0, 0
            for start, end in repeated_lines(text.encode(), ((p["at"], p["offset"], list(p["around"])) for p in places), least_words):
                out += lines[upto:start]
                n += max(0, end + 1 - max(upto, start))
                upto = max(upto, end + 1)
            out += lines[upto:]
            kept.append("\n".join(out))
            gone.append(n)
        return pd.DataFrame({"text": kept, "n_removed": gone})

    return cut


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text``, and with n_removed,
    the lines that went (blank lines inside a run among them).

    Every deleted line stands, but for white space at its ends, in what is kept: the first
    occurrence of a line is in no later run. Runs below ``least_words`` words stay. All rows
    stay, those whose every line went with an empty text. Null texts stay null. Every line of
    every later run goes, as windows reach both ways. Rows alike in id and text are one
    occurrence and lose the same lines. An empty table gives no rows; other columns pass, but
    n_removed is replaced.
    """
    places = repeated_places(docs, id_col, text, least_words)
    cols = [c for c in docs.columns if c != "n_removed"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"), row_key(id_col, text).alias("key"))
    met = rows.join(places, "key", "left")
    old = F.col("row").getField(text)
    done = met.withColumn("cut", _without(least_words)(F.when(F.col("anchors").isNotNull(), old), F.col("anchors")))
    kept = (F.coalesce("cut.text", old).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in cols)
    return done.select(*kept, F.coalesce("cut.n_removed", F.lit(0)).alias("n_removed"))


ORACLE_SQL = rf"""
with split as (select doc_id, text, string_split(text, chr(10)) as parts from documents),
numbered as (select doc_id, unnest(range(1, len(parts) + 1)) as i, parts from split),
lines as (
  select doc_id, i - 1 as i, parts[i] as line, regexp_replace(regexp_replace(parts[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') as bare,
    len(regexp_extract_all(parts[i], '[^\x20\x09-\x0D]+')) as n
  from numbered
),
full_lines as (
  select *, row_number() over (partition by doc_id order by i) as s, sum(n) over (partition by doc_id order by i) as c from lines where n > 0
),
ends as (
  select f.doc_id, f.s, f.i, min(g.s) as e
  from full_lines f join full_lines g on g.doc_id = f.doc_id and g.s between f.s and f.s + {LEAST_WORDS} and g.c - f.c + f.n >= {LEAST_WORDS}
  group by f.doc_id, f.s, f.i
),
backs as (
  select f.doc_id, max(g.s) as s, f.s as e
  from full_lines f join full_lines g on g.doc_id = f.doc_id and g.s between f.s - {LEAST_WORDS} and f.s and f.c - g.c + g.n >= {LEAST_WORDS}
  group by f.doc_id, f.s
),
placed as (select p.doc_id, p.s, l.i, p.e from (select doc_id, s, e from ends union select doc_id, s, e from backs) p join full_lines l on l.doc_id = p.doc_id and l.s = p.s),
windows as (
  select w.doc_id, w.s, w.i, max(g.i) as last, string_agg(g.bare, chr(10) order by g.s) as content
  from placed w join full_lines g on g.doc_id = w.doc_id and g.s between w.s and w.e
  group by w.doc_id, w.s, w.i, w.e
),
ranked as (select *, row_number() over (partition by content order by doc_id, i) as nth from windows),
gone as (select distinct l.doc_id, l.i from lines l join ranked r on r.doc_id = l.doc_id and r.nth > 1 and l.i between r.i and r.last),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.i) as text from lines l left join gone g on g.doc_id = l.doc_id and g.i = l.i where g.i is null group by l.doc_id),
counts as (select doc_id, count(*)::int as n_removed from gone group by doc_id)
select s.doc_id, case when s.text is null then null else coalesce(k.text, '') end as text, coalesce(c.n_removed, 0) as n_removed
from split s left join kept k on k.doc_id = s.doc_id left join counts c on c.doc_id = s.doc_id
"""
