"""Phrases of several words that occur together, by an FM-index for every shard of the corpus.

A shard is about 65,536 words of one language as numbers, pieces of sentences separated by
zeros, with the words behind the numbers, as one string: what passes between Spark and Python
is a few long values a row, not a value a word. Its index is the Burrows-Wheeler transform of that
sequence and of its reverse: a phrase is an interval in either, which a word to the left
splits in the one and a word to the right in the other, so that counts of phrases and of
their extensions come from intervals alone, to a limited depth. Shards give their phrases'
counts, which are summed up over the corpus.

Between lengths the corpus decides what is worth extending. Words, pairs and triples that are
too rare in the whole corpus end a sequence for the longer ones, as no phrase can be more
frequent than what it holds. What is frequent enough reaches the shards as bits at hashes,
a filter of a fixed size: a false hit costs a row that the summing drops. Words, pairs and
triples, of which there are most, are first counted by their hashes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioworks.session import bound_batches, staged

#: Occurrences and words of a phrase, phrases a language.
LEAST, DEPTH, MOST = 100, 5, 2000
#: Words of a shard, shards of a file (a reader holds a file's shards at once), bytes of texts that are split into words at once and that a task gathers, and bits of a filter.
SHARD, FILED, BYTES, MOST_HELD, FILTER = 1 << 16, 16, 1 << 20, 1 << 26, 1 << 26
#: Phrases that go out at once, phrases and marks that a task sums up before it sends them, and lengths counted by marks first.
SENT, HELD, MARKS, MARKED = 1 << 14, 1 << 18, 1 << 19, (1, 2, 3)
#: Tasks that send phrases, for each core: every task sends each phrase that it holds, so more of them only send the same ones again.
TASKS = 2
#: Lengths whose counts are summed up before the next ones are looked for.
ROUNDS = ((2,), (3,), (4, 5))

#: A-Z in lower case, tabs as spaces, every mark that ends a piece as a full stop.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: Odd numbers that weigh the words' hashes by their places.
_WEIGHTS = np.array([(xxhash.xxh64_intdigest(bytes([i])) | 1) for i in range(8)], np.uint64)


def chunks(text: bytes) -> Iterator[bytes]:
    """A text with its pieces' ends as full stops, cut at such ends into parts to split at once."""
    plain, start = text.translate(_PLAIN), 0
    while len(plain) - start > BYTES:
        cut = plain.rfind(b".", start, start + BYTES)
        cut = plain.find(b".", start + BYTES) if cut < 0 else cut
        if cut < 0:
            break
        yield plain[start:cut]
        start = cut + 1
    yield plain[start:]


class Shard:
    """Words of one language that are being gathered."""

    def __init__(self) -> None:
        self.parts: list[pa.Array] = []
        self.plain: list[bytes] = []
        self.size = self.waiting = 0

    def add(self, plain: bytes) -> None:
        self.plain.append(plain)
        self.waiting += len(plain)
        if self.waiting >= BYTES:
            self.split()

    def split(self) -> None:
        words = b" . ".join(self.plain).replace(b".", b" . ").split()
        words.append(b".")
        self.parts.append(pa.array(words, pa.binary()).dictionary_encode())
        self.size += len(words)
        self.plain, self.waiting = [], 0

    def row(self) -> tuple:
        """(ids, words, n): numbers from 1 on, 0 where a piece ends, and how many are not 0."""
        if self.plain:
            self.split()
        coded = pa.chunked_array(self.parts).unify_dictionaries().combine_chunks()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        stop = pc.index(words, pa.scalar(b".", pa.binary())).as_py()
        number = np.arange(len(words)) + 1
        number[stop:] -= 1
        number[stop] = 0
        ids = number[ids]
        ids = ids[np.append(True, (ids[1:] > 0) | (ids[:-1] > 0))]
        keep = pc.not_equal(words, pa.scalar(b".", pa.binary()))
        self.parts, self.size = [], 0
        return ids.astype("<u4").tobytes(), b" ".join(words.filter(keep).to_pylist()), int(np.count_nonzero(ids))


def shards(docs: DataFrame, text: str, lang: str, size: int = SHARD) -> DataFrame:
    """(lang, ids, words, n), a row a shard: the words of a task's texts, language by language."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Shard] = {}
        held = 0

        def out(name: str) -> pa.RecordBatch:
            ids, words, n = open_[name].row()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids], pa.binary()), pa.array([words], pa.binary()), pa.array([n], pa.int64())], names=["lang", "ids", "words", "n"])

        for batch in batches:
            names, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())
            for name, data in zip(names, texts):
                shard = open_.setdefault(name, Shard())
                for part in chunks(data.as_py() or b""):
                    shard.add(part)
                    held += len(part)
                    if shard.size >= size:
                        yield out(name)
                if held > MOST_HELD:  # of many languages none may fill a shard: all go out
                    yield from (out(n) for n, x in open_.items() if x.size or x.plain)
                    open_, held = {}, 0
        for name, shard in open_.items():
            if shard.size or shard.plain:
                yield out(name)

    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "lang string, ids binary, words binary, n long")


class Index:
    """The FM-index of a sequence in which 0 separates, its rows sorted by ``depth`` symbols."""

    def __init__(self, s: np.ndarray, depth: int):
        n, top = len(s), int(s.max(initial=0)) + 1
        key, reach = s.astype(np.int64), 1
        while reach < depth:
            step = min(reach, depth - reach)
            if key.max(initial=0) >= 1 << 31:
                key = np.unique(key, return_inverse=True)[1]
            more = np.zeros(n, np.int64)
            if step == reach:
                more[: max(0, n - step)] = key[step:]
                key = key * (int(key.max(initial=0)) + 1) + more
            else:  # symbols one by one, as fewer are wanted than a doubling gives
                for i in range(reach, depth):
                    if key.max(initial=0) >= 1 << 31:
                        key = np.unique(key, return_inverse=True)[1]
                    more[:] = 0
                    more[: max(0, n - i)] = s[i:]
                    key = key * top + more
            reach += step
        order = np.argsort(key, kind="stable")
        #: Rows before those that begin with each symbol.
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top))])
        #: The symbol before each row's suffix.
        self.before = s[order - 1].astype(np.int32)
        self.before[order == 0] = 0
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        #: Where the suffix that begins one symbol earlier stands.
        self.last_to_first = rank[order - 1]

    def extended(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All words before the intervals: (interval, word, size, low, rows of the interval with
        smaller symbols), in order of interval and word."""
        of = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        symbol = self.before[rows]
        key = of * (int(self.before.max(initial=0)) + 1) + symbol
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(key)))
        head = order[start]
        smaller = start - (np.cumsum(size) - size)[of[head]]
        # rows alike in ``depth`` symbols stand in any order: the least place is where the new interval begins
        new = np.minimum.reduceat(self.last_to_first[rows[order]], start) if len(start) else start
        some = symbol[head] > 0
        head = head[some]
        return of[head], symbol[head].astype(np.int64), count[some], new[some].astype(np.int64), smaller[some]


def phrases_of(s: np.ndarray, lengths: tuple[int, ...], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of ``lengths``: (phrases, a row of words each; counts; how often the commonest
    word stands before; and after) in the sequence ``s``, in which 0 separates."""
    top = max(lengths)
    forth, back = Index(s, top), Index(s[::-1], top)
    words = np.flatnonzero(np.diff(forth.first))
    words = words[words > 0]
    phrases, low, mirror = words[:, None], forth.first[words], back.first[words]
    count = forth.first[words + 1] - low
    for m in range(1, top + 1):
        of = longer = np.zeros(0, np.int64)
        if m < depth:
            of, word, longer, new_low, smaller = forth.extended(low, count)
        if m in lengths:
            left, right = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
            np.maximum.at(left, of, longer)
            if m < depth:
                after, _, n, _, _ = back.extended(mirror, count)
                np.maximum.at(right, after, n)
            yield phrases, count, left, right
        if m < top:
            phrases = np.column_stack([word, phrases[of]])
            low, mirror, count = new_low, mirror[of] + smaller, longer


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """At 0 the separator's, then the words'."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((0, *(xxhash.xxh64_intdigest(w, seed) for w in words)), np.uint64, len(words) + 1)


def marks(hashes: np.ndarray) -> np.ndarray:
    """32 bits for phrases (rows of their words' hashes)."""
    mixed = (hashes * _WEIGHTS[: hashes.shape[1]]).sum(axis=1, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _WEIGHTS[-1]
    return (mixed >> np.uint64(32)).astype(np.int64)


def marked_filter(found: DataFrame, bits: int) -> bytes:
    """The bits at the marks in ``found`` (at): ``bits`` in all, however many there are."""
    one = F.pmod("at", F.lit(bits)) + 1  # buckets are numbered from 1, as is what stands in them
    packed = found.groupBy(F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bitmap"))
    out, width = np.zeros(max(1, bits // 8), np.uint8), 4096
    for bucket, bitmap in packed.collect():  # as many bytes as the filter has, whatever the corpus
        start = (bucket - 1) * width
        part = np.frombuffer(bitmap, np.uint8)[: len(out) - start]
        out[start : start + len(part)] = part
    return out.tobytes()


def frequent_filter(found: DataFrame, bits: int = FILTER) -> bytes:
    """The filter of the phrases in ``found`` (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                at.append(int(marks(word_hashes(lang, phrase.encode().split(b" "))[None, 1:])[0]))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], names=["at"])

    return marked_filter(found.select("lang", "phrase").mapInArrow(run, "at long"), bits)


def _bit(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def allowed(ids: np.ndarray, hashes: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    """The sequence with separators wherever the filters of words, pairs, ... end it. A place
    stays only beside another one, as part of what the last filter passes."""
    s = ids * _bit(filters[0], marks(hashes[:, None]) % (len(filters[0]) * 8))[ids] * (ids > 0) if filters else ids
    for m, filter_ in enumerate(filters[1:], 2):
        n = len(s) - m + 1
        if n <= 0:
            return s[:0]
        runs = np.lib.stride_tricks.sliding_window_view(s, m)
        at = np.flatnonzero((runs > 0).all(axis=1))
        hit = at[_bit(filter_, marks(hashes[runs[at]]) % (len(filter_) * 8))]
        # places that a passing run covers stay, and a separator comes where two neighbours share none
        cover, link = np.zeros(len(s) + 1, np.int64), np.zeros(len(s) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + m, -1)
        np.add.at(link, hit, 1)
        np.add.at(link, hit + m - 1, -1)
        covered, linked = np.cumsum(cover)[:-1] > 0, np.cumsum(link)[:-1] > 0
        keep = np.flatnonzero(covered)
        parted = ~linked[keep]
        out = np.zeros(len(keep) + int(parted.sum()), s.dtype)
        out[np.arange(len(keep)) + np.cumsum(parted) - parted] = s[keep]
        s = out
    ends = np.append(True, (s[1:] > 0) | (s[:-1] > 0)) if len(s) else np.zeros(0, bool)
    return s[ends]


def _sequences(batch: pa.RecordBatch, filters: list[np.ndarray]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """(language, words, their hashes, sequence) of shards, by ``allowed``."""
    for i in range(batch.num_rows):
        lang, words = batch.column("lang")[i].as_py(), batch.column("words")[i].as_py().split()
        ids, hashes = np.frombuffer(batch.column("ids")[i].as_py(), "<u4").astype(np.int64), word_hashes(lang, words)
        s = allowed(ids, hashes, filters)
        if (s > 0).any():
            yield lang, pa.array(words, pa.binary()), hashes, s


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([a for a, _ in parts])
    order = np.argsort(at, kind="stable")
    at = at[order]
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    n = np.concatenate([n for _, n in parts])[order]
    return at[start], np.add.reduceat(n, start) if len(at) else n


def _packed(numbers: np.ndarray) -> bytes:
    """Eight bytes a number, first all lowest ones and so on: small numbers shrink to little when sent."""
    return np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def mark_filter(held: DataFrame, filters: list, m: int, least: int, bits: int, n_words: int) -> bytes:
    """A filter that passes every phrase of ``m`` words that occurs ``least`` times: they are
    counted by their marks. A task sends its marks with counts, in order, as a few rows of
    packed differences; a row is a range of marks, so many that about MARKS meet in one."""
    shift = 32 - min(20, max(4, (n_words // MARKS).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, parts, size = [np.frombuffer(f.value, np.uint8) for f in filters], [], 0

        def out(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            ranges, start = np.unique(at >> shift, return_index=True)
            each = list(zip(start, [*start[1:], len(at)]))
            columns = [pa.array(ranges.astype(np.int32)), *(pa.array([_packed(x) for x in xs], pa.binary()) for xs in ((np.diff(at[a:b], prepend=0) for a, b in each), (n[a:b] for a, b in each)))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "steps", "n"])

        for batch in batches:
            for _, _, hashes, s in _sequences(batch, passed):
                if len(s) < m:
                    continue
                runs = np.lib.stride_tricks.sliding_window_view(s, m)
                parts.append(np.unique(marks(hashes[runs[(runs > 0).all(axis=1)]]), return_counts=True))
                size += len(parts[-1][0])
                if size > MARKS:
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
                    if size > MARKS // 2:
                        yield out(*parts[0])
                        parts, size = [], 0
        if size:
            yield out(*_summed(parts))

    def often(rows: pa.Table) -> pa.Table:
        at, n = _summed([(np.cumsum(_unpacked(steps.as_py())), _unpacked(n.as_py())) for steps, n in zip(rows.column("steps"), rows.column("n"))])
        return pa.table([pa.array(at[n >= least], pa.int64())], ["at"])

    sent = held.select("lang", "ids", "words").mapInArrow(run, "part int, steps binary, n binary")
    return marked_filter(sent.groupBy("part").applyInArrow(often, "at long"), bits)


def _combined(parts: list[pa.RecordBatch]) -> pa.Table:
    sums = pa.Table.from_batches(parts).group_by(["lang", "phrase", "m"]).aggregate([(c, "sum") for c in ("a", "before", "after")])
    return sums.select(["lang", "phrase", "m", "a_sum", "before_sum", "after_sum"]).rename_columns(["lang", "phrase", "m", "a", "before", "after"])


def shard_phrases(held: DataFrame, lengths: tuple[int, ...], filters: list, depth: int = DEPTH) -> DataFrame:
    """(lang, phrase, m, a, before, after): the phrases of ``lengths`` words that the filters
    (broadcasts) pass, with their counts and those of their commonest neighbours in each
    shard, summed up over the shards of a task as far as it holds them. There are no more tasks
    than keep the cores busy, however many shards there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, parts, size = [np.frombuffer(f.value, np.uint8) for f in filters], [], 0
        for batch in batches:
            for lang, words, _, s in _sequences(batch, passed):
                for phrases, count, left, right in phrases_of(s, lengths, depth):
                    for start in range(0, len(count), SENT):
                        some = slice(start, start + SENT)
                        columns = [words.take(pa.array(c - 1)) for c in phrases[some].T]
                        text = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())).cast(pa.string())
                        n = len(text)
                        made = [pa.repeat(lang, n), text, pa.array(np.full(n, phrases.shape[1], np.int32)), *(pa.array(x[some]) for x in (count, left, right))]
                        parts.append(pa.RecordBatch.from_arrays(made, names=["lang", "phrase", "m", "a", "before", "after"]))
                        size += n
                if size > HELD:
                    parts = _combined(parts).to_batches()
                    size = sum(p.num_rows for p in parts)
                    if size > HELD // 2:
                        yield from (x for p in parts for x in pa.Table.from_batches([p]).to_batches(SENT))
                        parts, size = [], 0
        if size:
            yield from _combined(parts).to_batches(SENT)

    tasks = TASKS * held.sparkSession.sparkContext.defaultParallelism
    return held.select("lang", "ids", "words").coalesce(tasks).mapInArrow(run, "lang string, phrase string, m int, a long, before long, after long")


def first_words(phrase: Column, k: Column) -> Column:
    return F.substring_index(phrase, F.lit(" "), k) if isinstance(k, int) else F.call_function("substring_index", phrase, F.lit(" "), k)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, depth: int = DEPTH, most: int = MOST, rounds: tuple[tuple[int, ...], ...] = ROUNDS, shard: int = SHARD, bits: int = FILTER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of 2 to
    ``depth`` words that occur ``least`` times or more.

    A phrase's score is that of its weakest cut. Phrases of which a longer one occurs as often
    go: a sum of the shards' commonest neighbours below the count shows for most that there is
    none, the others look among the phrases that are a word longer. Null texts hold no words,
    a null language counts as ``und``; ties go by count and phrase, repeated rows count
    again. Texts may be of any length; of an empty table there is no row. Other columns don't
    matter, whatever their names.
    """
    spark = docs.sparkSession
    held = staged(shards(docs, text, lang, shard), "shards", FILED)
    totals = held.groupBy("lang").agg(F.sum("n").alias("n"))
    n_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def frequent(lengths: tuple[int, ...], depth: int) -> DataFrame:
        marked = []
        if min(lengths) in MARKED:
            marked = [spark.sparkContext.broadcast(mark_filter(held, filters, min(lengths), least, bits, n_words))]
        sums = shard_phrases(held, lengths, [*filters, *marked], depth).groupBy("lang", "phrase", "m").agg(*(F.sum(c).alias(c) for c in ("a", "before", "after")))
        made = staged(sums.where(F.col("a") >= least), "phrases")
        for f in marked:
            f.unpersist()
        return made

    found, filters = [], []
    found.append(frequent((1,), 1))  # only the frequent ones of the words leave the shards, and none needs its neighbours
    filters.append(spark.sparkContext.broadcast(frequent_filter(found[0], bits)))
    for lengths in rounds:
        lengths = tuple(m for m in lengths if m <= depth)
        if not lengths:
            break
        found.append(frequent(lengths, depth))
        if lengths != rounds[-1]:
            filters.append(spark.sparkContext.broadcast(frequent_filter(found[-1].where(F.col("m") == max(lengths)), bits)))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = staged(every, "frequent")
    for f in filters:
        f.unpersist()
    phrases = every.where("m > 1")
    counts = every.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cut = phrases.select("lang", "phrase", "m", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    halves = cut.select("*", first_words(F.col("phrase"), F.col("k")).alias("one"), first_words(F.col("phrase"), F.col("k") - F.col("m")).alias("two"))
    met = halves.join(counts.select("lang", F.col("part").alias("one"), F.col("f").alias("l")), ["lang", "one"]).join(counts.select("lang", F.col("part").alias("two"), F.col("f").alias("r")), ["lang", "two"])
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    scored = met.join(totals, "lang").withColumn("score", F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n").cast("decimal(16,0)"), whole("l") * whole("r")))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    open_ = phrases.where((F.col("before") >= F.col("a")) | (F.col("after") >= F.col("a"))).select("lang", "phrase", "a")
    longer = phrases.where("m > 2").select("lang", F.col("a").alias("f"), F.explode(F.array(first_words(F.col("phrase"), F.col("m") - 1), first_words(F.col("phrase"), F.lit(1) - F.col("m")))).alias("phrase"))
    inside = open_.join(longer, ["lang", "phrase"]).where("f >= a").select("lang", "phrase").distinct()
    kept = weakest.join(inside, ["lang", "phrase"], "left_anti").select("lang", "phrase", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents where text is not null
),
listed as (select row_number() over () as p, lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
starts as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from listed),
grams as (select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase, count(*)::hugeint as f from starts, range(1, {DEPTH + 1}) as lengths(m) where i + m - 1 <= len(ws) group by all),
totals as (select lang, sum(f)::hugeint as n from grams where m = 1 group by 1),
cand as (select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from grams where m > 1 and f >= {LEAST}),
cuts as (select c.*, unnest(range(1, m)) as k from cand c),
scored as (
  select c.lang, c.phrase, c.m, c.a, c.k, l.f as l, r.f as r, n, (1000 * a * n) // (l.f * r.f) as score
  from cuts c join grams l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1:c.k], ' ') join grams r on r.lang = c.lang and r.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ')
    join totals t on t.lang = c.lang
),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (
  select w.* from weakest w where not exists (
    select 1 from cand b where b.lang = w.lang and b.m > w.m and 100 * b.a >= 100 * w.a and contains(' ' || b.phrase || ' ', ' ' || w.phrase || ' '))
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::int as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from kept qualify rank <= {MOST}
"""
