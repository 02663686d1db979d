"""Best-fit packing of documents into sequences by exact complements.

A document's tokens and an end token are cut into pieces of at most a sequence's capacity.
Packing needs the pieces' lengths only, and there are no more different ones than the
capacity: the driver plans on how many pieces each length has, whatever the corpus. For the
longest length that is left, sums of one, two and three available lengths are looked up for
what fills its gap exactly, and the combination is taken as often as counts allow. Lengths
that nothing completes are best-fit into the fullest sequence that holds them.

Pieces are numbered within their length, in cells that spread a frequent length over many
tasks, and each number finds its sequence and place in the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from folioworks.llm.batches import map_texts
from folioworks.llm.bpe import byte_symbols
from folioworks.session import staged

#: Tokens of a sequence, and the token that ends a document.
CAPACITY, END = 1024, 2
#: Pieces of a length that one task numbers, and the least number of cells.
CELL, LEAST_CELLS = 1 << 15, 64

PIECES = "array<struct<piece:int,start:long,length:int,ids_crc32:long{}>>"
#: The split of a byte-level tokenizer (fixed values), and the same without looking ahead:
#: alike where no white space stands beside white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_SPLIT = SPLIT.replace(r"|\s+(?!\S)", "")


class ByteBpe:
    """Ids of a byte-level tokenizer file, as encode() gives them without special tokens added.

    Texts go to tiktoken with the file's own vocabulary. Where a text has characters whose class
    depends on the Unicode version, it is cut at spaces between two plain characters, over which
    no token reaches, and the parts with such characters are left to the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab, byte_of = spec["model"]["vocab"], {s: b for b, s in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        merged = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        if merged != sorted(merged):
            raise ValueError("a merge's rank must be the order of its token's id")
        self.any, self.plain = (tiktoken.Encoding("bytes", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (SPLIT, PLAIN_SPLIT))
        self.unusual = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-˿]")
        self.other_space = re.compile("[\t\x0b-\r]")
        self.sure = re.compile("(?<=[!-~¡-˿]) (?=[!-~¡-˿])")

    def _usual(self, text: str) -> bytes:
        runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self.other_space.search(text)
        return array("I", (self.any if runs else self.plain).encode_ordinary(text)).tobytes()

    def _parts(self, text: str) -> Iterable[bytes]:
        usual: list[str] = []
        for n, part in enumerate(self.sure.split(text)):
            part = " " * (n > 0) + part
            if not self.unusual.search(part):
                usual.append(part)
                continue
            yield self._usual("".join(usual))
            yield array("I", self.library.encode(part, add_special_tokens=False).ids).tobytes()
            usual = []
        yield self._usual("".join(usual))

    def _whole(self, text: str) -> bytes:
        return b"".join(self._parts(text)) if self.unusual.search(text) else self._usual(text)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.special):
            return self._whole(text)
        parts = self.special_split.split(text)
        return b"".join(pack("<I", self.special[p]) if i % 2 else self._whole(p) for i, p in enumerate(parts))


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` tokens: whole ones but for the first."""
    first = (n - 1) % capacity + 1
    return [(max(0, e - capacity), e) for e in range(first, n + 1, capacity)]


def with_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, and ids if asked for) of every row: its tokens,
    then ``end``, cut into ``capacity`` tokens, the first piece with what is over."""

    def run(texts: Iterable[bytes]) -> Iterator[tuple]:
        bpe, last = load(vocabulary), pack("<I", end)
        for data in texts:
            ids = bpe.encode(data.decode("utf-8", "replace")) + last
            pieces = []
            for piece, (a, b) in enumerate(cuts(len(ids) // 4, capacity)):
                own = ids[4 * a : 4 * b]
                pieces.append((piece, a, b - a, zlib.crc32(own), *([own] if keep_ids else [])))
            yield (pieces,)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    made = map_texts(rows, run, "pieces " + PIECES.format(",ids:binary" * keep_ids))
    return made.select("id", F.inline("pieces")).withColumnRenamed("id", id_col)


class Sums:
    """Available lengths, how many there are, and which sums one or two of them make."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.n[length] = n
        self.there = self.n > 0
        self.pairs = np.zeros(2 * capacity + 1, np.int64)
        for a in np.flatnonzero(self.there):
            b = np.flatnonzero(self.there[: a + 1])
            self.pairs[a + b] += 1
        self.pairs[2 * np.flatnonzero(self.n == 1)] -= 1

    def take(self, length: int, n: int) -> None:
        before, self.n[length] = self.n[length], self.n[length] - n
        if before >= 2 > self.n[length]:
            self.pairs[2 * length] -= 1
        if before and not self.n[length]:
            self.there[length] = False
            self.pairs[length + np.flatnonzero(self.there)] -= 1

    def holds(self, lengths: tuple[int, ...]) -> bool:
        return all(self.n[x] >= k for x, k in Counter(lengths).items())

    def pair(self, total: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths of the sum ``total``, the longer one as long as can be."""
        if total < 2 or not self.pairs[total]:
            return None
        a = np.arange(total - 1, (total - 1) // 2, -1)
        a = a[a < len(self.n)]
        for x in a[self.there[a] & self.there[total - a]]:
            if self.holds((*beside, int(x), int(total - x))):
                return int(x), int(total - x)
        return None

    def filling(self, length: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill ``gap`` exactly beside ``length``."""
        if self.holds((length, gap)):
            return (gap,)
        if two := self.pair(gap, (length,)):
            return two
        a = np.arange(min(gap - 2, length), 0, -1)
        for x in a[self.there[a] & (self.pairs[gap - a] > 0)]:
            if two := self.pair(gap - int(x), (length, int(x))):
                return (int(x), *two)
        return None


def exact_sequences(sums: Sums, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Combinations that fill a sequence, with how often each is taken, and the lengths left over."""
    plan, rest = [], {}
    for length in range(capacity, 0, -1):
        while n := int(sums.n[length]):
            found = () if length == capacity else sums.filling(length, capacity - length)
            if found is None:
                rest[length] = n
                sums.take(length, n)
                break
            need = Counter((length, *found))
            times = min(int(sums.n[x]) // k for x, k in need.items())
            for x, k in need.items():
                sums.take(x, k * times)
            plan.append(((length, *found), times))
    return plan, rest


def best_fit(rest: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest lengths first, each into the fullest sequence that has room for it."""
    open_: dict[int, list[list]] = {}
    room = np.zeros(capacity + 1, bool)

    def put(gap: int, inside: tuple[int, ...], times: int) -> None:
        if times:
            open_.setdefault(gap, []).append([inside, times])
            room[gap] = True

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fits = np.flatnonzero(room[length:])
            gap = int(fits[0]) + length if len(fits) else capacity
            inside, times = open_[gap].pop() if len(fits) else ((), n)
            if len(fits) and not open_[gap]:
                room[gap] = False
            each = gap // length
            whole = min(times, n // each)
            part = 1 if whole < times and n - whole * each else 0
            some = n - whole * each if part else 0
            put(gap - each * length, inside + (length,) * each, whole)
            put(gap - some * length, inside + (length,) * some, part)
            if len(fits):
                put(gap, inside, times - whole - part)
            n -= whole * each + some
    return [(inside, times) for groups in open_.values() for inside, times in groups]


def released(plan: list[tuple[tuple[int, ...], int]], rest: dict[int, int], n: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """The plan without ``n`` of its sequences, those of most pieces first, and the lengths
    left over with theirs."""
    kept, loose = [], Counter(rest)
    for inside, times in sorted(plan, key=lambda x: (-len(x[0]), x[0])):
        out = min(n, times)
        n -= out
        for length in inside if out else ():
            loose[length] += out
        if times > out:
            kept.append((inside, times - out))
    return kept, loose


#: Shares of the exact sequences that are opened again, to see whether best fit does better with their pieces.
SHARES = (0, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """How many sequences hold which lengths; every piece is in one.

    Exact combinations use up short pieces, which the lengths that nothing completes may need:
    the fewest sequences of several tries count, each with more short pieces left to best fit.
    """
    exact, rest = exact_sequences(Sums(counts, capacity), capacity)
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best: tuple[int, list] | None = None
    for share in SHARES:
        kept, loose = released(exact, rest, int(share * sum(n for _, n in exact)))
        plan = kept + best_fit(loose, capacity)
        n = sum(times for _, times in plan)
        if best is None or n < best[0]:
            best = n, plan
        if n == least:
            break
    return best[1]


def places(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, how many in a sequence, first sequence, offset), by length
    and number: where the pieces of a length go, in the order of their numbers."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for inside, times in plan:
        offset = 0
        for length, each in Counter(inside).items():
            rows.append((length, used[length], each, sequence, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for): the
    pieces of every row of ``docs``, packed into sequences of at most ``capacity`` tokens.

    ``vocabulary`` is a byte-level tokenizer's file, which every executor has. Null and empty
    texts are their end token alone. Rows of equal ids, repeated ones too, are documents of
    their own; which of two equal pieces goes to which place is open. Other columns don't
    matter, whatever their names; an empty table gives no rows.
    """
    made = with_pieces(docs, vocabulary, id_col, text, capacity, end, keep_ids).withColumn("_part", F.spark_partition_id())
    pieces = staged(made, "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    where = places(plan_sequences(counts, capacity))
    cells = max(LEAST_CELLS, -(-max(counts.values(), default=0) // CELL))
    order = [id_col, "piece", "start", "ids_crc32", "_part"]
    celled = pieces.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    sizes = celled.groupBy("length", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("length", "_cell").orderBy(*order))
    numbered = celled.withColumn("_nth", within - 1).join(first, ["length", "_cell"]).withColumn("_nth", F.col("_first") + F.col("_nth"))
    keep = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    wide = numbered.select(*keep, "_nth")
    key = (where[:, 0] << 44) + where[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_nth"))
            own = where[np.searchsorted(key, (length << 44) + nth, "right") - 1]
            past = nth - own[:, 1]
            added = [own[:, 3] + past // np.maximum(own[:, 2], 1), own[:, 4] + past % np.maximum(own[:, 2], 1) * length]
            columns = [batch.column(c) for c in keep] + [pa.array(x) for x in added]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema if f.name != "_nth")
    return wide.mapInArrow(place, fields + ", sequence_id long, offset long").withColumn("length", F.col("length").cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pieces packed with their ids: a sequence holds no more
    than its capacity, so its pieces come together in one row."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(inside, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))
