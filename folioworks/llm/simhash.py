"""SimHash near-duplicates by an inverted index over byte positions.

Two 64-bit fingerprints that differ in at most three bits share at least five of their
eight bytes, each in its own position. A posting list for one (position, byte) would hold
1/256 of all fingerprints, so lists are kept for the 56 choices of three positions, of which
such a pair meets in ten or more. What meets in a list shares three bytes; the tally of
shared positional bytes, taken in the first list that a pair meets in, retains the pairs
with five or more, and those are verified by their bits. In long lists the tally is taken
by splitting them on two more positions. Equal fingerprints are indexed once, however many
documents are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioworks.llm.batches import bound_batches
from folioworks.llm.components import connected_components, local_roots
from folioworks.llm.words import row_key
from folioworks.session import staged

SEED = 42
BYTES, MOST_BITS = 8, 3
#: Bytes that a pair within MOST_BITS is sure to share.
LEAST_SHARED = BYTES - MOST_BITS
#: Byte positions of a posting list: fewer make longer lists, LEAST_SHARED would leave nothing to count.
LISTED = 3
PLACES = tuple(combinations(range(BYTES), LISTED))
#: Longer lists are split on further positions; of those, longer ones look up the neighbours of each member.
COMPARE_UP_TO = 1024


def fingerprint(data: bytes, shingle_words: int = 3) -> int:
    """SimHash of UTF-8 ``data``: A-Z lower-cased, words at ASCII white space."""
    words = data.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))) if len(words) >= shingle_words else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` without ``text``, and with ``out``: the fingerprint as a signed long.

    Null and empty texts, and texts of white space, have 0. Whole texts are read, however long.
    """
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py() or b"") for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.array(found, np.uint64).view(np.int64))], names=[*keep, out])

    cols = [F.col(f"`{c}`") for c in keep]
    source = docs.select(*cols, F.col(f"`{text}`").cast("binary").alias("_text"))
    schema = source.select(*cols, F.lit(0).cast("long").alias(out)).schema
    return source.mapInArrow(run, schema)


def posting_keys(fp: Column) -> Column:
    """For each choice of LISTED byte positions: its number above the bytes there."""
    keys = []
    for n, places in enumerate(PLACES):
        key = F.lit(n).cast("long")
        for p in places:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)))
        keys.append(key)
    return F.array(*keys)


def shared_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The tally: positions at which two fingerprints have the same byte."""
    return (np.bitwise_xor(x, y).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def retained(x: np.ndarray, y: np.ndarray, last: np.ndarray | int, least_shared: int = LEAST_SHARED) -> np.ndarray:
    """Which pairs reach the tally and are their list's own: of the lists that a pair meets
    in, that whose ``last`` position is the pair's LISTED-th shared one."""
    same = np.bitwise_xor(x, y).view(np.uint8).reshape(-1, BYTES) == 0
    before = (same & (np.arange(BYTES) < np.reshape(last, (-1, 1)))).sum(axis=1)
    return np.flatnonzero((before < LISTED) & (shared_bytes(x, y) >= least_shared))


def verified(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= MOST_BITS


def list_links(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within MOST_BITS among distinct sorted fingerprints that share
    LEAST_SHARED bytes, all at the same positions.

    Few members are all compared; of many, each member's possible neighbours (all flips of
    up to three of the bits that vary) are looked up, so that the work grows with their
    number, not with its square.
    """
    n, lefts, rights = len(members), [], []
    if n <= COMPARE_UP_TO:
        for step in range(1, n):
            ok = np.flatnonzero(verified(members[:-step], members[step:]))
            lefts.append(ok)
            rights.append(ok + step)
    else:
        varied = int(np.bitwise_or.reduce(members ^ members[0]))
        bits = [np.uint64(1 << i) for i in range(64) if varied >> i & 1]
        for k in range(1, MOST_BITS + 1):
            for flips in combinations(bits, k):
                other = members ^ np.bitwise_or.reduce(np.array(flips))
                at = np.minimum(np.searchsorted(members, other), n - 1)
                ok = np.flatnonzero((members[at] == other) & (other > members))
                lefts.append(ok)
                rights.append(at[ok])
    none = [np.empty(0, np.int64)]
    return np.concatenate(none + lefts), np.concatenate(none + rights)


def posted_links(keys: np.ndarray, fps: np.ndarray, least_shared: int = LEAST_SHARED) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within MOST_BITS of each list (rows with one key, keys sorted), without
    those that belong to another list, as they are found there. Parts of a long list may
    give a pair again.

    Short lists tally every pair, all lists at once. A long one is split by the bytes at each
    choice of further positions beyond its own: members of a part reach the tally together.
    """
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    last = np.array([p[-1] for p in PLACES])[keys >> (8 * LISTED)]
    ends = np.repeat(start + size, size)
    at, step, lefts, rights = np.flatnonzero(np.repeat(size <= COMPARE_UP_TO, size)), 0, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(at):
        step += 1
        at = at[at + step < ends[at]]
        held = at[retained(fps[at], fps[at + step], last[at], least_shared)]
        ok = held[verified(fps[held], fps[held + step])]
        lefts.append(ok)
        rights.append(ok + step)
    for s, n in zip(start[size > COMPARE_UP_TO], size[size > COMPARE_UP_TO]):
        members = np.sort(fps[s : s + n])
        order = s + np.argsort(fps[s : s + n], kind="stable")
        octets = members.view(np.uint8).reshape(n, BYTES).astype(np.uint64)
        for more in combinations(range(last[s] + 1, BYTES), least_shared - LISTED):
            part = sum((octets[:, p] << np.uint64(8 * i) for i, p in enumerate(more)), np.zeros(n, np.uint64))
            by = np.argsort(part, kind="stable")
            for each in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
                left, right = list_links(members[each])
                lefts.append(order[each[left]])
                rights.append(order[each[right]])
    return np.concatenate(lefts), np.concatenate(rights)


def _list_edges(batches: Iterator[pa.RecordBatch], least_shared: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by both to edges that join what each list links: at most one
    edge less than the list has members."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        left, right = posted_links(keys, fps, least_shared)
        linked, where = np.unique(np.r_[left, right], return_inverse=True)
        root = local_roots(len(linked), where[: len(left)], where[len(left) :])
        hung = np.flatnonzero(root != np.arange(len(linked)))
        return pa.RecordBatch.from_arrays([pa.array(fps[linked[x]].view(np.int64)) for x in (hung, root[hung])], schema=schema)

    held: list[tuple[np.ndarray, np.ndarray]] = []  # an unfinished list at the end of what came so far
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if held[0][0][0] == held[-1][0][-1]:
            continue
        keys, fps = (np.concatenate(x) for x in zip(*held))
        cut = np.searchsorted(keys, keys[-1])
        held = [(keys[cut:], fps[cut:])]
        yield edges(keys[:cut], fps[:cut])
    if held:
        yield edges(*(np.concatenate(x) for x in zip(*held)))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v) that connect all that MOST_BITS links."""
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = fps.repartition(parts, "fp")  # few files may hold them all, and each makes 56 rows
    posted = spread.select("fp", F.explode(posting_keys(F.col("fp"))).alias("key")).select("key", "fp")
    lists = posted.repartition(parts, "key").sortWithinPartitions("key", "fp")
    least_shared = LEAST_SHARED
    return lists.mapInArrow(lambda batches: _list_edges(batches, least_shared), "u long, v long").distinct()


def _classes(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, fp, component_id) for ids of any ordered type."""
    prints = staged(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))), "prints")
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    roots = connected_components(fingerprint_links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    linked = staged(rooted, "rooted")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = linked.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col``, fp (signed long) and component_id, the smallest
    id of a document that can be reached over links of at most three differing bits.

    Equal fingerprints link at once, so only distinct ones are indexed: a group of copies
    of any size is one entry. Rows with a null id are classed like others and give no
    component id; it is null if a class has no other. Repeated rows stay repeated. An
    empty table gives no rows. Other columns play no part.
    """
    return _classes(docs, id_col, text)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the class's smallest id (null last),
    of several with that id the one whose row hashes lowest; repeated rows count once."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).alias("id"), F.col(text).alias("text"), row_key(id_col, text).alias("key"))
    rows = keyed.select(F.struct(F.col("id").isNull().alias("last"), "id", "key").alias("row"), "text")
    first = _classes(rows, "row", "text").where(F.col("row") == F.col("component_id")).select(F.col("row.key").alias("key")).distinct()
    kept = keyed.select("doc", "key").join(first, "key", "left_semi")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    return kept.withColumn("nth", nth).where("nth = 1").select("doc.*")


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
