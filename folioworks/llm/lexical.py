"""Ranked lexical search by two trees, one over items and one over documents.

A document's score for an item sums, over the item's terms, the term's weight times a number
that grows with the term's occurrences and falls with the document's length. So items and
documents are vectors without negative coordinates, and the maxima of their coordinates in a
group of items and in a group of documents bound every score between the two. Groups form
trees; both are descended together from their roots, and a pair of groups goes, with all that
hangs below it, where its bound stays below the weakest k-th best score of its items.

Documents reach the search as their occurrences of the items' terms, sorted in every task so
that neighbours share their heaviest terms. A first pass scores the most promising group of
each block for every item; the k best of those, from all tasks, are where the second pass
starts to prune. Nothing is estimated: what goes can't be among the k best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioworks.llm.batches import map_texts
from folioworks.session import staged

#: Documents an item gets, items and characters of items that are searched at once.
BEST, ITEMS, ITEM_CHARS = 10, 4096, 1 << 22
#: Branches of a tree's node, documents that are sorted together, of a block, and cells of a block.
FAN, SORTED, BLOCK, CELLS = 4, 1 << 14, 512, 1 << 22
LAST = np.iinfo(np.int64).max

#: ASCII letters in lower case and digits stay, other ASCII characters separate.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(_KEPT).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damped(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What ``tf`` occurrences count in documents of ``n`` terms."""
    m = 100 - 75 + (75 * n * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs): how many terms a text has, and how often those of the vocabulary."""
    get = vocabulary.get

    def run(texts: Iterable[bytes]) -> Iterator[tuple]:
        for data in texts:
            words = terms_of(data)
            held = np.array([i for w in words if (i := get(w)) is not None], np.int32)
            terms, tfs = np.unique(held, return_counts=True)
            yield len(words), terms, tfs.astype(np.int32)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return map_texts(rows, run, "n long, terms array<int>, tfs array<int>")


@dataclass
class Node:
    """A group of items: the maxima of their weights."""

    terms: np.ndarray
    weights: np.ndarray
    items: np.ndarray
    children: list[Node]


def item_tree(vectors: list[dict[int, int]]) -> Node | None:
    """Items by their heaviest terms, FAN to a group, groups again, up to one root."""
    heavy = lambda v: [(-w, t) for t, w in sorted(v.items(), key=lambda x: (-x[1], x[0]))[:3]]
    order = sorted((i for i, v in enumerate(vectors) if v), key=lambda i: [t for _, t in heavy(vectors[i])])
    arrays = lambda v: (np.array(list(v), np.int64), np.array(list(v.values()), np.int64))
    level = [(vectors[i], Node(*arrays(vectors[i]), np.array([i]), [])) for i in order]
    while len(level) > 1:
        above = []
        for start in range(0, len(level), FAN):
            some, most = level[start : start + FAN], {}
            for v, _ in some:
                for t, w in v.items():
                    most[t] = max(w, most.get(t, 0))
            above.append((most, Node(*arrays(most), np.concatenate([n.items for _, n in some]), [n for _, n in some])))
        level = above
    return level[0][1] if level else None


class Best:
    """Each item's k best so far, and what a document must reach: a score, and with that score
    an id that isn't larger."""

    def __init__(self, n: int, k: int, least: dict[int, tuple[int, int]]):
        self.k, self.found = k, [[] for _ in range(n)]
        self.score, self.id = np.ones(n, np.int64), np.full(n, LAST)
        for item, (score, doc_id) in least.items():
            self.score[item], self.id[item] = score, doc_id

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores > self.score[item]) | (scores == self.score[item]) & (ids <= self.id[item])
        if good.any():
            rows = sorted(self.found[item] + [(-int(s), int(i)) for s, i in zip(scores[good], ids[good])])[: self.k]
            self.found[item] = rows
            if len(rows) == self.k and (-rows[-1][0], -rows[-1][1]) > (int(self.score[item]), -int(self.id[item])):
                self.score[item], self.id[item] = -rows[-1][0], rows[-1][1]


class Block:
    """A tree over neighbouring documents: a matrix of coordinates a level, documents first."""

    def __init__(self, x: np.ndarray, at: np.ndarray, doc: np.ndarray, n_terms: int, ids: np.ndarray, dtype: type):
        n = -(-len(ids) // FAN) * FAN
        docs = np.zeros((n_terms, n), dtype)
        docs[at, doc] = x
        self.levels, self.ids = [docs], [np.append(ids, np.full(n - len(ids), LAST))]
        while self.levels[-1].shape[1] > 1:
            below, least = self.levels[-1], self.ids[-1]
            short = -below.shape[1] % FAN
            below, least = np.pad(below, ((0, 0), (0, short))), np.pad(least, (0, short), constant_values=LAST)
            self.levels.append(below.reshape(n_terms, -1, FAN).max(-1))
            self.ids.append(least.reshape(-1, FAN).min(-1))

    def bounds(self, node: Node, row_of: np.ndarray, level: int, at: np.ndarray) -> np.ndarray:
        rows = row_of[node.terms]
        there = rows >= 0
        return (node.weights[there].astype(self.levels[0].dtype) @ self.levels[level][np.ix_(rows[there], at)]).astype(np.int64)

    def below(self, level: int, at: np.ndarray) -> np.ndarray:
        down = (at[:, None] * FAN + np.arange(FAN)).ravel()
        return down[down < self.levels[level - 1].shape[1]]

    def descend(self, node: Node, row_of: np.ndarray, depth: int, level: int, at: np.ndarray, best: Best) -> int:
        """Both trees down from ``node`` and the nodes ``at`` of a level; how many bounds were taken."""
        bounds = self.bounds(node, row_of, level, at)
        taken = len(at)
        if node.children:
            at = at[bounds >= best.score[node.items].min()]
            if not len(at):
                return taken
            if level >= depth and level:
                return taken + self.descend(node, row_of, depth, level - 1, self.below(level, at), best)
            return taken + sum(self.descend(child, row_of, depth - 1, level, at, best) for child in node.children)
        item = int(node.items[0])
        if not level:
            best.add(item, bounds, self.ids[0][at])
            return taken
        for start in range(0, len(at), FAN):  # the most promising first, as they raise what the others must reach
            if not start:
                order = np.argsort(-bounds, kind="stable")
                at, bounds = at[order], bounds[order]
            some, high = at[start : start + FAN], bounds[start : start + FAN]
            reach = (high > best.score[item]) | (high == best.score[item]) & (self.ids[level][some] <= best.id[item])
            if high[0] < best.score[item]:
                break
            if reach.any():
                taken += self.descend(node, row_of, depth, level - 1, self.below(level, some[reach]), best)
        return taken

    def promising(self, root: Node, row_of: np.ndarray, best: Best) -> None:
        """For every item, only the documents of the group with the highest bound."""
        stack = [root]
        while stack:
            node = stack.pop()
            stack += node.children
            if not node.children:
                level = min(1, len(self.levels) - 1)
                bounds = self.bounds(node, row_of, level, np.arange(self.levels[level].shape[1]))
                at = self.below(level, np.array([int(bounds.argmax())])) if level else np.arange(self.levels[0].shape[1])
                best.add(int(node.items[0]), self.bounds(node, row_of, 0, at), self.ids[0][at])


def blocks(ids: np.ndarray, n: np.ndarray, lists: list[np.ndarray], n_docs: int, n_terms: int, weights: np.ndarray, dtype: type) -> Iterator[tuple[Block, np.ndarray]]:
    """Blocks of the documents whose posting ``lists`` are (offsets, terms, tfs), neighbours
    sharing their heaviest terms, each with the row of every term in its matrices."""
    offsets, terms, tfs = lists
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(ids)), sizes)
    x = damped(tfs.astype(np.int64), n[doc], n_docs, n_terms)
    used, row = np.unique(terms, return_inverse=True)
    row_of = np.full(len(weights), -1)
    row_of[used] = np.arange(len(used))
    heavy = np.lexsort((-(weights[terms] * x), doc))
    first = offsets[:-1]
    none = np.full(len(ids), -1)
    one, two = none.copy(), none.copy()
    one[sizes > 0] = terms[heavy[first[sizes > 0]]]
    two[sizes > 1] = terms[heavy[first[sizes > 1] + 1]]
    order = np.lexsort((ids, two, one))
    order = order[sizes[order] > 0]
    size = max(FAN, min(BLOCK, CELLS // max(1, len(used))))
    for start in range(0, len(order), size):
        some = order[start : start + size]
        at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in some])
        yield Block(x[at], row[at], np.repeat(np.arange(len(some)), sizes[some]), len(used), ids[some], dtype), row_of


def _search(posted: DataFrame, root: Node, n_items: int, k: int, n_docs: int, n_terms: int, weights: np.ndarray, least: dict[int, tuple[int, int]] | None) -> DataFrame:
    """(item, doc_id, score): each task's k best of an item; without ``least`` those of the
    promising groups only."""
    dtype = np.float64 if float(weights.sum()) * 1e6 < 2**53 else np.int64  # either way exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size = Best(n_items, k, least or {}), [], 0

        def work(some: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(some).combine_chunks()
            ids = t.column("doc_id").fill_null(LAST).to_numpy()
            terms, tfs = t.column("terms").combine_chunks(), t.column("tfs").combine_chunks()
            offsets = terms.offsets.to_numpy().astype(np.int64)
            lists = [offsets - offsets[0], terms.flatten().to_numpy(), tfs.flatten().to_numpy()]
            for block, row_of in blocks(ids, t.column("n").to_numpy(), lists, n_docs, n_terms, weights, dtype):
                if least is None:
                    block.promising(root, row_of, best)
                else:
                    top = len(block.levels) - 1
                    block.descend(root, row_of, top, top, np.arange(block.levels[top].shape[1]), best)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SORTED:
                work(held)
                held, size = [], 0
        if size:
            work(held)
        rows = [(item, None if i == LAST else i, -s) for item, found in enumerate(best.found) for s, i in found]
        columns = [pa.array([r[c] for r in rows], t) for c, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return posted.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_some(docs: DataFrame, items: list[tuple], k: int, id_col: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    counts = [Counter(terms_of((t or "").encode())) for _, t in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    posted = staged(postings(docs, vocabulary, id_col, text), "postings")
    n_docs, n_terms = posted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # as many rows as the items have terms
    vectors = [{i: w * q for t, q in c.items() if (i := vocabulary[t]) in df and (w := weight(n_docs, df[i]))} for c in counts]
    weights = np.zeros(len(vocabulary), np.int64)
    for v in vectors:
        for t, w in v.items():
            weights[t] = max(weights[t], w)
    root = item_tree(vectors)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item int, item_id long")
    if root is None:
        return names.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    args = posted, root, len(items), k, n_docs, n_terms, weights
    seeds = _ranked(_search(*args, None), k).where(F.col("rank") == k).collect()  # a row an item at most
    least = {r["item"]: (r["score"], LAST if r["doc_id"] is None else r["doc_id"]) for r in seeds}
    return _ranked(_search(*args, least), k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", at_once: int = ITEMS, chars: int = ITEM_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Items are the query set: as many as ``at_once`` with ``chars`` characters are searched
    together, more in several passes over the documents. Null texts have no terms; items
    without terms that any document holds have no rows. Equal scores go by id, null ids last;
    repeated documents are documents of their own, repeated items as well. Of an empty
    table nothing is found. Other columns don't matter, whatever their names.
    """
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text"))
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // at_once), -(-size // chars))
    found = None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect() if parts > 1 else asked.collect()
        if some or found is None:
            here = _search_some(docs, [tuple(r) for r in some], k, id_col, text)
            found = here if found is None else found.unionByName(here)
    return found


ORACLE_SQL = r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
),
tfs as (select doc_id, term, count(*) as tf from terms group by all),
sizes as (select doc_id, sum(tf)::bigint as n from tfs group by 1),
whole as (select count(*)::bigint as N, sum(n)::bigint as L from sizes),
dfs as (select term, count(*)::bigint as df from tfs group by 1),
asked as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
),
weighted as (
  select item_id, term, count(*) * floor(1000 * ln((2 * (select N from whole) + 2)::double / (2 * df + 1)))::bigint as w from asked join dfs using (term) group by item_id, term, df
),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * s.n * (select N from whole)) // (select L from whole)))))::bigint as score
  from weighted join tfs using (term) join sizes s using (doc_id) group by 1, 2
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0 qualify rank <= 10
"""
