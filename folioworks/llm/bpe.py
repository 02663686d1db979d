"""BPE encoding and decoding by forced boundaries.

Two neighbouring bytes that stand next to each other inside no token of the vocabulary can
never end up in one token, so a text may be cut between them and each fragment encoded by
itself: the ids are the fragments' ids, one after another. Fragments are short and recur,
and each is encoded once per worker and kept. Words are cut from each other likewise, as
every word ends in a symbol with the word-end mark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from folioworks.llm.batches import map_texts

#: Words and fragments kept per worker. When that many words are kept they become the older ones, and those go: words that recur stay.
KEPT = 1 << 17
#: Up to this many symbols a scan for the best merge costs less than a heap.
SHORT = 32
NO_MERGE = (1 << 40, -1)


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it prints, else the next from U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    symbols = {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(others)}
    return [symbols[b] for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind: NFC, white space dropped, lower case, words by a
    pattern, bytes as symbols, BPE with a word-end mark, no decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end, vocab = model["end_of_word_suffix"], model["vocab"]
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        #: Characters whose form, case and class every Unicode version agrees on.
        self.unusual = re.compile("[^\x00-\x1b\x20-\x84\x86-˿]")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        tokens = {i: t for t, i in [*vocab.items(), *special.items()]}
        self.tokens = np.array([tokens.get(i, "").encode() for i in range(max(tokens) + 1)], object)
        symbols = byte_symbols()
        self.symbols = symbols
        self.first = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.joined = self._joined(vocab)
        self.joined_rows = self.joined.tolist()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fragments: dict[tuple[bytes, bool], list[int]] = {}

    def _joined(self, vocab: dict[str, int]) -> np.ndarray:
        """Whether byte b follows byte a inside some token, at [a, b]."""
        joined, byte_of = np.zeros((256, 256), bool), {s: b for b, s in enumerate(self.symbols)}
        for token in vocab:
            data = [byte_of[c] for c in token.removesuffix(self.end) if c in byte_of]
            joined[data[:-1], data[1:]] = True
        return joined

    def _merge(self, ids: list[int]) -> list[int]:
        """Merges of least rank first, the leftmost of equal ones first."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        merge_of = self.merges.get
        while len(ids) > 1:
            found = [merge_of(p, NO_MERGE) for p in zip(ids, ids[1:])]
            if (best := min(found)) is NO_MERGE:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap, for fragments of any length."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank, i, new, p) for i, p in enumerate(zip(ids, ids[1:])) for rank, new in [self.merges.get(p, NO_MERGE)] if new >= 0]
        heapify(heap)
        while heap:
            _, i, new, pair = heappop(heap)
            j = after[i] if ids[i] is not None else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = new, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := self.merges.get((ids[a], ids[b]))):
                    heappush(heap, (found[0], a, found[1], (ids[a], ids[b])))
        return [x for x in ids if x is not None]

    def _fragment(self, data: bytes, ends_word: bool) -> list[int]:
        ids = [self.first[b] for b in data]
        if ends_word:
            ids[-1] = self.last[data[-1]]
        return self._merge(ids)

    def _kept_fragment(self, data: bytes, ends_word: bool) -> list[int]:
        key = (data, ends_word)
        if (found := self.fragments.get(key)) is None:
            found = self._fragment(data, ends_word)
            if len(self.fragments) >= KEPT:
                self.fragments.clear()
            self.fragments[key] = found
        return found

    def _cuts(self, data: bytes) -> list[int]:
        """Where two neighbours stand together in no token."""
        if len(data) > SHORT:
            at = np.frombuffer(data, np.uint8)
            return (np.flatnonzero(~self.joined[at[:-1], at[1:]]) + 1).tolist()
        rows = self.joined_rows
        return [i for i, (a, b) in enumerate(zip(data, data[1:]), 1) if not rows[a][b]]

    def _word(self, data: bytes) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        inner = self._cuts(data)
        if not inner:
            ids = self._fragment(data, True)
        else:
            cuts, ids = [0, *inner, len(data)], []
            for a, b in zip(cuts, cuts[1:]):
                ids += self._kept_fragment(data[a:b], b == len(data))
        return pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> Iterable[bytes]:
        if self.unusual.search(text):  # the library's own tables decide on forms, case and classes
            byte_of = {s: b for b, s in enumerate(self.symbols)}
            found = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
            return [self._word(bytes(byte_of[c] for c in w)) for w, _ in found]
        known, out = self.words, []
        for w in self.word.findall(text.lower()):
            if (ids := known.get(w)) is None:
                if (ids := self.older.get(w)) is None:
                    ids = self._word(w.encode())
                if len(w) <= 64:
                    if len(known) >= KEPT:
                        known, self.older = {}, known
                        self.words = known
                    known[w] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, special tokens' strings included, as encode() of the library
        gives them without special tokens added; little-endian unsigned 32-bit integers."""
        if not self.special_split or "<" not in text and not any(s in text for s in self.special):
            return b"".join(self._plain(text))
        pieces = self.special_split.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else b"".join(self._plain(p)) for i, p in enumerate(pieces) if p)

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings with a space between, in UTF-8: what decode() of a library
        tokenizer without a decoder gives, special tokens kept."""
        return b" ".join(self.tokens[np.frombuffer(ids, "<u4")].tolist())

    def restore(self, ids: bytes) -> str:
        """The normalised words again, a space after each."""
        byte_of = {s: b for b, s in enumerate(self.symbols)}
        strings = (self.tokens[i].decode() for i in np.frombuffer(ids, "<u4"))
        data = b"".join(bytes(byte_of[c] for c in t.removesuffix(self.end)) + b" " * t.endswith(self.end) if t not in self.special else t.encode() for t in strings)
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One per worker process."""
    return WordBpe(path)


def with_tokens(docs: DataFrame, vocabulary: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` without ``text``, and with n_tokens long, ids (binary: little-endian unsigned
    32-bit integers) and, if asked for, decoded (the ids decoded again).

    ``vocabulary`` is the tokenizer file's path, which every executor has. Null and empty texts
    have no ids. Texts are encoded whole, rows independently of each other: ties, repeated rows
    and an empty table need no rule. Columns of the same names are replaced.
    """

    def run(texts: Iterable[bytes]) -> Iterable[tuple]:
        bpe = load(vocabulary)
        for data in texts:
            ids = bpe.encode(data.decode("utf-8", "replace"))
            yield (len(ids) // 4, ids, bpe.decode(ids).decode()) if decoded else (len(ids) // 4, ids)

    return map_texts(docs, run, "n_tokens long, ids binary" + ", decoded string" * decoded, text)
