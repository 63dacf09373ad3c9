"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; the distinct new words of a batch become one
flat array of byte symbols, and merge rounds run over all of them at once: neighbouring
symbols form 64-bit pair keys, found by binary search over the sorted keys of the merge
table, and in each round every word merges its lowest-ranked pair. Finished words leave
the array. A word of more than LONG_WORD bytes, which would take very many rounds, is
merged by a heap of its pairs instead. Words seen before come from a bounded cache, which
only saves work.

Defined cases: empty and null texts give an empty list; text that looks like a special
token is ordinary text; white space and control characters are kept; repeated rows each
give their own list; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.functions.grouped import spread

#: Where the vocabulary files lie, unless the caller says so.
VOCABULARIES = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
NO_RANK = np.iinfo("int32").max
LONG_WORD = 20_000
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public byte-level BPE split pattern: letters, digits (numbers) and white space are filled in.
SPLIT = "'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


def runs_of(kind: str, last: int) -> str:
    """The characters of a Unicode class up to a code point, as ranges of a character class."""
    every = "".join(chr(c) for c in range(last + 1) if not 0xD800 <= c < 0xE000)
    return "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in regex.findall(rf"\p{{{kind}}}+", every))


class Splitter:
    """Splits texts by SPLIT. Texts of the lower planes go through patterns with spelled-out classes, which match faster."""

    def __init__(self):
        self.any = regex.compile(SPLIT.format(letters=r"\p{L}", numbers=r"\p{N}", space=SPACE)).findall
        self.ascii, self.basic = (re.compile(SPLIT.format(letters=runs_of("L", last), numbers=runs_of("N", last), space=SPACE)).findall for last in (0x7F, 0xFFFF))
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        return self.any(text) if self.beyond(text) else self.basic(text)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte (public rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairTable:
    """Merge table of a byte-level BPE vocabulary as sorted arrays, small enough to send with a task (50,000 merges: 1 MB)."""

    def __init__(self, first: np.ndarray, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        self.first, self.keys, self.ranks, self.merged = first, keys, ranks, merged
        self.by_key: dict[int, tuple[int, int]] | None = None

    @classmethod
    def load(cls, path: str) -> PairTable:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        first = np.array([vocabulary[s] for s in byte_symbols()], dtype="int64")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in merges], dtype="int64")
        order = np.argsort(keys, kind="stable")
        merged = np.array([vocabulary[a + b] for a, b in merges], dtype="int64")[order]
        return cls(first, keys[order], order.astype("int32"), merged)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (not empty)."""
        if any(len(w) > LONG_WORD for w in words):
            short = iter(self.encode_words([w for w in words if len(w) <= LONG_WORD]))
            return [self.merge_long(w) if len(w) > LONG_WORD else next(short) for w in words]
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        flat = self.first[np.frombuffer(b"".join(words), dtype="uint8")]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_owner = [], []
        while len(flat):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank, at = self.pair_ranks(flat, owner)
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(flat)])
            finished = np.repeat(lowest == NO_RANK, lengths)
            if finished.any():
                done_ids.append(flat[finished])
                done_owner.append(owner[finished])
            hit = (rank == np.repeat(lowest, lengths)) & ~finished
            where = np.flatnonzero(hit)
            # of overlapping hits (a run of one symbol) every second one merges, from the left
            run = np.cumsum(np.r_[True, np.diff(where) != 1]) - 1 if len(where) else where
            first = where[np.r_[True, np.diff(run) != 0]] if len(where) else where
            where = where[(where - first[run]) % 2 == 0] if len(where) else where
            flat = flat.copy()
            flat[where] = self.merged[at[where]]
            keep = ~finished
            keep[where + 1] = False
            flat, owner = flat[keep], owner[keep]
        ids, owners = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owners, kind="stable")
        ends = np.cumsum(np.bincount(owners, minlength=len(words)))
        return np.split(ids[order], ends[:-1])

    def merge_long(self, word: bytes) -> np.ndarray:
        """Token ids of one long word: pairs come off a heap by rank, then place; a pair that has changed meanwhile is passed over."""
        symbols = self.first[np.frombuffer(word, dtype="uint8")]
        n = len(symbols)
        rank, _ = self.pair_ranks(symbols, np.zeros(n, dtype="int8"))
        symbol, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        if self.by_key is None:
            self.by_key = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))
        known = self.by_key.get
        heap = [(int(rank[i]), i, symbol[i], symbol[i + 1]) for i in np.flatnonzero(rank != NO_RANK).tolist()]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = known(a << 32 | b)[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n:
                    found = known(symbol[left] << 32 | symbol[right])
                    if found:
                        heapq.heappush(heap, (found[0], left, symbol[left], symbol[right]))
        left = np.array(symbol, dtype="int64")
        return left[left >= 0]

    def pair_ranks(self, flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, at = np.full(len(flat), NO_RANK, dtype="int32"), np.zeros(len(flat), dtype="int64")
        if len(flat) > 1:
            key = (flat[:-1] << 32) | flat[1:]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[place] == key) & (owner[:-1] == owner[1:])
            rank[:-1] = np.where(known, self.ranks[place], NO_RANK)
            at[:-1] = place
        return rank, at


class Encoder:
    """Encodes batches of texts; keeps the ids (with ``lengths_only`` their number) of at most ``cache`` words and of no word longer than 64 bytes."""

    def __init__(self, pairs: PairTable, cache: int = 200_000, lengths_only: bool = False):
        self.pairs, self.most, self.lengths_only, self.known = pairs, cache, lengths_only, {}
        self.split = Splitter()

    def encode(self, texts: Iterable[str | None]) -> Iterator:
        """The ids (or the number of tokens) of each text of a batch of bounded size."""
        words = [self.split(t) if t else [] for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        fresh = list(set(chain.from_iterable(words)).difference(known))
        long = []
        if fresh:
            coded = [w.encode("utf-8", "surrogatepass") for w in fresh]
            for word, code, ids in zip(fresh, coded, self.pairs.encode_words(coded)):
                known[word] = len(ids) if self.lengths_only else ids.tolist()
                if len(code) > 64:
                    long.append(word)
        for ws in words:
            got = map(known.__getitem__, ws)
            yield sum(got) if self.lengths_only else list(chain.from_iterable(got))
        for word in long:
            del known[word]


def pieces(texts: list[str | None], most: int = 4_000_000) -> Iterator[slice]:
    """Slices of a batch of at most ``most`` characters (or one text)."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, lengths_only: bool = False) -> DataFrame:
    """doc_id and ``ids`` (list of integers), or ``n_tokens`` with ``lengths_only``. No shuffle, but to deal a small table to all cores."""
    pairs = PairTable.load(os.path.join(folder, f"{vocabulary}.json"))
    shared = documents.sparkSession.sparkContext.broadcast((pairs.first, pairs.keys, pairs.ranks, pairs.merged))  # fixed size: the vocabulary's merges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(PairTable(*shared.value), lengths_only=lengths_only)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in pieces(texts):
                got = list(encoder.encode(texts[part]))
                key = batch.column(0).slice(part.start, part.stop - part.start)
                if lengths_only:
                    out = pa.array(got, pa.int64())
                else:
                    sizes = np.fromiter(map(len, got), dtype="int32", count=len(got))
                    values = np.fromiter(chain.from_iterable(got), dtype="int32", count=int(sizes.sum()))
                    out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("int32")), pa.array(values))
                yield pa.RecordBatch.from_arrays([key, out], names=[doc_id, "n_tokens" if lengths_only else "ids"])

    kind = dict(documents.dtypes)[doc_id]
    return spread(documents.select(doc_id, text)).mapInArrow(run, f"`{doc_id}` {kind}, " + ("n_tokens long" if lengths_only else "ids array<int>"))
