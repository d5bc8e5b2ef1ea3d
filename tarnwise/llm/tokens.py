"""Encoding with a public byte-level BPE vocabulary.

A word is encoded by speculation: greedy longest match proposes tokens, and the
proposal is the word's encoding exactly when every adjacent pair of its tokens is one
that the merges could have left standing side by side. That check is vectorised over
all pairs of a batch. Only words with a pair that fails are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
#: Pattern that splits text into words before merging, as published with the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words a worker remembers before it starts afresh.
CACHE_WORDS = 400_000

_loaded: dict[str, Encoder] = {}


class Encoder:
    """Encodes text by a rank file; a token's rank is its id, lower ranks merge first."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words = regex.compile(pattern)
        self.longest = max(map(len, self.ranks))
        self.cache: dict[str, tuple[int, ...]] = {}
        self.exact = 0
        self.proposed = 0
        n = max(self.ranks.values()) + 1
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        pairs: dict[int, int] = {}
        for piece, rank in self.ranks.items():
            if len(piece) > 1:
                parts = self._merge(piece, below=rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = parts
                    pairs[parts[0] << 32 | parts[1]] = rank
        self.pair_keys = np.fromiter(sorted(pairs), dtype=np.int64, count=len(pairs))
        self.pair_rank = np.fromiter((pairs[int(k)] for k in self.pair_keys), dtype=np.int64, count=len(pairs))
        self.checked: dict[tuple[int, int], bool] = {}

    def _merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """Exact encoding of a word: repeatedly merge the adjacent pair of least rank, leftmost first. O(n log n)."""
        ranks, n = self.ranks, len(piece)
        limit = below if below is not None else 1 << 60
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), [i + 1 for i in range(n)]
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n:
                r = ranks.get(piece[i : end[j]])
                if r is not None and r < limit:
                    heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = nxt[i]
            if j >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _propose(self, piece: bytes) -> list[int]:
        """Greedy longest match."""
        ranks, out, i, n = self.ranks, [], 0, len(piece)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                r = ranks.get(piece[i:j])
                if r is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging would leave tokens a[i] and b[i] as they are when they stand side by side.

        Both tokens are taken apart in the reverse order of their making. At each stage
        the two parts that touch must not have a merge that would have come before the
        step just undone; all pairs of the arrays go through the stages together.
        """
        ok = np.ones(len(a), bool)
        t1, t2 = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), np.iinfo(np.int64).max, dtype=np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y, top = t1[live], t2[live], limit[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_rank[at] < top)
            ok[live[clash]] = False
            # Undo the later of the two tokens; a token that is a single byte cannot be undone.
            single_x, single_y = self.right[x] == x, self.left[y] == y
            undo_x = np.where(single_x, False, np.where(single_y, True, x > y))
            done = clash | (single_x & single_y)
            new_top = np.where(undo_x, x, y + 1)
            # The left token's last step ties with nothing to its right; the right token's step yields to an equal rank on its left.
            limit[live] = np.minimum(top, new_top)
            t1[live] = np.where(undo_x, self.right[x], x)
            t2[live] = np.where(~undo_x & ~single_y, self.left[y], y)
            live = live[~done]
        return ok

    def learn(self, words: list[str]) -> None:
        """Encode words not yet remembered."""
        pieces = [w.encode() for w in words]
        proposals = []
        for w, p in zip(words, pieces):
            r = self.ranks.get(p)
            proposals.append([r] if r is not None else self._propose(p))
        fresh = list({pair for ids in proposals for pair in zip(ids, ids[1:])} - self.checked.keys())
        if fresh:
            both = np.array(fresh, dtype=np.int64)
            if len(self.checked) > CACHE_WORDS:
                self.checked = {}
                fresh = list({pair for ids in proposals for pair in zip(ids, ids[1:])})
                both = np.array(fresh, dtype=np.int64)
            self.checked.update(zip(fresh, self.compatible(both[:, 0], both[:, 1]).tolist()))
        for w, p, ids in zip(words, pieces, proposals):
            self.proposed += 1
            if not all(self.checked[pair] for pair in zip(ids, ids[1:])):
                self.exact += 1
                ids = self._merge(p)
            self.cache[w] = tuple(ids)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their offsets; null and empty texts have none."""
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cache = self.cache
        new = list({w for words in split for w in words if w not in cache})
        if new:
            self.learn(new)
        flat: list[int] = []
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, words in enumerate(split):
            for w in words:
                flat.extend(cache[w])
            offsets[i + 1] = len(flat)
        return np.array(flat, dtype=np.int32), offsets


def encoder(path: str) -> Encoder:
    """The encoder of a rank file, loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def rank_file(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode(df: DataFrame, key: str, text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, ids: bool = True) -> DataFrame:
    """(key, ids array<int>, n_tokens long) of each row's text, without special tokens.

    Null and empty texts have an empty list and 0 tokens. Text that spells a special
    token is ordinary text. One pass over the scan, no shuffle; with `ids` false only
    the count crosses back. Texts are taken whole and in slices of 256 a time, so a
    batch of long texts does not swell.
    """
    path = rank_file(tokenizer, folder)
    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, " + ("ids array<int>, " if ids else "") + "n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat, offsets = enc.encode_batch(part.column(1).to_pylist())
                counts = pa.array(np.diff(offsets), pa.int64())
                lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))] if ids else []
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, counts], names=[key, *(["ids"] if ids else []), "n_tokens"])

    return df.select(key, text).mapInArrow(run, schema)
