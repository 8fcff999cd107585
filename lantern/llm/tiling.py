"""Evaluation texts leaking into training text (problem 9).

Method: greedy string tiling. Every text is a sequence of words. Windows of as many words as the
shortest match are hashed by a running Karp-Rabin sum; equal windows of an item and a document seed
matches, which are extended as far as they go. The longest match is marked as a tile, matches lose
what is marked, and so on until nothing of the shortest length is left. Tiles need not be in order,
so reordered passages add to an item's coverage as well.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Words of the shortest match.
SHORTEST = 12
#: Characters of items held in one index; more items are searched in so many blocks more.
BLOCK_CHARS = 20_000_000

_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased, with HTML tags as separators."""
    return _WORD.findall(_TAG.sub(" ", text).lower()) if text else []


class Index:
    """The windows of a set of items, in sorted arrays: twenty bytes a word besides the different words."""

    def __init__(self, items: list[tuple[int, str]], shortest: int = SHORTEST):
        self.shortest = shortest
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, array]] = []
        self.top = pow(_BASE, shortest - 1, _MOD)
        hashes, owners, starts = array("q"), array("i"), array("i")
        for key, text in items:
            seq = array("i", (self.number.setdefault(w, len(self.number) + 1) for w in words(text)))
            for at, h in self.rolling(seq):
                hashes.append(h)
                owners.append(len(self.items))
                starts.append(at)
            self.items.append((key, seq))
        found = np.frombuffer(hashes, np.int64) if hashes else np.zeros(0, np.int64)
        order = np.argsort(found, kind="stable")
        self.hashes = found[order]
        self.owners, self.starts = (np.frombuffer(x, np.int32)[order] if x else np.zeros(0, np.int32) for x in (owners, starts))

    def rolling(self, seq: list[int] | array) -> Iterator[tuple[int, int]]:
        """(start, hash) of every window of seq."""
        k, h = self.shortest, 0
        for i, w in enumerate(seq):
            if i >= k:
                h -= seq[i - k] * self.top
            h = (h * _BASE + w) % _MOD
            if i >= k - 1:
                yield i - k + 1, h

    def seeds(self, text: str | None) -> tuple[list[int], dict[int, list[tuple[int, int]]]]:
        """The numbered words of a text (0: in no item) and, by item, the (text, item) starts of equal windows."""
        number, k, found = self.number, self.shortest, {}
        seq = array("i", (number.get(w, 0) for w in words(text)))
        start, n = 0, len(seq)
        while start < n:
            # Only stretches of words that items know at all can hold a window.
            try:
                end = seq.index(0, start)
            except ValueError:
                end = n
            if end - start >= k:
                own = np.fromiter((h for _, h in self.rolling(seq[start:end])), np.int64, end - start - k + 1)
                low, high = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
                for at in np.flatnonzero(high > low):
                    window = seq[start + at : start + at + k]
                    for j in range(low[at], high[at]):
                        item, pos = int(self.owners[j]), int(self.starts[j])
                        if window == self.items[item][1][pos : pos + k]:
                            found.setdefault(item, []).append((start + int(at), pos))
            start = end + 1
        return seq, found


def tiles(seeds: list[tuple[int, int]], shortest: int) -> list[tuple[int, int, int]]:
    """(text start, item start, length) of the tiles that greedy tiling marks, longest first."""
    heap: list[tuple[int, int, int]] = []
    # Seeds one after the other on a diagonal are one match.
    run: list[int] | None = None
    for d, t in sorted((t - i, t) for t, i in seeds):
        if run and run[0] == d and t == run[2] + 1:
            run[2] = t
        else:
            if run:
                heap.append((-(run[2] - run[1] + shortest), run[1], run[1] - run[0]))
            run = [d, t, t]
    if run:
        heap.append((-(run[2] - run[1] + shortest), run[1], run[1] - run[0]))
    heapq.heapify(heap)
    in_text: set[int] = set()
    in_item: set[int] = set()
    out = []
    while heap:
        size, t, i = heapq.heappop(heap)
        size = -size
        free = [t + j not in in_text and i + j not in in_item for j in range(size)]
        if all(free):
            out.append((t, i, size))
            in_text.update(range(t, t + size))
            in_item.update(range(i, i + size))
            continue
        j = 0
        while j < size:
            if not free[j]:
                j += 1
                continue
            e = j
            while e < size and free[e]:
                e += 1
            if e - j >= shortest:
                heapq.heappush(heap, (-(e - j), t + j, i + j))
            j = e
    return out


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_key, n_tiles, longest, covered, item_words): every document and item that share `shortest` words in a row.

    covered is the number of words of the item under tiles. The items are a stated query set; they
    are indexed in blocks of at most block_chars characters, each block is broadcast and the
    documents are read once per block, row by row and whole, without a shuffle. Null and empty
    texts, rows without a key and items shorter than a window match nothing; items under one key
    are searched each, and a document delivered twice is reported twice. Only the named columns are
    read. Empty tables give no rows.
    """
    sizes = items.select(F.sum(F.length(item_text)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(sizes) // block_chars))
    sc = docs.sparkSession.sparkContext
    schema = f"{key} {dict(docs.dtypes)[key]}, {item_key} {dict(items.dtypes)[item_key]}, n_tiles int, longest int, covered int, item_words int"
    source = spread(docs.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()), key)
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == b)
        rows = [(r[0], r[1]) for r in part.select(item_key, item_text).dropna().distinct().collect()]
        shared = sc.broadcast(Index(rows, shortest))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for d in batches:
                found = []
                for k, t in zip(d[key], d[text]):
                    for item, starts in index.seeds(t)[1].items():
                        marked = tiles(starts, index.shortest)
                        item_id, seq = index.items[item]
                        found.append((k, item_id, len(marked), max(m[2] for m in marked), sum(m[2] for m in marked), len(seq)))
                yield pd.DataFrame(found, columns=[key, item_key, "n_tiles", "longest", "covered", "item_words"])

        one = source.mapInPandas(run, schema)
        out = one if out is None else out.unionByName(one)
    return out
