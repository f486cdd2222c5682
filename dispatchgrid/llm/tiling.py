"""Benchmark decontamination by greedy string tiling.

A text and an item that share a run of MIN_MATCH words (seeds, joined by their hashes) are tiled: running Karp-Rabin hashes
find the longest runs of words that neither side has marked yet, and these are marked, until none of MIN_MATCH words is left. The share
of an item's words under tiles is its coverage; since tiles may lie anywhere, a passage whose sentences were reordered is
covered as well as a verbatim one. Seeds found bound the coverage, so only items that can still reach the threshold are
tiled. Words are those of the lower-cased text without ASCII punctuation.

Items are handled in blocks of at most BLOCK_WORDS words, each broadcast to one narrow pass over all texts; so a benchmark
of any size works and what is broadcast is bounded. No row moves.

Nulls and empty texts: no words, so nothing is found. Items of fewer than MIN_MATCH words are not tested. Null doc_id: not
reported. Repeated rows and items: each is reported. Ties between tiles of one length: the earlier place in the item, then
in the text. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, small_batches, texts
from .shingles import rolled

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000

#: An odd base of the running hashes and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ONE = np.ones(1, np.uint64)
_PUNCTUATION = string.punctuation.encode()
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64()), ("longest", pa.int64())])


def words_of(text: str) -> np.ndarray:
    words = text.encode().lower().translate(None, _PUNCTUATION).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class _Running:
    """Karp-Rabin hashes of all runs of a length, for any length in one pass: differences of sums of words times powers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.up = np.cumprod(np.concatenate([_ONE, np.full(n, _BASE)]))
        down = np.cumprod(np.concatenate([_ONE, np.full(n, _INVERSE)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * down[:n])])
        self.open = np.ones(n, bool)

    def mark(self, at: int, size: int) -> None:
        self.open[at : at + size] = False

    def free(self, at: int, size: int) -> bool:
        return bool(self.open[at : at + size].all())

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of `size` words of which none is marked."""
        n = len(self.open) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        shut = np.concatenate([[0], np.cumsum(~self.open)])
        at = np.flatnonzero(shut[size:] == shut[:n])
        return at, (self.sums[at + size] - self.sums[at]) * self.up[at]


def tile(item: np.ndarray, text: np.ndarray, least: int = MIN_MATCH, where: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, text place, length). where: words of the text that can lie in a tile.

    Each round finds the longest length at which unmarked runs of both sides meet (a run of some length holds runs of all
    lesser ones, so bisection finds it) and marks those that don't overlap, by place in the item, then in the text.
    """
    a, b, tiles = _Running(item), _Running(text), []
    if where is not None:
        b.open &= where
    most = min(len(item), len(text))
    while most >= least:
        lo, hi = least - 1, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if np.isin(a.runs(mid)[1], b.runs(mid)[1]).any() else (lo, mid - 1)
        most = lo
        if most < least:
            break
        (at, own), (to, other) = a.runs(most), b.runs(most)
        order = np.argsort(other, kind="stable")
        to, other = to[order], other[order]
        left, right = np.searchsorted(other, own), np.searchsorted(other, own, "right")
        found = False
        waits: dict[int, list[int]] = {}  # by first place in `to`: the text's places with that hash, those still free last to first
        for p, i, j in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
            if i == j or not a.free(p, most):
                continue
            if i not in waits:
                waits[i] = to[i:j][::-1].tolist()
            unlike = []
            while waits[i]:
                t = waits[i].pop()
                if not b.free(t, most):
                    continue
                if (item[p : p + most] == text[t : t + most]).all():
                    a.mark(p, most)
                    b.mark(t, most)
                    tiles.append((p, t, most))
                    found = True
                    break
                unlike.append(t)
            waits[i] += reversed(unlike)
        if not found:  # equal hashes of unequal runs alone
            most -= 1
    return tiles


class Benchmark:
    """A block of items with an index of their seeds."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int = MIN_MATCH):
        self.least = least
        self.items = [(i, w) for i, w in items if len(w) >= least]
        seeds = [rolled(w, least) for _, w in self.items]
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]) if seeds else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner, self.place = flat[order], owner[order], place[order]

    def find(self, text: np.ndarray, least_coverage: float) -> Iterator[tuple[int, float, int, int]]:
        if len(text) < self.least or not len(self.seeds):
            return
        grams = rolled(text, self.least)
        at = np.searchsorted(self.seeds, grams)
        hit = np.flatnonzero(self.seeds[np.minimum(at, len(self.seeds) - 1)] == grams)
        if not len(hit):
            return
        # Each distinct seed of the text once: its places in the items, and, for items that may qualify, those in the text.
        distinct, which = np.unique(grams[hit], return_inverse=True)
        left, right = np.searchsorted(self.seeds, distinct), np.searchsorted(self.seeds, distinct, "right")
        seen: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        for g, i, j in zip(range(len(distinct)), left.tolist(), right.tolist(), strict=True):
            for k, p in zip(self.owner[i:j].tolist(), self.place[i:j].tolist(), strict=True):
                seen[k][0].append(p)
                if not seen[k][1] or seen[k][1][-1] != g:
                    seen[k][1].append(g)
        for k, (starts, seeds) in seen.items():
            i, item = self.items[k]
            if self._reach(len(item), starts).sum() < least_coverage * len(item):
                continue
            tiles = tile(item, text, self.least, self._reach(len(text), hit[np.isin(which, seeds)]))
            coverage = sum(n for *_, n in tiles) / len(item)
            if coverage >= least_coverage:
                yield i, coverage, len(tiles), max(n for *_, n in tiles)

    def _reach(self, n: int, starts) -> np.ndarray:
        """Which of n words lie in a seed that starts at one of the places."""
        edge = np.zeros(n + 1, np.int64)
        at = np.unique(np.fromiter(starts, np.int64))
        edge[at] += 1
        edge[at + self.least] -= 1
        return np.cumsum(edge[:n]) > 0


def _blocks(items: DataFrame, id_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about BLOCK_WORDS words; one block at a time is on the driver."""
    items = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")).cast("long"))).first()[0] or 0
    n = total // BLOCK_WORDS + 1
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toLocalIterator()]


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, coverage, tiles, longest: pairs whose item is covered to the threshold or more."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = texts(docs).where("doc_id is not null")
    out = None
    for block in _blocks(items, item_id):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = Benchmark([(i, words_of(x)) for i, x in shared.value])
            for b in batches:
                found = [(d, *f) for d, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for f in bench.find(words_of(x), coverage)]
                if found:
                    yield batch(_FOUND, **dict(zip(_FOUND.names, zip(*found, strict=True), strict=True)))

        part = docs.mapInArrow(run, "doc_id long, item_id long, coverage double, tiles long, longest long")
        out = part if out is None else out.union(part)
    return out
