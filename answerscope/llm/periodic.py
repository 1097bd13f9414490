"""Runs of repeated words (operator 12): maximal stretches with a smallest period q, at least max(6, 4 q) words long.

Descending-LCP Kruskal. The suffixes of a text that share their first words are sorted; neighbours in that order are edges, weighted by
the number of words they share (LCP). Edges are taken by decreasing LCP, and each unites two classes of suffixes: ordered sets of
their positions, the smaller inserted into the larger. Two positions i < j that become neighbours in the united class share exactly LCP
words, so [i, j + LCP) has period j - i; no class held both before, so nothing between them repeats sooner and the period is the
smallest. If the words before i and j differ, the stretch can't be extended and is a run. Every run of exponent 2 and more is met that way, at its
first two periods.

Many texts are sorted in one numpy pass; a word's number is its text's own, so classes never reach across texts. Suffixes
whose first 1, 2, 4, ... words are unique leave the sorting at once; a text without repeated windows of four words ends there.

Defined results: a NULL or empty text has no runs and an empty collapsed text. Every row gives a row, also repeated rows and
rows without id. Columns of the input other than id and text play no part. A text is worked on whole in one task, in memory of a
few dozen bytes a word.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, column, prepare, table, text_or_empty
from .words import numbered

LEAST, EXPONENT = 6, 4
#: Positions per block of an ordered set.
BLOCK = 1024
WORD = r"[^\x20\x09-\x0D]+"


class Positions:
    """An ordered set of positions in blocks, so that an insertion moves one block only."""

    __slots__ = ("blocks", "first", "size")

    def __init__(self, position: int):
        self.blocks, self.first, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def put(self, position: int) -> tuple[int | None, int | None]:
        """Insert and return the neighbours below and above."""
        at = max(0, bisect_right(self.first, position) - 1)
        block = self.blocks[at]
        i = bisect_right(block, position)
        below = block[i - 1] if i else None
        above = block[i] if i < len(block) else self.first[at + 1] if at + 1 < len(self.first) else None
        block.insert(i, position)
        self.first[at] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks.insert(at + 1, block[BLOCK:])
            self.first.insert(at + 1, block[BLOCK])
            del block[BLOCK:]
        return below, above


def united(large: Positions, small: Positions) -> Iterator[tuple[int, int]]:
    """Insert `small` into `large`; the pairs of positions, one of each set, that are neighbours afterwards."""
    places = list(small)
    last = None
    for k, position in enumerate(places):
        below, above = large.put(position)
        if below is not None and below != last:
            yield below, position
        if above is not None and (k + 1 == len(places) or places[k + 1] > above):
            yield position, above
        last = position


def repeated_suffixes(classes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of suffixes that are neighbours in the sorted order and share `least` words at least, by prefix doubling.

    A class of suffixes equal in their first `width` words is known by the place of its first member in the sorted order.
    """
    n = len(classes)
    order = np.argsort(classes, kind="stable")
    ordered = classes[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[n] = -1
    alone = new & np.concatenate((new[1:], [True]))
    active, width, coarse = order[~alone], 1, None
    while True:
        if width <= least:
            coarse = rank.copy()
        if not len(active):
            break
        follows = rank[np.minimum(active + width, n)]
        old = rank[active]
        by = np.lexsort((follows, old))
        active, old, follows = active[by], old[by], follows[by]
        begins = np.concatenate(([True], old[1:] != old[:-1]))
        parts = begins | np.concatenate(([True], follows[1:] != follows[:-1]))
        at = np.arange(len(active))
        rank[active] = old + at[np.flatnonzero(parts)][np.cumsum(parts) - 1] - at[np.flatnonzero(begins)][np.cumsum(begins) - 1]
        alone = parts & np.concatenate((parts[1:], [True]))
        active, width = active[~alone], 2 * width
    suffixes = np.empty(n, np.int64)
    suffixes[rank[:n]] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    same = coarse[left] == coarse[right]
    return left[same], right[same]


def common_words(classes: memoryview, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Shared words of each pair (left[k], right[k]), in the order of `right`; a position shares at most one word less than the one before."""
    found, last, shared = [], -2, 0
    for j, i in zip(right.tolist(), left.tolist()):
        shared = max(0, shared - 1) if j == last + 1 else 0
        while classes[i + shared] == classes[j + shared]:
            shared += 1
        found.append(shared)
        last = j
    return found


def runs_of(classes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least max(least, exponent * period) words, by start, then period."""
    need = min(max(least, exponent * q) - q for q in range(1, least + 1))
    if len(classes) <= need:
        return []
    left, right = repeated_suffixes(classes, need)
    by = np.argsort(right)
    left, right = left[by], right[by]
    ended = memoryview(np.append(classes, -1))
    shared = np.array(common_words(ended, left, right), np.int64)
    order = np.argsort(-shared, kind="stable")
    order = order[shared[order] >= need]
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x], sets[x] = x, Positions(x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    runs = []
    for i, j, lcp in zip(left[order].tolist(), right[order].tolist(), shared[order].tolist()):
        a, b = root(i), root(j)
        if sets[a].size < sets[b].size:
            a, b = b, a
        parent[b] = a
        for first, second in united(sets[a], sets.pop(b)):
            period = second - first
            if period + lcp >= max(least, exponent * period) and (first == 0 or ended[first - 1] != ended[second - 1]):
                runs.append((first, period + lcp, period))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def _runs(frames: Iterator[pa.RecordBatch], least: int, exponent: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches(frames):
        texts = [text.encode().split() for text in batch.column("text").to_pylist()]
        classes, starts = numbered(texts)
        found: list[list[dict]] = [[] for _ in texts]
        dropped = np.zeros(len(classes) + 1, np.int64)
        runs = runs_of(classes, least, exponent)
        owners = np.searchsorted(starts, [run[0] for run in runs], "right") - 1
        for (start, length, period), owner in zip(runs, owners.tolist()):
            found[owner].append({"start": start - int(starts[owner]), "length": length, "period": period})
            dropped[start + period] += 1
            dropped[start + length] -= 1
        stays = np.cumsum(dropped)[:-1] == 0
        collapsed = [
            b" ".join(words[k] for k in np.flatnonzero(stays[a:b]).tolist()) if runs_here else b" ".join(words)
            for words, a, b, runs_here in zip(texts, starts[:-1].tolist(), starts[1:].tolist(), found)
        ]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array([len(words) for words in texts], pa.int64()), pa.array(found, kind), pa.array([text.decode() for text in collapsed], pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed, the text without the words of each run after its first period.

    A row each, no shuffle. `exponent` is 2 at least: only then is every run met at its first two periods.
    """
    if exponent < 2 or least < 2:
        raise ValueError("runs have two periods and two words at least")
    rows = docs.select(column(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(lambda frames: _runs(frames, least, exponent), schema)


def repeat_tail(doc_id: Column, text: Column) -> Column:
    """The text of one document in ten with a periodic tail, by crc32 of the id; others, and rows without id, unchanged."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def edited(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
        return F.concat_ws(" ", F.slice(words, 1, a.cast("int")), tail)

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    bound = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, edited(w)).otherwise(text)), 0)
    return F.when(doc_id.isNotNull() & (h % 10 == 0), bound).otherwise(text)


def op12_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    rows = docs.select("doc_id", repeat_tail(F.col("doc_id"), text_or_empty()).alias("text"))
    found = periodic_runs(rows)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.less")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
