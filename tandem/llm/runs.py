"""Periodic runs of words: squares from an enhanced suffix array, rotated and merged into maximal runs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest run in words and in periods; words taken together into one suffix array (a longer text has one of its own).
MIN_WORDS, MIN_PERIODS, BATCH_WORDS = 6, 4, 200_000


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and the common prefix of each suffix with the one before it, by doubling.

    The codes of every doubling are kept until the prefixes are known: adjacent suffixes are compared from the
    longest length down. Memory is that of as many arrays as the longest repeat has binary digits.
    """
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, size = [rank], 1
    while n and rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        second[: max(0, n - size)] = rank[size:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        rank, size = fresh, 2 * size
        levels.append(rank)
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    common = np.zeros(n, np.int64)
    if n > 1:
        left, right = array[:-1].copy(), array[1:].copy()
        for level in range(len(levels) - 2, -1, -1):
            inside = np.flatnonzero((left < n) & (right < n))
            same = inside[levels[level][left[inside]] == levels[level][right[inside]]]
            for moved in (left, right):
                moved[same] += 1 << level
            common[1 + same] += 1 << level
    return array, rank, common


def smaller_children(common: np.ndarray) -> np.ndarray:
    """Rows ``low, high, child low, child high, depth``: of each interval all children but the largest, ends inclusive.

    An interval is a longest stretch of the suffix array whose suffixes share ``depth`` words; where exactly
    ``depth`` are shared, one child ends and the next begins. A stack of open intervals is all there is of the tree.
    """
    found: list[tuple[int, int, int, int, int]] = []
    depths, lows, cuts = [0], [0], [[]]
    n = len(common)
    values = common.tolist()
    values.append(-1)
    for k in range(1, n + 1):
        value, low = values[k], k - 1
        while depths and depths[-1] > value:
            depth, low, own = depths.pop(), lows.pop(), cuts.pop()
            starts, ends = [low, *own], [c - 1 for c in own] + [k - 1]
            widest = max(range(len(starts)), key=lambda x: ends[x] - starts[x])
            found += [(low, k - 1, starts[x], ends[x], depth) for x in range(len(starts)) if x != widest and depth]
        if value < 0:
            break
        if depths[-1] < value:
            depths.append(value)
            lows.append(low)
            cuts.append([])
        cuts[-1].append(k)
    return np.array(found, np.int64).reshape(-1, 5)


def branching_squares(codes: np.ndarray) -> np.ndarray:
    """Rows ``depth, place``, in that order: two equal stretches of ``depth`` codes side by side whose next codes differ.

    In an interval of that depth, a suffix ``i`` of a smaller child has the square if ``i + depth`` is in the interval
    but not in the child, and so has ``i - depth`` if that one is. A suffix is in a smaller child at most as often as
    the size of its interval doubles, so ``n log n`` places are looked at.
    """
    n = len(codes)
    array, inverse, common = suffix_array(codes)
    children = smaller_children(common)
    found = [np.zeros((0, 2), np.int64)]
    sizes = children[:, 3] - children[:, 2] + 1
    ends = np.cumsum(sizes)
    at = 0
    while at < len(children):
        # as many children at a time as fill a block, so memory stays in proportion to the text
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max(n, 1 << 16), "right")))
        size = sizes[at:upto]
        low, high, child_low, child_high, depth = (np.repeat(children[at:upto, c], size) for c in range(5))
        place = array[child_low + np.arange(len(low)) - np.repeat(np.cumsum(size) - size, size)]
        for other, square in ((place + depth, place), (place - depth, place - depth)):
            inside = np.flatnonzero((other >= 0) & (other < n))
            where = inverse[other[inside]]
            lo, hi, clo, chi = low[inside], high[inside], child_low[inside], child_high[inside]
            inside = inside[(where >= lo) & (where <= hi) & ((where < clo) | (where > chi))]
            found.append(np.stack([depth[inside], square[inside]], 1))
        at = upto
    return np.unique(np.concatenate(found), axis=0)


def rotated_start(codes: np.ndarray, place: int, period: int) -> int:
    """How far the square at ``place`` can be rotated to the left: looks at ever longer stretches, so at most twice the way."""
    step = 32
    while place:
        low = max(0, place - step)
        differ = np.flatnonzero(codes[low:place] != codes[low + period : place + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        place, step = low, 2 * step
    return 0


def find_runs(codes: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """``start, end, period`` of all maximal runs of the codes, by start and period.

    Squares come shortest first. The last square of a run is the branching one; a longer square that ends with a known run,
    lies in it and is a multiple of its period is the same run seen again.
    """
    ending: dict[int, list[tuple[int, int]]] = {}
    for depth, place in branching_squares(codes).tolist():
        end = place + 2 * depth
        known = ending.setdefault(end, [])
        if any(depth % period == 0 and start <= place for start, period in known):
            continue
        known.append((rotated_start(codes, place, depth), depth))
    runs = [(start, end, period) for end, known in ending.items() for start, period in known]
    return sorted((s, e, p) for s, e, p in runs if e - s >= max(min_words, min_periods * p))


def repeated(words: list[bytes], start: int, period: int) -> list[bytes]:
    """The words with everything from ``start`` on repeated from the ``period`` words found there."""
    return words[:start] + [words[start + (i - start) % period] for i in range(start, len(words))]


def altered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document by the crc32 of its id gets a made-up period; the others, and one without an id, stay."""
    if doc_id is None or not words:
        return words
    code = zlib.crc32(str(doc_id).encode())
    if code % 10:
        return words
    g, n = code // 10, len(words)
    start = g % n
    return repeated(words, start, 1 + (n - start) // (3 + g % 8))


@dataclass
class _Segment:
    text: int
    start: int
    codes: np.ndarray


def _segments(texts: list[list[bytes]], min_words: int, min_periods: int) -> Iterator[_Segment]:
    """Stretches of words that all occur often enough in their text to lie in a run; a rarer word ends any run."""
    for k, words in enumerate(texts):
        if len(words) < min_words:
            continue
        ids: dict[bytes, int] = {}
        codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        often = np.bincount(codes)[codes] >= min_periods
        edges = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]])))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if high - low >= min_words:
                yield _Segment(k, low, codes[low:high])


def runs_of_texts(texts: list[list[bytes]], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS,
                  batch_words: int = BATCH_WORDS) -> list[list[tuple[int, int, int]]]:
    """``start, end, period`` of the runs of each text, from one suffix array for about ``batch_words`` words of several texts.

    Each word of each text is a code of its own and every stretch ends with a code that occurs once, so nothing repeats across texts.
    """
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def search(held: list[_Segment]) -> None:
        parts, starts, next_code, at = [], [], 0, 0
        shift, text = 0, -1
        for s in held:
            if s.text != text:
                shift, text = next_code, s.text
            starts.append(at)
            next_code = max(next_code, shift + int(s.codes.max()) + 1)
            parts += [s.codes + shift, np.array([-1 - len(starts)])]
            at += len(s.codes) + 1
        found = find_runs(np.concatenate(parts), min_words, min_periods)
        owner = np.searchsorted(np.array(starts), [f[0] for f in found], "right") - 1
        for (start, end, period), k in zip(found, owner.tolist()):
            move = held[k].start - starts[k]
            runs[held[k].text].append((start + move, end + move, period))

    held: list[_Segment] = []
    size = 0
    for s in _segments(texts, min_words, min_periods):
        held.append(s)
        size += len(s.codes)
        if size >= batch_words:
            search(held)
            held, size = [], 0
    if held:
        search(held)
    return [sorted((s, e, p) for s, e, p in found) for found in runs]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what any run repeats after its first period, joined by one space."""
    keep = np.ones(len(words), bool)
    for start, end, period in runs:
        keep[start + period : end] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]) if runs else b" ".join(words)


RESULT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def word_runs(docs: DataFrame, alter=None, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every document: its runs by start and period, and its words without the repeats.

    A run is a stretch of words with smallest period ``p`` of at least ``min_words`` words and ``min_periods`` periods
    that goes on on neither side. ``alter(words, doc_id)`` may change the words first. Row-local, without a shuffle: a task joins the
    texts of a batch to suffix arrays of about ``BATCH_WORDS`` words, a longer text has its own, in time ``n log^2 n`` and memory
    in proportion to its length.

    Defined results: a null or empty text has no words, no runs and an empty ``collapsed``; a null id is kept; repeated rows are searched each; an
    empty table gives no rows; other columns are not read.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"].iloc[low : low + 1000]]
                texts = [(t or "").encode("utf-8", "replace").split() for t in batch["text"].iloc[low : low + 1000]]
                if alter is not None:
                    texts = [alter(words, i) for words, i in zip(texts, ids)]
                found = runs_of_texts(texts, min_words, min_periods)
                yield pd.DataFrame({
                    "doc_id": pd.array(ids, "Int64"), "n_words": [len(w) for w in texts],
                    "runs": [[{"start": s, "length": e - s, "period": p} for s, e, p in runs] for runs in found],
                    "collapsed": [collapsed(w, r).decode() for w, r in zip(texts, found)],
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(search, RESULT)


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run (``start, length, period, exponent_milli``) and digests of the runs and of the words left.

    Of equally long runs the first counts, then that of the smaller period. The column is sorted by start and period, so the
    smallest of ``-length, start, period`` is that run.
    """
    key = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.col("_best")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), key.alias("_best"), F.sha2(line, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", best["start"].alias("start"), (-best["n"]).alias("length"), best["period"].alias("period"),
        F.floor(-best["n"] * 1000 / best["period"]).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
