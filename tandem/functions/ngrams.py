"""N-gram overlap of two texts, row by row.

The counts of one sentence pair need no other row, so they are taken inside the
row and only a few sums per direction are ever shuffled. Exploding the n-grams
into rows would multiply the shuffled text by the number of orders. Spark's
column functions cannot count the entries of an array in linear time, hence one
Arrow-batched function, which counts a whole batch of rows with array operations.
"""

from __future__ import annotations

import functools
import string
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCT = set(string.punctuation)
#: Characters counted together: their arrays stay within a core's cache, and a task's memory does not grow with its batches.
BATCH_CHARS = 20_000
#: Numbers up to this are looked up in a table (8 MB a worker), larger ones hashed.
TABLE = 1 << 21


def _slices(sizes: np.ndarray, limit: int = BATCH_CHARS) -> Iterator[slice]:
    """Consecutive rows of about ``limit`` characters together; a longer row stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


@functools.cache
def _table() -> np.ndarray:
    return np.empty(TABLE, dtype=np.int32)


def _alike(numbers: np.ndarray, bound: int) -> np.ndarray:
    """For each number, all below ``bound``, the last place of an equal one; the entries of the table need no clearing, as only those just written are read."""
    places = np.arange(len(numbers))
    if bound <= TABLE:
        table = _table()
        table[numbers] = places
        return table[numbers].astype(np.int64)
    which, distinct = pd.factorize(numbers)
    last = np.empty(len(distinct), dtype=np.int64)
    last[which] = places
    return last[which]


def overlap_counts(ids: np.ndarray, n_hyp: np.ndarray, n_ref: np.ndarray, max_n: int) -> np.ndarray:
    """``rows x orders x (matches, hyp n-grams, ref n-grams)``.

    ``ids`` are the symbols of all hypotheses, then of all references; ``n_hyp`` and
    ``n_ref`` their lengths per row. An n-gram gets the number of its row and
    (n-1)-gram, extended by one symbol, and then the place of one like it: numbers stay small and
    equal numbers mean equal n-grams of the same row, so nothing is hashed away.
    """
    rows, cut = len(n_hyp), int(n_hyp.sum())
    lengths = np.concatenate([n_hyp, n_ref])
    row = np.repeat(np.tile(np.arange(rows), 2), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids))
    symbol, symbols = pd.factorize(ids)
    width = len(symbols) + 1
    out = np.zeros((rows, max_n, 3), dtype=np.int64)
    at, gram = np.arange(len(ids)), row
    for n in range(1, max_n + 1):
        if n > 1:
            longer = left[at] >= n
            at, gram = at[longer], gram[longer]
        before = rows if n == 1 else last
        gram = _alike(gram * width + symbol[at + n - 1], before * width)
        # the places of the hypotheses come first
        last, middle = len(at), np.searchsorted(at, cut)
        counts = [np.bincount(side, minlength=len(at)) for side in (gram[:middle], gram[middle:])]
        out[:, n - 1, 0] = np.bincount(row[at], weights=np.minimum(*counts), minlength=rows)
        out[:, n - 1, 1] = np.maximum(n_hyp - n + 1, 0)
        out[:, n - 1, 2] = np.maximum(n_ref - n + 1, 0)
    return out


def _token_counts(hyps: list[list[str]], refs: list[list[str]], max_n: int) -> np.ndarray:
    flat = np.array([w for text in (*hyps, *refs) for w in text], dtype=object)
    ids = pd.factorize(flat)[0]
    sizes = [np.array([len(t) for t in side], dtype=np.int64) for side in (hyps, refs)]
    return overlap_counts(ids, *sizes, max_n)


def _char_counts(hyps: list[str], refs: list[str], max_n: int) -> np.ndarray:
    ids = np.frombuffer("".join((*hyps, *refs)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    sizes = [np.array([len(t) for t in side], dtype=np.int64) for side in (hyps, refs)]
    return overlap_counts(ids, *sizes, max_n)


def _edge_words(text: str) -> list[str]:
    """Words with one punctuation mark split off the end, or else off the start."""
    out = []
    for word in text.split():
        if len(word) > 1 and word[-1] in _PUNCT:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in _PUNCT:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


def _batched(hyp: Column, ref: Column, count: Callable[[list[str], list[str]], np.ndarray]) -> Column:
    @F.pandas_udf("array<long>")
    def stats(hyps: pd.Series, refs: pd.Series) -> pd.Series:
        rows: list[np.ndarray] = []
        for part in _slices(hyps.str.len().to_numpy() + refs.str.len().to_numpy()):
            counts = count(list(hyps.iloc[part]), list(refs.iloc[part]))
            rows.extend(counts.reshape(len(counts), -1))
        return pd.Series(rows)

    # a missing text is an empty one
    return stats(F.coalesce(hyp, F.lit("")), F.coalesce(ref, F.lit("")))


def token_overlap(hyp: Column, ref: Column, max_n: int) -> Column:
    """``array<long>``: matches, hyp count, ref count for each token order 1..max_n."""

    def count(hyps: list[str], refs: list[str]) -> np.ndarray:
        return _token_counts([t.split() for t in hyps], [t.split() for t in refs], max_n)

    return _batched(hyp, ref, count)


def char_word_overlap(hyp: Column, ref: Column, char_n: int, word_n: int) -> Column:
    """``array<long>`` as above: character orders 1..char_n, then word orders 1..word_n.

    Whitespace does not count as a character. An order the reference lacks
    entirely does not count hypothesis n-grams either.
    """

    def count(hyps: list[str], refs: list[str]) -> np.ndarray:
        parts = [_char_counts(["".join(t.split()) for t in hyps], ["".join(t.split()) for t in refs], char_n)]
        if word_n:
            parts.append(_token_counts([_edge_words(t) for t in hyps], [_edge_words(t) for t in refs], word_n))
        both = np.concatenate(parts, axis=1)
        both[:, :, 1] *= both[:, :, 2] > 0
        return both

    return _batched(hyp, ref, count)
