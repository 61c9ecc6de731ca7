"""Subword vocabularies: learning, encoding, dictionary, ids."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.fixed_values import EOS, SPECIALS, UNK, VOCABULARY_SPECIALS, WORD_MARK
from tandem.functions.text import char_pieces, decode_pieces, word_pieces
from tandem.operators.unigram import UnigramModel, unigram_pieces
from tandem.session import discard, shared_folder, spread

VOCAB_SIZE = 160_000
#: Passes whose pair changes are folded into the counts, and whose merges into the packed words, at once; rows of changes a task holds.
MERGE_SEGMENTS, HELD_CHANGES = 8, 1 << 21
#: Symbols of packed words from which on one task makes all merges that are left.
LAST_SYMBOLS = 1 << 22
#: Symbols of single code points in encoding; merged ones are numbered from here on.
POINTS = 0x110000


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``word, cnt`` of marked words: partial aggregation, then one row per distinct word, which alone gets the mark."""
    found = df.select(F.explode(F.split(text, " ")).alias("word")).where("word <> ''")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).select(F.concat(F.lit(WORD_MARK), "word").alias("word"), "cnt")


@dataclass
class Learned:
    """Merges in order, and for each pass the merges it made and the distinct words they changed."""

    merges: list[tuple[str, str]]
    passes: list[tuple[int, int]]


class _PairCounts:
    """Pair counts in the shared folder: ``left, right, delta``, a pair's count being the sum of its deltas.

    Each pass appends what it changes; every ``MERGE_SEGMENTS`` passes the deltas are folded into one row a pair.
    """

    def __init__(self, changes: DataFrame):
        self.spark = changes.sparkSession
        self.counts = self._write(self._summed(changes), "subword-counts")
        self.recent: list[str] = []

    def _write(self, df: DataFrame, purpose: str) -> str:
        path = shared_folder(self.spark, purpose)
        df.select("left", "right", "delta").write.parquet(path)
        return path

    @staticmethod
    def _summed(changes: DataFrame) -> DataFrame:
        return changes.groupBy("left", "right").agg(F.sum("delta").alias("delta")).where("delta <> 0")

    def _deltas(self) -> DataFrame:
        return self.spark.read.schema("left string, right string, delta long").parquet(self.counts, *self.recent)

    def append(self, changes: DataFrame) -> None:
        self.recent.append(self._write(changes, "subword-changes"))
        if len(self.recent) == MERGE_SEGMENTS:
            folded = self._write(self._summed(self._deltas()), "subword-counts")
            self.close()
            self.counts, self.recent = folded, []

    def top(self, n: int) -> list[tuple[str, str, int]]:
        ranked = self._summed(self._deltas()).orderBy(F.desc("delta"), "left", "right").limit(n)
        return [tuple(r) for r in ranked.select("left", "right", "delta").collect()]

    def close(self) -> None:
        for path in [self.counts, *self.recent]:
            discard(self.spark, path)


def numbered(merges: list[tuple[str, str]]) -> dict[tuple[str, str], int | list[int]]:
    """The number of each pair; a list where a pair is merged again."""
    places: dict[tuple[str, str], int | list[int]] = {}
    for i, pair in enumerate(merges):
        seen = places.get(pair)
        places[pair] = i if seen is None else [seen, i] if isinstance(seen, int) else [*seen, i]
    return places


def apply_in_order(symbols: list[str], places: dict[tuple[str, str], int | list[int]], low: int, high: int) -> list[str]:
    """The symbols after the merges numbered ``low`` to ``high - 1``, one after the other; ``places`` has the numbers of each pair."""
    at = low - 1
    while len(symbols) > 1:
        best, pair = high, None
        for both in zip(symbols, symbols[1:]):
            number = places.get(both, high)
            if isinstance(number, list):
                number = next((k for k in number if k > at), high)
            if at < number < best:
                best, pair = number, both
        if pair is None:
            break
        symbols, at = merge_pair(symbols, pair), best
    return symbols


def merge_pair(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    """Every occurrence of the pair as one symbol, from the left."""
    merged, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
            merged.append(symbols[i] + symbols[i + 1])
            i += 2
        else:
            merged.append(symbols[i])
            i += 1
    return merged


# Packed words: one row per batch of distinct words, ``symbols`` (int32 numbers from 1 on, a 0 before each word) and ``cnts`` (int64)

PACKED, CHANGE = "symbols binary, cnts binary", "left string, right string, delta long, looked long"
Batch = list[tuple[int, int, int]]


def _packed_rows(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array([row[i].tobytes() for row in rows], pa.binary()) for i in range(2)]
    return pa.RecordBatch.from_arrays(columns, names=["symbols", "cnts"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for symbols, cnts in zip(*(batch.column(i) for i in range(2))):
            yield np.frombuffer(symbols.as_buffer(), np.int32), np.frombuffer(cnts.as_buffer(), np.int64)


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words one after the other, and the place of each word's first one."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4"), np.cumsum(lengths) - lengths


def _pack(words: DataFrame, alphabet: list[str]) -> DataFrame:
    """``word, cnt`` as packed words, characters numbered in the order of the alphabet."""
    shared = words.sparkSession.sparkContext.broadcast(alphabet)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(POINTS, np.int32)
        number[[ord(c) for c in shared.value]] = np.arange(1, len(shared.value) + 1)
        for batch in batches:
            points, starts = _code_points(batch.column(0).to_pylist())
            symbols = np.insert(number[points], starts, 0).astype(np.int32)
            yield _packed_rows([(symbols, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))])

    return words.select("word", "cnt").mapInArrow(pack, PACKED)


class _Rules:
    """The pairs of one batch as arrays; ``span`` is above every symbol."""

    def __init__(self, batch: Batch, span: int):
        self.span = span
        ordered = np.array(sorted((left * span + right, made) for left, right, made in batch), np.int64)
        self.keys, self.made = ordered[:, 0], ordered[:, 1].astype(np.int32)
        self.is_left = np.zeros(span, bool)
        self.is_left[[left for left, _, _ in batch]] = True

    def found(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs stand, from the left and without overlap, and the symbols they become."""
        at = np.flatnonzero(self.is_left[symbols[:-1]])
        pairs = symbols[at].astype(np.int64) * self.span + symbols[at + 1]
        place = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        same = self.keys[place] == pairs
        at, place = at[same], place[same]
        kept = _alternate(at)
        return at[kept], self.made[place[kept]]

    def applied(self, symbols: np.ndarray) -> np.ndarray:
        return _joined(symbols, *self.found(symbols))


def _alternate(at: np.ndarray) -> np.ndarray:
    """Of places that follow each other every second one: only a symbol's pairs with itself overlap."""
    if not len(at):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
    run = np.repeat(first, np.diff(first, append=len(at)))
    return (np.arange(len(at)) - run) % 2 == 0


def _joined(symbols: np.ndarray, at: np.ndarray, made: np.ndarray) -> np.ndarray:
    """The symbols with each pair at one of the places as one symbol."""
    if not len(at):
        return symbols
    out, kept = symbols.copy(), np.ones(len(symbols), bool)
    out[at], kept[at + 1] = made, False
    return out[kept]


def _merged(packed: DataFrame, batches: list[Batch], span: int) -> DataFrame:
    """Packed words after the merges of the batches; words of one symbol have no pairs left and go."""

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [_Rules(batch, span) for batch in batches]
        for symbols, cnts in _unpacked(rows):
            for rule in rules:
                symbols = rule.applied(symbols)
            lengths = np.diff(np.flatnonzero(symbols == 0), append=len(symbols))
            yield _packed_rows([(symbols[np.repeat(lengths > 2, lengths)], cnts[lengths > 2])])

    return packed.mapInArrow(merge, PACKED)


def _pair_changes(packed: DataFrame, batches: list[Batch], spelled: list[str]) -> DataFrame:
    """What the last batch changes in the counts of pairs, when the others have been applied; without a batch, all pairs.

    Each task hands on one row per pair; ``looked`` adds up to the words that changed.
    """
    shared = packed.sparkSession.sparkContext.broadcast((batches, spelled))

    def counted(symbols: np.ndarray, cnts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        inner = (symbols[:-1] > 0) & (symbols[1:] > 0)
        return symbols[:-1][inner].astype(np.int64) * span + symbols[1:][inner], cnts[np.cumsum(symbols == 0) - 1][:-1][inner]

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, place, np.concatenate([n for _, n in held]))
        return keys, sums

    def change(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, spelled = shared.value
        span, names = len(spelled), pa.array(spelled)
        *before, last = [_Rules(batch, span) for batch in batches] or [None]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        looked = 0

        def told(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            # never empty: a merge always takes away from its own pair
            keys, sums = keys[sums != 0], sums[sums != 0]
            seen = np.zeros(len(keys), np.int64)
            seen[:1] = looked
            return pa.RecordBatch.from_arrays([names.take(pa.array(keys // span)), names.take(pa.array(keys % span)), pa.array(sums), pa.array(seen)],
                                              names=["left", "right", "delta", "looked"])

        for symbols, cnts in _unpacked(rows):
            for rule in before:
                symbols = rule.applied(symbols)
            if last is None:
                found = [counted(symbols, cnts, span)]
            else:
                at, _ = last.found(symbols)
                if not len(at):
                    continue
                starts = np.flatnonzero(symbols == 0)
                hit = np.zeros(len(starts), bool)
                hit[np.searchsorted(starts, at, "right") - 1] = True
                symbols, cnts = symbols[np.repeat(hit, np.diff(starts, append=len(symbols)))], cnts[hit]
                looked += len(cnts)
                keys, n = counted(symbols, cnts, span)
                found = [(keys, -n), counted(last.applied(symbols), cnts, span)]
            held.append(summed(found))
            if sum(len(k) for k, _ in held) > HELD_CHANGES:
                held = [summed(held)]
                if len(held[0][0]) > HELD_CHANGES // 2:
                    yield told(*held[0])
                    held, looked = [], 0
        if held and len((last_sums := summed(held))[0]):
            yield told(*last_sums)

    return packed.mapInArrow(change, CHANGE)


class _Remaining:
    """All merges of packed words one at a time: the places of a pair are listed, and a heap has the counts."""

    def __init__(self, symbols: np.ndarray, cnts: np.ndarray, spelled: list[str]):
        # numbers of symbols stay below 2**31; a key is a pair
        n = len(symbols)
        word = np.cumsum(symbols == 0) - 1
        self.spelled, self.number = list(spelled), {symbol: i for i, symbol in enumerate(spelled)}
        inner = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
        keys = symbols[inner].astype(np.int64) << 32 | symbols[inner + 1]
        inner = inner[np.argsort(keys, kind="stable")].astype(np.int32)
        listed, first = np.unique(symbols[inner].astype(np.int64) << 32 | symbols[inner + 1], return_index=True)
        sums = np.add.reduceat(cnts[word[inner]], first) if len(inner) else np.zeros(0, np.int64)
        self.counts = dict(zip(listed.tolist(), sums.tolist()))
        self.given, self.places = inner, {}
        self.spans = dict(zip(listed.tolist(), zip(first.tolist(), np.append(first[1:], len(inner)).tolist())))
        self.word, self.cnts = array("i", word.astype(np.int32).tobytes()), cnts
        # a last separator ends the last word
        self.symbols = array("i", np.append(symbols, 0).astype(np.int32).tobytes())
        self.before = array("i", (np.arange(n + 1) - 1).astype(np.int32).tobytes())
        self.after = array("i", (np.arange(n + 1) + 1).astype(np.int32).tobytes())
        self.heap = [self._entry(key) for key in self.counts]
        heapq.heapify(self.heap)

    def _entry(self, key: int) -> tuple[int, str, str, int]:
        return -self.counts[key], self.spelled[key >> 32], self.spelled[key & 0xFFFFFFFF], key

    def merges(self, most: int) -> Iterator[tuple[str, str, int]]:
        """At most so many pairs in order, and the distinct words each changed."""
        for _ in range(most):
            while self.heap:
                entry = heapq.heappop(self.heap)
                now = self.counts.get(entry[3], 0)
                if now == -entry[0]:
                    break
                if 0 < now < -entry[0]:
                    heapq.heappush(self.heap, self._entry(entry[3]))
            else:
                return
            yield entry[1], entry[2], self._merge(entry[3])

    def _merge(self, key: int) -> int:
        symbols, before, after, counts, places = self.symbols, self.before, self.after, self.counts, self.places
        left, right = key >> 32, key & 0xFFFFFFFF
        text = self.spelled[left] + self.spelled[right]
        made = self.number.setdefault(text, len(self.spelled))
        if made == len(self.spelled):
            self.spelled.append(text)
        low, high = self.spans.pop(key, (0, 0))
        at = sorted({*self.given[low:high].tolist(), *places.pop(key, ())})
        raised: set[int] = set()
        changed, last = 0, -1
        for i in at:
            j = after[i]
            if symbols[i] != left or symbols[j] != right:
                continue
            word = self.word[i]
            n = int(self.cnts[word])
            changed, last = changed + (word != last), word
            p, k = before[i], after[j]
            counts[key] -= n
            if symbols[p] > 0:
                counts[symbols[p] << 32 | left] -= n
                new = symbols[p] << 32 | made
                counts[new] = counts.get(new, 0) + n
                places.setdefault(new, []).append(p)
                raised.add(new)
            if symbols[k] > 0:
                counts[right << 32 | symbols[k]] -= n
                new = made << 32 | symbols[k]
                counts[new] = counts.get(new, 0) + n
                places.setdefault(new, []).append(i)
                raised.add(new)
            symbols[i], symbols[j] = made, -1
            after[i], before[k] = k, i
        for new in raised:
            if counts[new] > 0:
                heapq.heappush(self.heap, self._entry(new))
        return changed


def _last_merges(packed: DataFrame, spelled: list[str], most: int) -> list[tuple[str, str, int]]:
    """The merges of words that fit into one task, and the distinct words each changed."""
    shared = packed.sparkSession.sparkContext.broadcast(spelled)

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(_unpacked(rows))
        if held:
            found = list(_Remaining(*(np.concatenate([row[i] for row in held]) for i in range(2)), shared.value).merges(most))
            columns = [pa.array(range(len(found)), pa.int64()), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "left", "right", "looked"])

    found = packed.coalesce(1).mapInArrow(merge, "at long, left string, right string, looked long").collect()
    return [(r["left"], r["right"], r["looked"]) for r in sorted(found, key=lambda r: r["at"])]


def _alphabet(words: DataFrame) -> list[str]:
    """The distinct characters of the words, in order; Unicode bounds them."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for batch in batches:
            found.update("".join(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["ch"])

    return sorted(r["ch"] for r in words.select("word").mapInArrow(distinct, "ch string").distinct().collect())


def learn_subwords(counts: DataFrame, vocab_size: int = VOCAB_SIZE, top: int = 256) -> Learned:
    """Byte-pair merges in order; ties go to the smaller pair.

    ``counts`` has one row per distinct word, far fewer than the corpus has tokens. The words are packed once into arrays of
    symbols, which stay spread over the tasks. Pairs are counted once; a pass then finds the pairs it merges in the arrays and appends
    what that changes in the counts, one row per pair and task. Merges are written into the packed words only every ``MERGE_SEGMENTS``
    passes and till then applied anew. Only the alphabet and the ``top`` pairs come to the driver.

    A pass applies several merges when that provably equals doing them one at a time: the
    leading pairs must not overlap each other (no right symbol is another's left symbol), each must be strictly more frequent than the
    first pair that does overlap, which bounds the count of every pair a merge creates,
    and no merge may spell an existing symbol. Once the words with pairs have at most ``LAST_SYMBOLS`` symbols, one task makes the merges
    that are left one at a time: towards the end of a large vocabulary most pairs are equally frequent, and passes would make one merge each.
    """
    spark = counts.sparkSession

    def write(df: DataFrame, purpose: str) -> str:
        path = shared_folder(spark, purpose)
        df.write.parquet(path)
        return path

    def read(path: str) -> DataFrame:
        return spark.read.schema(PACKED).parquet(path)

    listed = write(counts.where(F.length("word") > 0).groupBy("word").agg(F.sum("cnt").alias("cnt")), "subword-words")
    words = spread(spark.read.schema("word string, cnt long").parquet(listed), "word")
    alphabet = _alphabet(words)
    packed = write(_pack(words, alphabet), "subword-packed")
    discard(spark, listed)
    # number 0 stands between words
    spelled = ["", *alphabet]
    number = {symbol: i for i, symbol in enumerate(spelled)}
    state = _PairCounts(_pair_changes(read(packed), [], spelled))
    budget = max(vocab_size - len(alphabet) - len(VOCABULARY_SPECIALS), 0)
    merges: list[tuple[str, str]] = []
    passes: list[tuple[int, int]] = []
    pending: list[Batch] = []
    while len(merges) < budget:
        if not pending and (read(packed).agg(F.sum(F.length("symbols"))).first()[0] or 0) // 4 <= LAST_SYMBOLS:
            rest = _last_merges(read(packed), spelled, budget - len(merges))
            merges += [(left, right) for left, right, _ in rest]
            passes += [(1, looked) for *_, looked in rest]
            break
        if not (ranked := state.top(top)):
            break
        made = {left + right for left, right in merges}
        batch = _independent_prefix(ranked, made, complete=len(ranked) < top)[: budget - len(merges)]
        merges += batch
        for left, right in batch:
            # a symbol that is spelled anew keeps its number
            if left + right not in number:
                number[left + right] = len(spelled)
                spelled.append(left + right)
        pending.append([(number[left], number[right], number[left + right]) for left, right in batch])
        seen = Observation()
        state.append(_pair_changes(read(packed), pending, spelled).observe(seen, F.sum("looked").alias("words")))
        passes.append((len(batch), seen.get["words"] or 0))
        if len(pending) >= MERGE_SEGMENTS:
            old, packed, pending = packed, write(_merged(read(packed), pending, len(spelled)), "subword-packed"), []
            discard(spark, old)
    state.close()
    discard(spark, packed)
    return Learned(merges, passes)


def train_subwords(counts: DataFrame, vocab_size: int = VOCAB_SIZE, top: int = 256) -> list[tuple[str, str]]:
    """The merges of ``learn_subwords``."""
    return learn_subwords(counts, vocab_size, top).merges


def _independent_prefix(ranked: list[tuple[str, str, int]], made: set[str], complete: bool) -> list[tuple[str, str]]:
    """The leading pairs that can be merged in one pass with the sequential result."""
    lefts: set[str] = set()
    rights: set[str] = set()
    taken: list[tuple[str, str, int]] = []
    # pairs beyond a cut-off list are no more frequent than its last entry
    bound = 0 if complete else ranked[-1][2]
    for left, right, n in ranked:
        if left == right or left in rights or right in lefts or left + right in made:
            bound = max(bound, n)
            break
        lefts.add(left)
        rights.add(right)
        made = made | {left + right}
        taken.append((left, right, n))
    batch = [(a, b) for a, b, n in taken if n > bound]
    return batch or [ranked[0][:2]]


def encode_words(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply merges to one word in rank order."""
    symbols = list(word)
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:]), key=lambda pair: ranks.get(pair, len(ranks)))
        if best not in ranks:
            break
        symbols = merge_pair(symbols, best)
    return symbols


class _Encoder:
    """Merges in rank order for many words at once; the result is that of ``encode_words``."""

    def __init__(self, merges: list[tuple[str, str]]):
        symbols = {s: None for left, right in merges for s in (left, right, left + right) if len(s) > 1}
        self.spelled = list(symbols)
        number = {s: POINTS + i for i, s in enumerate(self.spelled)}
        of = lambda s: ord(s) if len(s) == 1 else number[s]
        ranks = {pair: i for i, pair in enumerate(merges)}
        rules = sorted((of(left) << 32 | of(right), rank, of(left + right)) for (left, right), rank in ranks.items())
        self.keys, self.ranks, self.made = np.array(rules, np.int64).reshape(-1, 3).T
        self.none = len(merges)

    def symbol(self, number: int) -> str:
        return chr(number) if number < POINTS else self.spelled[number - POINTS]

    def _rules(self, symbols: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the pair that begins at each place, and where its rule is."""
        ranks, place = np.full(len(symbols), self.none), np.zeros(len(symbols), np.int64)
        at = np.flatnonzero(inner)
        pairs = symbols[at] << 32 | symbols[at + 1]
        rule = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        known = self.keys[rule] == pairs
        place[at[known]] = rule[known]
        ranks[at[known]] = self.ranks[rule[known]]
        return ranks, place

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, one word after the other, and how many each has. No word may be empty."""
        points, starts = _code_points(words)
        symbols, which = points.astype(np.int64), np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(which) and len(self.keys):
            lengths = np.diff(starts, append=len(symbols))
            inner = np.ones(len(symbols), bool)
            inner[starts + lengths - 1] = False
            ranks, place = self._rules(symbols, inner)
            best = np.minimum.reduceat(ranks, starts)
            open_ = best < self.none
            if not open_.all():
                # a word without a pair to merge is ready
                kept = np.repeat(open_, lengths)
                done.append((which[~open_], lengths[~open_], symbols[~kept]))
                which, best, lengths = which[open_], best[open_], lengths[open_]
                symbols, ranks, place = symbols[kept], ranks[kept], place[kept]
            if not len(which):
                break
            at = np.flatnonzero(ranks == np.repeat(best, lengths))
            at = at[_alternate(at)]
            word = np.repeat(np.arange(len(which)), lengths)[at]
            symbols = _joined(symbols, at, self.made[place[at]])
            lengths = lengths - np.bincount(word, minlength=len(which))
            starts = np.cumsum(lengths) - lengths
        if not len(self.keys):
            done.append((which, np.diff(starts, append=len(symbols)), symbols))
        which, lengths, symbols = (np.concatenate(c) for c in zip(*done)) if done else (np.zeros(0, np.int64),) * 3
        order = np.argsort(which)
        return symbols[_spans(np.cumsum(lengths)[order] - lengths[order], lengths[order])], lengths[order]


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def bpe_pieces(df: DataFrame, col: str, merges: list[tuple[str, str]], name: str) -> DataFrame:
    """Pieces of each row. A worker encodes a distinct word once, all new ones of a batch together, and remembers it, so the
    corpus is neither exploded into words nor shuffled; the merge list is bounded by the
    vocabulary size and shipped as a broadcast variable. A null text has no pieces."""
    shared = df.sparkSession.sparkContext.broadcast([tuple(pair) for pair in merges])

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _Encoder(shared.value)
        place, names = np.full(POINTS + len(encoder.spelled), -1, np.int64), []
        seen: dict[str, int] = {}
        pieces = starts = lengths = np.zeros(0, np.int64)
        for batch in batches:
            if len(seen) > 200_000:
                seen = {}
                pieces = starts = lengths = np.zeros(0, np.int64)
            parts = pc.split_pattern(batch.cast(pa.string()), " ")
            words, row = parts.flatten(), pc.list_parent_indices(parts)
            kept = pc.not_equal(words, "")
            listed = words.filter(kept).dictionary_encode()
            found = listed.dictionary.to_pylist()
            new = [w for w in found if w not in seen]
            if new:
                seen.update(zip(new, range(len(seen), len(seen) + len(new))))
                symbols, sizes = encoder.encode([WORD_MARK + w for w in new])
                fresh = np.unique(symbols)
                fresh = fresh[place[fresh] < 0]
                place[fresh] = np.arange(len(names), len(names) + len(fresh))
                names += map(encoder.symbol, fresh.tolist())
                starts = np.concatenate([starts, len(pieces) + np.cumsum(sizes) - sizes])
                lengths, pieces = np.concatenate([lengths, sizes]), np.concatenate([pieces, place[symbols]])
            numbers = np.fromiter(map(seen.__getitem__, found), np.int64, len(found))[listed.indices.to_numpy(zero_copy_only=False)]
            sizes = np.bincount(row.filter(kept).to_numpy(zero_copy_only=False), lengths[numbers], len(batch)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = pa.array(names, pa.string()).take(pa.array(pieces[_spans(starts[numbers], lengths[numbers])]))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=batch.is_null())

    return df.withColumn(name, encode(F.col(col)))


def encode_pieces(df: DataFrame, cols: dict[str, str], mode: str = "word", merges: list[tuple[str, str]] | UnigramModel | None = None) -> DataFrame:
    """Add pieces for each ``text column -> piece column``; mode ``word``, ``char``, ``bpe`` with its merges or ``unigram`` with its model."""
    if mode == "unigram":
        for text, pieces in cols.items():
            df = unigram_pieces(df, text, merges, pieces)
        return df
    if mode == "bpe":
        for text, pieces in cols.items():
            df = bpe_pieces(df, text, merges or [], pieces)
        return df
    encode = {"word": word_pieces, "char": char_pieces}[mode]
    return df.withColumns({pieces: encode(F.col(text)) for text, pieces in cols.items()})


def decode(df: DataFrame, pieces: str, name: str) -> DataFrame:
    return df.withColumn(name, decode_pieces(F.col(pieces)))


# Vocabulary, dictionary, ids ---------------------------------------------------------------


def vocabulary(pieces: DataFrame, vocab_size: int = VOCAB_SIZE, cols: tuple[str, ...] = ("src_pieces", "tgt_pieces")) -> DataFrame:
    """``rank, token, cnt``: the specials, then the most frequent tokens up to ``vocab_size`` in all.

    A top-k over the token counts: the rank window only sees ``vocab_size`` rows.
    """
    tokens = pieces.select(F.explode(F.concat(*[F.col(c) for c in cols])).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    room = vocab_size - len(VOCABULARY_SPECIALS)
    kept = counts.orderBy(F.desc("cnt"), "token").limit(room).select(F.lit(1).alias("_part"), "token", "cnt")
    specials = pieces.sparkSession.createDataFrame(
        [(-i, t, 0) for i, t in enumerate(reversed(VOCABULARY_SPECIALS))], "_part int, token string, cnt long"
    )
    listed = specials.unionByName(kept)
    rank = F.row_number().over(Window.orderBy("_part", F.desc("cnt"), "token"))
    return listed.select(rank.alias("rank"), "token", "cnt")


def build_dictionary(vocab: DataFrame) -> DataFrame:
    """Vocabulary without its three specials; every count is 1; ids follow the model's own specials."""
    return vocab.where(F.col("rank") > len(VOCABULARY_SPECIALS)).select(
        "token", F.lit(1).alias("cnt"),
        (F.col("rank") - len(VOCABULARY_SPECIALS) - 1 + len(SPECIALS)).cast("int").alias("token_id"),
    )


def tag_id(vocab_size: int, lang_index: Column) -> Column:
    """Language tags are numbered after the whole vocabulary."""
    return (F.lit(len(SPECIALS) + vocab_size) + lang_index).cast("int")


def binarize(df: DataFrame, dictionary: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Pieces to ids for each ``piece column -> id column``: unknown pieces give the unknown id, end of sentence closes.

    The dictionary is as long as the vocabulary was asked to be, whatever the corpus, so it is shipped
    to the executors and looked up inside the rows: no shuffle, and rows need no key. Null pieces are none.
    """
    rows = dictionary.select("token", "token_id").collect()
    shared = df.sparkSession.sparkContext.broadcast({r["token"]: r["token_id"] for r in rows})

    @F.pandas_udf("array<int>")
    def look_up(batch: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([[known.get(p, UNK) for p in (() if row is None else row)] + [EOS] for row in batch])

    return df.withColumns({ids: look_up(F.col(pieces)) for pieces, ids in cols.items()})
