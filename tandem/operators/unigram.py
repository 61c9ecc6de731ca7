"""Subwords by a unigram language model: seed substrings, expectation maximisation, pruning by likelihood, best segmentation."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.fixed_values import VOCABULARY_SPECIALS, WORD_MARK
from tandem.session import discard, shared_folder

SEED_PIECES, PIECE_CHARS, EM_STEPS, KEPT_SHARE = 1_000_000, 16, 2, 0.75
#: An unknown character costs this much more than the rarest piece, in natural logarithms.
UNKNOWN_COST = 10.0
REMEMBERED, REMEMBERED_CHARS, SUMMED = 200_000, 64, 1_000_000
#: Arcs of words of one length that are summed together, and the fewest words for which arrays pay.
LATTICE_CELLS, FEW_WORDS = 200_000, 8
#: Words less likely than this are summed by logarithms: what products lose below the smallest number is nothing beside it.
LEAST_PRODUCT = 1e-250


@dataclass
class UnigramModel:
    """Log probability of each piece, and the log likelihood of the words before each step of learning, run by run."""

    scores: dict[str, float]
    likelihoods: list[list[float]] = field(default_factory=list)

    def __post_init__(self):
        self.longest = max(map(len, self.scores), default=1)
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_COST

    def arcs(self, word: str, end: int) -> Iterator[tuple[int, str, float]]:
        """``start, piece, score`` of the pieces that end there, the longest first; an unknown character is a piece of its own."""
        get = self.scores.get
        for start in range(max(0, end - self.longest), end):
            score = get(word[start:end])
            if score is not None:
                yield start, word[start:end], score
            elif start == end - 1:
                yield start, word[start:end], self.unknown

    def segment(self, word: str) -> list[str]:
        """The pieces of the likeliest segmentation; of equally likely ones that with the longest last piece."""
        best, back = [0.0], [0]
        for end in range(1, len(word) + 1):
            top, first = -math.inf, end - 1
            for start, _, score in self.arcs(word, end):
                if best[start] + score > top:
                    top, first = best[start] + score, start
            best.append(top)
            back.append(first)
        pieces, end = [], len(word)
        while end:
            pieces.append(word[back[end] : end])
            end = back[end]
        return pieces[::-1]

    def score(self, pieces: list[str]) -> float:
        return sum(self.scores.get(p, self.unknown) for p in pieces)

    def expect(self, word: str, cnt: float, into: dict[str, float]) -> float:
        """Add to each piece how often it is expected in ``cnt`` such words, over all segmentations; the log likelihood of one.

        Forward sums over all ways to a place, backward sums over all ways from it, both as logarithms, so a word may have any length.
        """
        n = len(word)
        arcs = [list(self.arcs(word, end)) for end in range(n + 1)]
        forward = [0.0] + [-math.inf] * n
        for end in range(1, n + 1):
            forward[end] = log_sum([forward[start] + score for start, _, score in arcs[end]])
        backward = [-math.inf] * n + [0.0]
        for end in range(n, 0, -1):
            for start, piece, score in arcs[end]:
                share = math.exp(forward[start] + score + backward[end] - forward[n])
                into[piece] += cnt * share
                ahead = score + backward[end]
                high, low = (ahead, backward[start]) if ahead > backward[start] else (backward[start], ahead)
                backward[start] = high + math.log1p(math.exp(low - high))
        return forward[n]


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top if len(values) == 1 else top + math.log(sum(math.exp(v - top) for v in values))


# Many words at once ---------------------------------------------------------------------------

#: Bits of a code point in the key of a step: the node before stands above them.
CODE_BITS = 21


class Trie:
    """Nodes of a prefix tree as two sorted arrays: node and code point of a step, and the node it leads to. The root is node 0."""

    def __init__(self):
        self.keys, self.targets, self.nodes = np.empty(0, np.int64), np.empty(0, np.int64), 1

    def grow(self, keys: np.ndarray) -> np.ndarray:
        """Add steps (distinct, none of them known) and number their nodes in the order given."""
        added = np.arange(self.nodes, self.nodes + len(keys))
        both, targets = np.concatenate([self.keys, keys]), np.concatenate([self.targets, added])
        order = np.argsort(both)
        self.keys, self.targets, self.nodes = both[order], targets[order], self.nodes + len(keys)
        return added

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each node leads, and whether it leads anywhere."""
        if not len(self.keys):
            return nodes, np.zeros(len(nodes), bool)
        keys = nodes << CODE_BITS | codes
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.targets[at], self.keys[at] == keys

    def walk(self, codes: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``k, places, nodes`` for k = 1, 2, ...: the places whose next k characters lead to a node; ``left`` are the characters up to the word's end."""
        at, nodes, k = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        while len(at):
            nodes, known = self.step(nodes, codes[at + k])
            at, nodes, k = at[known], nodes[known], k + 1
            yield k, at, nodes
            more = left[at] > k
            at, nodes = at[more], nodes[more]


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the words one behind the other, and for each how many there are from it to its word's end."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    return codes, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))


class Lattices:
    """A model as arrays: sums over the segmentations of all words of one length at a time, the same sums as ``UnigramModel`` takes word by word."""

    def __init__(self, model: UnigramModel):
        self.model, self.pieces = model, list(model.scores)
        self.scores = np.array(list(model.scores.values()), float)
        self.weights = np.exp(self.scores)
        self.trie = Trie()
        codes, left = code_points(self.pieces)
        sizes = np.array([len(p) for p in self.pieces], np.int64)
        starts, nodes = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
        for depth in range(model.longest):
            at = np.flatnonzero(sizes > depth)
            keys, which = np.unique(nodes[at] << CODE_BITS | codes[starts[at] + depth], return_inverse=True)
            nodes[at] = self.trie.grow(keys)[which]
        self.piece = np.full(self.trie.nodes, -1, np.int64)
        self.piece[nodes] = np.arange(len(nodes))

    def groups(self, words: list[str], counts: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
        """Words of one length with their counts, at most so many that their arcs stay within bounds."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if len(same) and (n := sizes[same[0]]):
                step = max(1, LATTICE_CELLS // int(n * min(n, self.model.longest)))
                for low in range(0, len(same), step):
                    part = same[low : low + step]
                    yield [words[i] for i in part], counts[part]

    def arcs(self, words: list[str], log: bool) -> tuple[np.ndarray, list[tuple]]:
        """Log probability (or probability) by end, length less one and word, and ``length, start, word, piece`` of the arcs."""
        n, wide = len(words[0]), len(words)
        listed, none, unknown = (self.scores, -np.inf, self.model.unknown) if log else (self.weights, 0.0, math.exp(self.model.unknown))
        found = []
        for k, at, nodes in self.trie.walk(*code_points(words)):
            piece = self.piece[nodes]
            at, piece = at[piece >= 0], piece[piece >= 0]
            if len(at):
                found.append((k, *np.divmod(at, n)[::-1], piece))
        values = np.full((n + 1, max((k for k, *_ in found), default=1), wide), none)
        values[1:, 0] = unknown
        for k, start, word, piece in found:
            values[start + k, k - 1, word] = listed[piece]
        return values, found

    def expect(self, words: list[str], counts: np.ndarray, into: np.ndarray) -> float:
        """``UnigramModel.expect`` of words of one length; the sum of log likelihoods by count.

        Sums of products of probabilities; words too unlikely for that are summed by logarithms.
        """
        n = len(words[0])
        values, found = self.arcs(words, log=False)
        longest = values.shape[1]
        forward, backward = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
        forward[0] = backward[n] = 1.0
        for end in range(1, n + 1):
            k = min(longest, end)
            np.einsum("kw,kw->w", forward[end - k : end][::-1], values[end, :k], out=forward[end])
        small = np.flatnonzero(forward[n] < LEAST_PRODUCT)
        total = 0.0
        if len(small):
            total = self._expect_log([words[i] for i in small], counts[small], into)
            counts = counts.copy()
            counts[small], forward[n, small] = 0.0, 1.0
        for start in range(n - 1, -1, -1):
            k = np.arange(min(longest, n - start))
            np.einsum("kw,kw->w", backward[start + 1 + k], values[start + 1 + k, k], out=backward[start])
        scaled = forward * (counts / forward[n])
        for k, start, word, piece in found:
            into += np.bincount(piece, scaled[start, word] * self.weights[piece] * backward[start + k, word], len(into))
        return total + float((np.log(forward[n]) * counts).sum())

    def _expect_log(self, words: list[str], counts: np.ndarray, into: np.ndarray) -> float:
        n = len(words[0])
        values, found = self.arcs(words, log=True)
        longest = values.shape[1]
        forward, backward = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
        for end in range(1, n + 1):
            k = min(longest, end)
            forward[end] = _log_sums(forward[end - k : end][::-1] + values[end, :k])
        for start in range(n - 1, -1, -1):
            k = np.arange(min(longest, n - start))
            backward[start] = _log_sums(backward[start + 1 + k] + values[start + 1 + k, k])
        for k, start, word, piece in found:
            share = np.exp(forward[start, word] + self.scores[piece] + backward[start + k, word] - forward[n, word])
            into += np.bincount(piece, share * counts[word], len(into))
        return float((forward[n] * counts).sum())

    def count_best(self, words: list[str], counts: np.ndarray, into: np.ndarray) -> float:
        """Adds to each piece how often the best segmentations use it; the sum of their scores by count."""
        n = len(words[0])
        scores, found = self.arcs(words, log=True)
        pieces = np.full(scores.shape, -1, np.int64)
        for k, start, word, piece in found:
            pieces[start + k, k - 1, word] = piece
        best, back = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)), np.int64)
        for end in range(1, n + 1):
            k = min(scores.shape[1], end)
            # the longest first, so that the first of equals is the longest
            ways = best[end - k : end] + scores[end, :k][::-1]
            top = ways.argmax(0)
            back[end], best[end] = k - top, ways[top, np.arange(len(words))]
        word, end = np.arange(len(words)), np.full(len(words), n)
        while len(word):
            k = back[end, word]
            piece = pieces[end, k - 1, word]
            known = piece >= 0
            into += np.bincount(piece[known], counts[word[known]], len(into))
            end = end - k
            word, end = word[end > 0], end[end > 0]
        return float((best[n] * counts).sum())


def _log_sums(values: np.ndarray) -> np.ndarray:
    top = values.max(0)
    return top if len(values) == 1 else top + np.log(np.exp(values - top).sum(0))


def _summed(words: DataFrame, model: UnigramModel, best: bool = False) -> tuple[dict[str, float], float]:
    """How often each piece is expected in all words, or used by their best segmentations, and the sum of the log likelihoods, or of the best scores.

    Each task sums in one array and hands on one row a piece; pieces are bounded by the seed size whatever the corpus.
    """
    shared = words.sparkSession.sparkContext.broadcast(Lattices(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices = shared.value
        model, number = lattices.model, None
        sums, total = np.zeros(len(lattices.pieces)), 0.0
        for batch in batches:
            for same, counts in lattices.groups(list(batch["word"]), batch["cnt"].to_numpy(float)):
                if len(same) >= FEW_WORDS:
                    total += (lattices.count_best if best else lattices.expect)(same, counts, sums)
                    continue
                number = number or {p: i for i, p in enumerate(lattices.pieces)}
                for word, cnt in zip(same, counts):
                    single: dict[str, float] = defaultdict(float)
                    total += cnt * (_count_best(model, word, cnt, single) if best else model.expect(word, cnt, single))
                    for piece, n in single.items():
                        if piece in number:
                            sums[number[piece]] += n
        used = np.flatnonzero(sums)
        yield pd.DataFrame({"piece": [*used.tolist(), -1], "n": [*sums[used].tolist(), total]})

    rows = words.select("word", "cnt").mapInPandas(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    found = {r["piece"]: r["n"] for r in rows}
    total, pieces = found.pop(-1, 0.0), list(model.scores)
    return {pieces[i]: n for i, n in found.items()}, total


def _count_best(model: UnigramModel, word: str, cnt: float, sums: dict[str, float]) -> float:
    pieces = model.segment(word)
    for piece in pieces:
        sums[piece] += cnt
    return model.score(pieces)


@dataclass
class _Followed:
    """Substrings still followed, after each pass: ``depths``, and for each the sorted packed keys; a key's place is its number in the next one."""

    alphabet: np.ndarray
    bits: int
    depths: list[int]
    keys: list[np.ndarray]

    def packed(self, numbers: np.ndarray, codes: np.ndarray, at: np.ndarray, low: int, high: int) -> np.ndarray:
        for k in range(low, high):
            numbers = numbers << self.bits | codes[at + k]
        return numbers

    def places(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places where a followed substring starts, and its number."""
        at, numbers, low = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        for depth, known in zip(self.depths, self.keys):
            more = left[at] >= depth
            at = at[more]
            keys = self.packed(numbers[more], codes, at, low, depth)
            numbers = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            same = known[numbers] == keys
            at, numbers, low = at[same], numbers[same], depth
        return at, numbers


def _following(words: DataFrame, followed: _Followed, low: int, high: int) -> DataFrame:
    """``chars, key, n``: how often the followed substrings of ``low`` characters are met with up to ``high``."""
    shared = words.sparkSession.sparkContext.broadcast(followed)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        found, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return found, np.bincount(which, np.concatenate([n for _, n in parts]), len(found))

    def out(chars: int, keys: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"chars": np.full(len(keys), chars), "key": keys, "n": n.astype(np.int64)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        followed, held = shared.value, {chars: [] for chars in range(low + 1, high + 1)}
        for batch in batches:
            listed = list(batch["word"])
            codes, left = code_points(listed)
            codes = np.searchsorted(followed.alphabet, codes)
            weights = np.repeat(batch["cnt"].to_numpy(float), [len(w) for w in listed])
            at, keys = followed.places(codes, left)
            for chars, parts in held.items():
                more = left[at] >= chars
                at = at[more]
                keys = followed.packed(keys[more], codes, at, chars - 1, chars)
                parts.append(merged([(keys, weights[at])]))
                if sum(len(k) for k, _ in parts) > SUMMED:
                    parts[:] = [merged(parts)]
                    if len(parts[0][0]) > SUMMED // 2:
                        yield out(chars, *parts.pop())
        for chars, parts in held.items():
            if parts:
                yield out(chars, *merged(parts))

    counted = words.select("word", "cnt").mapInPandas(count, "chars long, key long, n long")
    return counted.groupBy("chars", "key").agg(F.sum("n").alias("n"))


#: Characters more that a pass over the words counts, if as many fit into a key: the first passes, which follow everything, take few.
PASS_CHARS = (2, 1, 2, 3, 8)


def seed_pieces(words: DataFrame, seed_size: int = SEED_PIECES, piece_chars: int = PIECE_CHARS) -> dict[str, int]:
    """Every character, and the substrings of words with the highest count times length, at most ``seed_size``; each is met at least twice.

    Counted by passes over the words, each a few characters longer. What follows a substring is no more frequent than it, so one that at the
    full length would still be worth less than the ``seed_size`` best so far is not followed. Worth and counts grow together:
    what comes to the driver depends on the seed size, not on the corpus.
    """
    chars = words.select(F.explode(F.split("word", "")).alias("ch"), "cnt").where("ch <> ''").groupBy("ch").agg(F.sum("cnt").alias("n")).collect()
    found = {r["ch"]: r["n"] for r in chars}
    alphabet = sorted(found)
    followed = _Followed(np.array([ord(c) for c in alphabet], np.int64), max(1, len(alphabet).bit_length()), [], [])
    texts, worth, least, low, turn = [""], np.empty(0, np.int64), 0, 0, 0
    while texts and low < piece_chars and seed_size > 0 and found:
        room = (62 - len(texts).bit_length()) // followed.bits
        # the first pass ends behind the second character at least: the characters themselves are all followed
        high = min(piece_chars, low + max(1, min(room, PASS_CHARS[min(turn, len(PASS_CHARS) - 1)])))
        counted = _following(words, followed, low, high).where((F.col("n") > 1) & (F.col("n") * piece_chars >= least))
        table, mask = counted.toArrow(), (1 << followed.bits) - 1
        lengths, keys, n = (table[c].to_numpy() for c in ("chars", "key", "n"))
        worth = np.concatenate([worth, (n * lengths)[lengths > 1]])
        if len(worth) >= seed_size:
            worth = np.partition(worth, len(worth) - seed_size)[len(worth) - seed_size :]
            least = int(worth.min())
        kept = n * piece_chars >= least
        lengths, keys, n = lengths[kept], keys[kept], n[kept]

        def spelt(key: int, length: int) -> str:
            tail = [alphabet[key >> followed.bits * k & mask] for k in range(length - low)]
            return texts[key >> followed.bits * (length - low)] + "".join(reversed(tail))

        good = (lengths > 1) & (n * lengths >= least)
        found.update((spelt(k, c), m) for k, c, m in zip(keys[good].tolist(), lengths[good].tolist(), n[good].tolist()))
        on = np.sort(keys[lengths == high])
        texts = [spelt(k, high) for k in on.tolist()]
        followed = _Followed(followed.alphabet, followed.bits, [*followed.depths, high], [*followed.keys, on])
        low, turn = high, turn + 1
    longer = sorted((-n * len(p), p) for p, n in found.items() if len(p) > 1)[: max(0, seed_size)]
    return {c: found[c] for c in alphabet} | {p: -n // len(p) for n, p in longer}


def estimated(counts: dict[str, float], keep: Callable[[str], bool]) -> UnigramModel:
    """Relative frequencies as log probabilities; pieces that were never used go, those to ``keep`` stay at next to nothing."""
    counts = {p: max(c, 1e-9) for p, c in counts.items() if c > 1e-9 or keep(p)}
    total = math.log(sum(counts.values())) if counts else 0.0
    return UnigramModel({p: math.log(c) - total for p, c in counts.items()})


def em_steps(words: DataFrame, model: UnigramModel, steps: int = EM_STEPS) -> tuple[UnigramModel, list[float]]:
    """The model after so many steps, and the log likelihood before each: it never falls from one step to the next."""
    seen = []
    for _ in range(steps):
        counts, likelihood = _summed(words, model)
        seen.append(likelihood)
        # a character keeps its place, so every text of these characters can be written
        model = estimated({p: counts.get(p, 0.0) for p in model.scores}, lambda p: len(p) == 1)
    return model, seen


def prune(words: DataFrame, model: UnigramModel, size: int) -> UnigramModel:
    """The ``size`` pieces whose loss would cost most likelihood; characters always stay.

    A piece's loss: how often the best segmentations use it, times what its own best other segmentation is worth less. The smaller piece of
    equally dear ones stays.
    """
    used, _ = _summed(words, model, best=True)
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = dict(shared.value.scores)
        other = UnigramModel(scores)
        for batch in batches:
            found = []
            for piece, n in zip(batch["piece"], batch["n"]):
                own = scores.pop(piece)
                found.append(n * (own - other.score(other.segment(piece))))
                scores[piece] = own
            yield pd.DataFrame({"piece": list(batch["piece"]), "loss": found}, columns=["piece", "loss"])

    rows = [(p, float(used.get(p, 0.0))) for p in sorted(model.scores) if len(p) > 1]
    ranked = []
    if rows:
        asked = spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "n"])).repartition(spark.sparkContext.defaultParallelism, "piece")
        ranked = sorted((-float(f"{r['loss']:.9g}"), r["piece"]) for r in asked.mapInPandas(losses, "piece string, loss double").collect())
    chars = [p for p in model.scores if len(p) == 1]
    kept = chars + [p for _, p in ranked[: max(0, size - len(chars))]]
    total = log_sum([model.scores[p] for p in kept]) if kept else 0.0
    return UnigramModel({p: model.scores[p] - total for p in kept})


def train_unigram(counts: DataFrame, vocab_size: int, seed_size: int = SEED_PIECES, piece_chars: int = PIECE_CHARS, steps: int = EM_STEPS,
                  kept_share: float = KEPT_SHARE) -> UnigramModel:
    """A model of ``vocab_size`` pieces, the specials among that number, from ``word, cnt``.

    The seed is learnt for some steps, then cut to a share of its pieces, and so on until the size is reached; characters
    are never cut, so the size is missed where there are more of them. The words are written once and read by every
    step; only sums by piece come back, whose number the seed size bounds.

    Defined results: null and empty words count nothing; repeated rows of a word add up; no words give an empty model; a word longer than
    a piece is cut only into pieces, never left out.
    """
    spark, listed = counts.sparkSession, shared_folder(counts.sparkSession, "unigram-words")
    summed = counts.where(F.length("word") > 0).groupBy("word").agg(F.sum("cnt").alias("cnt"))
    # few bytes, but much work a word
    summed.repartition(spark.sparkContext.defaultParallelism, "word").write.parquet(listed)
    # a file a task: no step shuffles the words again
    words = spark.read.schema("word string, cnt long").parquet(listed)
    target = max(0, vocab_size - len(VOCABULARY_SPECIALS))
    seeds = seed_pieces(words, seed_size, piece_chars)
    model, runs = estimated({p: float(n) for p, n in seeds.items()}, lambda p: True), []
    while True:
        model, seen = em_steps(words, model, steps)
        runs.append(seen)
        room = max(target, sum(len(p) == 1 for p in model.scores))
        if len(model.scores) <= room:
            break
        model = prune(words, model, max(room, int(len(model.scores) * kept_share)))
    discard(spark, listed)
    return UnigramModel(model.scores, runs)


def unigram_vocabulary(spark, model: UnigramModel) -> DataFrame:
    """``rank, token, score``: the specials, then the pieces from the likeliest on; equals by token."""
    pieces = sorted((-s, p) for p, s in model.scores.items())
    rows = [(i, t, 0.0) for i, t in enumerate(VOCABULARY_SPECIALS, 1)]
    rows += [(len(rows) + i, p, -s) for i, (s, p) in enumerate(pieces, 1)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["rank", "token", "score"]).astype({"rank": "int32", "score": "float64"}))


def unigram_pieces(df: DataFrame, col: str, model: UnigramModel, name: str) -> DataFrame:
    """The best pieces of each text, word by word; a null text has none.

    Row-local: the model is as large as the vocabulary and shipped once, and a worker remembers the words it has cut.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<string>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, seen = shared.value, {}
        for batch in batches:
            rows = []
            for text in batch:
                row = []
                for word in (text or "").split(" "):
                    if word:
                        pieces = seen.get(word)
                        if pieces is None:
                            pieces = model.segment(WORD_MARK + word)
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            if len(word) <= REMEMBERED_CHARS:
                                seen[word] = pieces
                        row += pieces
                rows.append(row)
            yield pd.Series(rows, dtype=object)

    return df.withColumn(name, encode(F.col(col)))
