"""Quality rules: exact counts with fixed limits, and a calibrated classifier on hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.hashing import gram_codes, pack, word_codes
from tandem.llm.tables import held_out_fold, labelled_sample, trained

_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Bounds of the labelled sample, width of the hash tables, and the probability a kept text needs.
SAMPLE_ROWS, SAMPLE_CHARS, HASH_BITS, KEEP_ABOVE = 4_000, 8_000_000, 15, 0.5
PIECE = 1 << 20

_rng = np.random.default_rng(8)
_MIX = _rng.integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by windows of eight words that occur twice or more in the text, the first included.

    Windows are compared by a 64-bit hash of their word numbers, which are exact within the text.
    """
    n = len(words)
    if n < WINDOW + 1:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, n)
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    m = n - WINDOW + 1
    hashes = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        hashes += ids[k : k + m] * _MIX[k]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    edges[:m] += twice
    edges[WINDOW:] -= twice
    return int((np.cumsum(edges[:n]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``; a null text has none of any."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    word_chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated_words(words)


@dataclass
class QualityModel:
    """Logistic regression over the mean weight of a text's words and of its character 4-grams, then a calibration."""

    words: np.ndarray
    grams: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    #: False if there was nothing to learn from: such a model rejects no text.
    learned: bool = True

    def logits(self, texts: list[bytes]) -> np.ndarray:
        sums, sizes = np.zeros((len(texts), 2)), np.zeros((len(texts), 2))
        for rows, buffer in pack(texts, PIECE):
            for j, (table, (codes, owner)) in enumerate(
                    ((self.words, word_codes(buffer, HASH_BITS)), (self.grams, gram_codes(buffer, 4, HASH_BITS)))):
                sums[:, j] += np.bincount(rows[owner], table[codes], len(texts))
                sizes[:, j] += np.bincount(rows[owner], minlength=len(texts))
        return (sums / np.maximum(sizes, 1)).sum(1) + self.bias

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -40, 40)))


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, column, share`` of the hashed features; 4-grams follow the words."""
    found = []
    for rows, buffer in pack(texts, PIECE):
        for shift, (codes, owner) in ((0, word_codes(buffer, HASH_BITS)), (1 << HASH_BITS, gram_codes(buffer, 4, HASH_BITS))):
            keys, counts = np.unique(rows[owner].astype(np.int64) << (HASH_BITS + 1) | (codes + shift), return_counts=True)
            found.append((keys, counts))
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    counts = np.bincount(where, np.concatenate([c for _, c in found]))
    row, column = keys >> (HASH_BITS + 1), keys & ((1 << (HASH_BITS + 1)) - 1)
    kind = row * 2 + (column >> HASH_BITS)
    return row, column, counts / np.bincount(kind, counts)[kind]


def fit_quality(texts: list[bytes], labels: list[int], share: float | None = None, rounds: int = 120, rate: float = 0.5, decay: float = 1e-6) -> QualityModel:
    """Train on four fifths of the sample, calibrate the slope and shift on the rest, for a corpus with that ``share`` of label 1.

    Without both labels there is nothing to learn: the model then gives the smoothed share of label 1 and rejects nothing.
    """
    size = 1 << HASH_BITS
    y = np.array([1.0 if v > 0 else 0.0 for v in labels])
    prior = (y.sum() + 1) / (len(y) + 2)
    model = QualityModel(np.zeros(size), np.zeros(size), float(np.log(prior / (1 - prior))))
    if len(set(y)) < 2 or not any(t.split() for t in texts):
        model.learned = False
        return model
    fold = np.arange(len(y)) % 5 == 4
    train = ~fold if len(set(y[fold])) == 2 and len(set(y[~fold])) == 2 else np.ones(len(y), bool)
    row, column, part = _features(texts)
    use = train[row]
    r, c, s = row[use], column[use], part[use]
    # common n-grams differ little between texts: scale each feature so that rare ones can speak
    seen = np.bincount(c, s, 2 * size)
    scale = 1 / np.sqrt(seen + 1e-3)
    s = s * scale[c]
    weights, memory, bias, bias_memory = np.zeros(2 * size), np.full(2 * size, 1e-8), model.bias, 1e-8
    balance = np.where(y > 0, 0.5 / y[train].mean(), 0.5 / (1 - y[train].mean())) * train
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, weights[c] * s, len(y)) + bias, -40, 40)))
        error = (p - y) * balance
        slope = np.bincount(c, error[r] * s, 2 * size) + decay * weights
        memory += slope**2
        weights -= rate * slope / np.sqrt(memory)
        bias_memory += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(bias_memory)
    weights *= scale
    model = QualityModel(weights[:size], weights[size:], float(bias))
    used = train if train.all() else fold
    model.slope, model.shift = calibrate(model.logits(texts)[used], y[used], share)
    return model


def calibrate(logits: np.ndarray, y: np.ndarray, share: float | None = None, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift that turn logits into probabilities: damped Newton steps on smoothed targets, slope not negative.

    ``share`` of label 1 in the corpus weighs the two labels, where the sample holds another share.
    """
    own = float(y.mean())
    weight = np.ones(len(y)) if share is None or own in (0.0, 1.0) else np.where(y > 0, share / own, (1 - share) / (1 - own))
    weight = weight / weight.mean()
    mean, spread = float(logits.mean()), float(logits.std()) or 1.0
    x = np.stack([(logits - mean) / spread, np.ones(len(logits))], 1)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - target * z)).mean() + ridge * (w @ w) / 2)

    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (p - target)) / len(x) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    a = max(float(w[0]) / spread, 0.0)
    return a, float(w[1]) - a * mean


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rate_quality(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), keep_above: float = KEEP_ABOVE) -> DataFrame:
    """``keep``, the exact counts, ``base_failed``, the ``score`` and ``kept`` of every document; a pure map in Arrow batches.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated windows. ``score`` is the
    calibrated probability of label 1 over the whole text; a text is kept if its base rules hold and the
    score reaches ``keep_above``. A model that learned nothing leaves it to the base rules.

    Defined results: a null or empty text has zero counts, fails the base rules and gets the model's prior;
    repeated rows give repeated results; columns of the input named like results are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<" + "".join(f"{c}: long, " for c in COUNTS) + "base_failed: boolean, score: double>")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = np.array([text_counts(text) for text in batch], np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])
            scores = shared.value.probabilities([(text or "").encode("utf-8", "replace") for text in batch])
            yield pd.DataFrame(dict(zip(COUNTS, counts.T)) | {"base_failed": failed, "score": scores})

    rated = docs.select(*dict.fromkeys([*keep, "text"])).select(*keep, rate("text").alias("_rated")).select(*keep, "_rated.*")
    return rated.withColumn("kept", ~F.col("base_failed") & ((F.col("score") >= keep_above) | F.lit(not model.learned)))


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> QualityModel:
    """Model of a bounded sample of the labelled rows: at most ``rows`` documents of about ``chars`` characters together."""
    sample = labelled_sample(docs, labels, "quality", rows, chars, held_out_fold(F.col("doc_id")))
    return trained(docs.sparkSession, fit_quality, sample)
