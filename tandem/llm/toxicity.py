"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

The network is trained in numpy on windows of words and scores every window of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.quality import calibrate
from tandem.llm.tables import held_out_fold, labelled_sample, trained

#: Words of a window and from one window to the next, sizes of the network, and its hash tables.
WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, HASH_BITS = 64, 32, 8, 8, 8, 12
#: Bounds of the labelled sample, and the score from which on a text is toxic.
SAMPLE_ROWS, SAMPLE_CHARS, TOXIC_FROM = 4_000, 8_000_000, 0.3
EPOCHS, BATCH, RATE, SEED = 12, 256, 0.01, 4
#: Share of words whose own embedding is left out in training, so that characters must do, and the decay of the embeddings.
WORD_DROPOUT, DECAY = 0.8, {"words": 0.1, "chars": 0.04}
_CHUNK_BYTES, _CHUNK_WORDS, _CHUNK_WINDOWS, _PART_WINDOWS = 1 << 20, 1 << 16, 1024, 4096

# Lower-cases A-Z; ASCII letters and digits and all other bytes from 128 on belong to words.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass
class Words:
    """Words of some texts as numbers: hashes, character trigrams of all words end to end, where each word's begin, and where each text's words begin."""

    codes: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray
    text_starts: np.ndarray


def _hash(x: np.ndarray, bits: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - bits)).astype(np.int32)


def read_words(texts: list[bytes]) -> Words:
    """Every byte of a word opens a trigram with its neighbours; the word's frame, a space on each side, counts as such."""
    buffer = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8).astype(np.uint64)
    inside = buffer != 32
    place = np.flatnonzero(inside)
    ends = np.cumsum([1] + [len(t) + 1 for t in texts])
    if not len(place):
        return Words(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    first = np.flatnonzero(~inside[place - 1])
    trigram = buffer[place - 1] << np.uint64(16) | buffer[place] << np.uint64(8) | buffer[place + 1]
    since = np.arange(len(place), dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, len(place)))).astype(np.uint64)
    spread = (since * np.uint64(2) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    word = np.add.reduceat(buffer[place] * (spread ^ spread >> np.uint64(31)), first)
    starts = np.searchsorted(place[first], ends)
    return Words(_hash(word, HASH_BITS), _hash(trigram + np.uint64(1), HASH_BITS), first, starts)


def windows_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of each overlapping window; a text has at least one, of no words if it has none."""
    n = np.diff(starts)
    many = np.where(n <= WINDOW, 1, 1 + -(-(n - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(n)), many)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = starts[:-1][text] + turn * STRIDE
    return text, first, np.minimum(WINDOW, starts[1:][text] - first)


class Network:
    """Parameters by name, forward and backward passes. Both directions have their own gates; ``U`` are their recurrent weights."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size, gates = WORD_DIM + CHAR_DIM, 3 * HIDDEN

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "words": normal(1 << HASH_BITS, WORD_DIM, scale=0.1), "chars": normal(1 << HASH_BITS, CHAR_DIM, scale=0.3),
            "Wf": normal(size, gates, scale=size**-0.5), "Wb": normal(size, gates, scale=size**-0.5),
            "bf": np.zeros(gates, np.float32), "bb": np.zeros(gates, np.float32),
            "Uf": normal(HIDDEN, gates, scale=HIDDEN**-0.5), "Ub": normal(HIDDEN, gates, scale=HIDDEN**-0.5),
            "att": normal(2 * HIDDEN, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32),
        }

    def inputs(self, words: Words) -> np.ndarray:
        """One vector per word: its own embedding and the mean of its trigrams', then a row of zeros for padding."""
        x = np.zeros((len(words.codes) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if len(words.codes):
            x[:-1, :WORD_DIM] = self.p["words"][words.codes]
            ends = np.append(words.gram_starts, len(words.grams))
            for at in range(0, len(words.codes), _CHUNK_WORDS):
                starts = ends[at : at + _CHUNK_WORDS + 1]
                sums = np.add.reduceat(self.p["chars"][words.grams[starts[0] : starts[-1]]], starts[:-1] - starts[0], axis=0)
                x[at : at + len(sums), WORD_DIM:] = sums / np.diff(starts)[:, None]
        return x

    def _run(self, x: np.ndarray, U: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction over ``x`` (time, window, gates); a padded step has state zero."""
        h, states = np.zeros((x.shape[1], HIDDEN), np.float32), np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
        for t in range(x.shape[0]):
            a = h @ U
            rz = 0.5 * np.tanh(0.5 * (x[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])) + 0.5
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            new = (n + z * (h - n)) * mask[t]
            if keep is not None:
                keep.append((h, r, z, n, a[:, 2 * HIDDEN :]))
            h = states[t] = new
        return states

    def forward(self, inputs: np.ndarray, first: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        p, steps = self.p, max(1, int(length.max(initial=1)))
        at = np.arange(steps)[:, None]
        mask = (at < length[None]).astype(np.float32)[:, :, None]
        index = np.where(at < length[None], first[None] + at, len(inputs) - 1)
        # each word is projected once, however many windows it is in, unless windows far apart leave most words between them out
        low = int(first.min(initial=0))
        high = max(low, int((first + length).max(initial=0)))
        if high - low < index.size:
            span = np.concatenate([inputs[low:high], inputs[-1:]])
            local = np.where(mask[:, :, 0] > 0, index - low, len(span) - 1)
        else:
            span, local = inputs[index.ravel()], np.arange(index.size).reshape(index.shape)
        kept = ([], []) if keep is not None else (None, None)
        hf = self._run((span @ p["Wf"] + p["bf"])[local], p["Uf"], mask, kept[0])
        hb = self._run((span @ p["Wb"] + p["bb"])[local[::-1]], p["Ub"], mask[::-1], kept[1])[::-1]
        h = np.concatenate([hf, hb], 2)
        score = np.where(mask[:, :, 0] > 0, (h.reshape(-1, h.shape[2]) @ p["att"]).reshape(h.shape[:2]), -1e9)
        weight = np.exp(score - score.max(0)) * mask[:, :, 0]
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tw,twh->wh", weight, h)
        if keep is not None:
            keep.update(mask=mask, index=index, h=h, weight=weight, pooled=pooled, kept=kept)
        return pooled @ p["out"] + p["bias"][0]

    def backward(self, words: Words, inputs: np.ndarray, keep: dict, slope: np.ndarray,
                 dropped: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Gradient of ``sum(slope * logits)`` for every parameter; ``dropped`` words were fed without their embedding."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        h, weight, pooled, mask = keep["h"], keep["weight"], keep["pooled"], keep["mask"]
        g["out"], g["bias"] = pooled.T @ slope, np.array([slope.sum()], np.float32)
        d_pooled = slope[:, None] * p["out"][None]
        d_weight = (h * d_pooled[None]).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["att"] = np.einsum("tw,twh->h", d_score, h)
        d_h = weight[:, :, None] * d_pooled[None] + d_score[:, :, None] * p["att"]
        x = inputs[keep["index"]]
        d_x = np.zeros_like(x)
        for name, part, order, kept in (("f", d_h[:, :, :HIDDEN], 1, keep["kept"][0]), ("b", d_h[:, :, HIDDEN:], -1, keep["kept"][1])):
            U, W, own, msk, xs = p["U" + name], p["W" + name], part[::order], mask[::order], x[::order]
            carried, d_own = np.zeros_like(own[0]), d_x[::order]
            for t in range(len(own) - 1, -1, -1):
                before, r, z, n, a_n = kept[t]
                d = (own[t] + carried) * msk[t]
                d_n = d * (1 - z) * (1 - n * n)
                d_r = d_n * a_n * r * (1 - r)
                d_z = d * (before - n) * z * (1 - z)
                d_in = np.concatenate([d_r, d_z, d_n], 1)
                d_a = np.concatenate([d_r, d_z, d_n * r], 1)
                carried = d * z + d_a @ U.T
                g["U" + name] += before.T @ d_a
                g["W" + name] += xs[t].T @ d_in
                g["b" + name] += d_in.sum(0)
                d_own[t] += d_in @ W.T
        used = mask[:, :, 0] > 0
        word, d_word = keep["index"][used], d_x[used]
        order = np.argsort(word, kind="stable")
        unique, at = np.unique(word[order], return_index=True)
        d_word = np.add.reduceat(d_word[order], at, axis=0) if len(at) else d_word
        heard = np.ones(len(inputs), bool)
        if dropped is not None:
            heard[dropped] = False
        g["words"] += _sums(words.codes[unique], d_word[:, :WORD_DIM] * heard[unique, None], len(g["words"]))
        ends = np.append(words.gram_starts, len(words.grams))
        sizes = ends[unique + 1] - ends[unique]
        which = np.repeat(np.arange(len(unique)), sizes)
        gram = words.grams[np.repeat(ends[unique], sizes) + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        g["chars"] += _sums(gram, (d_word[:, WORD_DIM:] / np.maximum(sizes, 1)[:, None])[which], len(g["chars"]))
        return g


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of ``values`` at each index."""
    return np.stack([np.bincount(index, column, size) for column in values.T], 1)


def window_logits(network: Network, inputs: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """In chunks of neighbouring windows of about one length, so that little is padded and memory stays small."""
    out = np.empty(len(first), np.float32)
    full = length == WINDOW
    for group in (np.flatnonzero(full), np.flatnonzero(~full)[np.argsort(length[~full], kind="stable")]):
        for at in range(0, len(group), _CHUNK_WINDOWS):
            part = group[at : at + _CHUNK_WINDOWS]
            # neighbours by place again, so that the words they share are few
            part = np.sort(part)
            out[part] = network.forward(inputs, first[part], length[part])
    return out


@dataclass
class ToxicityModel:
    """The network, and the calibration of a text's largest window logit."""

    network: Network
    slope: float = 1.0
    shift: float = 0.0
    #: False if there was nothing to learn from: such a model calls no text toxic.
    learned: bool = True

    def logits(self, texts: Iterator[bytes]) -> np.ndarray:
        """Largest window logit of each text. Texts are gathered to chunks of bounded size; a longer text is fed part
        by part, cut so that its windows stay what they are."""
        best: list[float] = []
        held: list[bytes] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            words = read_words(held)
            text, first, length = windows_of(words.text_starts)
            found = window_logits(self.network, self.network.inputs(words), first, length)
            top = np.full(len(held), -np.inf)
            np.maximum.at(top, text, found)
            for i, value in zip(owner, top):
                best[i] = max(best[i], float(value))

        for i, text in enumerate(texts):
            best.append(-np.inf)
            for part in window_parts(text.translate(_FOLD)):
                held.append(part)
                owner.append(i)
                size += len(part) + 1
                if size >= _CHUNK_BYTES:
                    flush()
                    held, owner, size = [], [], 0
        if held:
            flush()
        return np.array(best)

    def scores(self, texts: Iterator[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -40, 40)))


def window_parts(folded: bytes) -> Iterator[bytes]:
    """The text itself, or, if it is long, parts of a fixed number of windows each; together they have the same windows."""
    if len(folded) <= _CHUNK_BYTES:
        yield folded
        return
    words = folded.split()
    step = _PART_WINDOWS * STRIDE
    for at in range(0, max(1, len(words) - (WINDOW - STRIDE)), step):
        yield b" ".join(words[at : at + step + WINDOW - STRIDE])


def train_network(texts: list[bytes], labels: list[int], share: float | None = None, epochs: int = EPOCHS, seed: int = SEED) -> ToxicityModel:
    """A text is toxic if a window of it is. Each epoch scores all windows and learns from a text's highest one; at
    first, when scores mean nothing, from all windows of short texts; and from some more at random of texts without label 1.

    Adam steps on the cross entropy; a fifth of the texts sets the calibration, for a corpus with that ``share`` of label 1. Without both labels
    or any word nothing is learned: scores are then the smoothed share of label 1, and no text is called toxic.
    """
    y = np.array([1.0 if v > 0 else 0.0 for v in labels], np.float32)
    network, rng = Network(seed), np.random.default_rng(seed)
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2 or not any(t.translate(_FOLD).split() for t in texts):
        for name in ("out", "bias"):
            network.p[name][:] = 0
        return ToxicityModel(network, 1.0, float(np.log(prior / (1 - prior))), False)
    words = read_words([t.translate(_FOLD) for t in texts])
    text, first, length = windows_of(words.text_starts)
    many = np.bincount(text, minlength=len(y))
    fold = np.arange(len(y)) % 5 == 4
    train = ~fold if len(set(y[fold].tolist())) == 2 and len(set(y[~fold].tolist())) == 2 else np.ones(len(y), bool)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    for epoch in range(epochs):
        noise = rng.random(len(text))
        if epoch < 2:
            chosen = np.flatnonzero(train[text] & ((many[text] <= 3) | (noise < 3 / many[text])))
        else:
            found = window_logits(network, network.inputs(words), first, length)
            order = np.lexsort((found, text))
            last = np.append(text[order][1:] != text[order][:-1], True)
            top = order[last]
            extra = np.flatnonzero((y[text] == 0) & (noise < 4 / many[text]))
            chosen = np.unique(np.concatenate([top, extra]))
            chosen = chosen[train[text[chosen]]]
        rng.shuffle(chosen)
        target = y[text[chosen]]
        balance = np.where(target > 0, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6)) ** 0.5
        # a small sample still makes some tens of steps in an epoch
        size = min(BATCH, max(16, len(chosen) // 30))
        for at in range(0, len(chosen), size):
            part, keep = chosen[at : at + size], {}
            inputs = network.inputs(_select(words, first[part], length[part], local := {}))
            dropped = np.flatnonzero(rng.random(len(inputs)) < WORD_DROPOUT)
            inputs[dropped, :WORD_DIM] = 0
            logit = network.forward(inputs, local["first"], length[part], keep)
            slope = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - target[at : at + size]) * balance[at : at + size] / len(part)).astype(np.float32)
            grads = network.backward(local["words"], inputs, keep, slope, dropped)
            step += 1
            rate = RATE * (1 - epoch / (epochs + 1))
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                network.p[k] *= 1 - rate * DECAY.get(k, 0.0)
                network.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = ToxicityModel(network)
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, text, window_logits(network, network.inputs(words), first, length))
    used = train if train.all() else fold
    model.slope, model.shift = calibrate(top[used], y[used], share)
    return model


def _select(words: Words, first: np.ndarray, length: np.ndarray, local: dict) -> Words:
    """The words of some windows alone, window after window; ``local`` gets them and each window's first word among them."""
    total = int(length.sum())
    begin = np.cumsum(length) - length
    index = np.repeat(first - begin, length) + np.arange(total)
    ends = np.append(words.gram_starts, len(words.grams))
    sizes = ends[index + 1] - ends[index] if total else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    grams = words.grams[np.repeat(ends[index] - starts, sizes) + np.arange(int(sizes.sum()))] if total else words.grams[:0]
    local["words"], local["first"] = Words(words.codes[index], grams, starts, begin), begin
    return local["words"]


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), toxic_from: float = TOXIC_FROM) -> DataFrame:
    """``keep, score, predicted`` for every document: all overlapping windows of the whole text are scored, the highest counts.

    Defined results: a null or empty text is one window without words and gets the score of the bias; a model that
    learned nothing predicts 0 for all; repeated
    rows give repeated results; an empty table gives no rows; columns of the input named like results are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.scores((text or "").encode("utf-8", "replace") for text in batch))

    scored = docs.select(*dict.fromkeys([*keep, "text"])).select(*keep, score("text").alias("score"))
    return scored.withColumn("predicted", ((F.col("score") >= toxic_from) & F.lit(model.learned)).cast("int"))


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """Model of a bounded sample of the labelled rows outside the held-out fold: at most ``rows`` documents of about ``chars`` characters."""
    sample = labelled_sample(docs, labels, "toxic", rows, chars, held_out_fold(F.col("doc_id")))
    return trained(docs.sparkSession, train_network, sample)


def keep_clean(docs: DataFrame, model: ToxicityModel, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The documents whose score stays below the limit, with all their columns."""
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_doc")
    scored = score_toxicity(docs.select(whole, "text"), model, ("_doc",), toxic_from)
    return scored.where("predicted = 0").select("_doc.*")
