"""Translation quality per direction: BLEU, chrF, segment-score means, off-target ratio."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import text as t
from tandem.functions.ngrams import char_word_overlap, token_overlap
from tandem.operators.records import apply_model
from tandem.session import staged


def detokenize(df: DataFrame, cols: tuple[str, ...] = ("hyp", "ref"), lang_col: str = "tgt_lang") -> DataFrame:
    return df.withColumns({c: t.detokenize(F.col(c), F.col(lang_col)) for c in cols})


def _joined(df: DataFrame, col: str) -> Column:
    return F.array_join(col, " ") if df.schema[col].dataType.typeName() == "array" else F.col(col)


def _sum_stats(df: DataFrame, keys: list[str], stats: Column, orders: int) -> DataFrame:
    counted = df.select(*keys, stats.alias("_s"))
    names = [(n, i) for n in range(orders) for i in range(3)]
    return counted.groupBy(*keys).agg(*[
        F.sum(F.col("_s")[3 * n + i]).alias(("match", "hyp", "ref")[i] + str(n + 1)) for n, i in names
    ])


def corpus_bleu(df: DataFrame, keys: list[str], hyp: str = "hyp", ref: str = "ref", max_n: int = 4, swap_roles: bool = False) -> DataFrame:
    """Corpus BLEU over pieces (arrays or space-separated), no further tokenisation.

    ``swap_roles`` scores the reference against the hypothesis. An order without a match
    counts half, a quarter, ... of one match; a corpus with an order that does not occur
    at all, or without any match, scores 0.
    """
    h, r = _joined(df, hyp), _joined(df, ref)
    if swap_roles:
        h, r = r, h
    sums = _sum_stats(df, keys, token_overlap(h, r, max_n), max_n)
    sys_len, ref_len = F.col("hyp1"), F.col("ref1")
    log_sum, zeros, empty = F.lit(0.0), F.lit(0), F.lit(False)
    for n in range(1, max_n + 1):
        match, total = F.col(f"match{n}"), F.col(f"hyp{n}")
        zeros = zeros + F.when(match == 0, 1).otherwise(0)
        share = F.when(match > 0, match / total).otherwise(1.0 / (F.pow(F.lit(2.0), zeros) * total))
        log_sum = log_sum + F.when(total > 0, F.log(share)).otherwise(0.0)
        empty = empty | (total == 0)
    no_match = sum((F.col(f"match{n}") for n in range(2, max_n + 1)), F.col("match1")) == 0
    brevity = F.when(sys_len >= ref_len, F.lit(1.0)).otherwise(F.exp(1 - ref_len / sys_len))
    bleu = F.when(empty | no_match, F.lit(0.0)).otherwise(100 * brevity * F.exp(log_sum / max_n))
    counts = [c for n in range(1, max_n + 1) for c in (f"match{n}", f"hyp{n}")]
    return sums.select(*keys, sys_len.alias("sys_len"), ref_len.alias("ref_len"), *counts, bleu.alias("bleu"))


def chrf(df: DataFrame, keys: list[str], hyp: str = "hyp", ref: str = "ref", char_n: int = 6, word_n: int = 2,
         beta: float = 2, swap_roles: bool = False) -> DataFrame:
    """chrF (``word_n=0``) or chrF++ (``word_n=2``) over the orders that occur on both sides."""
    h, r = F.col(hyp), F.col(ref)
    if swap_roles:
        h, r = r, h
    orders = char_n + word_n
    sums = _sum_stats(df, keys, char_word_overlap(h, r, char_n, word_n), orders)
    precision, recall, used = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in range(1, orders + 1):
        match, n_hyp, n_ref = F.col(f"match{n}"), F.col(f"hyp{n}"), F.col(f"ref{n}")
        both = (n_hyp > 0) & (n_ref > 0)
        precision = precision + F.when(both, match / n_hyp).otherwise(0.0)
        recall = recall + F.when(both, match / n_ref).otherwise(0.0)
        used = used + F.when(both, 1).otherwise(0)
    with_means = sums.withColumns({"_p": precision, "_r": recall, "orders": used}).withColumns({
        "_p": F.when(F.col("orders") > 0, F.col("_p") / F.col("orders")).otherwise(0.0),
        "_r": F.when(F.col("orders") > 0, F.col("_r") / F.col("orders")).otherwise(0.0),
    })
    square = float(beta) ** 2
    score = F.when(F.col("_p") + F.col("_r") > 0,
                   100 * (1 + square) * F.col("_p") * F.col("_r") / (square * F.col("_p") + F.col("_r"))).otherwise(0.0)
    counts = [f"{kind}{n}" for n in range(1, orders + 1) for kind in ("match", "hyp", "ref")]
    return with_means.select(*keys, "orders", *counts, score.alias("chrf"))


def system_score(df: DataFrame, load: Callable[[], Any], score: Callable[[Any, pd.DataFrame], pd.Series],
                 keys: list[str] = ["pair"], batch_size: int = 100) -> DataFrame:  # noqa: B006 - read only
    """Mean of a segment scorer over ``src, hyp, ref``, times 100, per direction."""
    slim = df.select(*keys, "src", "hyp", "ref")

    def predict(model: Any, batch: pd.DataFrame) -> pd.DataFrame:
        return batch[keys].assign(segment_score=score(model, batch).astype("float64"))

    schema = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys) + ", segment_score double"
    scored = apply_model(slim, load, predict, schema, batch_size)
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"), (F.avg("segment_score") * 100).alias("score"))


def offtarget_ratio(df: DataFrame, keys: list[str] = ["pair"], pred: str = "pred_lang", tgt: str = "tgt_lang") -> DataFrame:  # noqa: B006
    """Share of hypotheses whose detected language is not the target, in percent."""
    off = F.count_if(~F.col(pred).eqNullSafe(F.col(tgt)))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sentences"), off.alias("offtarget"), (off / F.count(F.lit(1)) * 100).alias("ratio")
    )


# Language detection ---------------------------------------------------------------------------

SCALE = 1_000_000


def char_ngrams(col: Column, n: int = 3) -> Column:
    """Character n-grams of the text framed by spaces, so that no text is without one."""
    framed = t.characters(F.concat(F.lit(" "), col, F.lit(" ")))

    def grams(chars: Column) -> Column:
        firsts = F.slice(chars, F.lit(1), F.size(chars) - (n - 1))
        runs = F.transform(firsts, lambda ch, i: F.concat(ch, *[F.get(chars, i + k) for k in range(1, n)]))
        # a text shorter than n is its own only n-gram
        return F.when(F.size(chars) >= n, runs).otherwise(F.array(F.array_join(chars, "")))

    # the one-element array binds the characters to a name: an inner function would
    # otherwise split the text again for every n-gram
    return F.transform(F.array(framed), grams)[0]


#: Code points fit into 21 bits, so up to three of them into one number.
CODE_BITS, PACKED = 21, 3
#: Characters of texts counted or scored together, and distinct n-grams a task holds before it hands them on.
CHARS_TOGETHER, HELD_GRAMS = 1 << 18, 1 << 20


def packed_grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the texts, each framed by spaces, as numbers, and how many each text has.

    At most ``PACKED`` code points, each one higher, make a number. A framed text shorter than that is its own only n-gram, with zeros behind it.
    """
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), "<u4").astype(np.int64) + 1
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    counts = np.maximum(sizes - n + 1, 1)
    at = np.flatnonzero(left >= np.minimum(n, np.repeat(sizes, sizes)))
    numbers = np.zeros(len(at), np.int64)
    for k in range(n):
        inside = left[at] > k
        numbers = numbers << CODE_BITS | np.where(inside, codes[np.minimum(at + k, len(codes) - 1)], 0)
    return numbers, counts


def unpacked(number: int, n: int) -> str:
    points = [number >> CODE_BITS * k & (1 << CODE_BITS) - 1 for k in reversed(range(n))]
    return "".join(chr(p - 1) for p in points if p)


def _together(texts: list[str]) -> Iterator[slice]:
    """Consecutive texts of about ``CHARS_TOGETHER`` characters; a longer one stands alone."""
    start, total = 0, 0
    for i, value in enumerate(texts):
        if total and total + len(value) > CHARS_TOGETHER:
            yield slice(start, i)
            start, total = i, 0
        total += len(value) + 2
    if start < len(texts):
        yield slice(start, len(texts))


def gram_counts(df: DataFrame, langs: list[str], n: int) -> DataFrame:
    """``gram`` and ``n_0, n_1, ...``: how often each language has it. The tasks count numbers and hand on a row a distinct n-gram, not one per occurrence."""
    names = [f"n_{i}" for i in range(len(langs))]
    if n > PACKED:
        grams = df.select("lang", F.explode(char_ngrams(F.col("text"), n)).alias("gram"))
        return grams.groupBy("gram").agg(*[F.count_if(F.col("lang") == x).alias(c) for c, x in zip(names, langs)])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        numbers, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        rows = np.concatenate([c for _, c in parts])
        sums = [np.bincount(which, rows[:, i], len(numbers)) for i in range(len(langs))]
        return numbers, np.stack(sums, 1).astype(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for i, x in enumerate(langs):
                texts = batch["text"][(batch["lang"] == x) & batch["text"].notna()].tolist()
                for part in _together(texts):
                    numbers, times = np.unique(packed_grams(texts[part], n)[0], return_counts=True)
                    rows = np.zeros((len(numbers), len(langs)), np.int64)
                    rows[:, i] = times
                    held.append((numbers, rows))
                    size += len(numbers)
                    if size > HELD_GRAMS:
                        held = [merged(held)]
                        size = len(held[0][0])
                        if size > HELD_GRAMS // 2:
                            yield pd.DataFrame(held[0][1], columns=names).assign(number=held[0][0])
                            held, size = [], 0
        if held:
            numbers, rows = merged(held)
            yield pd.DataFrame(rows, columns=names).assign(number=numbers)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[names].assign(gram=[unpacked(x, n) for x in batch["number"].tolist()])

    numbers = ", ".join(f"{c} long" for c in names)
    counted = df.mapInPandas(count, f"{numbers}, number long").groupBy("number").agg(*[F.sum(c).alias(c) for c in names])
    return counted.mapInPandas(spell, f"{numbers}, gram string")


def train_langid(df: DataFrame, langs: list[str], n: int = 3, text: str = "text", lang: str = "lang") -> DataFrame:
    """Naive-Bayes model: one row per n-gram with a log-probability per language.

    Add-one smoothing; log-probabilities are whole millionths so that sums are exact in
    any order. The row with a null n-gram holds what an unseen n-gram gets. The model is
    written once below the shared folder.
    """
    known = df.where(F.col(lang).isin(langs) & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = gram_counts(known, langs, n)
    totals = counts.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n_{i}").alias(f"t_{i}") for i in range(len(langs))])

    def log_p(count: Column, total: Column, v: Column) -> Column:
        return F.floor(F.log((count + 1) / (total + v)) * SCALE + 0.5).cast("long")

    sizes = totals.select(F.struct("*")).scalar()
    seen = counts.withColumn("_t", sizes).select(
        "gram", *[log_p(F.col(f"n_{i}"), F.col(f"_t.t_{i}"), F.col("_t.v")).alias(f"lp_{i}") for i in range(len(langs))])
    unseen = totals.select(
        F.lit(None).cast("string").alias("gram"),
        *[log_p(F.lit(0), F.col(f"t_{i}"), F.col("v")).alias(f"lp_{i}") for i in range(len(langs))])
    return staged(seen.unionByName(unseen), "langid")


#: Bytes of a model row beside its log-probabilities: the n-gram and its place in a table.
ROW_BYTES = 160
_PART = 1 << 14


def detect_language(df: DataFrame, model: DataFrame, langs: list[str], keys: list[str], n: int = 3, text: str = "text",
                    broadcast_bytes: int = 128 << 20) -> DataFrame:
    """``keys, pred_lang`` of every row: the language with the largest sum of log-probabilities, ties to the first listed.

    A model of up to ``broadcast_bytes`` (n-grams times languages, and the n-grams) goes to every executor and
    each row is scored where it is: nothing is shuffled. A larger one is joined by n-gram, each n-gram of a
    row counted once, with adaptive skew handling. Rows with equal keys stay rows of their own; a
    null text has no language.
    """
    if model.count() * (8 * len(langs) + ROW_BYTES) <= broadcast_bytes:
        return df.select(*keys, _scorer(model, langs, n)(F.col(text)).alias("pred_lang"))
    lps = [f"lp_{i}" for i in range(len(langs))]
    unseen = model.where(F.col("gram").isNull()).select(F.struct(*lps)).scalar()
    known = model.where(F.col("gram").isNotNull())
    row = ["_row", *keys, "_none"]
    numbered = df.select(*keys, F.monotonically_increasing_id().alias("_row"), F.col(text).isNull().alias("_none"), F.col(text).alias("_text"))
    grams = numbered.select(*row, F.explode_outer(char_ngrams(F.col("_text"), n)).alias("gram"))
    grams = grams.groupBy(*row, "gram").agg(F.count(F.lit(1)).alias("_times"))
    scored = grams.join(known, "gram", "left").withColumn("_u", unseen)
    sums = scored.groupBy(*row).agg(*[
        F.sum(F.coalesce(F.col(c), F.col(f"_u.{c}")) * F.col("_times")).alias(c) for c in lps])
    best = F.greatest(*[F.col(c) for c in lps]) if len(lps) > 1 else F.col(lps[0])
    pred = F.coalesce(*[F.when(F.col(c) == best, F.lit(x)) for c, x in zip(lps, langs)])
    return sums.select(*keys, F.when(~F.col("_none"), pred).alias("pred_lang"))


def _scorer(model: DataFrame, langs: list[str], n: int) -> Callable[[Column], Column]:
    """Arrow function over texts; the first row of the table is what an unseen n-gram gets."""
    table = model.orderBy(F.col("gram").asc_nulls_first()).toPandas()
    weights = table[[f"lp_{i}" for i in range(len(langs))]].to_numpy(np.int64)
    grams = list(table["gram"])
    if n > PACKED:
        known: object = {g: i for i, g in enumerate(grams) if i}
    else:
        numbers = np.array([_number(g, n) for g in grams[1:]], np.int64)
        order = np.argsort(numbers)
        known = (numbers[order], order + 1)
    shared = model.sparkSession.sparkContext.broadcast((known, weights))

    def best(value: str) -> str:
        places, table = shared.value
        framed, sums = f" {value} ", np.zeros(len(langs), np.int64)
        count = max(1, len(framed) - n + 1)
        for low in range(0, count, _PART):
            found = [places.get(framed[i : i + n], 0) for i in range(low, min(low + _PART, count))]
            sums += table[found].sum(0)
        return langs[int(sums.argmax())]

    def together(texts: list[str]) -> list[str]:
        (numbers, places), table = shared.value
        out: list[str] = []
        for part in _together(texts):
            grams, counts = packed_grams(texts[part], n)
            # many occurrences, few n-grams: each is looked up once
            distinct, which = np.unique(grams, return_inverse=True)
            at = np.zeros(len(distinct), np.int64)
            if len(numbers):
                near = np.minimum(np.searchsorted(numbers, distinct), len(numbers) - 1)
                at = np.where(numbers[near] == distinct, places[near], 0)
            sums = np.add.reduceat(table[at][which], np.cumsum(counts) - counts)
            out += [langs[i] for i in sums.argmax(1)]
        return out

    @F.pandas_udf("string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            result = pd.Series([None] * len(batch), dtype=object)
            given = batch.notna().to_numpy()
            texts = batch[given].tolist()
            result[given] = [best(t) for t in texts] if n > PACKED else together(texts)
            yield result

    return predict


def _number(gram: str, n: int) -> int:
    """An n-gram as ``packed_grams`` numbers it."""
    number = 0
    for k in range(n):
        number = number << CODE_BITS | (ord(gram[k]) + 1 if k < len(gram) else 0)
    return number
