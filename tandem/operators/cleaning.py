"""Cleaning of bitext: ``pair, src_lang, tgt_lang, line_no, src, tgt``."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.fixed_values import PUNCTUATION
from tandem.functions.text import count_in_set, count_punct, strip
from tandem.operators.numbering import hash_block, number_rows

SEPARATOR = "\x01"


def strip_text(df: DataFrame, cols: tuple[str, ...] = ("src", "tgt")) -> DataFrame:
    return df.withColumns({c: strip(F.col(c)) for c in cols})


def punct_ok(col: Column, max_share: float = 0.5, charset: str = PUNCTUATION) -> Column:
    """Strictly under the share, so an empty text fails."""
    return count_punct(col, charset) < F.lit(max_share) * F.length(col)


def filter_overpunct(df: DataFrame, max_share: float = 0.5, cols: tuple[str, ...] = ("src", "tgt")) -> DataFrame:
    for c in cols:
        df = df.where(punct_ok(F.col(c), max_share))
    return df


def dedup_pairs(df: DataFrame) -> DataFrame:
    """Exact copies within a pair collapse to the first line.

    A hash aggregate: copies meet in the map-side part, so a line that fills a third
    of the data costs one row per task in the shuffle.
    """
    return df.groupBy("pair", "src_lang", "tgt_lang", "src", "tgt").agg(F.min("line_no").alias("line_no"))


def shuffle_key(seed: int | str, *cols: str) -> Column:
    """Reproducible uniform order. The line number keeps copies apart."""
    return F.md5(F.concat_ws(SEPARATOR, F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def shuffle(df: DataFrame, seed: int = 1) -> DataFrame:
    """Seeded random order per pair: a range-partitioned sort on a uniform key."""
    key = shuffle_key(seed, "pair", "line_no", "src", "tgt")
    return df.withColumn("_key", key).orderBy("pair", "_key", "line_no").drop("_key")


def shuffle_positions(df: DataFrame, seed: int = 1) -> DataFrame:
    """The same order as an explicit 0-based ``position`` column, for any later stage."""
    keyed = df.withColumn("_key", shuffle_key(seed, "pair", "line_no", "src", "tgt"))
    return number_rows(keyed, ["pair"], ["_key", "line_no"], hash_block(F.col("_key")), "position", 1).drop("_key")


# Character histograms -----------------------------------------------------------------------


#: Counts a task holds before it hands them on: far more than an alphabet has characters.
HELD_COUNTS = 1 << 20


def char_counts(df: DataFrame, by: tuple[str, ...] = ("lang",), text: str = "text") -> DataFrame:
    """``ch, cnt`` per group: each task counts the code points of its texts and hands on one row per group and character, not one per occurrence.

    A null or empty text has no characters.
    """
    names = [*by, "ch"]

    def rows(held: dict[tuple, Counter], kinds: list[pa.DataType]) -> pa.RecordBatch:
        found = [(*key, chr(point), n) for key, counts in held.items() for point, n in counts.items()]
        columns = list(zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [*kinds, pa.string(), pa.int64()])], names=[*names, "cnt"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = {}
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(by))]
            groups: dict[tuple, list[str]] = {}
            for *key, value in zip(*(batch.column(i).to_pylist() for i in range(len(by) + 1))):
                if value:
                    groups.setdefault(tuple(key), []).append(value)
            for key, texts in groups.items():
                points = np.bincount(np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4"))
                found = np.flatnonzero(points)
                held.setdefault(key, Counter()).update(dict(zip(found.tolist(), points[found].tolist())))
            if sum(map(len, held.values())) > HELD_COUNTS:
                yield rows(held, kinds)
                held = {}
        if held:
            yield rows(held, kinds)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)
    counted = df.select(*by, text).mapInArrow(count, f"{schema}, ch string, cnt long")
    return counted.groupBy(*names).agg(F.sum("cnt").alias("cnt"))


def build_char_histogram(df: DataFrame, coverage: float = 0.99, by: tuple[str, ...] = ("lang",), text: str = "text") -> DataFrame:
    """``ch, cnt, cum_share, keep`` per language; kept characters make up the first ``coverage`` of the text.

    Counted inside the tasks; the window then runs over distinct characters.
    """
    counts = char_counts(df, by, text)
    whole = Window.partitionBy(*by)
    ranked = whole.orderBy(F.desc("cnt"), "ch")
    running = F.sum("cnt").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("cnt").over(whole)
    # a character is kept while the characters before it are short of the coverage
    return counts.withColumns({"_run": running, "_all": total}).select(
        *by, "ch", "cnt", (F.col("_run") / F.col("_all")).alias("cum_share"),
        ((F.col("_run") - F.col("cnt")) < F.lit(coverage) * F.col("_all")).alias("keep"),
    )


def char_coverage(df: DataFrame, coverage: float = 1.0, text: str = "text") -> DataFrame:
    """The alphabet over all languages that covers the given share of characters."""
    one = df.withColumn("_all_text", F.lit(1))
    return build_char_histogram(one, coverage, ("_all_text",), text).drop("_all_text")


def accepted_sets(histogram: DataFrame) -> DataFrame:
    """One row per language: its accepted characters as one string (at most its alphabet)."""
    kept = histogram.where("keep").groupBy("lang").agg(F.array_sort(F.collect_list("ch")).alias("chs"))
    return kept.select("lang", F.array_join("chs", "").alias("accepted"))


def with_histogram_flag(df: DataFrame, histogram: DataFrame, threshold: float = 0.5, name: str = "hist_ok") -> DataFrame:
    """Flag rows whose accepted share reaches ``threshold`` on both sides. No language row: not accepted."""
    # bounded: one row per language, as wide as its alphabet. Without the broadcast the
    # text would be shuffled by language, where one language may be most of it
    sets = F.broadcast(accepted_sets(histogram))
    for side in ("src", "tgt"):
        df = df.join(sets.select(F.col("lang").alias(f"{side}_lang"), F.col("accepted").alias(f"_{side}_set")),
                     f"{side}_lang", "left")
    ok = F.lit(True)
    for side in ("src", "tgt"):
        share = count_in_set(F.col(side), F.coalesce(F.col(f"_{side}_set"), F.lit(""))) >= F.lit(threshold) * F.length(side)
        ok = ok & share & (F.length(side) > 0)
    return df.withColumn(name, ok).drop("_src_set", "_tgt_set")


def filter_by_histogram(df: DataFrame, histogram: DataFrame, threshold: float = 0.5) -> DataFrame:
    return with_histogram_flag(df, histogram, threshold, "_ok").where("_ok").drop("_ok")


def side_texts(df: DataFrame) -> DataFrame:
    """Both sides of bitext as ``lang, text``, one scan."""
    sides = F.array(
        F.struct(F.col("src_lang").alias("lang"), F.col("src").alias("text")),
        F.struct(F.col("tgt_lang").alias("lang"), F.col("tgt").alias("text")),
    )
    return df.select(F.inline(sides))


# Lengths --------------------------------------------------------------------------------------


def length_ok(lo: int = 1, hi: int = 250, src: str = "src_pieces", tgt: str = "tgt_pieces") -> Column:
    return F.size(src).between(lo, hi) & F.size(tgt).between(lo, hi)


def filter_length(df: DataFrame, lo: int = 1, hi: int = 250, src: str = "src_pieces", tgt: str = "tgt_pieces") -> DataFrame:
    return df.where(length_ok(lo, hi, src, tgt))


def ratio_ok(ratio: float = 3, src: str = "src_pieces", tgt: str = "tgt_pieces") -> Column:
    a, b = F.size(src), F.size(tgt)
    return F.greatest(a, b) <= F.lit(ratio) * F.least(a, b)


def filter_ratio(df: DataFrame, ratio: float = 3, src: str = "src_pieces", tgt: str = "tgt_pieces") -> DataFrame:
    return df.where(ratio_ok(ratio, src, tgt))


def filter_positions(df: DataFrame, n: int = 256, cols: tuple[str, ...] = ("src_ids", "tgt_ids")) -> DataFrame:
    for c in cols:
        df = df.where(F.size(c) <= n)
    return df
