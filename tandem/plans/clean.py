"""The cleaning chain over all pairs at once: the pair is a column, not a loop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators import cleaning as c
from tandem.session import shuffle_tasks, staged


@dataclass(frozen=True)
class CleanConfig:
    max_punct_share: float = 0.5
    coverage: float = 0.99
    threshold: float = 0.5
    seed: int = 1
    shuffled: bool = False
    #: Least number of tasks in which the deduplicated text meets; the session's own number if absent.
    tasks: int | None = None


def clean_corpus(df: DataFrame, cfg: CleanConfig = CleanConfig(), histogram: DataFrame | None = None) -> DataFrame:
    """Strip, drop over-punctuated pairs, deduplicate, (shuffle,) filter by histogram.

    Only the deduplication shuffles rows. Without a given ``histogram`` it is computed
    from the deduplicated text, which is written once so that the shuffle is not repeated.
    """
    kept = c.filter_overpunct(c.strip_text(df), cfg.max_punct_share)
    distinct = c.dedup_pairs(kept)
    if histogram is None:
        with shuffle_tasks(df.sparkSession, cfg.tasks):
            distinct = staged(distinct, "dedup")
        histogram = c.build_char_histogram(c.side_texts(distinct), cfg.coverage)
    out = c.filter_by_histogram(distinct, histogram, cfg.threshold)
    out = out.select("pair", "src_lang", "tgt_lang", "line_no", "src", "tgt")
    return c.shuffle(out, cfg.seed) if cfg.shuffled else out


def stage_counts(df: DataFrame, cfg: CleanConfig = CleanConfig(), histogram: DataFrame | None = None) -> DataFrame:
    """Rows per pair after each stage, counted in one pass over the deduplicated groups.

    Copies are counted inside the deduplicating aggregate, so rows before and after
    it come from the same shuffle.
    """
    stripped = c.strip_text(df).withColumn("punct_ok", c.punct_ok(F.col("src"), cfg.max_punct_share)
                                           & c.punct_ok(F.col("tgt"), cfg.max_punct_share))
    groups = stripped.groupBy("pair", "src_lang", "tgt_lang", "src", "tgt", "punct_ok").agg(F.count(F.lit(1)).alias("copies"))
    if histogram is None:
        with shuffle_tasks(df.sparkSession, cfg.tasks):
            groups = staged(groups, "groups")
        histogram = c.build_char_histogram(c.side_texts(groups.where("punct_ok")), cfg.coverage)
    flagged = c.with_histogram_flag(groups, histogram, cfg.threshold)
    return flagged.groupBy("pair").agg(
        F.sum("copies").alias("n_read"),
        F.sum(F.when(F.col("punct_ok"), F.col("copies")).otherwise(0)).alias("n_punct"),
        F.count_if("punct_ok").alias("n_dedup"),
        F.count_if(F.col("punct_ok") & F.col("hist_ok")).alias("n_clean"),
    )


def with_length_counts(counts: DataFrame, trimmed: DataFrame) -> DataFrame:
    """``n_length`` beside the other counts: rows per pair left after the length and ratio filters."""
    left = trimmed.groupBy("pair").agg(F.count(F.lit(1)).alias("n_length"))
    return counts.join(left, "pair", "left").withColumn("n_length", F.coalesce("n_length", F.lit(0)))
