"""From id sequences to the padded rows a decoder-only translation model reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.fixed_values import PAD
from tandem.functions import arrays as a

BATCH_KEYS = ("pair", "bucket", "batch")


def append_registers(df: DataFrame, factor: float = 1.0, pad: int = PAD) -> DataFrame:
    """``n_registers`` and ``src_reg``: the real source tokens followed by their registers."""
    real = a.strip_pad(F.col("src_ids"), pad)
    return df.withColumns({
        "n_registers": a.register_count(F.col("src_ids"), factor, pad),
        "src_reg": a.append_registers(real, factor, pad),
    })


def left_pad_batch(df: DataFrame, pad: int = PAD, keys: tuple[str, ...] = BATCH_KEYS) -> DataFrame:
    """``src_padded`` and ``pad_mask``: every row of a batch at source width plus the largest register count.

    A batch is bounded by its token budget, so its window group is small.
    """
    rows = Window.partitionBy(*keys)
    width = F.max(F.size("src_ids")).over(rows) + F.max("n_registers").over(rows)
    padded = df.withColumn("_width", width).withColumn("src_padded", a.left_pad(F.col("src_reg"), F.col("_width"), pad))
    return padded.withColumn("pad_mask", a.pad_mask(F.col("src_padded"), pad)).drop("_width")


def set_decoder_start(df: DataFrame, prev: str = "prev_ids", src: str = "src_reg") -> DataFrame:
    return df.withColumn(prev, a.set_decoder_start(F.col(prev), F.col(src)))


def strip_pad(df: DataFrame, cols: tuple[str, ...], pad: int = PAD) -> DataFrame:
    return df.withColumns({c: a.strip_pad(F.col(c), pad) for c in cols})


def concat_source_target(df: DataFrame) -> DataFrame:
    """``tokens, segment, loss_mask`` of one row: padded source, registers, then the decoder input."""
    n_pad = F.size("src_padded") - F.size("src_reg")
    n_src = F.size("src_reg") - F.col("n_registers")
    segment = a.segments(n_pad, n_src, F.col("n_registers"), F.size("prev_ids"))
    return df.withColumns({
        "tokens": F.concat("src_padded", "prev_ids"), "segment": segment,
    }).withColumn("loss_mask", F.transform("segment", lambda x: x == 3))
