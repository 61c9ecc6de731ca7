"""Token-id array expressions: one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.fixed_values import PAD


def tag_ids(tag: Column, ids: Column) -> Column:
    return F.concat(F.array(tag), ids)


def strip_pad(ids: Column, pad: int = PAD) -> Column:
    return F.filter(ids, lambda x: x != pad)


def register_count(ids: Column, factor: float = 1.0, pad: int = PAD) -> Column:
    """One register per ``factor`` real tokens, rounded up."""
    return F.ceil(F.size(strip_pad(ids, pad)) / F.lit(float(factor))).cast("int")


def append_registers(ids: Column, factor: float = 1.0, pad: int = PAD) -> Column:
    """Append copies of the largest id: language tags are numbered after the vocabulary."""
    return F.concat(ids, F.array_repeat(F.array_max(ids), register_count(ids, factor, pad)))


def left_pad(ids: Column, width: Column, pad: int = PAD) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), width - F.size(ids)), ids)


def pad_mask(ids: Column, pad: int = PAD) -> Column:
    return F.transform(ids, lambda x: x == pad)


def set_decoder_start(prev: Column, src: Column) -> Column:
    """The last source token replaces the first decoder token."""
    return F.concat(F.array(F.element_at(src, -1)), F.slice(prev, 2, F.greatest(F.size(prev) - 1, F.lit(0))))


def segments(n_pad: Column, n_src: Column, n_reg: Column, n_tgt: Column) -> Column:
    """0 pad, 1 source, 2 register, 3 target: the attention rules need nothing else."""
    return F.concat(
        F.array_repeat(F.lit(0), n_pad), F.array_repeat(F.lit(1), n_src),
        F.array_repeat(F.lit(2), n_reg), F.array_repeat(F.lit(3), n_tgt),
    )
