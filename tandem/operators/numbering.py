"""Dense row numbers within a group, for groups of any size.

A window over the whole group would put a group holding a third of the data into
one task. Instead rows are cut into blocks that are ordered like the rows and
small by construction; block sizes give each block its start, and only a block is
ever sorted in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 18
SPAN_BLOCKS = 1 << 12


def range_block(number: Column, rows: int = BLOCK_ROWS) -> Column:
    """Block of a unique number: holds at most ``rows`` rows."""
    return F.floor(number / F.lit(rows)).cast("long")


def hash_block(md5_hex: Column, digits: int = 4) -> Column:
    """Block of a uniformly spread hash; 16**digits blocks per group."""
    return F.conv(F.substring(md5_hex, 1, digits), 16, 10).cast("long")


def block_starts(df: DataFrame, group: list[str], block: str, levels: int = 1) -> DataFrame:
    """Rows before each block of its group (``block_start``), in it (``block_rows``) and in the whole group (``group_rows``).

    With two ``levels``, numeric blocks are first summed in spans of ``SPAN_BLOCKS``: a
    group whose row numbers have gaps, and therefore many small blocks, is then not
    summed in one task either. One level does where the number of blocks is bounded.
    """
    sizes = df.groupBy(*group, block).agg(F.count(F.lit(1)).alias("block_rows"))

    def before(rows: str, part: list[str], order: str) -> Column:
        earlier = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(rows).over(earlier), F.lit(0))

    def total(rows: str) -> Column:
        return F.sum(rows).over(Window.partitionBy(*group))

    if levels == 1:
        return sizes.select("*", before("block_rows", group, block).alias("block_start"), total("block_rows").alias("group_rows"))
    sizes = sizes.withColumn("_span", F.floor(F.col(block) / SPAN_BLOCKS))
    spans = sizes.groupBy(*group, "_span").agg(F.sum("block_rows").alias("_span_rows"))
    spans = spans.select(*group, "_span", before("_span_rows", group, "_span").alias("_span_start"), total("_span_rows").alias("group_rows"))
    inside = sizes.withColumn("_inside", before("block_rows", [*group, "_span"], block))
    return inside.join(spans, [*group, "_span"]).select(
        *group, block, "block_rows", (F.col("_span_start") + F.col("_inside")).alias("block_start"), "group_rows")


def number_rows(df: DataFrame, group: list[str], order: list[str], block: Column, name: str = "row_idx",
                levels: int = 2, total: str | None = None) -> DataFrame:
    """Add the 0-based position of each row within its group, and as ``total`` the rows of the group.

    ``block`` must grow with ``order``, and ``order`` must be unique in a group.
    ``levels=2`` needs a numeric block. Group columns must not be null. ``df`` is read twice, so it must be
    deterministic; the second read needs only the key columns.
    """
    keyed = df.withColumn("_nr_block", block)
    starts = block_starts(keyed, group, "_nr_block", levels).select(
        *group, "_nr_block", F.col("block_start").alias("_nr_start"), *([F.col("group_rows").alias(total)] if total else []))
    inside = Window.partitionBy(*group, "_nr_block").orderBy(*order)
    return (
        keyed.withColumn("_nr_pos", F.row_number().over(inside) - 1)
        .join(starts, [*group, "_nr_block"])
        .withColumn(name, F.col("_nr_start") + F.col("_nr_pos"))
        .drop("_nr_block", "_nr_pos", "_nr_start")
    )
