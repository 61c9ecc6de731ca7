"""Availability of pairs and line-count checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_pair_source(wanted: DataFrame, available: DataFrame, skip: tuple[str, ...] = ("ns",)) -> DataFrame:
    """For each wanted pair the archive ``src-tgt``, else ``tgt-src`` marked inversed, else none.

    ``available`` has ``pair, path``. Pairs with a skipped language are left out.
    """
    wanted = wanted.where(~F.col("src_lang").isin(*skip) & ~F.col("tgt_lang").isin(*skip))
    forward = available.select("pair", F.col("path").alias("_forward"))
    inverse = available.select(F.col("pair").alias("_inv"), F.col("path").alias("_inverse"))
    return (
        wanted.join(forward, "pair", "left")
        .join(inverse, F.concat_ws("-", "tgt_lang", "src_lang") == F.col("_inv"), "left")
        .select(
            "pair", "src_lang", "tgt_lang", F.coalesce("_forward", "_inverse").alias("path"),
            (F.col("_forward").isNull() & F.col("_inverse").isNotNull()).alias("inversed"),
            (F.col("_forward").isNull() & F.col("_inverse").isNull()).alias("missing"),
        )
    )


def orient(df: DataFrame) -> DataFrame:
    """Swap the sides of rows read from an inversed archive."""
    return df.withColumns({
        "src": F.when(F.col("inversed"), F.col("tgt")).otherwise(F.col("src")),
        "tgt": F.when(F.col("inversed"), F.col("src")).otherwise(F.col("tgt")),
    })


def reconcile_counts(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Line counts of both sides per pair and whether they agree."""
    a = src.groupBy("pair").agg(F.count(F.lit(1)).alias("src_lines"))
    b = tgt.groupBy("pair").agg(F.count(F.lit(1)).alias("tgt_lines"))
    return a.join(b, "pair", "full_outer").select(
        "pair", F.coalesce("src_lines", F.lit(0)).alias("src_lines"), F.coalesce("tgt_lines", F.lit(0)).alias("tgt_lines"),
    ).withColumn("status", F.when(F.col("src_lines") == F.col("tgt_lines"), "ok").otherwise("mismatch"))


def failed_pairs(wanted: DataFrame, resolved: DataFrame, checked: DataFrame) -> DataFrame:
    """Wanted pairs that did not come through, with the reason: no source, not counted, or counts that differ.

    Pairs left out of ``resolved`` were skipped on purpose and have not failed.
    """
    reason = (F.when(F.col("missing"), "source missing").when(F.col("status").isNull(), "not counted")
              .otherwise("line counts differ"))
    tried = wanted.select("pair").join(resolved.select("pair", "missing"), "pair").join(checked.select("pair", "status"), "pair", "left")
    return tried.where(~F.col("status").eqNullSafe("ok")).select("pair", reason.alias("reason"))
