"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.session import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node each node of an edge reaches; ``edges`` has long columns ``a`` and ``b``.

    Each round hangs neighbours on the smallest one they share: first those above a node, then those
    below it. Minima are combined before the shuffle and the joins are plain equi-joins against one row
    per node, so a node with very many edges is dealt out by the skew handling. Every round is
    written to the shared folder; only two numbers per round come to the driver. It ends when a
    round changes nothing: every node then hangs on its root.
    """
    state = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _mark(state)
    while seen[0]:
        both = state.union(state.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("_m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                               F.col("_m").alias("b"))
        state = staged(small.distinct(), "edges")
        now = _mark(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(state: DataFrame) -> tuple:
    row = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
