"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.tables import count_words
from tandem.session import staged

#: Hexadecimal digits of the hash a document is placed by, and digits a level resolves.
HASH_DIGITS, LEVEL_DIGITS = 15, 3
ABOVE_ALL = "g"


def place(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Hash that orders the documents of a source; rows equal in id and text share it and stay together."""
    shown = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(F.col(text), F.lit("")))
    return F.substring(F.md5(shown.cast("binary")), 1, HASH_DIGITS)


def source_key(source: str = "source") -> Column:
    """Not null, and ordered like the sources by code point with null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """``_key, source_size, target``: one row per source.

    The weights go round over the sorted sources. All targets add up to the size of the corpus; a target
    stops at ``repeats`` times its source and the excess is shared again by weight. Sources sorted by
    how soon they stop make that one pass: the level the rest reaches is the largest of
    (what is left) / (weights left). The windows see one row per source.
    """
    totals = sized.groupBy("_key").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy("_key")) - 1) % len(weights) + 1
    ranked = totals.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn))
    ranked = ranked.withColumn("_cap", F.col("source_size") * repeats)
    soonest = Window.orderBy(F.col("_cap") / F.col("_weight"), "_key")
    earlier = soonest.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
    weight_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(earlier), F.lit(0))
    levels = ranked.withColumn("_level", left / weight_left)
    level = F.max("_level").over(everything)
    return levels.select(
        "_key", "source_size", F.least(F.col("_cap").cast("double"), level * F.col("_weight")).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame, exact_rows: int = 4096) -> DataFrame:
    """``_key, source_size, target, _times, _until``: whole repeats, and the hash below which a document is taken once more.

    The words of a source are summed by hash bucket. Buckets in order fill what is left of the target
    until one does not fit; only the documents in that bucket are looked at again, by finer buckets,
    until every source has at most ``exact_rows`` of them (or no digits are left), which are
    then summed hash by hash. A growing target only raises the threshold, so mixes are nested.
    The document at the edge is taken if that comes nearer to the target. ``sized`` is read twice.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = staged(targets.withColumn("_times", times), "mix-targets")
    left = plan.select("_key", (F.col("target") - F.col("_times") * F.col("source_size")).alias("_left"))
    candidates, digits, bounds = sized.select("_key", "_place", "size"), LEVEL_DIGITS, None
    while True:
        last = digits >= HASH_DIGITS
        buckets = candidates.groupBy("_key", F.substring("_place", 1, digits).alias("_bucket")).agg(F.sum("size").alias("_words"))
        before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        filled = buckets.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).join(left, "_key")
        reach = F.col("_before") + (F.col("_words") / 2 if last else F.col("_words"))
        edge = filled.where(reach > F.col("_left")).groupBy("_key").agg(
            F.min(F.struct("_bucket", (F.col("_left") - F.col("_before")).alias("_left"))).alias("_edge"))
        edge = staged(edge.select("_key", "_edge._bucket", "_edge._left"), "mix-edge")
        if last:
            # where the last bucket is taken to its end, the threshold lies behind it
            ends = bounds.select("_key", F.concat("_bucket", F.lit(ABOVE_ALL)).alias("_end"))
            found = ends.join(edge, "_key", "left").select("_key", F.coalesce("_bucket", "_end").alias("_until"))
            return plan.join(found, "_key", "left").withColumn("_until", F.coalesce("_until", F.lit(ABOVE_ALL)))
        bounds = edge
        inside = candidates.join(edge, "_key").where(F.substring("_place", 1, digits) == F.col("_bucket"))
        candidates = staged(inside.select("_key", "_place", "size"), "mix-candidates")
        left = edge.select("_key", "_left")
        most = candidates.groupBy("_key").count().agg(F.max("count")).first()[0] or 0
        digits = HASH_DIGITS if most <= exact_rows else digits + LEVEL_DIGITS


def sized_documents(docs: DataFrame) -> DataFrame:
    """The documents with ``_key``, ``_place`` and ``size`` beside their own columns."""
    return docs.withColumns({"_key": source_key(), "_place": place(), "size": count_words(F.col("text"))})


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3,
                keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``size, source_size, target, times, taken`` for every document.

    ``times`` says how often the mix holds the document, ``taken`` its words times that. The threshold
    search runs on a written table of ids, hashes and sizes; nothing is sorted and no text is shuffled.

    Defined results: a null text has no words; a null source is a source, the last one; empty texts are
    taken as their hash says, at most ``repeats`` times, and weigh nothing; equal rows are taken alike; an empty table gives an
    empty mix; columns of the input named like results are not read.
    """
    sized = sized_documents(docs.select(*dict.fromkeys(["doc_id", "text", "source"])))
    narrow = staged(sized.select("_key", "_place", "size", "doc_id"), "mix-sizes")
    plan = staged(thresholds(narrow, source_targets(narrow, weights, repeats)), "mix-plan")
    rows = narrow if keep == ("doc_id",) else sized_documents(docs.select(*dict.fromkeys([*keep, "doc_id", "text", "source"])))
    # a source at its limit has nothing left for one more turn, so its documents without words get none either
    times = F.least(F.col("_times") + F.when(F.col("_place") < F.col("_until"), 1).otherwise(0), F.lit(repeats))
    mixed = rows.join(plan, "_key").withColumn("times", times.cast("long"))
    return mixed.select(*keep, "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15) AS place
  FROM documents),
totals AS (SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
ranked AS (
  SELECT k, source_size, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
          / ((sum(weight) OVER ())::DOUBLE
             - coalesce(sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) AS level
  FROM ranked),
targets AS (SELECT k, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
repeated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM targets),
alike AS (SELECT k, place, sum(size)::BIGINT AS words FROM sized GROUP BY k, place),
filled AS (
  SELECT k, place, words, coalesce(sum(words) OVER (PARTITION BY k ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM alike),
taken AS (SELECT k, place, before + words / 2 <= target - times * source_size AS once_more FROM filled JOIN repeated USING (k))
SELECT doc_id, size, source_size, target, least(times + once_more::INT, 3) AS times, size * least(times + once_more::INT, 3) AS taken
FROM sized JOIN repeated USING (k) JOIN taken USING (k, place)
"""
