"""From found files to checked bitext: find, count, turn round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators.pairing import failed_pairs, orient, reconcile_counts, resolve_pair_source
from tandem.operators.planning import split_pair
from tandem.sources.text import align_sides


def checked_bitext(src: DataFrame, tgt: DataFrame, wanted: DataFrame | None = None,
                   skip: tuple[str, ...] = ("ns",)) -> tuple[DataFrame, DataFrame]:
    """Bitext of the pairs whose sides have as many lines as each other, and the failed pairs with the reason.

    ``src`` has ``pair, line_no, src`` and ``tgt`` has ``pair, line_no, tgt``, under the name the files have. A
    ``wanted`` pair (``pair, src_lang, tgt_lang``) that was only found the other way round is turned; without a
    list every found pair is wanted and none is skipped. The joins with pairs are with one row per pair.
    """
    counts = reconcile_counts(src, tgt)
    found = counts.select("pair", F.col("pair").alias("path"))
    if wanted is None:
        a, b = split_pair(F.col("pair"))
        wanted, skip = found.select("pair", a.alias("src_lang"), b.alias("tgt_lang")), ()
    resolved = resolve_pair_source(wanted, found, skip)
    named = resolved.join(counts.select(F.col("pair").alias("path"), "status"), "path").select("pair", "status")
    failed = failed_pairs(wanted, resolved, named)
    good = resolved.join(failed, "pair", "left_anti").select("pair", "src_lang", "tgt_lang", "path", "inversed")
    rows = align_sides(src.select("pair", "line_no", "src"), tgt.select("pair", "line_no", "tgt")).withColumnRenamed("pair", "path")
    return orient(rows.join(F.broadcast(good), "path")).select("pair", "src_lang", "tgt_lang", "line_no", "src", "tgt"), failed
