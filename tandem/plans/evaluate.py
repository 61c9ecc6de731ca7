"""From generation logs to the overview report, all directions together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators import metrics as m
from tandem.operators import planning as p
from tandem.operators import records as r
from tandem.operators import report as rep
from tandem.operators import subword as s
from tandem.session import staged


@dataclass(frozen=True)
class SegmentScorer:
    """A segment scorer, loaded inside the workers, and the languages it knows (all if not given)."""

    load: Callable[[], Any]
    score: Callable[[Any, pd.DataFrame], pd.Series]
    langs: list[str] | None = None


@dataclass(frozen=True)
class Detector:
    """A language model of ``metrics.train_langid`` and its languages, in the order of its columns."""

    model: DataFrame
    langs: list[str]


def aligned(log: DataFrame, detokenized: bool = False) -> DataFrame:
    """``pair, src_lang, tgt_lang, sample_id, src, hyp, ref`` of a log (``pair, line_no, line``)."""
    parts = F.split("pair", "-")
    rows = r.align_hyp_ref(r.parse_records(log)).withColumns({"src_lang": parts[0], "tgt_lang": parts[1]})
    if detokenized:
        rows = m.detokenize(m.detokenize(rows, ("src",), "src_lang"), ("hyp", "ref"), "tgt_lang")
    return rows


def _known(rows: DataFrame, langs: list[str], cols: list[str]) -> DataFrame:
    return p.supported_only(rows, rows.sparkSession.createDataFrame([(x,) for x in langs], "lang string"), cols)


def direction_scores(rows: DataFrame, merges: list[tuple[str, str]] | None = None, swap_roles: bool = False,
                     scorer: SegmentScorer | None = None, detector: Detector | None = None) -> DataFrame:
    """``metric, src_lang, tgt_lang, score``: BLEU, chrF++ and, if asked for, a segment scorer's mean and the off-target ratio.

    BLEU is over the pieces of a subword model (``spbleu``), or over words (``bleu``) if no ``merges`` are
    given. ``swap_roles`` scores the reference against the hypothesis in these two. The segment scorer (``comet``) takes
    the directions of which it knows both languages, the detector (``offtarget``) those whose target it knows;
    other directions have no such score. All metrics read one written copy of the aligned rows.
    """
    rows = staged(rows, "aligned")
    mode, name = ("word", "bleu") if merges is None else ("bpe", "spbleu")
    keys = ["src_lang", "tgt_lang"]
    encoded = s.encode_pieces(rows, {"hyp": "hyp_pieces", "ref": "ref_pieces"}, mode, merges)
    bleu = m.corpus_bleu(encoded, keys, "hyp_pieces", "ref_pieces", swap_roles=swap_roles)
    chrf = m.chrf(rows, keys, swap_roles=swap_roles)
    found = [(name, bleu, "bleu"), ("chrf", chrf, "chrf")]
    if scorer is not None:
        known = rows if scorer.langs is None else _known(rows, scorer.langs, keys)
        found.append(("comet", m.system_score(known, scorer.load, scorer.score, keys), "score"))
    if detector is not None:
        known = _known(rows, detector.langs, ["tgt_lang"])
        found.append(("offtarget", m.offtarget_ratio(m.detect_language(known, detector.model, detector.langs, keys, text="hyp"), keys), "ratio"))
    scores = [df.select(F.lit(metric).alias("metric"), *keys, F.col(column).alias("score")) for metric, df, column in found]
    for more in scores[1:]:
        scores[0] = scores[0].unionByName(more)
    return scores[0]


def overview(scores: DataFrame, dim: DataFrame, extra: DataFrame, families: list[str], hub_family: str) -> DataFrame:
    """One row per metric with every mean of the overview, rounded to two decimals."""
    return rep.overview_bar(rep.report(scores, dim, extra), rep.overview_labels(families, hub_family))


def benchmark_report(matrix: DataFrame, hub: str | int, classes: DataFrame, limited: DataFrame | None = None) -> DataFrame:
    """``metric, label, score`` of a hub-centred benchmark: the hub overview, the means of the resource classes (``a2b``) and their marginals
    (``~2b``, ``a2~``). ``limited`` (``metric, lang``) names the languages of metrics that do not know all. A mean without cells is null."""
    hubs = rep.hub_overview(matrix, hub)
    labels = [c for c in hubs.columns if c != "metric"]
    means = rep.class_means(matrix, classes, limited)
    cells = means.select("metric", F.concat("src_class", F.lit("2"), "tgt_class").alias("label"), "score")
    return hubs.unpivot(["metric"], labels, "label", "score").unionByName(cells).unionByName(rep.class_marginals(means))
