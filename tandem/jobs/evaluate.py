"""Score generation logs and write the scores and the overview table.

spark-submit -m tandem.jobs.evaluate --logs 'results/ck/*.raw.txt' --checkpoint ck --out out [--detokenize] [--swap-roles]
spark-submit -m tandem.jobs.evaluate --arrivals results --out out
... [--scorer MODULE] [--detector-text PARQUET] [--benchmark]
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem import fixed_values as fv
from tandem.operators import metrics as m
from tandem.operators import planning as p
from tandem.operators import report as r
from tandem.plans.evaluate import Detector, SegmentScorer, aligned, benchmark_report, direction_scores, overview
from tandem.session import build_session, staged
from tandem.sources import sinks
from tandem.sources.text import read_generation_log
from tandem.streaming.arrivals import read_committed, score_arrivals


def main(argv: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser()
    source = cli.add_mutually_exclusive_group(required=True)
    source.add_argument("--logs", help="glob of the {src}-{tgt}.raw.txt logs of --checkpoint")
    source.add_argument("--arrivals", help="folder of {checkpoint}/{src}-{tgt}.raw.txt; only logs not scored before are")
    cli.add_argument("--checkpoint", help="with --logs")
    cli.add_argument("--out", required=True)
    cli.add_argument("--detokenize", action="store_true")
    cli.add_argument("--swap-roles", action="store_true")
    cli.add_argument("--merges", help="Parquet of rank, left, right; words are scored if absent")
    cli.add_argument("--scorer", help="importable module with load() and score(model, batch of src, hyp, ref)")
    cli.add_argument("--detector-text", help="Parquet of lang, text the language detector learns from")
    cli.add_argument("--benchmark", action="store_true", help="report the hub-centred benchmark of 41 languages by resource class")
    args = cli.parse_args(argv)
    if args.logs and not args.checkpoint:
        cli.error("--logs needs --checkpoint")
    spark = build_session("evaluate")
    merges = None
    if args.merges:
        table = spark.read.schema("rank int, left string, right string").parquet(args.merges)
        # bounded by the vocabulary size
        merges = [(x["left"], x["right"]) for x in table.orderBy("rank").collect()]
    models = {"scorer": load_scorer(args.scorer, args.benchmark), "detector": train_detector(spark, args.detector_text, args.benchmark)}
    if args.arrivals:
        score_arrivals(spark, args.arrivals, f"{args.out}/scores", f"{args.out}/state", merges, args.detokenize, args.swap_roles, **models)
        stored = read_committed(spark, f"{args.out}/scores")
    else:
        rows = aligned(read_generation_log(spark, args.logs), args.detokenize)
        scores = direction_scores(rows, merges, args.swap_roles, **models)
        sinks.append_results(scores.withColumn("checkpoint", F.lit(args.checkpoint)), f"{args.out}/scores")
        stored = sinks.read_results(spark, f"{args.out}/scores").where(F.col("checkpoint") == args.checkpoint)
    stored = staged(stored, "scores")
    # one row per checkpoint
    for row in stored.select("checkpoint").distinct().orderBy("checkpoint").collect():
        export = export_benchmark if args.benchmark else export_report
        export(stored.where(F.col("checkpoint") == row["checkpoint"]).drop("checkpoint"), args.out, row["checkpoint"])


def load_scorer(module: str | None, benchmark: bool) -> SegmentScorer | None:
    if module is None:
        return None
    found = importlib.import_module(module)
    return SegmentScorer(found.load, found.score, fv.SCORER_LANGUAGES if benchmark else None)


def train_detector(spark: SparkSession, path: str | None, benchmark: bool) -> Detector | None:
    """Of the languages the text has; in the benchmark only of those its detector supports."""
    if path is None:
        return None
    texts = spark.read.schema("lang string, text string").parquet(path)
    # one row per language
    langs = sorted(r["lang"] for r in texts.where("lang IS NOT NULL").select("lang").distinct().collect())
    if benchmark:
        langs = [x for x in fv.DETECTOR_LANGUAGES if x in langs]
    if not langs:
        raise ValueError(f"{path} has no text of a supported language")
    return Detector(m.train_langid(texts, langs), langs)


def export_benchmark(scores: DataFrame, out: str, checkpoint: str) -> None:
    """Report by resource class and score matrix of the 41 languages; the scorer's and the detector's cells without a known language are left out."""
    spark, langs = scores.sparkSession, fv.BENCHMARK_LANGUAGES
    matrix = staged(r.dense_matrix(scores, p.language_dim(spark, {"benchmark": langs}, [], langs[0])), "matrix")
    classes = spark.createDataFrame([(x, c) for c, group in fv.RESOURCE_CLASSES.items() for x in group], "lang string, class string")
    limits = {"comet": fv.SCORER_LANGUAGES, "offtarget": fv.DETECTOR_LANGUAGES}
    limited = spark.createDataFrame([(metric, x) for metric, known in limits.items() for x in known], "metric string, lang string")
    sinks.export_matrix(benchmark_report(matrix, langs[0], classes, limited).orderBy("metric", "label"), f"{out}/benchmark/{checkpoint}")
    sinks.export_matrix(r.score_matrix(matrix, langs), f"{out}/matrix/{checkpoint}")


def export_report(scores: DataFrame, out: str, checkpoint: str) -> None:
    """The overview bar and the score matrix of one checkpoint."""
    spark = scores.sparkSession
    dim = p.language_dim(spark, fv.LANGUAGE_FAMILIES, fv.BRIDGES, fv.HUB)
    families = list(fv.LANGUAGE_FAMILIES)
    bar = overview(scores, dim, p.extra_pairs(spark, fv.EXTRA_PAIRS), families, families[0])
    sinks.export_matrix(bar, f"{out}/overview/{checkpoint}")
    langs = [x for group in fv.LANGUAGE_FAMILIES.values() for x in group]
    sinks.export_matrix(r.score_matrix(r.dense_matrix(scores, dim), langs), f"{out}/matrix/{checkpoint}")


if __name__ == "__main__":
    main()
