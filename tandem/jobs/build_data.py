"""Check and clean bitext files, learn subwords and write training shards.

spark-submit -m tandem.jobs.build_data --bitext 'in/*/*' (or --archives 'zips/*.zip') --out out [--histogram hist.parquet]
"""

from __future__ import annotations

import argparse

from tandem.operators import subword as s
from tandem.operators.unigram import unigram_vocabulary
from tandem.plans.clean import CleanConfig, clean_corpus, stage_counts, with_length_counts
from tandem.plans.dataset import DatasetConfig, learn_subwords, shards_of, trimmed_pieces
from tandem.plans.intake import checked_bitext
from tandem.session import build_session, staged
from tandem.sources import sinks
from tandem.sources.archive import read_archive_bitext
from tandem.sources.text import read_pair_list, read_sides


def main(argv: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser()
    source = cli.add_mutually_exclusive_group(required=True)
    source.add_argument("--bitext", help="glob of {src}-{tgt}.{lang} files")
    source.add_argument("--archives", help="glob of {src}-{tgt}.zip archives")
    cli.add_argument("--out", required=True)
    cli.add_argument("--pairs", help="text file of comma-separated wanted pairs; every found pair if absent")
    cli.add_argument("--histogram", help="Parquet of lang, ch, keep; computed from the text if absent")
    cli.add_argument("--vocab-size", type=int, default=s.VOCAB_SIZE)
    cli.add_argument("--subwords", choices=["bpe", "unigram"], default=DatasetConfig.mode)
    cli.add_argument("--shards", type=int, default=DatasetConfig.n_shards)
    cli.add_argument("--min-lines", type=int, default=DatasetConfig.min_lines)
    cli.add_argument("--sample", type=int, help="random sentences the subwords are learned from; all if absent")
    cli.add_argument("--seed", type=int, default=CleanConfig.seed)
    args = cli.parse_args(argv)
    spark = build_session("build-data")
    wanted = read_pair_list(spark, args.pairs) if args.pairs else None
    if args.archives:
        raw, failed = read_archive_bitext(spark, args.archives, wanted)
    else:
        raw, failed = checked_bitext(*read_sides(spark, args.bitext), wanted)
    failed.write.mode("overwrite").parquet(f"{args.out}/failed")
    raw = staged(raw, "checked")
    histogram = spark.read.schema("lang string, ch string, keep boolean").parquet(args.histogram) if args.histogram else None
    cfg = CleanConfig(seed=args.seed)
    sinks.write_bitext(clean_corpus(raw, cfg, histogram), f"{args.out}/clean")
    clean = spark.read.parquet(f"{args.out}/clean")
    learned = learn_subwords(clean, args.vocab_size, args.sample, args.seed, args.subwords)
    dictionary = None
    if args.subwords == "unigram":
        vocabulary = unigram_vocabulary(spark, learned)
        vocabulary.write.mode("overwrite").parquet(f"{args.out}/vocabulary")
        dictionary = s.build_dictionary(vocabulary)
    else:
        ranked = [(i, a, b) for i, (a, b) in enumerate(learned, 1)]
        spark.createDataFrame(ranked, "rank int, left string, right string").write.mode("overwrite").parquet(f"{args.out}/merges")
    data = DatasetConfig(mode=args.subwords, n_shards=args.shards, min_lines=args.min_lines, seed=args.seed)
    pieces = trimmed_pieces(clean, learned, data)
    counts = with_length_counts(stage_counts(raw, cfg, histogram), pieces)
    counts.write.mode("overwrite").parquet(f"{args.out}/counts")
    sinks.write_shards(shards_of(pieces, dictionary, args.vocab_size, data), f"{args.out}/shards")


if __name__ == "__main__":
    main()
