"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tandem.llm import bpe, embeddings, licenses, mixing, ordering, packing, pii, quality, runs, simhash, spelling, toxicity, warc
from tandem.llm.tables import held_out_fold, read_table


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read_table(spark, sf_dir, "documents"))
    # label:first word:end word:edits of every notice
    told = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(
        ":", s["label"], s["first_word"].cast("string"), s["end_word"].cast("string"), s["edits"].cast("string"))))
    return found.withColumn("spans", told)


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out_fold(F.col("doc_id")).alias("held_out"), "score", "predicted")


def training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.training_order(read_table(spark, sf_dir, "documents"))


def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive_records(read_table(spark, sf_dir, "pages"))


def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.scan_pii(docs, pii.train_pii(docs))


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read_table(spark, sf_dir, "embeddings"))


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.rate_quality(docs, quality.train_quality(docs, read_table(spark, sf_dir, "labels")))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(read_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.word_runs(read_table(spark, sf_dir, "documents"), runs.altered))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mix,
    "op2_license_scan": license_scan,
    "op3_simhash_near_dedup": simhash_near_dedup,
    "op4_toxicity": toxicity_scores,
    "op5_training_order": training_order,
    "op6_pii": pii_scan,
    "op7_embedding_near_dedup": embedding_near_dedup,
    "op8_warc_derivatives": warc_derivatives,
    "op9_packing": pack,
    "op10_quality_rules": quality_rules,
    "op11_spelling_variants": spelling_variants,
    "op12_bpe_codec": bpe_codec,
    "op13_periodic_runs": periodic_runs,
}

ORACLES: dict[str, str] = {"op1_mix_sources": mixing.MIX_SQL}
