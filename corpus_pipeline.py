"""A corpus pipeline of five stages; each takes the documents the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import mixing, packing, pii, simhash, toxicity
from tandem.llm.tables import read_table
from tandem.session import staged

#: No SQL can express the network's scores; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose highest window score stays below the limit; the network learns from the labels outside the held-out fold."""
    model = toxicity.train_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest id."""
    return simhash.deduplicate(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` counts the new text. No document goes."""
    return pii.redact(docs, pii.train_pii(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    columns = docs.columns
    whole = F.struct(*[F.col(c) for c in columns]).alias("_doc")
    mixed = mixing.mix_sources(docs.select(whole, "doc_id", "text", "source"), keep=("_doc",))
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_turn")
    return mixed.where("times > 0").select("_doc", repeats).select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as sequences of tokens, one row per piece."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("personal data", redact_private),
    ("mix", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written once and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
