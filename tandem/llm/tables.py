"""Reading the given tables, and small helpers several operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.session import staged

#: White space as the contracts define it; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column) -> Column:
    """Words of a text; a null text has none. The possessive quantifier spares the matcher its way back."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


@dataclass
class Sample:
    """Labelled texts, and the share of label 1 among all labelled documents, which the sample does not keep to."""

    texts: list[bytes]
    labels: list[int]
    share: float


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, held_out: Column) -> Sample:
    """At most ``rows`` labelled documents, up to half of them of either label, and about ``chars`` characters; the same ones on every run.

    Labels that are null or that ``held_out`` (over ``doc_id``) marks are left out; of several labels of a
    document the largest counts. The ids come from the narrow label table in hash order, so text is
    only read for the chosen ones: the broadcast is of ``rows`` ids. Both bounds hold at every corpus
    size; documents are taken whole, see ``within_bound``.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("_label"))
    halves = [known.where(F.col("_label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for v in (0, 1)]
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(halves[0].union(halves[1])), "doc_id")
    # one text of each document id; in an order that has nothing to do with them, until the character bound
    one = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label"))
    one = staged(one.withColumn("_n", F.length("text")), "labelled")
    sizes = sorted(one.select("doc_id", "_n", "_label", F.hash("doc_id").alias("_h")).collect(), key=lambda r: (r["_h"], r["doc_id"]))
    kept = within_bound([(r["doc_id"], r["_n"], r["_label"]) for r in sizes], chars)
    picked = sorted((r["doc_id"], r["text"], r["_label"]) for r in one.where(F.col("doc_id").isin(kept)).collect()) if kept else []
    share = known.agg(F.avg("_label")).first()[0]
    return Sample([t.encode("utf-8", "replace") for _, t, _ in picked], [v for _, _, v in picked], 0.5 if share is None else float(share))


def within_bound(sizes: list[tuple[int, int, int]], chars: int) -> set[int]:
    """Of ``doc_id, characters, label`` in the given order, the ids that fit into ``chars``; what does not fit is passed over.

    Each label may fill half of the bound, then what the other left is filled up. A label none of whose documents
    fits keeps its shortest one, so no label is lost to the bound.
    """
    kept, used = {}, {0: 0, 1: 0}
    for doc_id, n, label in sizes:
        if used[label] + n <= chars // 2:
            kept[doc_id] = label
            used[label] += n
    left = chars - sum(used.values())
    for doc_id, n, label in sizes:
        if doc_id not in kept and n <= left:
            kept[doc_id] = label
            left -= n
    for label in {label for *_, label in sizes} - set(kept.values()):
        kept[min((n, k, d) for k, (d, n, v) in enumerate(sizes) if v == label)[2]] = label
    return set(kept)


def trained(spark: SparkSession, fit: Callable, sample: Sample):
    """The model ``fit(texts, labels, share)`` makes of a bounded sample, in one task, where numerical libraries keep to one core."""
    shared = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            model = fit(shared.value.texts, shared.value.labels, shared.value.share)
            yield pd.DataFrame({"model": [pickle.dumps(model)]})

    return pickle.loads(spark.range(0, 1, 1, 1).mapInPandas(run, "model binary").first()["model"])


def held_out_fold(doc_id: Column) -> Column:
    """The fold whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
