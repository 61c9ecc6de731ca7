"""Writers. Every write is spread over bounded blocks, never one task per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators.numbering import range_block


def write_bitext(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by pair; a large pair is written by as many tasks as it has blocks."""
    (df.repartition(F.col("pair"), range_block(F.col("line_no")))
     .write.mode(mode).partitionBy("pair").parquet(path))


def write_side_text(df: DataFrame, side: str, path: str, mode: str = "overwrite") -> None:
    """One text line per row of one side, in line order across the part files of a pair."""
    ordered = df.repartitionByRange("pair", "line_no").sortWithinPartitions("pair", "line_no")
    ordered.select("pair", F.col(side).alias("value")).write.mode(mode).partitionBy("pair").text(path)


def write_shards(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by shard and pair: a reader of one shard prunes all others."""
    (df.repartition(F.col("shard"), F.col("pair"), range_block(F.col("line_no")))
     .write.mode(mode).partitionBy("shard", "pair").parquet(path))


def append_results(df: DataFrame, path: str) -> None:
    """Append ``checkpoint, metric, src_lang, tgt_lang, score`` rows to the results table."""
    df.write.mode("append").partitionBy("checkpoint", "metric").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read one of the tables above with a stated schema: nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The appended results, one row per checkpoint, metric and direction: the score written last."""
    keys = ["checkpoint", "metric", "src_lang", "tgt_lang"]
    stored = spark.read.schema("checkpoint string, metric string, src_lang string, tgt_lang string, score double").parquet(path)
    written = stored.select(*keys, F.struct("_metadata.file_modification_time", "_metadata.file_path", "score").alias("_s"))
    return written.groupBy(*keys).agg(F.max("_s")["score"].alias("score"))


def write_lang_list(dim: DataFrame, path: str) -> None:
    dim.coalesce(1).sortWithinPartitions("idx").select("lang").write.mode("overwrite").text(path)


def write_pair_list(pairs: DataFrame, path: str) -> None:
    """All pairs on one comma-separated line, by ``ord``. A list of directions, not data."""
    items = F.array_sort(F.collect_list(F.struct("ord", "pair")))
    line = pairs.agg(F.array_join(F.transform(items, lambda x: x["pair"]), ",").alias("value"))
    line.write.mode("overwrite").text(path)


def export_matrix(matrix: DataFrame, path: str) -> None:
    """A pivoted score table as one CSV sheet with a header."""
    matrix.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
