"""Text sources: numbered lines, aligned bitext, lists, logs, parallel sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.sources.numbered import numbered_text

_PAIR_FILE = r"([A-Za-z_]+)-([A-Za-z_]+)\.([A-Za-z_]+)(?:\.[a-z0-9]+)?$"


def read_bitext(spark: SparkSession, src_path: str, tgt_path: str, pair: str) -> DataFrame:
    """Two line-aligned files as ``pair, src_lang, tgt_lang, line_no, src, tgt``; stops at the shorter."""
    src_lang, tgt_lang = pair.split("-")
    src = numbered_text(spark, src_path).select("line_no", F.col("value").alias("src"))
    tgt = numbered_text(spark, tgt_path).select("line_no", F.col("value").alias("tgt"))
    return align_sides(
        src.withColumn("pair", F.lit(pair)), tgt.withColumn("pair", F.lit(pair))
    ).select("pair", F.lit(src_lang).alias("src_lang"), F.lit(tgt_lang).alias("tgt_lang"), "line_no", "src", "tgt")


def read_sides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of every ``{src}-{tgt}.{lang}`` file below a glob, in one scan over all pairs."""
    lines = numbered_text(spark, path).select(*_file_names(F.col("path")), "line_no", "value")
    src = lines.where(F.col("lang") == F.col("src_lang")).select("pair", "src_lang", "tgt_lang", "line_no", F.col("value").alias("src"))
    return src, lines.where(F.col("lang") == F.col("tgt_lang")).select("pair", "line_no", F.col("value").alias("tgt"))


def read_bitext_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every ``{src}-{tgt}.{lang}`` file below a glob as bitext; a pair stops at its shorter side."""
    src, tgt = read_sides(spark, path)
    return align_sides(src, tgt).select("pair", "src_lang", "tgt_lang", "line_no", "src", "tgt")


def _file_names(path: Column) -> list[Column]:
    src, tgt = F.regexp_extract(path, _PAIR_FILE, 1), F.regexp_extract(path, _PAIR_FILE, 2)
    return [
        F.concat_ws("-", src, tgt).alias("pair"), src.alias("src_lang"), tgt.alias("tgt_lang"),
        F.regexp_extract(path, _PAIR_FILE, 3).alias("lang"),
    ]


def align_sides(src: DataFrame, tgt: DataFrame, tasks: int | None = None) -> DataFrame:
    """Zip two numbered sides: inner, so surplus lines of the longer side drop out.

    ``tasks`` deals both sides into so many tasks; without it the session says how many, however long the sides are.
    """
    keys = ["pair", "line_no"]
    if tasks:
        src, tgt = src.repartition(tasks, *keys), tgt.repartition(tasks, *keys)
    return src.join(tgt, keys)


def read_parallel_set(spark: SparkSession, path: str) -> DataFrame:
    """``{split}.{lang}`` files of an N-way parallel set as ``split, sent_id, lang, text``."""
    lines = numbered_text(spark, path)
    name = r"([^/.]+)\.([^/.]+)$"
    return lines.select(
        F.regexp_extract("path", name, 1).alias("split"), F.col("line_no").alias("sent_id"),
        F.regexp_extract("path", name, 2).alias("lang"), F.col("value").alias("text"),
    )


def read_lang_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("lang")).where("lang <> ''")


def read_pair_list(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated pairs as ``ord, src_lang, tgt_lang, pair``; ``ord`` counts within the line."""
    items = spark.read.text(path).select(F.posexplode(F.split("value", ",")).alias("pos", "pair")).where("pair <> ''")
    parts = F.split("pair", "-")
    return items.select((F.col("pos") + 1).alias("ord"), parts[0].alias("src_lang"), parts[1].alias("tgt_lang"), "pair")


def read_generation_log(spark: SparkSession, path: str) -> DataFrame:
    """``pair, line_no, line`` of ``{src}-{tgt}.raw.txt`` logs."""
    return numbered_text(spark, path).select(
        F.regexp_extract("path", r"([^/]+)\.raw\.txt$", 1).alias("pair"), "line_no", F.col("value").alias("line")
    )


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """``checkpoint, metric, line_no, line`` of ``{checkpoint}.{metric}`` logs."""
    name = r"([^/]+)\.([a-z]+)$"
    return numbered_text(spark, path).select(
        F.regexp_extract("path", name, 1).alias("checkpoint"), F.regexp_extract("path", name, 2).alias("metric"),
        "line_no", F.col("value").alias("line"),
    )
