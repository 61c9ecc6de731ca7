"""Evaluation of generation logs as they arrive, with results that are committed a batch at a time."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators.report import skip_measured
from tandem.plans.evaluate import Detector, SegmentScorer, aligned, direction_scores
from tandem.session import staged
from tandem.sources.text import read_generation_log

LOG_FILE = r"([^/]+)/([^/]+)\.raw\.txt$"
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
RESULT = "checkpoint string, metric string, src_lang string, tgt_lang string, score double"


def commit_batch(df: DataFrame, path: str, batch: str) -> None:
    """Write the results of a batch as a whole: the same batch written again takes the place of what a broken run left."""
    df.select("checkpoint", "metric", "src_lang", "tgt_lang", "score").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def committed_batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of the batches whose write has ended; one that broke off has no closing mark and is not seen."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    marks = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    return sorted(m.getPath().getParent().toString() for m in (marks or []))


def read_committed(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """``checkpoint, metric, src_lang, tgt_lang, score`` of the committed batches, without batch ``but``; of several scores that written last counts."""
    folders = [f for f in committed_batches(spark, path) if but is None or not f.endswith(f"batch={but}")]
    if not folders:
        return spark.createDataFrame([], RESULT)
    keys = ["checkpoint", "metric", "src_lang", "tgt_lang"]
    rows = spark.read.schema(RESULT).parquet(*folders)
    written = rows.select(*keys, F.struct("_metadata.file_modification_time", "_metadata.file_path", "score").alias("_s"))
    return written.groupBy(*keys).agg(F.max("_s")["score"].alias("score"))


def score_arrivals(spark: SparkSession, folder: str, out: str, state: str, merges: list[tuple[str, str]] | None = None, detokenized: bool = False,
                   swap_roles: bool = False, files_per_batch: int = 1_000, after_write: Callable[[str], None] | None = None,
                   scorer: SegmentScorer | None = None, detector: Detector | None = None) -> int:
    """Score the logs ``{folder}/{checkpoint}/{src}-{tgt}.raw.txt`` that were not scored before; the number of batches it took.

    A file stream that takes what there is and ends: ``state`` remembers which files it has handed out in which batch. A run that dies is
    repeated with the same batch of the same files, and ``commit_batch`` replaces what it had written, so each direction has one row. Directions with
    scores in other committed batches are left out, so a lost ``state`` costs a listing, not a second evaluation.
    ``after_write(batch)`` runs between the write and the stream's own commit.

    Only paths of new files, at most ``files_per_batch``, come to the driver; a checkpoint and pair is scored from one file. An empty folder gives no batch.
    """
    taken = []
    arriving = (spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.raw.txt").option("recursiveFileLookup", "true")
                .option("maxFilesPerTrigger", str(files_per_batch)).load(folder).select("path"))

    def score(files: DataFrame, number: int) -> None:
        spark = files.sparkSession
        # numbers start anew with another state: the stream's own id keeps its batches apart from those of others
        batch = f"{json.loads(spark.read.text(f'{state}/metadata').first()['value'])['id']}-{number}"
        checkpoint, pair = (F.regexp_extract("path", LOG_FILE, k) for k in (1, 2))
        named = files.select("path", F.concat_ws("/", checkpoint, pair).alias("name"))
        measured = read_committed(spark, out, batch).select(F.concat("checkpoint", F.lit("/"), F.concat_ws("-", "src_lang", "tgt_lang")).alias("name"))
        paths = sorted(r["path"] for r in skip_measured(named, measured).collect())
        if not paths:
            return
        taken.append(batch)
        rows = [score_checkpoint(spark, name, own, merges, detokenized, swap_roles, scorer, detector) for name, own in _by_checkpoint(paths)]
        found = rows[0]
        for more in rows[1:]:
            found = found.unionByName(more)
        commit_batch(found, out, batch)
        if after_write is not None:
            after_write(batch)

    query = arriving.writeStream.foreachBatch(score).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(taken)


def _by_checkpoint(paths: list[str]) -> list[tuple[str, list[str]]]:
    groups: dict[str, list[str]] = {}
    for path in paths:
        groups.setdefault(path.rsplit("/", 2)[1], []).append(path)
    return sorted(groups.items())


def score_checkpoint(spark: SparkSession, checkpoint: str, paths: list[str], merges=None, detokenized: bool = False, swap_roles: bool = False,
                     scorer: SegmentScorer | None = None, detector: Detector | None = None) -> DataFrame:
    """The scores of one checkpoint's logs, written once: they are small, and the log is read once for them."""
    scores = direction_scores(aligned(read_generation_log(spark, paths), detokenized), merges, swap_roles, scorer, detector)
    return staged(scores.withColumn("checkpoint", F.lit(checkpoint)), "scores")
