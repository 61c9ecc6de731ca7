"""Training order: a keyed permutation gives every sequence its slot, and slots fill fixed-stride shards."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.packing import SEQUENCE_TOKENS, public_path, token_ids
from tandem.session import shared_folder

ROUNDS, SHARD_SEQUENCES, KEY = 6, 4096, 20
_ROWS = 200


def _rounds(key: int) -> np.ndarray:
    return np.random.default_rng(key).integers(1, 1 << 63, ROUNDS, dtype=np.uint64)


def feistel(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    """Permutation of the numbers of ``2 * half`` bits: each round mixes one half into the other."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in keys:
        mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        left, right = right, left ^ (mixed >> np.uint64(64 - half) & mask)
    return left << np.uint64(half) | right


def slots(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slot of each index, both in ``0 .. n - 1``: the permutation is walked until it lands there, at most four steps on average."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    keys, out = _rounds(key), feistel(index.astype(np.uint64), half, _rounds(key))
    while (far := out >= np.uint64(n)).any():
        out[far] = feistel(out[far], half, keys)
    return out.astype(np.int64)


def short_ids(ids: np.ndarray) -> bytes:
    """Little-endian 16-bit ids; larger ids are refused."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError(f"id {int(ids.max())} does not fit into 16 bits")
    return ids.astype("<u2").tobytes()


def record(ids: np.ndarray, tokens: int) -> bytes:
    """The ids of a sequence, filled up with the closing id."""
    return short_ids(ids).ljust(2 * tokens, b"\0")


def _sequences(docs: DataFrame, path: str, tokens: int) -> DataFrame:
    """``doc_id, start, length, ids`` of every sequence, as the table is read; the last one of a document may be short."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), _ROWS):
                found = []
                for doc_id, text in zip(batch["doc_id"].iloc[low : low + _ROWS], batch["text"].iloc[low : low + _ROWS]):
                    ids = token_ids(text, path)
                    for start in range(0, len(ids), tokens):
                        part = ids[start : start + tokens]
                        found.append((None if pd.isna(doc_id) else int(doc_id), start, len(part), short_ids(part)))
                frame = pd.DataFrame(found, columns=["doc_id", "start", "length", "ids"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, start long, length long, ids binary")


def write_training_order(docs: DataFrame, folder: str | None = None, key: int = KEY, shard_sequences: int = SHARD_SEQUENCES,
                         path: str | None = None, tokens: int = SEQUENCE_TOKENS) -> str:
    """Write the sequences of all documents in training order and return the folder.

    A document's ids, its closing id included, are cut into sequences of ``tokens``, the last one filled up with the
    closing id. Sequences are numbered as the table is read; the permutation of these numbers is the slot.
    Slots ``k * shard_sequences`` and following are ``shard=k``: one file, sorted, each record the same number of bytes
    (16-bit ids, little-endian), so a reader finds slot ``s`` at record ``s % shard_sequences`` of shard
    ``s // shard_sequences`` and goes on from there after a break.

    Sequences are written once with their places, so numbers stay the same however Spark cuts the table when it reads
    it again; this costs one copy of all ids, compressed and without the closing ids that fill sequences up: those are
    added as a shard is written. A shard is written by one task.

    Defined results: a null or empty text is one sequence of closing ids; repeated rows are sequences of their own;
    an empty table writes no shard; other columns are not read.
    """
    path, spark = path or public_path(), docs.sparkSession
    folder = folder or shared_folder(spark, "training-order")
    numbered = _sequences(docs, path, tokens).withColumn("_place", F.monotonically_increasing_id())
    places = shared_folder(spark, "sequences")
    numbered.write.option("compression", "zstd").parquet(places)
    stored = spark.read.schema(numbered.schema).parquet(places)
    # the upper bits of a place name the task that wrote it, the lower ones count from 0 there
    counts = {r["part"]: r["n"] for r in stored.groupBy(F.shiftright("_place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [counts.get(k, 0) for k in range(max(counts, default=-1) + 1)]
    n, starts = sum(sizes), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @F.pandas_udf("long")
    def slot(place: pd.Series) -> pd.Series:
        at = place.to_numpy(np.int64)
        return pd.Series(slots(starts[at >> 33] + (at & ((1 << 33) - 1)), n, key))

    placed = stored.select("doc_id", "start", "length", "ids", slot("_place").alias("slot"))
    shards = max(1, -(-n // shard_sequences))
    sharded = placed.withColumn("shard", F.floor(F.col("slot") / shard_sequences).cast("long"))
    ordered = sharded.repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", "slot")
    filled = ordered.withColumn("ids", F.expr(f"rpad(ids, {2 * tokens}, X'00')"))
    filled.write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    return folder


def read_training_order(spark, folder: str, from_slot: int = 0, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """``doc_id, start, length, ids, slot, shard`` of the written shards, from a slot on.

    A run that broke off goes on at ``from_slot``: shards before it are not opened, records before it in its shard are
    skipped by the file's own statistics. ``shard_sequences`` must be that of the writer.
    """
    schema = "doc_id long, start long, length long, ids binary, slot long, shard long"
    stored = spark.read.schema(schema).parquet(folder)
    return stored.where((F.col("shard") >= from_slot // shard_sequences) & (F.col("slot") >= from_slot)) if from_slot else stored


def training_order(docs: DataFrame, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY) -> DataFrame:
    """``slot, shard, record, doc_id, start, length, ids_crc32`` of every sequence, from the shards as written."""
    stored = read_training_order(docs.sparkSession, write_training_order(docs, key=key, shard_sequences=shard_sequences))
    return stored.select("slot", "shard", (F.col("slot") % shard_sequences).alias("record"), "doc_id", "start", "length",
                         F.crc32("ids").alias("ids_crc32"))


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u2").tobytes())
