"""SimHash near-duplicates found by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.graph import connected_components
from tandem.session import shuffled, staged

BITS, DISTANCE, SHINGLE_WORDS, SEED = 64, 3, 3, 42
#: Members of an index entry that one task compares; larger entries are cut into blocks that meet pair by pair.
BLOCK = 4_096
_PART = 100_000


def fingerprint(text: str | None) -> int:
    """64 bits: one is set if it is in over half the hashes of the word shingles, repeats included.

    A-Z is lowered. Fewer words than a shingle has are one shingle; no words give zero.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _PART):
        part = words[at : min(at + _PART, n) + SHINGLE_WORDS - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(SHINGLE_WORDS)])) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprints as signed longs."""
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


def near_edges(values: np.ndarray, others: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all distinct values within the distance: a spanning forest, not the pairs.

    Each value in turn meets the rest at once. A value whose component already holds everything it meets is
    skipped, so a tight group takes few turns. ``others`` gives links between two lists; links within
    each list are then found where that list meets itself.
    """
    if others is None and len(values) == 2:
        a, b = int(values[0]), int(values[1])
        return [(a, b)] if (a ^ b).bit_count() <= DISTANCE else []
    own = values if others is None else np.concatenate([values, others])
    label, links = np.arange(len(own)), []
    first = 0 if others is None else len(values)
    for i in range(len(values)):
        low = max(first, i + 1)
        rest = np.flatnonzero(label[low:] != label[i]) + low
        if not len(rest):
            continue
        near = rest[np.bitwise_count(own[rest] ^ own[i]) <= DISTANCE]
        for other in np.unique(label[near]):
            j = near[label[near] == other][0]
            links.append((i, int(j)))
        if len(near):
            label[np.isin(label, label[near])] = label[i]
    return [(int(own[a]), int(own[b])) for a, b in links]


def variants(values: DataFrame) -> DataFrame:
    """``fp, entry``: index entries of each fingerprint.

    Three differing bits over two halves leave one half with at most one. Each half therefore enters the index
    32 times, once with each of its bits deleted; halves that differ in at most one bit share
    the entry that lacks it. Half, deleted bit and the other bits make up the entry.
    """
    half = F.explode(F.expr("sequence(0, 1)")).alias("_half")
    bit = F.explode(F.expr("sequence(0, 31)")).alias("_bit")
    halves = values.select("fp", half).select(
        "fp", "_half", F.expr("shiftrightunsigned(fp, 32 * _half) & 4294967295").alias("_part")).select("*", bit)
    left = F.expr("_part & ~shiftleft(1L, _bit)")
    return halves.select("fp", F.expr("shiftleft(CAST(32 * _half + _bit AS BIGINT), 32)").bitwiseOR(left).alias("entry"))


def fingerprint_links(values: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: verified links that connect what is within the distance; ``values`` has distinct ``fp``.

    Entries with one member are dropped after a count that combines before its shuffle. The rest are
    compared entry by entry, after a shuffled join, as a fingerprint has 64 entries; an entry with over
    ``block`` members is dealt by hash into blocks and every two blocks meet in a task of their own, so
    no task holds more than two blocks.
    """
    indexed = variants(values)
    shared = indexed.groupBy("entry").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    members = indexed.join(shuffled(shared), "entry")
    n_blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), n_blocks).cast("int")
    dealt = members.select("entry", "fp", n_blocks.alias("_blocks"), own.alias("_own"))
    meets = F.explode(F.expr("sequence(0, _blocks - 1)")).alias("_other")
    met = dealt.select("entry", "fp", "_own", meets).select(
        "entry", "fp", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> list[tuple[int, int]]:
            rows = np.concatenate(held)
            if len(rows) < 2:
                return []
            fps, sides = rows[:, 0].copy().view(np.uint64), rows[:, 1]
            if key[1] == key[2]:
                return near_edges(np.unique(fps))
            low = sides == key[1]
            return near_edges(np.unique(fps[low]), np.unique(fps[~low])) if low.any() and not low.all() else []

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            entry, fp, side, i, j = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
            if not len(entry):
                continue
            cuts = np.flatnonzero((np.diff(entry) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            found: list[tuple[int, int]] = []
            for low, high in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(entry)]])):
                now = (entry[low], i[low], j[low])
                if key is not None and now != key:
                    found += links()
                    held = []
                key = now
                held.append(np.stack([fp[low:high], side[low:high]], 1))
            yield batch_of(found)
        if held:
            yield batch_of(links())

    ordered = met.repartition("entry", "_i", "_j").sortWithinPartitions("entry", "_i", "_j")
    found = ordered.select("entry", "fp", "_own", "_i", "_j").mapInArrow(compare, "a long, b long")
    return found.distinct()


def _rooted(marked: DataFrame) -> DataFrame:
    """``fp, root, _first``: each fingerprint of the rows, that of its component, and the smallest id that has it."""
    classes = staged(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("_first")), "classes")
    roots = connected_components(fingerprint_links(classes.select("fp")))
    return classes.join(shuffled(roots), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "_first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document.

    Equal fingerprints collapse to one before anything is compared, so groups of copies cost one row;
    texts are read once and never shuffled. ``component_id`` is the smallest ``doc_id`` that links reach.

    Defined results: null and empty texts have fingerprint zero and are linked like any other; rows with a null
    id take part and get the smallest id of their component, null only if it has none; repeated rows share a
    component; an empty table gives no rows; other columns are not read.
    """
    marked = staged(docs.select("doc_id", fingerprints("text").alias("_fp")), "fingerprints")
    rooted = _rooted(marked)
    first = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(first, "root").select(F.col("fp").alias("_fp"), "component_id")
    shown = F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint")
    return marked.join(named, "_fp").select("doc_id", shown, "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents, one of each component: the one with the smallest id, null last, then the smallest hash of its columns.

    Components are found on ids, fingerprints and row hashes. The documents are shuffled once,
    by id and row hash, to meet the chosen ones; of rows equal in all columns one stays.
    """
    columns = docs.columns
    whole = F.struct(*[F.col(c) for c in columns])
    keyed = docs.select(whole.alias("_doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.md5(F.to_json(whole)).alias("_row"))
    marked = staged(keyed.select("_doc.doc_id", "_id", "_row", fingerprints("_doc.text").alias("_fp")), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_id", "_row")).alias("_best")
    by_print = marked.groupBy(F.col("_fp").alias("fp")).agg(best)
    chosen = by_print.join(shuffled(_rooted(marked)), "fp").groupBy("root").agg(F.min("_best").alias("_best"))
    chosen = staged(chosen.select("_best._id", "_best._row"), "chosen")
    return keyed.join(shuffled(chosen), ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).select("_doc.*")
