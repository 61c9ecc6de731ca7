"""Reports over direction scores: ``metric, src_lang, tgt_lang, score``.

All tables here are dimensions: languages, directions, metrics, checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.fixed_values import METRIC_KEYS
from tandem.functions.text import round2
from tandem.operators.planning import all_directions


def parse_metric_log(df: DataFrame, langs: list[str] | None = None, keys: dict[str, tuple[str, int]] = METRIC_KEYS) -> DataFrame:
    """Scores of metric logs (``checkpoint, metric, line_no, line``).

    A short line with a hyphen names the direction of the lines after it; a line with
    the metric's word carries the score in a ':'-separated field, up to a comma. The
    last score of a direction wins. With ``langs``, other languages are left out.
    """
    text = F.trim("line")
    is_pair = F.contains(text, F.lit("-")) & (F.length(text) < 8)
    word = F.create_map(*[F.lit(v) for m, (w, _) in keys.items() for v in (m, w)])[F.col("metric")]
    field = F.create_map(*[F.lit(v) for m, (_, f) in keys.items() for v in (m, f)])[F.col("metric")]
    log = Window.partitionBy("checkpoint", "metric").orderBy("line_no")
    so_far = log.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = df.withColumn("_pair", F.last(F.when(is_pair, text), ignorenulls=True).over(so_far))
    value = F.split(F.get(F.split(text, ":"), field - 1), ",")[0]
    parts = F.split("_pair", "-")
    scored = placed.where(F.contains(text, word) & F.col("_pair").isNotNull()).select(
        "checkpoint", "metric", parts[0].alias("src_lang"), parts[1].alias("tgt_lang"),
        F.trim(value).try_cast("double").alias("_value"), "line_no",
    )
    if langs is not None:
        scored = scored.where(F.col("src_lang").isin(langs) & F.col("tgt_lang").isin(langs))
    return scored.groupBy("checkpoint", "metric", "src_lang", "tgt_lang").agg(
        round2(F.max_by("_value", "line_no")).alias("score")
    )


def dense_matrix(scores: DataFrame, dim: DataFrame) -> DataFrame:
    """Every direction of every metric; a missing score becomes 0, ``missing`` tells which."""
    metrics = scores.agg(F.collect_set("metric")).scalar()
    grid = all_directions(dim).select("src_lang", "tgt_lang", F.explode(metrics).alias("metric"))
    return grid.join(scores, ["metric", "src_lang", "tgt_lang"], "left").select(
        "metric", "src_lang", "tgt_lang", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("score").isNull().alias("missing")
    )


def safe_mean(score: Column, missing: Column | None = None, skip: bool = False) -> Column:
    """Mean, 0 without rows. Missing directions count as 0 unless ``skip``."""
    value = F.when(~missing, score) if skip and missing is not None else score
    return F.coalesce(F.avg(value), F.lit(0.0))


def _with_dim(matrix: DataFrame, dim: DataFrame, *cols: str) -> DataFrame:
    for side in ("src", "tgt"):
        named = dim.select(F.col("lang").alias(f"{side}_lang"), *[F.col(c).alias(f"{side}_{c}") for c in cols])
        matrix = matrix.join(named, f"{side}_lang")
    return matrix


def supervision_split(matrix: DataFrame, dim: DataFrame, extra: DataFrame | None = None, skip_missing: bool = False) -> DataFrame:
    """``metric, label, n, score`` for supervised, zero and averaged.

    Supervised: a bridge on either side, or an extra pair in either order.
    """
    rows = _with_dim(matrix, dim, "is_bridge")
    label = F.col("src_is_bridge") | F.col("tgt_is_bridge")
    if extra is not None:
        both = extra.select("src_lang", "tgt_lang").unionByName(
            extra.select(F.col("tgt_lang").alias("src_lang"), F.col("src_lang").alias("tgt_lang"))
        ).distinct().withColumn("_extra", F.lit(True))
        rows = rows.join(both, ["src_lang", "tgt_lang"], "left")
        label = label | F.coalesce("_extra", F.lit(False))
    rows = rows.withColumn("label", F.when(label, "supervised").otherwise("zero"))
    sets = rows.groupingSets([["metric", "label"], ["metric"]], "metric", "label")
    return sets.agg(F.count(F.lit(1)).alias("n"), safe_mean(F.col("score"), F.col("missing"), skip_missing).alias("score")).select(
        "metric", F.coalesce("label", F.lit("averaged")).alias("label"), "n", "score"
    )


def trained_flag(matrix: DataFrame, trained: DataFrame) -> DataFrame:
    """``trained``: the direction is in the training list; narrower than supervised."""
    listed = trained.select("src_lang", "tgt_lang").distinct().withColumn("trained", F.lit(True))
    return matrix.join(listed, ["src_lang", "tgt_lang"], "left").withColumn("trained", F.coalesce("trained", F.lit(False)))


def family_means(matrix: DataFrame, dim: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Means by family pair (``A2B``), by source (``A2x``), by target (``x2A``) and over all (``x2x``)."""
    rows = _with_dim(matrix, dim, "family", "is_hub")
    rows = rows.select("metric", F.col("src_family").cast("string").alias("sf"), F.col("tgt_family").cast("string").alias("tf"), "score", "missing")
    sets = rows.groupingSets([["metric", "sf", "tf"], ["metric", "sf"], ["metric", "tf"], ["metric"]], "metric", "sf", "tf")
    x = F.lit("x")
    return sets.agg(F.count(F.lit(1)).alias("n"), safe_mean(F.col("score"), F.col("missing"), skip_missing).alias("score")).select(
        "metric", F.concat(F.coalesce("sf", x), F.lit("2"), F.coalesce("tf", x)).alias("label"), "n", "score"
    )


def overview_labels(families: list[str], hub_family: str) -> list[str]:
    """The fixed column order of the overview row."""
    out = ["supervised", "zero", "averaged"]
    for f in families:
        out += [f"{f}2x", f"x2{f}"]
    return out + [f"{a}2{b}" for a in families for b in families if not (a == b == hub_family)]


def overview_bar(means: DataFrame, labels: list[str], digits2: bool = True) -> DataFrame:
    """One row per metric, one column per label in the given order; labels without rows give 0."""
    wide = means.groupBy("metric").pivot("label", labels).agg(F.first("score"))
    value = (lambda c: round2(c)) if digits2 else (lambda c: c)
    return wide.select("metric", *[value(F.coalesce(F.col(f"`{x}`"), F.lit(0.0))).alias(x) for x in labels])


def score_matrix(matrix: DataFrame, langs: list[str]) -> DataFrame:
    """Source by target sheet per metric; zero cells stay blank."""
    return matrix.groupBy("metric", "src_lang").pivot("tgt_lang", langs).agg(F.first(F.nullif("score", F.lit(0.0))))


def nonzero_mean(score: Column, keep_zero: bool = False) -> Column:
    return F.avg(score if keep_zero else F.when(score != 0, score))


def hub_overview(matrix: DataFrame, hub, keep_zero: bool = False) -> DataFrame:
    """Hub-out, hub-in, their mean, the block without the hub, and all; means over non-zero cells."""
    s, src, tgt = F.col("score"), F.col("src_lang") == hub, F.col("tgt_lang") == hub
    means = matrix.groupBy("metric").agg(
        nonzero_mean(F.when(src, s), keep_zero).alias("hub2m"), nonzero_mean(F.when(tgt, s), keep_zero).alias("m2hub"),
        nonzero_mean(F.when(~src & ~tgt, s), keep_zero).alias("zero"), nonzero_mean(s, keep_zero).alias("averaged"),
    )
    return means.select("metric", "hub2m", "m2hub", ((F.col("hub2m") + F.col("m2hub")) / 2).alias("supervised"), "zero", "averaged")


def class_means(matrix: DataFrame, classes: DataFrame, supported: DataFrame | None = None, require_both: bool = False) -> DataFrame:
    """``metric, src_class, tgt_class, n, score``.

    ``supported`` (``metric, lang``) limits the metrics it names: a cell is left out when
    neither language is supported, or already when one is not with ``require_both``.
    """
    rows = _with_dim(matrix, classes, "class")
    if supported is not None:
        limited = supported.select("metric").distinct().withColumn("_limited", F.lit(True))
        rows = rows.join(limited, "metric", "left")
        for side in ("src", "tgt"):
            named = supported.select("metric", F.col("lang").alias(f"{side}_lang"), F.lit(True).alias(f"_{side}_ok"))
            rows = rows.join(named, ["metric", f"{side}_lang"], "left")
        a, b = F.coalesce("_src_ok", F.lit(False)), F.coalesce("_tgt_ok", F.lit(False))
        rows = rows.where(F.col("_limited").isNull() | ((a & b) if require_both else (a | b)))
    return rows.groupBy("metric", "src_class", "tgt_class").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))


def class_marginals(means: DataFrame, n_classes: int = 4) -> DataFrame:
    """Unweighted means of the class means by target (``~2c``) and by source (``c2~``); an absent class mean counts as 0."""
    by_tgt = means.groupBy("metric", F.concat(F.lit("~2"), "tgt_class").alias("label")).agg((F.sum("score") / n_classes).alias("score"))
    by_src = means.groupBy("metric", F.concat("src_class", F.lit("2~")).alias("label")).agg((F.sum("score") / n_classes).alias("score"))
    return by_tgt.unionByName(by_src)


def report(scores: DataFrame, dim: DataFrame, extra: DataFrame | None = None, skip_missing: bool = False) -> DataFrame:
    """``metric, label, n, score`` of the whole overview, every metric in one pass over the matrix."""
    matrix = dense_matrix(scores, dim)
    return supervision_split(matrix, dim, extra, skip_missing).unionByName(family_means(matrix, dim, skip_missing))


# Checkpoints -------------------------------------------------------------------------------------


def checkpoint_update(name: Column) -> Column:
    """Update number of ``checkpoint_{epoch}_{update}.pt``; null for any other name."""
    return F.element_at(F.split(name, "[_.]"), -2).try_cast("long")


def select_checkpoints(df: DataFrame, mode: str, averaged: str = "checkpoint_1_averaged.pt") -> DataFrame:
    """``all`` numbered checkpoints and the averaged one, ``averaged`` only, or the one with the given id."""
    if mode == "all":
        return df.where(F.col("name").rlike(r"^checkpoint_[^_]*_.*\.pt$"))
    if mode == "averaged":
        return df.where(F.col("name") == averaged)
    chosen = df.where(F.col("name") == f"checkpoint_{mode}.pt")
    if chosen.isEmpty():
        raise ValueError(f"checkpoint {mode} does not exist")
    return chosen


def skip_measured(df: DataFrame, measured: DataFrame) -> DataFrame:
    return df.join(measured.select("name").distinct(), "name", "left_anti")


def last_k(df: DataFrame, k: int = 5) -> DataFrame:
    """The k checkpoints with the largest update numbers; names without a number never count."""
    numbered = df.withColumn("update_no", checkpoint_update(F.col("name"))).where(F.col("update_no").isNotNull())
    return numbered.orderBy(F.desc("update_no"), "name").limit(k)


def vector_blocks(df: DataFrame, vector: str = "params", size: int = 1 << 16, name: str = "block") -> DataFrame:
    """``block`` (or another ``name``) and that part of the vector: with ``block`` among the keys a mean never gathers more than ``size`` elements in a row.

    A null or empty vector has no blocks.
    """
    last = F.floor((F.size(vector) - 1) / size).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias(name), F.slice(vector, i * size + 1, F.lit(size)).alias("_part")))
    rest = [c for c in df.columns if c != vector]
    return df.where(F.size(vector) > 0).select(*rest, F.inline(blocks)).withColumnRenamed("_part", vector)


def _block_sums(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each element as a number, zero where it is null, and whether it counts."""
    return values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)


def _grown(buffer: np.ndarray, size: int) -> np.ndarray:
    return buffer if len(buffer) >= size else np.concatenate([buffer, np.zeros(size - len(buffer), buffer.dtype)])


def _add(held: dict, key: tuple, sums: np.ndarray, counts: np.ndarray) -> None:
    if key not in held:
        held[key] = [sums.copy(), counts.copy()]
        return
    for own, more in zip((0, 1), (sums, counts)):
        grown = held[key][own] = _grown(held[key][own], len(more))
        grown[: len(more)] += more


def average_blocks(df: DataFrame, keys: list[str], vector: str = "params", size: int = 1 << 16, held_elements: int = 1 << 22,
                   name: str = "block") -> DataFrame:
    """Element-wise means per group, ``size`` elements a row: ``keys, block`` and that part of the mean.

    A task adds the parts of its vectors in numpy buffers and hands on one row per key and block, at the latest when it holds ``held_elements``; the
    partial sums of a block then meet sorted, and are added as they come. So no element is a row of its own, and no task holds more than its buffers or one
    block, however long a vector is and however many there are of a key.

    Null elements do not count, and a place no vector of the group fills is null; shorter vectors count where they are; a null or empty vector has no blocks.
    """
    cut = vector_blocks(df.select(*keys, vector), vector, size, name)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    names = [*keys, name]

    def rows(held: dict, schema: list[pa.DataType], closing: bool) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(schema)]
        if closing:
            ((sums, counts),) = held.values()
            mean = pa.array(sums / np.maximum(counts, 1), mask=counts == 0)
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(mean)], pa.int32()), mean)], names=[*names, vector])
        sums, counts = (pa.array([x[i].tobytes() for x in held.values()], pa.binary()) for i in (0, 1))
        return pa.RecordBatch.from_arrays([*columns, sums, counts], names=[*names, "_sums", "_counts"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        schema: list[pa.DataType] = []
        elements = 0
        for batch in batches:
            schema = [batch.schema.field(i).type for i in range(len(names))]
            places = list(zip(*(batch.column(i).to_pylist() for i in range(len(names)))))
            for row, key in enumerate(places):
                part = batch.column(len(names))[row].values
                elements += len(part) if key not in held else 0
                _add(held, key, *_block_sums(part))
                if elements >= held_elements:
                    yield rows(held, schema, False)
                    held, elements = {}, 0
        if held:
            yield rows(held, schema, False)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        schema: list[pa.DataType] = []
        for batch in batches:
            schema = [batch.schema.field(i).type for i in range(len(names))]
            places = list(zip(*(batch.column(i).to_pylist() for i in range(len(names)))))
            for row, key in enumerate(places):
                if held and key not in held:
                    yield rows(held, schema, True)
                    held = {}
                sums, counts = (np.frombuffer(batch.column(len(names) + i)[row].as_py(), kind) for i, kind in ((0, np.float64), (1, np.int64)))
                _add(held, key, sums, counts)
        if held:
            yield rows(held, schema, True)

    summed = cut.select(*names, vector).mapInArrow(partial, f"{kinds}, `{name}` int, _sums binary, _counts binary")
    sorted_ = summed.repartition(*names).sortWithinPartitions(*names)
    return sorted_.mapInArrow(total, f"{kinds}, `{name}` int, `{vector}` array<double>")


def average_vectors(df: DataFrame, keys: list[str], vector: str = "params") -> DataFrame:
    """Element-wise mean of arrays per group as one row a group; for vectors that do not fit into one, ``average_blocks``."""
    blocks = average_blocks(df, keys, vector, name="_block")
    rows = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", vector))).alias("_v"))
    return rows.select(*keys, F.flatten(F.transform("_v", lambda x: x[vector])).alias(vector))
