"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.graph import connected_components
from tandem.session import staged

COSINE, GRID_DIMS, LEAF, BLOCK_ROWS, TILE = 0.95, 16, 256, 4096, 4
#: What rounding may do to a distance; far below the grid, far above the error of single precision.
MARGIN = 1e-4


def usable(embedding: str = "embedding"):
    """Not null, not zero, every component finite."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def unit_rows(column: pd.Series | np.ndarray) -> np.ndarray:
    """Vectors scaled to length one, in double precision; scaling by the largest component first avoids overflow."""
    x = np.stack([np.asarray(v, np.float64) for v in column])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _dtype(classes: DataFrame) -> str:
    """Single precision is kept as it is read; unit vectors are always made from it in double."""
    return "f4" if classes.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"


def principal_axes(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and leading principal axes for each vector length, from sums over all vectors.

    A task hands on its sums one matrix row at a time, and each row is summed over all tasks by itself; so nothing
    gathers the matrices of all tasks, and one matrix per vector length comes to the driver.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for size, rows in batch.groupby(batch["embedding"].map(len))["embedding"]:
                x = unit_rows(rows)
                n, s, c = held.get(size, (0, 0.0, 0.0))
                held[size] = (n + len(x), s + x.sum(0), c + x.T @ x)
        for size, (n, s, c) in held.items():
            yield pd.DataFrame({"dim": size, "axis": np.arange(size), "n": n, "s": s, "c": [row.tobytes() for row in c]})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(int(rows["dim"].iloc[0]))
        for row in rows["c"]:
            c += np.frombuffer(row)
        return pd.DataFrame([(rows["dim"].iloc[0], rows["axis"].iloc[0], rows["n"].sum(), rows["s"].sum(), c.tobytes())], columns=list(rows.columns))

    schema, axes = "dim int, axis int, n long, s double, c binary", {}
    made = classes.select("embedding").mapInPandas(sums, schema).groupBy("dim", "axis").applyInPandas(added, schema)
    whole = made.toPandas()
    for dim, rows in whole.groupby("dim"):
        rows = rows.sort_values("axis")
        n = rows["n"].iloc[0]
        mean, c = rows["s"].to_numpy() / n, np.stack([np.frombuffer(r) for r in rows["c"]])
        _, vectors = np.linalg.eigh(c / n - np.outer(mean, mean))
        axes[int(dim)] = (mean, np.ascontiguousarray(vectors[:, ::-1][:, :GRID_DIMS]))
    return axes


def _gap(low_a, high_a, low_b, high_b) -> float:
    """Squared distance between two boxes."""
    apart = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float((apart * apart).sum())


class IntervalJoin:
    """Counts and connecting links between two sorted runs of vectors.

    Runs are halved until they are small; two halves whose boxes on the leading axes are further apart
    than epsilon are skipped, and so is every pair whose distance on those axes alone is too large.
    What is left is decided by the cosine in double precision.
    """

    def __init__(self, epsilon: float, cosine: float):
        self.limit, self.cosine = (epsilon + MARGIN) ** 2, cosine
        self.links: list[tuple[int, int]] = []

    def join(self, a, b, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """``a`` and ``b``: (unit vectors, leading coordinates, copies). Links of each row, copies counted."""
        self.a, self.b, self.same = a, b, same
        self.n_a, self.n_b = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)
        self.label = {"a": np.arange(len(a[0])), "b": np.arange(len(b[0])) + len(a[0])}
        self._descend(0, len(a[0]), 0, len(b[0]))
        return self.n_a, self.n_b

    def _descend(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if self.same and b1 <= a0:
            return
        box_a, box_b = self.a[1][a0:a1], self.b[1][b0:b1]
        if _gap(box_a.min(0), box_a.max(0), box_b.min(0), box_b.max(0)) > self.limit:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            return self._leaf(a0, a1, b0, b1)
        halves_a = [(a0, a1)] if a1 - a0 <= LEAF else [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)]
        halves_b = [(b0, b1)] if b1 - b0 <= LEAF else [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)]
        for x in halves_a:
            for y in halves_b:
                self._descend(*x, *y)

    def _leaf(self, a0: int, a1: int, b0: int, b1: int) -> None:
        near = self.a[1][a0:a1], self.b[1][b0:b1]
        far = (near[0] ** 2).sum(1)[:, None] + (near[1] ** 2).sum(1)[None] - 2 * (near[0] @ near[1].T)
        i, j = np.nonzero(far <= self.limit)
        if self.same:
            above = j + b0 > i + a0
            i, j = i[above], j[above]
        if not len(i):
            return
        linked = []
        for at in range(0, len(i), 1 << 14):
            x, y = self.a[0][a0 + i[at : at + (1 << 14)]], self.b[0][b0 + j[at : at + (1 << 14)]]
            linked.append(np.einsum("nd,nd->n", x, y) >= self.cosine)
        linked = np.concatenate(linked)
        i, j = i[linked] + a0, j[linked] + b0
        np.add.at(self.n_a, i, self.b[2][j])
        np.add.at(self.n_a if self.same else self.n_b, j, self.a[2][i])
        self._keep(i, j)

    def _keep(self, i: np.ndarray, j: np.ndarray) -> None:
        """Keep the links that join two components of this pair of runs."""
        own, other = self.label["a"], self.label["a" if self.same else "b"]
        while len(i):
            open_ = own[i] != other[j]
            i, j = i[open_], j[open_]
            if not len(i):
                return
            self.links.append((int(i[0]), int(j[0])))
            new, old = own[i[0]], other[j[0]]
            for label in {id(own): own, id(other): other}.values():
                label[label == old] = new


def sorted_blocks(classes: DataFrame, epsilon: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Classes in epsilon grid order, cut into blocks of up to ``rows``.

    ``block, dim, ids, copies, vectors, coords, low, high``: the order is that of the grid cells on the leading
    principal axes, one axis after the other; equal cells are told apart by class number, so a full cell is
    cut like any other stretch. ``low`` and ``high`` bound the block on those axes.
    """
    axes = principal_axes(classes)
    kind = _dtype(classes)
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["embedding"].map(len)):
                mean, main = shared.value[dim]
                unit = unit_rows(part["embedding"])
                coords = (unit - mean) @ main
                cells = np.floor(coords / epsilon).astype(np.int64)
                yield pd.DataFrame({"cid": part["cid"].to_numpy(), "copies": part["copies"].to_numpy(), "dim": dim, "cells": list(cells),
                                    "vector": [np.asarray(v, kind).tobytes() for v in part["embedding"]],
                                    "coord": [v.tobytes() for v in coords.astype(np.float32)]})

    placed = classes.select("cid", "copies", "embedding").mapInPandas(
        turned, "cid long, copies long, dim int, cells array<long>, vector binary, coord binary")
    ordered = placed.repartitionByRange("dim", "cells", "cid").sortWithinPartitions("dim", "cells", "cid")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("cid", "copies", "dim", "vector", "coord")), pa.array(np.full(n, part)), pa.array(np.arange(at, at + n))],
                names=["cid", "copies", "dim", "vector", "coord", "part", "at"])
            at += n

    rank = "cid long, copies long, dim int, vector binary, coord binary, part long, at long"
    run = staged(ordered.mapInArrow(numbered, rank), "grid-order")
    # rows per partition and length: as many rows as the shuffle has partitions
    sizes = run.groupBy("dim", "part").agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_from"))
    earlier = Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("dim", "part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from")).alias("_start"))
    place = run.join(starts, ["dim", "part"]).withColumn("_place", F.col("_start") + F.col("at"))

    def packed(rows_: pd.DataFrame) -> pd.DataFrame:
        rows_ = rows_.sort_values("_place")
        coords = np.stack([np.frombuffer(c, np.float32) for c in rows_["coord"]])
        return pd.DataFrame([{
            "block": int(rows_["_place"].iloc[0]) // rows, "dim": int(rows_["dim"].iloc[0]), "ids": rows_["cid"].to_numpy().tobytes(),
            "copies": rows_["copies"].to_numpy().tobytes(), "vectors": b"".join(rows_["vector"]), "coords": coords.tobytes(),
            "low": coords.min(0).astype(float).tolist(), "high": coords.max(0).astype(float).tolist()}])

    blocks = place.withColumn("_block", F.floor(F.col("_place") / rows)).groupBy("dim", "_block").applyInPandas(
        packed, "block long, dim int, ids binary, copies binary, vectors binary, coords binary, low array<double>, high array<double>")
    return staged(blocks, "grid-blocks")


def block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """``dim, i, j`` with ``i <= j``: pairs of blocks whose boxes are within epsilon.

    A block is one row per block of vectors here. It meets others through the cells of the first
    axis it spans, widened by one, so blocks in distant cells never meet; the boxes on all axes decide.
    """
    boxes = blocks.select("dim", "block", "low", "high")
    first = lambda c: F.floor(F.col(c)[0] / epsilon)
    spans = boxes.withColumn("_cell", F.explode(F.sequence(first("low"), first("high"))))
    wide = boxes.withColumn("_cell", F.explode(F.sequence(first("low") - 1, first("high") + 1)))
    a = spans.select("dim", "_cell", F.col("block").alias("i"), F.col("low").alias("_al"), F.col("high").alias("_ah"))
    b = wide.select("dim", "_cell", F.col("block").alias("j"), F.col("low").alias("_bl"), F.col("high").alias("_bh"))
    apart = F.zip_with(
        F.zip_with("_al", "_bh", lambda x, y: x - y), F.zip_with("_bl", "_ah", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)))
    gap = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)
    met = a.join(b, ["dim", "_cell"]).where("i <= j").where(gap <= (epsilon + MARGIN) ** 2)
    return met.select("dim", "i", "j").distinct()


def class_links(blocks: DataFrame, epsilon: float, cosine: float, dtype: str, side: int = TILE) -> DataFrame:
    """``a, b, n``: with a null ``b``, ``n`` vectors link with class ``a``; else a link, enough of which are given to connect all.

    Pairs of blocks are dealt in tiles: ``side`` neighbouring blocks against ``side`` others. A block travels once for each tile it
    has a partner in, not once for each partner, and a task holds ``2 * side`` blocks.
    """
    kind, tile = dtype, lambda c: F.floor(F.col(c) / side).cast("long")
    pairs = block_pairs(blocks, epsilon).withColumns({"ti": tile("i"), "tj": tile("j")})
    wanted = pairs.select("dim", "ti", "tj", F.explode(F.array("i", "j")).alias("block")).distinct()
    held = wanted.join(blocks.select("dim", "block", "ids", "copies", "vectors", "coords"), ["dim", "block"])

    def compare(group: pa.Table) -> pa.Table:
        runs = {}
        ti, tj = group["ti"][0].as_py(), group["tj"][0].as_py()
        for row in group.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            unit = unit_rows(np.frombuffer(row["vectors"], kind).reshape(-1, row["dim"]))
            coords = np.frombuffer(row["coords"], np.float32).reshape(len(ids), -1)
            runs[row["block"]] = ids, (unit, coords, np.frombuffer(row["copies"], np.int64))
        out = []
        for i in (b for b in sorted(runs) if b // side == ti):
            for j in (b for b in sorted(runs) if b // side == tj and b >= i):
                (ids_a, a), (ids_b, b) = runs[i], runs[j]
                # blocks that are too far apart are told by their boxes, before anything is compared
                work = IntervalJoin(epsilon, cosine)
                n_a, n_b = work.join(a, b, i == j)
                ids, n = (ids_a, n_a) if i == j else (np.concatenate([ids_a, ids_b]), np.concatenate([n_a, n_b]))
                some, links = n > 0, np.array(work.links, np.int64).reshape(-1, 2)
                out.append(pa.table({
                    "a": np.concatenate([ids[some], ids_a[links[:, 0]]]),
                    "b": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(ids_b[links[:, 1]], pa.int64())]),
                    "n": np.concatenate([n[some], np.zeros(len(links), np.int64)])}))
        return pa.concat_tables(out)

    # one tile is one group: that is all a task holds at a time
    return staged(held.groupBy("dim", "ti", "tj").applyInArrow(compare, "a long, b long, n long"), "vector-links")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector.

    Equal vectors are one class with its number of copies and smallest id, so groups of copies are counted,
    not paired. Vectors of different lengths never link.

    Defined results: null, zero and non-finite vectors link with nothing and are their own component; rows with a
    null id take part, their component is that of the class; repeated ids are rows of their own;
    an empty table gives no rows; other columns, labels among them, are not read.
    """
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = vectors.select("vec_id", "embedding")
    fit = rows.where(usable())
    grouped = fit.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = staged(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    found = class_links(sorted_blocks(classes, epsilon, block_rows), epsilon, cosine, _dtype(classes))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("_n"))
    linked = classes.join(roots, F.col("cid") == F.col("node"), "left").join(counts, F.col("cid") == F.col("a"), "left")
    linked = linked.select("embedding", "cid", "first", F.coalesce("root", "cid").alias("root"),
                           (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "root").select("embedding", "n_links", "component_id")
    own = fit.join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
