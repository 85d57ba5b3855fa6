"""Embedding near-duplicates by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.llm.components import connected_components
from tessera.llm.shared import by_group, discard, group_starts, local_components, written

RANK = 64  # leading axes that order the work; any number gives the same links
BINS = 4096  # angles to the ordering axis are told apart in steps of pi / BINS


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _units(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    x = _matrix(column, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(classes: DataFrame, least: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For every vector length of more than `least` rows: (leading axes of all its unit vectors by descending variance, the
    axis along which they spread most).

    A randomised range finder over all rows, in two passes: tasks sum length x RANK numbers, whatever the length, and
    those sums reach the driver. They only order the work: any orthonormal axes give the same links.
    """
    dims = [r["dim"] for r in classes.groupBy("dim").count().where(F.col("count") > least).select("dim").collect()]
    bases = {d: np.linalg.qr(np.random.default_rng(d).normal(size=(d, min(d, RANK))))[0] for d in dims}
    for _ in range(2):
        shared = classes.sparkSession.sparkContext.broadcast(bases)

        def moments(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                of = batch.column("dim").to_numpy()
                for dim in np.unique(of).tolist():
                    if dim in shared.value:
                        x = _units(batch.column("vector").filter(pa.array(of == dim)), dim)
                        sums[dim] = sums.get(dim, 0.0) + x.T @ np.c_[x @ shared.value[dim], np.ones(len(x))]
            for dim, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, dim, np.int32)), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.ravel())], ["dim", "k", "v"])

        got = classes.select("dim", "vector").mapInArrow(moments, "dim int, k int, v double").groupBy("dim", "k").agg(F.sum("v").alias("v")).toArrow().to_pandas()
        moved = {int(d): rows.sort_values("k")["v"].to_numpy().reshape(int(d), -1) for d, rows in got.groupby("dim")}
        values = {d: np.linalg.eigh(bases[d].T @ m[:, :-1]) for d, m in moved.items()}  # of the last basis, for the last pass
        last, bases = bases, {d: np.linalg.qr(m[:, :-1])[0] for d, m in moved.items()}
    out = {}
    for d, m in moved.items():
        axes = last[d] @ values[d][1][:, ::-1]
        n = max(1.0, float(np.abs(values[d][0]).sum()))
        spread = values[d][0][::-1] / n - (m[:, -1] @ axes / n) ** 2
        out[d] = axes, axes[:, int(np.argmax(spread))]
    return out


def links_in(x: np.ndarray, y: np.ndarray, axes: np.ndarray | None, threshold: float, first: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of x, j of y) with cosine >= threshold.

    Products accumulate over the leading axes; the rest of each product is at most the product of the suffix norms,
    and once no pair can reach the threshold the tile ends. Survivors are decided on the given vectors in double.
    """
    ux, uy = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    axes = np.eye(x.shape[1])[:, :RANK] if axes is None else axes
    px, py = ux @ axes, uy @ axes
    rank, at, slack = axes.shape[1], 0, 1e-9
    tail = lambda p, k: np.sqrt(np.maximum(1 - (p[:, :k] ** 2).sum(1), 0) + 1e-12)
    part = np.zeros((len(x), len(y)))
    for k in [k for k in (first, 2 * first, 4 * first) if k < rank] + [rank]:
        part += px[:, at:k] @ py[:, at:k].T
        at = k
        i, j = np.nonzero(part + np.outer(tail(px, k), tail(py, k)) >= threshold - slack)
        if not len(i):
            return i, j
        if len(i) * 4 < part.size:  # few are left: decide them one by one
            break
    sure = np.zeros(len(i), bool)
    for lo in range(0, len(i), 65536):
        a, b = i[lo : lo + 65536], j[lo : lo + 65536]
        near = np.flatnonzero((ux[a] * uy[b]).sum(1) >= threshold - slack)
        exact = (x[a[near]] * y[b[near]]).sum(1) / (np.linalg.norm(x[a[near]], axis=1) * np.linalg.norm(y[b[near]], axis=1))
        sure[lo + near] = exact >= threshold
    return i[sure], j[sure]


def _blocks(keyed: DataFrame, block: int, reach: int) -> DataFrame:
    """(g, dim, bin, first, last, low, high) for every bin: the blocks its rows are dealt to, and those within reach of it.

    Blocks follow the order of the bins and hold about `block` rows; a bin of more rows has several. A group has at most
    BINS bins, whatever its rows, so the windows here are small.
    """
    own = ["g", "dim"]
    order = Window.partitionBy(*own).orderBy("bin")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = keyed.groupBy(*own, "bin").agg(F.count("*").alias("n")).withColumn("before", before)
    cut = lambda c: F.floor(c / F.lit(float(block))).cast("int")
    bins = bins.select(*own, "bin", cut(F.col("before")).alias("first"), cut(F.col("before") + F.col("n") - 1).alias("last"))
    near = order.rangeBetween(-reach, reach)
    return bins.withColumns({"low": F.min("first").over(near), "high": F.max("last").over(near)})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", threshold: float = 0.98, block: int = 1024) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Rows link when their groups are equal and their cosine is at least threshold. A row links with nothing (n_links 0,
    its own component) if its id, group or vector is null, its vector is empty, zero or holds null or non-finite
    components, or no other vector of its length is near. Equal vectors of a group are one class and are compared
    once; repeated rows count as separate vectors. An empty table gives no rows; other columns are ignored.
    Classes of a group are dealt to blocks by their angle to the axis along which all vectors spread most. Two vectors
    whose angles differ by more than the threshold's own angle cannot link, so only blocks within that reach meet, each
    two of them in one tile: no task holds a group.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(group_col).alias("__group"), F.col(vector_col).alias("__vector"))
    finite = F.forall("__vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("__id").isNotNull() & F.col("__group").isNotNull() & (F.size("__vector") > 0) & finite & F.exists("__vector", lambda v: v != 0)
    good = rows.where(usable)
    classes = good.groupBy("__group", "__vector").agg(F.min("__id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes.select("id", "copies", F.col("__group").alias("grp"), F.col("__vector").alias("vector"), F.size("__vector").alias("dim")), "vectors")
    axes = vectors.sparkSession.sparkContext.broadcast(principal_axes(classes, block))  # length x RANK numbers for every vector length
    step = np.pi / BINS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, bins = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                if dim in axes.value:
                    x = _units(batch.column("vector").filter(pa.array(dims == dim)), dim)
                    bins[dims == dim] = np.arccos(np.clip(x @ axes.value[dim][1], -1, 1)) / step
            yield batch.append_column("bin", pa.array(bins))

    # A group may be any value; the smallest id among its vectors of a length stands for it.
    groups = written(classes.groupBy("grp", "dim").agg(F.min("id").alias("g"), F.count("*").alias("n")).where("n > 1").drop("n"), "labels")
    keyed = classes.join(groups, ["grp", "dim"]).select("id", "copies", "vector", "dim", "g")
    keyed = written(keyed.mapInArrow(place, StructType([*keyed.schema.fields, StructField("bin", IntegerType())])), "keyed")
    reach = int(np.ceil(np.arccos(np.clip(threshold - 1e-9, -1, 1)) / step)) + 1
    blocks = written(_blocks(keyed, block, reach), "blocks")
    tiles = keyed.join(blocks, ["g", "dim", "bin"]).withColumn("b", F.col("first") + F.pmod(F.xxhash64("id"), (F.col("last") - F.col("first") + 1).cast("long")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence("low", "high"))).withColumns({"t1": F.least("b", "other"), "t2": F.greatest("b", "other")})
    tiles = tiles.select("id", "copies", "vector", "dim", "g", "b", "t1", "t2")

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = [*group_starts(table, ["dim", "g", "t1", "t2"]), table.num_rows]
        ids, copies, block_of = (table.column(k).to_numpy() for k in ("id", "copies", "b"))
        t1, t2, dims = (table.column(k).to_numpy() for k in ("t1", "t2", "dim"))
        vectors = table.column("vector").combine_chunks()
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            dim = int(dims[lo])
            x, own, n = _matrix(vectors.slice(lo, hi - lo), dim), ids[lo:hi], copies[lo:hi]
            basis = axes.value[dim][0] if dim in axes.value else None
            if t1[lo] == t2[lo]:
                i, j = links_in(x, x, basis, threshold)
                i, j = i[i < j], j[i < j]
            else:
                left, right = np.flatnonzero(block_of[lo:hi] == t1[lo]), np.flatnonzero(block_of[lo:hi] == t2[lo])
                if not len(left) or not len(right):
                    continue
                i, j = links_in(x[left], x[right], basis, threshold)
                i, j = left[i], right[j]
            if not len(i):
                continue
            found = np.zeros(hi - lo, np.int64)
            np.add.at(found, i, n[j])
            np.add.at(found, j, n[i])
            root = local_components(hi - lo, i, j)
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(own[root[some]]), pa.array(found[some])], ["id", "other", "n"])

    found = written(by_group(tiles, ["g", "dim", "t1", "t2"], compare, "id long, other long, n long"), "links")
    discard(keyed, blocks)
    component = connected_components(found.select(F.col("id").alias("src"), F.col("other").alias("dst")))
    per_class = (
        classes.select("id", "copies", "grp", "vector")
        .join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left")
        .join(component.select(F.col("node").alias("id"), "component"), "id", "left")
        .select(F.col("grp").alias("__group"), F.col("vector").alias("__vector"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    per_class = written(per_class, "classes")
    keyed_rows = rows.withColumn("__group", F.when(usable, F.col("__group")))
    out = keyed_rows.join(per_class, ["__group", "__vector"], "left").select(
        F.col("__id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "__id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
