"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are compared when their labels are equal and not null and their dimensions agree.

1. Equal vectors of a label, by a 128-bit print, become one point with a count.
2. Points are scaled to length one and turned into the principal axes of all points. The axes come from one
   dimension-by-dimension matrix of sums, which each task adds up by itself.
3. Points of a label fall into cells of a grid over its first axes, as wide as two linked points can be apart. A label has as many of
   up to AXES axes as bring its largest cell down to a tile, none if it is small; a cell of more is cut into tiles.
   Each pair of tiles of equal or neighbouring cells is compared in one task, and a point goes to a neighbouring cell only if
   that is near enough.
4. Products are summed over the leading axes first, block by block. The rest of a product is at most the product of the two
   suffix norms; pairs that cannot reach the threshold any more are dropped after each block of axes.
5. What survives is decided by the cosine of the vectors as given, in double precision.

A task returns numbers of links and a spanning forest, not its pairs. Components come from the forests.

Vectors that are null, empty or zero, hold null or non-finite components, or have a null label link with nothing and are
components of their own. Every row is a vector: rows of one id are separate, and rows with a null id link like others but are
no one's component_id (null, and kept, where a component has no id at all). Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import components, drop, keep

#: Bytes of the vectors of a tile, and vectors that are multiplied at once.
TILE_BYTES, ROWS = 16 << 20, 1024
#: Axes that a grid has at most.
AXES = 3
#: Axes per block of partial products.
BLOCK = 16
SLACK = 1e-9
SUMMANDS = 8


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the unit vectors of each dimension in a binary column."""
    vectors = column.to_pylist()
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join(vectors[k] for k in at)).reshape(len(at), -1)
        yield at, x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of outer products of the unit vectors, one matrix per task and dimension."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in _by_size(batch.column(0)):
            sums[x.shape[1]] = sums.get(x.shape[1], 0) + x.T @ x
    if sums:
        dims = list(sums)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(dims, pa.int32()), "sums": pa.array([sums[d].tobytes() for d in dims])})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix per dimension of those that a task gets."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[dim] = sums.get(dim, 0) + np.frombuffer(part)
    if sums:
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(sums), pa.int32()), "sums": pa.array([m.tobytes() for m in sums.values()])})


def principal_axes(points: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the axes as columns, by falling share of the sums of squares.

    Matrices are added in two rounds, so that the driver gets at most SUMMANDS of a dimension, whatever the number of tasks.
    """
    axes: dict[int, np.ndarray] = {}
    schema = "dim int, sums binary"
    parts = points.select("vector").mapInArrow(_moments, schema).repartition(SUMMANDS).mapInArrow(_added, schema)
    for row in parts.toLocalIterator():
        part = np.frombuffer(row["sums"]).reshape(row["dim"], row["dim"])
        axes[row["dim"]] = axes.get(row["dim"], 0) + part
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in axes.items()}


def _leading(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows with the coordinates along the first axes; 0 for axes that a vector does not have."""
    for batch in batches:
        found = np.zeros((batch.num_rows, AXES))
        for at, x in _by_size(batch.column("vector")):
            lead = x @ axes[x.shape[1]][:, :AXES]
            found[at, : lead.shape[1]] = lead
        for k in range(AXES):
            batch = batch.append_column(f"x{k}", pa.array(found[:, k]))
        yield batch


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with cosine(a[i], b[j]) >= threshold."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ua, ub = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    ra = np.sqrt(np.maximum(0, np.cumsum((ua**2)[:, ::-1], axis=1)[:, ::-1]))
    rb = np.sqrt(np.maximum(0, np.cumsum((ub**2)[:, ::-1], axis=1)[:, ::-1]))
    dims = a.shape[1]
    sums = ua[:, :BLOCK] @ ub[:, :BLOCK].T
    if dims > BLOCK:
        open_ = sums + np.outer(ra[:, BLOCK], rb[:, BLOCK]) >= threshold - SLACK
    else:
        open_ = sums >= threshold - SLACK
    i, j = np.nonzero(open_)
    sums = sums[i, j]
    for at in range(BLOCK, dims, BLOCK):
        if len(i) == 0:
            break
        to = min(at + BLOCK, dims)
        if len(i) * 4 > len(ua) * len(ub):
            sums = sums + (ua[:, at:to] @ ub[:, at:to].T)[i, j]
        else:
            sums = sums + np.concatenate(
                [np.einsum("ij,ij->i", ua[p, at:to], ub[q, at:to]) for p, q in _runs(i, j)] or [np.zeros(0)]
            )
        rest = ra[i, to] * rb[j, to] if to < dims else 0
        alive = sums + rest >= threshold - SLACK
        i, j, sums = i[alive], j[alive], sums[alive]
    if len(i):
        cosine = np.concatenate([np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q]) for p, q in _runs(i, j)])
        i, j = i[cosine >= threshold], j[cosine >= threshold]
    return i, j


def _runs(i: np.ndarray, j: np.ndarray, size: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(i), size):
        yield i[at : at + size], j[at : at + size]


def _forest(edges: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that span the components of a graph on n places."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in edges.tolist():
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def compared_tiles(data: np.ndarray, side: np.ndarray, copies: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each place, by copies, and a spanning forest; places of side -1 meet those of side 1, those of side 0 each other."""
    links, forest = np.zeros(len(data), np.int64), []
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    same = bool((side == 0).all())
    for x in range(0, len(left), ROWS):
        for y in range(x if same else 0, len(right), ROWS):
            p, q = left[x : x + ROWS], right[y : y + ROWS]
            i, j = linked_pairs(data[p], data[q], axes, threshold)
            i, j = p[i], q[j]
            if same and x == y:
                i, j = i[i < j], j[i < j]
            links += np.bincount(i, copies[j], len(data)).astype(np.int64) + np.bincount(j, copies[i], len(data)).astype(np.int64)
            forest = _forest(np.array(forest + list(zip(i.tolist(), j.tolist(), strict=True)), np.int64).reshape(-1, 2), len(data))
    return links, forest


def _grid(points: DataFrame, width: float, tile_bytes: int) -> DataFrame:
    """Points with their cell c0, c1, ... on as many axes as their label needs, 0 on the others, and the number of axes."""
    names = [f"c{k}" for k in range(AXES)]
    celled = points.withColumns({c: F.floor(F.col(f"x{k}") / width).cast("int") for k, c in enumerate(names)})
    counts = keep(celled.groupBy("label", "dim", *names).agg(F.count("*").alias("n")), "cells")
    largest = None
    for k in range(AXES):  # with k axes, the largest cell of a label
        most = counts.groupBy("label", "dim", *names[:k]).agg(F.sum("n").alias("n")).groupBy("label", "dim").agg((F.max("n") * F.col("dim") * 8).alias(f"m{k}"))
        largest = most if largest is None else largest.join(most, ["label", "dim"])
    few = F.coalesce(*(F.when(F.col(f"m{k}") <= tile_bytes, k) for k in range(AXES)), F.lit(AXES))
    chosen = keep(largest.select("label", "dim", few.alias("axes")), "axes")
    out = celled.join(chosen, ["label", "dim"])
    return out.withColumns({c: F.when(F.col("axes") > k, F.col(c)).otherwise(0) for k, c in enumerate(names)})


def _tasks(placed: DataFrame, width: float, tile_bytes: int) -> DataFrame:
    """Points with the pairs of tiles (cell and tile, cell and tile) that they go to and their side there."""
    names = [f"c{k}" for k in range(AXES)]
    group = ["label", "dim", *names]
    cells = placed.groupBy(*group).agg(F.ceil(F.count("*") * F.first("dim") * 8 / tile_bytes).cast("int").alias("tiles"), F.first("axes").alias("axes"))
    cells = keep(cells, "tiles")
    steps = F.array(*(F.array(*map(F.lit, o)) for o in product((-1, 0, 1), repeat=AXES) if any(o)))
    near = cells.select(*group, "axes", F.explode(steps).alias("step"))
    # Steps along axes that a label does not use lead to no cell.
    near = near.select(*group, "step", *((F.col(c) + F.get("step", F.lit(k))).alias(f"n{k}") for k, c in enumerate(names)))
    there = cells.select("label", "dim", *(F.col(c).alias(f"n{k}") for k, c in enumerate(names)), F.col("tiles").alias("others"))
    near = near.join(there, ["label", "dim", *(f"n{k}" for k in range(AXES))])
    near = near.groupBy(*group).agg(F.collect_list(F.struct("step", "others")).alias("near"))
    own = placed.join(cells.drop("axes").join(keep(near, "near"), group, "left"), group)
    own = own.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    def away(k: int) -> str:
        """The distance along an axis to the cell that a step leads to."""
        return f"(case s.step[{k}] when 1 then (c{k} + 1) * {width!r} - x{k} when -1 then x{k} - c{k} * {width!r} else 0 end)"

    task = "named_struct({cells}, 'p', {p}, 'q', {q}, 'side', {side})"
    same_cells = ", ".join(f"'a{k}', c{k}, 'b{k}', c{k}" for k in range(AXES))
    up_cells = ", ".join(f"'a{k}', c{k}, 'b{k}', c{k} + s.step[{k}]" for k in range(AXES))
    down_cells = ", ".join(f"'a{k}', c{k} + s.step[{k}], 'b{k}', c{k}" for k in range(AXES))
    same = f"transform(sequence(0, tiles - 1), o -> {task.format(cells=same_cells, p='least(tile, o)', q='greatest(tile, o)', side='cast(signum(tile - o) as int)')})"
    up = task.format(cells=up_cells, p="tile", q="o", side="-1")
    down = task.format(cells=down_cells, p="o", q="tile", side="1")
    # The first step that is not 0 tells which cell of a pair comes first.
    rises = "coalesce(" + ", ".join(f"nullif(s.step[{k}], 0)" for k in range(AXES)) + ") > 0"
    reach = " + ".join(f"{away(k)} * {away(k)}" for k in range(AXES)) + f" <= {width * width!r}"
    others = f"flatten(transform(filter(coalesce(near, array()), s -> {reach}), s -> transform(sequence(0, s.others - 1), o -> case when {rises} then {up} else {down} end)))"
    dealt = own.withColumn("task", F.explode(F.expr(f"concat({same}, {others})")))
    return dealt.select("label", "dim", "task.*", "node", "copies", "vector")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """id, n_links, component_id, kept for every row."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)
    marked = rows.withColumn("ok", F.coalesce(valid, F.lit(False)))
    named = marked.withColumns({"one": F.when(F.col("ok"), F.xxhash64("v")), "two": F.when(F.col("ok"), F.xxhash64(F.lit(1), "v"))})
    key = ["label", "one", "two"]
    dense = named.where("ok").groupBy(*key).agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    kind = dense.schema["label"].dataType.simpleString()
    packed = dense.withColumn("node", F.monotonically_increasing_id()).mapInArrow(
        _packed, f"label {kind}, one long, two long, node long, least {rows.schema['id'].dataType.simpleString()}, copies long, dim int, vector binary"
    )
    points = keep(packed, "points")
    rows = keep(named.select("id", *key), "rows")
    axes = spark.sparkContext.broadcast(principal_axes(points))
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-6)
    columns = f"label {kind}, dim int, node long, copies long, vector binary, " + ", ".join(f"x{k} double" for k in range(AXES))
    lead = points.select("label", "dim", "node", "copies", "vector").mapInArrow(lambda it: _leading(it, axes.value), columns)
    placed = keep(_grid(keep(lead, "leading"), width, tile_bytes), "placed")
    dealt = _tasks(placed, width, tile_bytes)

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable")
        dims = int(rows["dim"].iloc[0])
        data = np.frombuffer(b"".join(rows["vector"])).reshape(-1, dims)
        nodes = rows["node"].to_numpy()
        links, forest = compared_tiles(data, rows["side"].to_numpy(), rows["copies"].to_numpy(), axes.value[dims], threshold)
        at = np.flatnonzero(links)
        return pd.DataFrame(
            {
                "a": np.concatenate([nodes[at], [nodes[x] for x, _ in forest]]).astype("int64"),
                "b": np.concatenate([nodes[at], [nodes[y] for _, y in forest]]).astype("int64"),
                "links": np.concatenate([links[at], np.zeros(len(forest))]).astype("int64"),
            }
        )

    spots = [f"{side}{k}" for k in range(AXES) for side in "ab"]
    found = dealt.groupBy("label", "dim", *spots, "p", "q").applyInPandas(compared, "a long, b long, links long")
    found = keep(found, "links")
    drop(placed)
    degree = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comps = components(found.where("a <> b").select("a", "b"))
    nodes = points.select(*key, "node", "least", "copies").join(degree, "node", "left").join(comps, "node", "left")
    nodes = nodes.select(*key, "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    nodes = keep(nodes, "nodes")
    drop(points, found)
    low = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = nodes.join(low, "component").select(*key, "n_links", "component_id")
    out = rows.join(by_key, key, "left")
    own_id = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"),
        F.col("id").eqNullSafe(own_id).alias("kept"),
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their doubles."""
    for batch in batches:
        column = batch.column("v")
        values = column.values.to_numpy(zero_copy_only=False).astype("<f8")
        at = column.offsets.to_numpy()
        parts = {c: batch.column(c) for c in ("label", "one", "two", "node", "least", "copies")}
        parts["dim"] = pa.array(np.diff(at).astype("int32"))
        parts["vector"] = pa.array([values[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())
        yield pa.RecordBatch.from_pydict(parts)
