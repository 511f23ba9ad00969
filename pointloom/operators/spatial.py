"""Radius links and connected components of points, by cells and equi-joins.

Two points are linked when their distance is at most the larger of their radii, the border
included. Cells are as wide as the largest radius, so links lie in a cell and its 26
neighbours; half of those are visited, so each pair meets once. Components come from
cells that are joined over the table (any size of frame) or from a kernel for each frame (many small frames).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import DETECTOR, Detector
from ..session import frame_keyed, materialise
from .graph import connected_components


def link_radius(cfg: Detector = DETECTOR) -> Column:
    """Wider beyond the far range, as returns get sparse."""
    far = F.sqrt(F.col("s") ** 2 + F.col("l") ** 2 + F.col("h") ** 2) >= cfg.far_range_m
    return F.when(far, F.lit(max(cfg.link_m, cfg.far_link_m))).otherwise(F.lit(cfg.link_m))


def radius_links(df: DataFrame, cell_m: float) -> DataFrame:
    """(frame_index, a, b) with a < b for ``df`` (frame_index, point_id, s, l, h, radius); cell_m: the largest radius."""
    cell = lambda c: F.floor(F.col(c) / cell_m).cast("int")
    home = df.select("frame_index", "point_id", "s", "l", "h", "radius", cell("s").alias("i"), cell("l").alias("j"), cell("h").alias("k"))
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in steps])).alias("d")
    visit = home.select("frame_index", F.col("point_id").alias("p"), F.col("s").alias("s1"), F.col("l").alias("l1"), F.col("h").alias("h1"),
        F.col("radius").alias("r1"), "i", "j", "k", near)
    visit = visit.select("frame_index", "p", "s1", "l1", "h1", "r1", (F.col("i") + F.col("d.a")).alias("i"),
        (F.col("j") + F.col("d.b")).alias("j"), (F.col("k") + F.col("d.c")).alias("k"),
        ((F.col("d.a") == 0) & (F.col("d.b") == 0) & (F.col("d.c") == 0)).alias("same"))
    d2 = (F.col("s") - F.col("s1")) ** 2 + (F.col("l") - F.col("l1")) ** 2 + (F.col("h") - F.col("h1")) ** 2
    met = visit.join(home, ["frame_index", "i", "j",
            "k"]).where((~F.col("same") | (F.col("p") < F.col("point_id"))) & (d2 <= F.greatest("radius", "r1") ** 2))
    return met.select("frame_index", F.least("p", "point_id").alias("a"), F.greatest("p", "point_id").alias("b"))


#: Pairs of points that are measured at once, and places looked up at once.
PAIRS_AT_ONCE, LOOKUPS = 2_000_000, 4_000_000
#: So few points are all compared with each other, as setting up cells would take longer.
FEW_POINTS = 256


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest of its group) after the groups of a[k] and b[k] are joined."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


@functools.cache
def _steps(reach: int) -> np.ndarray:
    """Steps to half of the cells around one that may hold points in reach."""
    steps = [(x, y, z) for x in range(reach + 1) for y in range(-reach, reach + 1) for z in range(-reach, reach + 1) if (x, y, z) > (0, 0, 0)]
    # the gap between two cells is one side less than their step; three of its squares are a squared diagonal
    return np.array([s for s in steps if sum(max(abs(x) - 1, 0) ** 2 for x in s) <= reach * reach])


def _neighbours(cell: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in ``cell``) of occupied cells that may hold points in reach; ``cell`` is sorted by rows."""
    steps = _steps(reach)
    low = cell.min(0) - reach
    span = cell.max(0) - low + reach + 1
    code = lambda c: ((c[..., 0] - low[0]) * span[1] + c[..., 1] - low[1]) * span[2] + c[..., 2] - low[2]
    codes, many = code(cell), max(1, LOOKUPS // len(steps))
    found = []
    for at in range(0, len(cell), many):
        want = code(cell[at : at + many, None, :] + steps[None, :, :])
        place = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
        k, s = np.nonzero(codes[place] == want)
        found.append((k + at, place[k, s]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _labels_of_few(points: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """``_labels`` by the distances of all pairs."""
    d2 = sum((x[:, None] - x[None, :]) ** 2 for x in points.T)
    near, n = d2 <= np.maximum(radius[:, None], radius[None, :]) ** 2, len(points)
    np.fill_diagonal(near, True)
    label = np.arange(n)
    while True:
        low = np.where(near, label[None, :], n).min(1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _labels(points: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The smallest row number linked to each row.

    Cells have the smallest radius as their diagonal, so all points of a cell are linked. Neighbouring cells are
    linked where their first points are in reach, and only cells that are in different groups by then are compared point by point.
    """
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    if n <= FEW_POINTS:
        return _labels_of_few(points, radius)
    side = max(float(radius.min()), 1e-12) / 3**0.5 * (1 - 1e-9)
    cell, of = np.unique(np.floor(points / side).astype(np.int64), axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    size = np.bincount(of)
    start = np.cumsum(size) - size
    a, b = _neighbours(cell, int(np.ceil(radius.max() / side)))
    near = lambda x, y: ((points[x] - points[y]) ** 2).sum(1) <= np.maximum(radius[x], radius[y]) ** 2
    first = order[start]
    hit = near(first[a], first[b])
    label = _merged(np.arange(len(cell)), a[hit], b[hit])
    rest = np.flatnonzero(label[a] != label[b])
    rest = rest[np.argsort(size[a[rest]] * size[b[rest]], kind="stable")]  # few points first
    while len(rest):
        many = size[a[rest]] * size[b[rest]]
        part = rest[: max(1, int(np.searchsorted(np.cumsum(many), PAIRS_AT_ONCE, side="right")))]
        x, y = a[part], b[part]
        many, own = size[x] * size[y], np.repeat(np.arange(len(part)), size[x] * size[y])
        k = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        hit = near(order[start[x[own]] + k // size[y[own]]], order[start[y[own]] + k % size[y[own]]])
        linked = np.unique(own[hit])
        label = _merged(label, x[linked], y[linked])
        rest = rest[len(part) :]
        rest = rest[label[a[rest]] != label[b[rest]]]
    least = np.full(len(cell), n)
    np.minimum.at(least, label[of], np.arange(n))
    return least[label[of]]


def components(df: DataFrame, largest_m: float | None = None, by_frame: bool = True) -> DataFrame:
    """``df`` with ``label``: the smallest point_id of the frame's component that the row is in.

    ``by_frame`` runs a kernel for each frame (frames of a sensor are bounded); otherwise
    cells are joined and components found over the whole table, for frames of any size; ``largest_m`` is the largest radius where it is known.
    """
    if by_frame:
        schema = df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

        def run(table: pa.Table) -> pa.Table:
            ids = table.column("point_id").to_numpy()
            order, label = np.argsort(ids), np.empty_like(ids)
            at = _labels(np.column_stack([table.column(c).to_numpy() for c in "slh"])[order], table.column("radius").to_numpy()[order])
            label[order] = ids[order][at]
            return table.append_column("label", pa.array(label))

        return df.groupBy("frame_index").applyInArrow(run, schema + ", label long")
    return _components_by_cells(df, largest_m)


def _within_reach(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
    """Whether some point of one cell links with some point of the other, block by block and no further than the first."""
    read = lambda t: (np.column_stack([t.column(c).to_numpy() for c in (2, 3, 4)]), t.column(5).to_numpy())
    (p, r), (q, t) = read(a), read(b)
    hit, many = False, max(1, PAIRS_AT_ONCE // max(1, len(q)))
    for at in range(0, len(p), many):
        d2 = ((p[at : at + many, None, :] - q[None, :, :]) ** 2).sum(2)
        if (d2 <= np.maximum(r[at : at + many, None], t[None, :]) ** 2).any():
            hit = True
            break
    return pa.table({"a": pa.array([key[0].as_py()] * hit, pa.int64()), "b": pa.array([key[1].as_py()] * hit, pa.int64())})


def _components_by_cells(df: DataFrame, largest_m: float | None = None) -> DataFrame:
    """``df`` with ``label`` for frames larger than a task: what the kernel of a frame does, over the table.

    Cells have the smallest radius as their diagonal, so each is one node, however many points it holds. Cells whose first points are in
    reach are linked; only cells that are in different components by then compare points, pair by pair of cells.
    """
    found = df.agg(F.min("radius").alias("lo"), F.max("radius").alias("hi")).first()
    if found.lo is None:
        return df.withColumn("label", F.lit(None).cast("long"))
    side = max(found.lo, 1e-12) / 3**0.5 * (1 - 1e-9)
    reach = int(np.ceil(max(found.hi, largest_m or 0.0) / side))
    place, code = ("ci", "cj", "ck"), lambda c: F.col("frame_index") * (1 << 32) + F.col(c)
    rows = df.withColumns({n: F.floor(F.col(c) / side).cast("long") for n, c in zip(place, "slh", strict=True)})
    first = F.min_by(F.struct("s", "l", "h", "radius"), "point_id").alias("first")
    # cells (one row each, however full) are dealt by frame, so that their many neighbours are looked up where they are and never shuffled
    cells = frame_keyed(rows.groupBy("frame_index", *place).agg(F.min("point_id").alias("point_id"), first).withColumn("node", code("point_id")))
    steps = [(x, y, z) for x in range(reach + 1) for y in range(-reach, reach + 1) for z in range(-reach, reach + 1) if (x, y, z) > (0, 0, 0)]
    steps = [x for x in steps if sum(max(abs(c) - 1, 0) ** 2 for c in x) <= reach * reach]  # as far apart as two cells can link
    offsets = F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip("xyz", x, strict=True)]) for x in steps])
    visit = cells.select("frame_index", F.col("node").alias("a"), F.col("first").alias("p"), *place, F.explode(offsets).alias("d"))
    visit = visit.select("frame_index", "a", "p", *[(F.col(c) + F.col(f"d.{n}")).alias(c) for c, n in zip(place, "xyz", strict=True)])
    near = visit.join(cells.select("frame_index", *place, F.col("node").alias("b"), F.col("first").alias("q")).hint("shuffle_hash"), ["frame_index", *place])
    d2 = sum((F.col(f"p.{c}") - F.col(f"q.{c}")) ** 2 for c in "slh")
    near = materialise(near.select("a", "b", (d2 <= F.greatest("p.radius", "q.radius") ** 2).alias("linked")), "near-cells")
    nodes = cells.select("node")
    known = materialise(connected_components(nodes, "node", near.where("linked").select("a", "b"), "a", "b").select("node", F.col("component_id").alias("part")), "parts")
    part = lambda c: known.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
    apart = near.where("not linked").join(part("a"), "a").join(part("b"), "b").where("a_part <> b_part")
    apart = materialise(apart, "cells-apart")
    members = rows.join(cells.select("frame_index", *place, "node"), ["frame_index", *place]).select("node", "s", "l", "h", "radius")
    # either side under names of its own, as both are of the same table
    side_of = lambda c, o: apart.select("a", "b", F.col(c).alias("node")).join(members, "node").select(*[F.col(n).alias(o + n) for n in ("a", "b", "s", "l", "h", "radius")])
    met = side_of("a", "p").groupBy("pa", "pb").cogroup(side_of("b", "q").groupBy("qa", "qb")).applyInArrow(_within_reach, "a long, b long")
    more = met.join(part("a"), "a").join(part("b"), "b").select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct()
    whole = connected_components(known.select("part").distinct(), "part", more, "a", "b").select("part", "component_id")
    labels = cells.select("frame_index", *place, "node").join(known, "node").join(whole, "part").select("frame_index", *place, F.pmod("component_id", F.lit(1 << 32)).alias("label"))
    return rows.join(labels, ["frame_index", *place]).drop(*place)


def cell_components(df: DataFrame, gap_m: float = DETECTOR.cell_gap_m) -> DataFrame:
    """``df`` with ``label`` (smallest point_id) by 26-connected occupied cells."""
    cell = lambda c: F.floor(F.col(c) / gap_m).cast("int")
    rows = df.withColumns({"ci": cell("s"), "cj": cell("l"), "ck": cell("h")})
    cells = rows.groupBy("frame_index", "ci", "cj", "ck").agg(F.min("point_id").alias("first"))
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    moved = cells.select("frame_index", F.col("first").alias("a"), "ci", "cj", "ck",
        F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a, b, c in steps])).alias("d"))
    moved = moved.select("frame_index", "a", (F.col("ci") + F.col("d.x")).alias("ci"), (F.col("cj") + F.col("d.y")).alias("cj"),
        (F.col("ck") + F.col("d.z")).alias("ck"))
    code = lambda c: F.col("frame_index") * (1 << 32) + F.col(c)
    links = moved.join(cells.withColumnRenamed("first", "b"), ["frame_index", "ci", "cj", "ck"]).select(code("a").alias("a"), code("b").alias("b"))
    done = connected_components(cells.withColumn("__node", code("first")), "__node", links, "a", "b").select("frame_index", "ci", "cj",
        "ck", F.pmod("component_id", F.lit(1 << 32)).alias("label"))
    return rows.join(done, ["frame_index", "ci", "cj", "ck"]).drop("ci", "cj", "ck")


def split_components(df: DataFrame, split_m: float = DETECTOR.far_range_m, near_m: float = DETECTOR.link_m,
    far_m: float = DETECTOR.far_link_m) -> DataFrame:
    """Near and far points in components of their own, never linked across the border."""
    r = F.sqrt(F.col("s") ** 2 + F.col("l") ** 2 + F.col("h") ** 2)
    near = components(df.where(r < split_m).withColumn("radius", F.lit(near_m)))
    return near.unionByName(components(df.where(r >= split_m).withColumn("radius", F.lit(far_m))))
