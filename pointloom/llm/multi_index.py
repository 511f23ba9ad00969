"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut into halves. Each half has a codebook of its
own (k-means on a bounded sample, ``SAMPLE`` vectors), and the product of the two books
is the grid of cells; every vector lies in the cell of its nearest codewords. A vector
visits cells in the order of the multi-sequence traversal, nearest first, and it visits
as many as brought ``RECALL`` of the neighbours of ``QUERIES`` vectors into reach. Those are
sampled, too, but kept out of the fit, and their neighbours lie at the threshold's cosine itself
in random directions: real links are as far apart at most, and can be found from either end, so the
share of links that is found is above RECALL. There is no cap on visits short of the whole grid,
which is the exact search. What a vector meets in a visited cell is verified in double precision.

A cell is a group of a join, however many vectors it has: its members and its visitors
are dealt into chunks of ``CHUNK`` rows, and each pair of chunks is a task of its own
with one matrix product. A chunk pair returns counts and a spanning forest of its links,
never the links themselves, so a dense cluster gives few rows. Members carry their own
visited cells, which tells for each link whether it will be met from the other side too;
so each link counts once for both ends.

Defined results: vectors that are null, zero or hold null or non-finite components link with
nothing and stay alone; vectors of each length link among themselves, on a grid of their own; rows with one vec_id never link to
each other, and each gets the result of their id; null ids keep their row and link with nothing; an
empty table gives an empty result; columns other than id and vector are not read. Ids are integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import star_edges
from ..session import materialise
from .common import arrow_limits

#: Vectors that codebooks are fitted on at most, queries that set the number of visits, and k-means rounds.
SAMPLE, QUERIES, ROUNDS = 16_384, 512, 12
#: Share of the queries' neighbours that the visited cells must hold, and sampled vectors for each codeword at least.
RECALL, PER_WORD = 0.95, 16
#: Rows of a chunk of a cell.
CHUNK = 1_024


def multi_sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index pairs of two distance lists by growing sum; ties by position in the sorted lists."""
    x, y = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen = [(a[x[0]] + b[y[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(x[i]), int(y[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(x) and q < len(y) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (a[x[p]] + b[y[q]], p, q))


def first_cells(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` cells (i * len(b) + j) of the traversal for each row of two distance tables.

    Only places with (i + 1)(j + 1) <= n in the sorted lists can be among the first n.
    """
    k1, k2 = a.shape[1], b.shape[1]
    n = min(n, k1 * k2)
    x, y = np.argsort(a, axis=1, kind="stable")[:, :n], np.argsort(b, axis=1, kind="stable")[:, :n]
    places = [(i, j) for i in range(x.shape[1]) for j in range(min(y.shape[1], n // (i + 1)))]
    i, j = (np.array(p) for p in zip(*places, strict=True))
    sums = np.take_along_axis(a, x, 1)[:, i] + np.take_along_axis(b, y, 1)[:, j]
    best = np.argsort(sums, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(x[:, i] * k2 + y[:, j], best, 1)


def unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one in double precision and the mask of the valid ones, from an Arrow column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False)
    out, valid = np.zeros((n, width)), sized.copy()
    if sized.any():
        values = pc.list_flatten(column.filter(pa.array(sized))).cast(pa.float64())
        x = np.nan_to_num(values.to_numpy(zero_copy_only=False), nan=np.nan, posinf=np.nan, neginf=np.nan).reshape(-1,
            width)  # null, too, becomes nan
        top = np.abs(x).max(1)
        good = np.isfinite(top) & (top > 0)
        valid[sized] = good
        x = x[good] / top[good, None]
        out[valid] = x / np.linalg.norm(x, axis=1)[:, None]
    return out, valid


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means with its start drawn from the sample."""
    r = np.random.default_rng(seed)
    book = x[r.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = _distances(x, book).argmin(1)
        n = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, near, x)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


class Grid:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float = RECALL):
        self.half = sample.shape[1] // 2
        # every so many vectors are queries and not fitted on, where there are enough
        apart = np.zeros(len(sample), dtype=bool)
        apart[:: max(2, len(sample) // QUERIES)] = len(sample) >= 8
        x, rest = (sample[apart], sample[~apart]) if apart.any() else (sample, sample)
        k = max(1, min(k, len(rest) // PER_WORD))
        self.books = codebook(rest[:, : self.half], k, 1), codebook(rest[:, self.half :], k, 2)
        r = np.random.default_rng(3)
        noise = r.standard_normal(x.shape)
        noise -= (noise * x).sum(1)[:, None] * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-300)[:, None]
        y = threshold * x + math.sqrt(1 - threshold * threshold) * noise
        (a, b), (c, d) = self.tables(x), self.tables(y)
        q = np.arange(len(x))
        own = a[q, c.argmin(1)] + b[q, d.argmin(1)]
        ranks = np.array([int(np.searchsorted(np.sort(b[i]), own[i] - np.sort(a[i]), side="left").sum()) for i in q])
        self.visits = int(min(max(1, math.ceil(np.quantile(ranks, recall)) + 1), k * k))

    def tables(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        return first_cells(*self.tables(x), self.visits)


def fit(vectors: DataFrame, width: int, n: int, threshold: float) -> Grid | None:
    """The grid for the ``n`` vectors of one length (None where none of the sampled ones is valid)."""
    rows = vectors.where(F.size("vec") == width).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()
    x, valid = unit(rows.column("vec"), width)
    return Grid(x[valid], min(1024, math.ceil(math.sqrt(n) / 4) + 1), threshold) if valid.any() else None


def _meet(threshold: float):
    """Verify one chunk of visitors against one chunk of a cell's members."""

    def run(members: pa.Table, visitors: pa.Table) -> pa.Table:
        none = pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not members.num_rows or not visitors.num_rows:
            return none
        read = lambda t, c: np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=np.float64).reshape(t.num_rows, -1)
        h, p = members.column("id").to_numpy(), visitors.column("visitor").to_numpy()
        link = (read(visitors, "its") @ read(members, "unit").T >= threshold) & (p[:, None] != h[None, :])
        if not link.any():
            return none
        i, j = np.nonzero(link)
        back = np.frombuffer(b"".join(members.column("visited").to_pylist()), dtype=np.int32).reshape(len(h), -1)
        home = visitors.column("its_home").to_numpy()
        alone = np.concatenate([~(back[j[s : s + 100_000]] == home[i[s : s + 100_000], None]).any(1) for s in range(0, len(i), 100_000)])
        counts = np.concatenate([np.bincount(i, minlength=len(p)), np.bincount(j[alone], minlength=len(h))])
        ids = np.concatenate([p, h])
        # smallest id reachable inside the chunk pair
        lp, lh, big = p.astype(np.int64), h.astype(np.int64), np.iinfo(np.int64).max
        while True:
            nh = np.minimum(lh, np.where(link, lp[:, None], big).min(0))
            np_ = np.minimum(lp, np.where(link, nh[None, :], big).min(1))
            if (nh == lh).all() and (np_ == lp).all():
                break
            lh, lp = nh, np_
        roots = np.concatenate([lp, lh])
        used = (counts > 0) | (roots != ids)
        return pa.table({"id": ids[used], "n": counts[used].astype(np.int64), "root": roots[used]})

    return run


def links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame | None:
    """(id, n, root): parts of link counts and forest edges; None where nothing can link."""
    arrow_limits(df.sparkSession)
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    finite = F.forall("vec",
        lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))) & F.exists("vec", lambda c: c != 0)
    out, lengths = None, vectors.where(finite).groupBy(F.size("vec").alias("w")).count().where("count > 1")
    for r in lengths.orderBy("w").toLocalIterator():  # as a rule, one
        grid = fit(vectors.where(finite), r.w, r["count"], threshold)
        if grid is not None:
            found = _links_of(vectors, grid, r.w, threshold)
            out = found if out is None else out.unionByName(found)
    return out


def _links_of(vectors: DataFrame, grid: Grid, width: int, threshold: float) -> DataFrame:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(grid)

    def encode(batches):
        g = shared.value
        for b in batches:
            ids = b.column(0).to_numpy()
            x, valid = unit(b.column(1), width)
            x, ids = x[valid], ids[valid]
            for at in range(0, len(x), 256):
                part = x[at : at + 256]
                cells = g.cells(part).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"id": ids[at : at + 256], "unit": pa.array([r.tobytes() for r in part], pa.binary()),
                    "home": cells[:, 0], "visited": pa.array([r.tobytes() for r in cells], pa.binary()),
                    "cells": pa.array(list(cells), pa.list_(pa.int32()))})

    coded = materialise(vectors.mapInArrow(encode, "id long, unit binary, home int, visited binary, cells array<int>"), "multi-index")
    visit = coded.select("id", "unit", "home", F.explode("cells").alias("cell"))
    members = coded.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("members"))
    visitors = coded.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    sizes = materialise(members.join(visitors, "cell").where("visitors > 1").select("cell", chunks("members").alias("hs"),
            chunks("visitors").alias("ps")), "multi-index-cells")
    sizes = F.broadcast(sizes)  # a row for each cell of the grid at most, 1024 x 1024
    of = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = coded.select("id", "unit", "visited", F.col("home").alias("cell")).join(sizes, "cell").select("id", "unit", "visited", "cell",
        of("hs").alias("h"), every("ps").alias("p"))
    right = visit.join(sizes, "cell").select(F.col("id").alias("visitor"), F.col("unit").alias("its"), F.col("home").alias("its_home"),
        F.col("cell").alias("its_cell"), of("ps").alias("its_p"), every("hs").alias("its_h"))
    return left.groupBy("cell", "h", "p").cogroup(right.groupBy("its_cell", "its_h", "its_p")).applyInArrow(_meet(threshold),
        "id long, n long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    found = links(df, id_col, vec_col, threshold)
    own = df.select(F.col(id_col).alias("vec_id"))
    if found is None:
        done = own.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id").cast("long"))
    else:
        parts = materialise(found, "multi-index-links")
        counts = parts.groupBy(F.col("id").alias("vec_id")).agg(F.sum("n").alias("n_links"))
        stars = star_edges(parts.select("id", "root"), "id", "root").withColumnsRenamed({"u": "vec_id", "v": "root"})
        done = own.join(counts, "vec_id", "left").join(stars, "vec_id", "left").select("vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("root", F.col("vec_id").cast("long")).alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
