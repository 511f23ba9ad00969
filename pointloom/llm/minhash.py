"""Near-duplicates by similarity of word shingles: MinHash bands propose, the whole shingle sets decide.

A text is the set of its runs of ``shingle`` words, case and white space folded; a text of
fewer words is one run of them all. Two texts are linked when the Jaccard similarity of
their sets is at least ``percent`` / 100. Texts of one set collapse to one class first. A class
has ``BANDS`` keys of ``ROWS`` minima each; a pair at similarity s shares a key with
probability 1 - (1 - s ** ROWS) ** BANDS, which is 0.99993 at 0.8 and more above. Every pair
that meets is verified on its whole sets.

Components need not all pairs of a band. First each member is verified against the band's
smallest class, so a group of near copies costs one pair a member. Only members that fail
there, and are in another component by then, are compared with all others of the band: those
and the others are dealt into chunks of bounded rows and shingles, and each pair of chunks is
one group of a cogroup, which counts all intersections by matrix products and returns a spanning
forest of the links, never the pairs. A pair that shares several keys counts in the first of
them only. So components are those of all pairs that share a key, and what is stored grows with the rows.

Shingle sets are not stored for the corpus: they are computed again from the text of one
document of each class that meets another.

Defined results: null and word-free texts are copies of each other; repeated rows share a
component; an empty table gives an empty result; null ids keep a row and never name a component
that has another id; columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import star_edges
from ..session import drop_path, materialise
from .common import broadcast_if_few, join_classes, map_texts

#: Keys of a class, and minima in each.
BANDS, ROWS = 24, 5
#: Rows and shingles of a chunk of a band, and columns of one matrix product.
CHUNK_ROWS, CHUNK_SHINGLES, COLUMNS = 256, 1_000_000, 4_096
#: Pairs up to which a chunk pair intersects one by one.
FEW_PAIRS = 2_048
#: Seed of the shingle hash and of the permutations.
SEED = 42

_random = np.random.default_rng(SEED)
_FACTOR = _random.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_TERM = _random.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_MIX = _random.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word runs, ascending."""
    words = text.decode().lower().encode().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.array([digest(g, SEED) for g in grams], dtype=np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _FACTOR + _TERM).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets of hashes reach the similarity."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _near_sizes(a: str, b: str, percent: int) -> Column:
    """Whether two sets of these sizes can reach the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sets(df: DataFrame, id_col: str, text_col: str, shingle: int, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """key and grams (the shingle set as bytes) of the classes in ``keys``, from the text of the document that names the class."""
    wanted = materialise(classes.join(keys, "key", "left_semi").select("key", F.col("rep").alias(id_col)), "wanted")
    texts = df.select(id_col, text_col)
    ids = broadcast_if_few(wanted.where(F.col(id_col).isNotNull()).select(id_col).distinct())
    texts = texts.join(ids, id_col, "left_semi").unionByName(texts.where(F.col(id_col).isNull()))  # null ids may name classes, too

    def make():
        def f(_, texts):
            sets = [shingles(t, shingle) for t in texts]
            return {"key": [_key(s) for s in sets], "grams": [s.tobytes() for s in sets]}

        return f

    found = map_texts(texts, id_col, text_col, make, [("key", "long", pa.int64()), ("grams", "binary", pa.binary())])
    found = found.join(broadcast_if_few(wanted.select("key")), "key", "left_semi")
    return materialise(found.groupBy("key").agg(F.first("grams").alias("grams")), "sets")


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets reach the similarity."""
    met = pairs.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")),
        "b").join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a")

    def run(batches):
        for batch in batches:
            raw = lambda n: [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(n)]  # noqa: B023, E731
            linked = pa.array([alike(x, y, percent) for x, y in zip(raw("ga"), raw("gb"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(linked)

    return materialise(met.select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long"), "verified")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the ``wanted`` pairs of sets (0 for the others)."""
    out = np.zeros(wanted.shape, dtype=np.int64)
    if wanted.sum() <= FEW_PAIRS:
        for i, j in zip(*np.nonzero(wanted), strict=True):
            out[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return out
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = (np.repeat(np.arange(len(x)), list(map(len, x))) for x in (left, right))
    shared = np.intersect1d(a, b)
    at_a, at_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    for at, x in ((at_a, a), (at_b, b)):
        at[at == len(shared)] = 0
        at[shared[at] != x if len(shared) else slice(None)] = -1
    for low in range(0, len(shared), COLUMNS):
        sides = []
        for at, row, n in ((at_a, row_a, len(left)), (at_b, row_b, len(right))):
            here = (at >= low) & (at < low + COLUMNS)
            side = np.zeros((n, COLUMNS), dtype=np.float32)
            side[row[here], at[here] - low] = 1
            sides.append(side)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)  # sums of at most COLUMNS ones are exact
    return out


def _meet(percent: int):
    """Compare one chunk of a band's loose members with one chunk of its members."""

    def run(loose: pa.Table, others: pa.Table) -> pa.Table:
        none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        if not loose.num_rows or not others.num_rows:
            return none
        band = loose.column("band")[0].as_py()
        read = lambda t, p: (t.column(f"{p}key").to_numpy(), t.column(f"{p}root").to_numpy(), np.array(t.column(f"{p}bands").to_pylist()),
            [np.frombuffer(x, dtype=np.uint64) for x in t.column(f"{p}grams").to_pylist()])
        (ka, ra, ba, ga), (kb, rb, bb, gb) = read(loose, ""), read(others, "its_")
        na, nb = np.array(list(map(len, ga))), np.array(list(map(len, gb)))
        wanted = (ra[:, None] != rb[None, :]) & (100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :]))
        for k in range(ba.shape[1]):  # another band that both share, and that comes before, has the pair
            wanted &= (ba[:, k, None] != bb[None, :, k]) | ~(ba[:, k] < band)[:, None]
        if not wanted.any():
            return none
        both = _overlaps(ga, gb, wanted)
        link = wanted & (100 * both >= percent * (na[:, None] + nb[None, :] - both))
        i, j = np.nonzero(link)
        if not len(i):
            return none
        # a forest: every member to the smallest key that its links reach here
        la, lb, big = ka.copy(), kb.copy(), np.iinfo(np.int64).max
        while True:
            new_b = np.minimum(lb, np.where(link, la[:, None], big).min(0))
            new_a = np.minimum(la, np.where(link, new_b[None, :], big).min(1))
            if (new_a == la).all() and (new_b == lb).all():
                break
            la, lb = new_a, new_b
        u, v = np.concatenate([ka, kb]), np.concatenate([la, lb])
        return pa.table({"u": u[u != v], "v": v[u != v]})

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id and ``component_id`` (smallest id reachable)."""

    def make():
        def f(_, texts):
            sets = [shingles(t, shingle) for t in texts]
            return {"key": [_key(s) for s in sets], "bands": [bands(s) for s in sets], "size": [len(s) for s in sets]}

        return f

    fields = [("key", "long", pa.int64()), ("bands", "array<long>", pa.list_(pa.int64())), ("size", "int", pa.int32())]
    docs = materialise(map_texts(df, id_col, text_col, make, fields), "shingles")
    classes = materialise(docs.groupBy("key").agg(F.min(id_col).alias("rep"), F.first("bands").alias("bands"),
            F.first("size").alias("size"), F.count("*").alias("n")), "classes")
    dealt = classes.select("key", "size", F.explode("bands").alias("band"))
    several = dealt.groupBy("band").agg(F.min(F.struct("key", "size")).alias("p"), F.count("*").alias("n")).where("n > 1")
    several = several.select("band", "n", F.col("p.key").alias("pivot"), F.col("p.size").alias("pivot_size"))
    met = materialise(join_classes(dealt, several, "band").select("band", "key", "size", "pivot", "pivot_size"), "bands")

    first = materialise(met.where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b"),
            _near_sizes("size", "pivot_size", percent).alias("near")).distinct(), "pairs")
    sets = _sets(df, id_col, text_col, shingle, classes, first.where("near").select(F.explode(F.array("a", "b")).alias("key")).distinct())
    linked = _verified(first.where("near").select("a", "b"), sets, percent)
    drop_path(df.sparkSession, sets._scratch_path)
    stars = star_edges(linked, "a", "b")
    a_root, b_root = (stars.select(F.col("u").alias(c), F.col("v").alias(f"{c}_root")) for c in "ab")
    failed = first.select("a", "b").join(linked, ["a", "b"], "left_anti").join(a_root, "a", "left").join(b_root, "b", "left")
    failed = failed.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select(F.col("a").alias("pivot"), F.col("b").alias("key"))

    # members of a band with loose ones, but for the pivot, which has been compared with all
    loose = met.join(failed, ["pivot", "key"], "left_semi").select("band", "key", F.lit(True).alias("loose"))
    held = materialise(met.where("key <> pivot").join(loose, ["band", "key"], "left").select("band", "key", "size",
            F.coalesce("loose", F.lit(False)).alias("loose")), "members")
    chunks = lambda rows, size: F.greatest(F.ceil(rows / CHUNK_ROWS), F.ceil(size / CHUNK_SHINGLES)).cast("int")
    mine = lambda c: F.coalesce(F.sum(F.when(F.col("loose"), c)), F.lit(0))
    sizes = held.groupBy("band").agg(F.count("*").alias("n"), mine(F.lit(1)).alias("nl"),
        chunks(mine(F.lit(1)), mine(F.col("size"))).alias("ls"), chunks(F.count("*"), F.sum("size")).alias("os")).where("n > 1 and nl > 0")
    held = materialise(join_classes(held, sizes.select("band", "n", "ls", "os"), "band"), "members")
    of = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    keys = held.select("key").distinct()
    roots = stars.select(F.col("u").alias("key"), F.col("v").alias("root"))
    known = _sets(df, id_col, text_col, shingle, classes, keys).join(classes.select("key", "bands"), "key").join(roots, "key", "left")
    known = materialise(known.select("key", "grams", "bands", F.coalesce("root", "key").alias("root")), "loose")
    left = held.where("loose").select("band", "key", of("ls").alias("l"), every("os").alias("o")).join(known, "key")
    right = held.select("band", "key", of("os").alias("o"), every("ls").alias("l")).join(known, "key")
    right = right.select(*[F.col(c).alias(f"its_{c}") for c in right.columns])
    forest = left.groupBy("band", "l", "o").cogroup(right.groupBy("its_band", "its_l", "its_o")).applyInArrow(_meet(percent), "u long, v long")
    more = materialise(forest.distinct(), "forest")
    stars = star_edges(linked.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(more), "u", "v")

    rooted = classes.join(stars.withColumnsRenamed({"u": "key", "v": "root"}), "key", "left").select("key", "rep", "n",
        F.coalesce("root", "key").alias("root"))
    moved = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return join_classes(docs.select(id_col, "key"), rooted.join(moved, "root").select("key", "n", "component_id"), "key").select(id_col,
        "component_id")
