"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two fingerprints within
``max_bits`` must have one segment differing in at most one bit (two segments
for up to three bits). Every segment is indexed once for each of its bits with
that bit wildcarded, so such a pair meets by equality on one signature. What
meets is verified on all 64 bits.

Copies collapse to one row per distinct fingerprint before the join. Signatures
that only one fingerprint has, nearly all, are dropped by a count before anything
is paired; the rest are joined on signature plus one equal piece of the other
bits, which keeps a signature shared by very many fingerprints from being paired
all against all. Links become components by ``operators.graph``.

Defined results: a null or word-free text has fingerprint zero and is linked like
any other; repeated rows share a fingerprint and so a component; an empty table
gives an empty result; null ids keep a row and never name a component that has
another id; columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.graph import star_edges
from .common import join_classes, map_texts

#: Seed of the shingle hash.
SEED = 42
#: Fingerprints that one task expands to their signatures.
FINGERPRINTS = 8_000


def fingerprint(text: bytes, shingle: int = 3) -> bytes:
    """The 8 bytes (most significant first) of a text's fingerprint."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return bytes(8)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    digest = xxhash.xxh64_digest
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    raw = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), dtype=np.uint8).reshape(-1, 8)
    n = len(raw)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(raw[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: bool = False) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed long (with ``keep``: beside all columns)."""

    def make():
        def f(_, texts):
            return {"fp": np.frombuffer(b"".join(fingerprint(t, shingle) for t in texts), dtype=">i8").astype(np.int64)}

        return f

    return map_texts(df, id_col, text_col, make, [("fp", "long", pa.int64())], keep)


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment; one of them differs by one bit at most."""
    n = (max_bits + 2) // 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def linked_pairs(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints of ``fps`` (one column ``fp``) within ``max_bits``.

    A pair may appear more than once.
    """
    signatures = []
    for s, (low, width) in enumerate(_segments(max_bits)):
        mask = ((1 << width) - 1) << low
        for j in range(width):
            hole = mask & ~(1 << (low + j))
            hole -= (1 << 64) if hole >= 1 << 63 else 0
            # 64 bits of segment do not fit beside a tag, so the tag is hashed in with the masked bits
            signatures.append(F.struct(F.lit(64 * s + j).cast("short").alias("tag"),
                F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(hole)), low).alias("key")))
    # a small table is read as one or two partitions, which would expand it 64-fold in as many tasks
    tasks = 1 + fps.count() // FINGERPRINTS
    met = fps.repartition(tasks).select("fp", F.explode(F.array(*signatures)).alias("s")).select("fp", "s.tag", "s.key")
    both = met.withColumn("n", F.count("*").over(Window.partitionBy("tag", "key"))).where("n > 1").drop("n")
    # the bits outside the segment differ by max_bits at most: of max_bits + 1 pieces one is equal
    pieces = max_bits + 1
    cases = []
    for s, (low, width) in enumerate(_segments(max_bits)):
        rest = [b for b in range(64) if not low <= b < low + width]
        cuts = [len(rest) * i // pieces for i in range(pieces + 1)]
        for p in range(pieces):
            m = sum(1 << b for b in rest[cuts[p] : cuts[p + 1]])
            m -= (1 << 64) if m >= 1 << 63 else 0
            cases.append((s, p, m))
    piece = F.array(*[F.when(F.col("tag").between(64 * s, 64 * s + 63),
            F.struct(F.lit(p).alias("p"), F.col("fp").bitwiseAND(F.lit(m)).alias("v"))) for s, p, m in cases])
    dealt = both.select("fp", "tag", "key", F.explode(F.filter(piece, lambda x: x.isNotNull())).alias("x")).select("fp",
        F.xxhash64("tag", "key", "x.p", "x.v").alias("k"))
    a, b = dealt.withColumnRenamed("fp", "a"), dealt.withColumnRenamed("fp", "b")
    return a.join(b, "k").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable).

    The fingerprints are computed once and kept in shared storage, as three later
    reads need them.
    """
    from ..session import materialise

    docs = materialise(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    classes = materialise(docs.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("n")), "classes")
    stars = star_edges(linked_pairs(classes.select("fp"), max_bits), "a", "b")  # components of fingerprints
    rooted = classes.join(stars.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").select("fp", "rep",
        F.coalesce("root", "fp").alias("root"))
    moved = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    # only classes in a component of two or more need the second look-up; alone, a class is its own component
    several = rooted.join(moved.where("size > 1"), "root").select("fp", F.col("component_id").alias("joined"))
    found = classes.join(several, "fp", "left").select("fp", "n", F.coalesce("joined", "rep").alias("component_id"))
    return join_classes(docs, found, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
