"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Each whole text (null: empty) becomes token ids and an end id. Only longer documents are cut, from the end, so that
only their first piece may be shorter than a sequence. What best fit decides depends on lengths alone, and there are no
more lengths than tokens in a sequence. So:

1. one pass over the texts writes the pieces, each with its rank among the pieces of its length in its task;
2. the pieces are counted by length (``capacity`` rows at most, which is all that the driver sees);
3. best-fit decreasing runs over the lengths: a segment tree over remaining capacities finds the tightest open
   sequences in logarithmic time, and a run of documents of equal length is dealt to a run of sequences that are equally full;
   sequences, capacities and order are those of placing one document after the other;
4. a piece finds its sequence by its length and its rank, by bisection in the runs of its length. There are at most some
   ``3 * capacity`` runs of open sequences at any time, however many documents there are, so the runs are broadcast.

Defined cases: an empty or null text is one piece that holds the end id; rows with a null id or with equal ids are
packed like any other; columns beside the id and the text are ignored, whatever their names; an empty table gives no rows.
Which of two pieces of equal length goes first is not defined, the number of sequences is.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .bpe import Vocabulary
from .common import arrow_limits, fresh

#: Tokens of a sequence.
CAPACITY = 1024
#: Id that ends a document.
END_ID = 2
#: Longer texts, and those with special tokens or characters that Unicode versions class differently, are left to the library itself.
LONGEST_FAST = 200_000


class OpenSequences:
    """Runs of sequences (first, last + 1) by remaining capacity, under a segment tree that knows which capacities have any."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        i = self.leaves + room
        self.any[i] = bool(self.runs[room])
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def put(self, room: int, run: tuple[int, int]) -> None:
        if room and run[0] < run[1]:
            self.runs[room].append(run)
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of ``length`` or more that a sequence has."""
        i = self.leaves + length
        if self.any[i]:
            return length
        while i > 1:
            if not i & 1 and self.any[i + 1]:  # the nearest right neighbour with a sequence
                i += 1
                while i < self.leaves:
                    i = 2 * i + (not self.any[2 * i])
                return i - self.leaves
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, np.ndarray], int]:
    """Runs of best-fit decreasing for so many pieces of each length, and the number of sequences.

    For each length an array with rows (first rank, first sequence, pieces a sequence takes one after the other, offset of the first).
    """
    opened, free, out = 0, OpenSequences(capacity), {}
    for length in sorted(counts, reverse=True):
        rank, end, runs = 0, counts[length], []
        while rank < end:
            room = free.tightest(length)
            if room is None:  # open as many as the rest needs
                room = capacity
                run = (opened, opened + -(-(end - rank) // (room // length)))
                opened = run[1]
            else:
                run = free.take(room)
            each = room // length  # the tightest sequence stays the tightest until nothing more fits
            runs.append((rank, run[0], each, capacity - room))
            full = min(run[1] - run[0], (end - rank) // each)
            free.put(room - each * length, (run[0], run[0] + full))
            rank += full * each
            at = run[0] + full
            if rank < end and at < run[1]:  # the last one is not filled by this length
                free.put(room - (end - rank) * length, (at, at + 1))
                rank, at = end, at + 1
            free.put(room, (at, run[1]))
        out[length] = np.array(runs, dtype=np.int64)
    return out, opened


class Tokens:
    """Ids as the tokenizers library gives them; plain texts take a faster encoder over the same merges, others the library."""

    def __init__(self, file: str):
        import tiktoken
        from tokenizers import Tokenizer

        vocab = Vocabulary.__new__(Vocabulary)
        vocab.__setstate__({"file": file})
        self.library = Tokenizer.from_str(file)
        self.library.no_truncation()
        self.library.no_padding()
        ranks = {p: i for i, p in enumerate(vocab.pieces) if p and i not in vocab.special.values()}
        self.fast = tiktoken.Encoding("packing", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
            mergeable_ranks=ranks, special_tokens={})
        special = "|".join(map(regex.escape, vocab.special)) or r"(?!)"
        # letters of Latin, Greek and Cyrillic, common marks, and CJK have had their classes since early versions of Unicode
        self.slow = regex.compile(rf"{special}|[^\x00-ȳΑ-ΡΣ-ώЀ-ҁ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]")

    def ids(self, text: str) -> np.ndarray:
        if len(text) > LONGEST_FAST or self.slow.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


_HERE: dict[int, Tokens] = {}


def _tokens(file: str) -> Tokens:
    """The worker's encoder, kept between tasks."""
    if hash(file) not in _HERE:
        _HERE.clear()
        _HERE[hash(file)] = Tokens(file)
    return _HERE[hash(file)]


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row a piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, with ``ids`` also ``token_ids``, and in ``__part``
    and ``__rank`` its place among the pieces of its length."""
    spark = df.sparkSession
    arrow_limits(spark)
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, __part int, __rank long" + (", token_ids array<int>" if ids else "")

    def run(batches):
        made, part, seen = _tokens(shared.value), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            rows, places, bodies = [], [], []
            for at, text in enumerate(b.column(1).to_pylist()):
                got = np.append(made.ids(text or ""), np.uint32(end_id)).astype("<u4")
                cut = len(got) % capacity or capacity  # the first piece takes what is left of whole ones
                for k, start in enumerate([0, *range(cut, len(got), capacity)]):
                    body = got[start : cut if k == 0 else start + capacity]
                    rows.append((k, start, len(body), zlib.crc32(body.tobytes()), part, seen[len(body)]))
                    seen[len(body)] += 1
                    places.append(at)
                    if ids:
                        bodies.append(body.astype("<i4"))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [b.column(0).take(pa.array(places, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]]
            names = [id_col, "piece", "start", "length", "ids_crc32", "__part", "__rank"]
            if ids:
                arrays.append(pa.array(bodies, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        pa.default_memory_pool().release_unused()

    body = fresh(df, "__body")
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias(body)).mapInArrow(run, schema)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row a piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and with ``ids`` its ``token_ids``."""
    spark = df.sparkSession
    # ranks must not change once they are counted, so the pieces are a table from here on
    cut = materialise(pieces(df, path, id_col, text_col, capacity, end_id, ids), "pieces")
    local = cut.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("__n"))
    before = local.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__part")) - F.col("__n"))
    before = materialise(before, "ranks")
    runs, _ = plan({r.length: r.n for r in before.groupBy("length").agg(F.sum("__n").alias("n")).collect()}, capacity)
    shared = spark.sparkContext.broadcast(runs)
    kept = [c for c in cut.columns if not c.startswith("__")]
    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"

    def place(batches):
        runs = shared.value
        for b in batches:
            lengths, ranks = b.column(len(kept)).to_numpy(), b.column(len(kept) + 1).to_numpy()
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                of = runs[int(lengths[own[0]])]
                first, at, each, start = of[np.searchsorted(of[:, 0], ranks[own], "right") - 1].T
                past = ranks[own] - first
                sequence[own], offset[own] = at + past // each, start + past % each * lengths[own]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    ranked = cut.join(before.select("__part", "length", "__before"), ["__part", "length"])
    numbered = ranked.select(*[F.col(f"`{c}`") for c in kept], F.col("length").alias("__length"), (F.col("__before") + F.col("__rank")).alias("__place"))
    placed = numbered.mapInArrow(place, schema)
    last = ["token_ids"] if ids else []
    return placed.select(F.col(f"`{id_col}`"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *last)


def sequences(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``token_ids`` and ``docs`` (id, piece, offset), each of at most ``capacity`` tokens."""
    placed = pack(df, path, id_col, text_col, capacity, end_id, ids=True)
    own = F.struct("offset", "token_ids", F.col(f"`{id_col}`").alias("doc"), "piece")
    grouped = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(own)).alias("own"))
    docs = F.transform("own", lambda x: F.struct(x.doc.alias(id_col), x.piece.alias("piece"), x.offset.alias("offset")))
    return grouped.select("sequence_id", F.flatten(F.transform("own", lambda x: x.token_ids)).alias("token_ids"), docs.alias("docs"))


def best_fit_one_by_one(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """Remaining capacities after best-fit decreasing, one piece after the other; the plain rule for comparison."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        i = bisect_right(rooms, n - 1)
        room = rooms.pop(i) if i < len(rooms) else capacity
        rooms.insert(bisect_right(rooms, room - n), room - n)
    return rooms
