"""Benchmark decontamination: a BM25 index of the test items searched by block-max WAND.

The index is inverted: for each word the items that hold it, in item order, with the
share of the item's own BM25 score that the word brings (so a score of 1 is the item
itself). Items are grouped into blocks and each word keeps its largest share in every
block. Every passage of every document is a query: a document is cut into strides,
a passage is two neighbouring strides, and the longest item fits into one stride, so
each occurrence of an item lies whole in some passage.

Document frequencies, the number of items and their mean length are those of all items, whatever
part of them an index holds, so a score means the same however many items there are.

For all passages of a document at once the block maxima of their distinct words are
summed, and a block is entered only by passages whose sum reaches the threshold.
Inside, WAND keeps the words' cursors in item order, skips to the first item that the
words before it can lift over the threshold, and scores it. All items above the
threshold are retrieved; none is lost, as only what cannot reach it is skipped.

A retrieved item is then verified on words: 80 % of its five-word shingles must stand
in the passage (items of fewer words are one shingle, so these match whole or not at all),
and 80 % of the words of its question and of its answer (its last sentence; the second
half where there is one sentence; a part without words is no condition).

Items are read in order into indexes of at most ``SHARD_WORDS`` words, and one pass over the
documents searches ``SHARDS_A_PASS`` of them: what is broadcast at once, and held by a worker, has
a bounded size. Only benchmarks beyond that, some 100,000 items, need a further pass.

Defined results: null or word-free texts and items match nothing; words are runs
between ASCII white space and punctuation, with A-Z lower-cased; equal items are reported
each under its own id, repeated rows of items count once; repeated rows of documents repeat results; empty
tables give an empty result; columns other than ids and texts are not read; ids keep their types.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialise
from .common import arrow_limits, join_classes

#: BM25's constants, the retrieval threshold, shares of shingles and of words that verify.
K1, B, THRESHOLD, SHINGLES, WORDS = 1.2, 0.75, 0.6, 0.8, 0.8
#: Items in a block, words of the items in an index, indexes in a pass, words in a stride at least, words in a shingle.
BLOCK, SHARD_WORDS, SHARDS_A_PASS, STRIDE, SHINGLE = 4, 200_000, 25, 64, 5
_APART = bytes.maketrans(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 31)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_APART).split()


def parts_of(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: the last sentence is the answer, or the second half of a single one."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if words_of(s.encode())]
    if len(sentences) > 1:
        return words_of(" ".join(sentences[:-1]).encode()), words_of(sentences[-1].encode())
    words = words_of(text.encode())
    return words[: len(words) // 2], words[len(words) // 2 :]


@dataclass(frozen=True)
class Corpus:
    """What a score takes from all items: their number, their mean length and document frequencies."""

    items: int
    mean: float

    @classmethod
    def of(cls, texts: list[str]) -> tuple[Corpus, Counter]:
        words = [w for t in texts if (w := words_of((t or "").encode()))]
        return cls(len(words), sum(map(len, words)) / max(1, len(words))), Counter(t for w in words for t in set(w))


class Index:
    """The inverted index over items [(id, text), ...]; statistics are those of all items (by default these)."""

    def __init__(self, items: list[tuple[int, str]], corpus: Corpus | None = None, df: dict[bytes, int] | None = None):
        rows = [(i, t, w) for i, t in items if (w := words_of((t or "").encode()))]
        if corpus is None:
            corpus, df = Corpus.of([t for _, t, _ in rows])
        self.ids = [i for i, _, _ in rows]
        self.words = [w for _, _, w in rows]
        self.parts = [parts_of(t) for _, t, _ in rows]
        self.stride = max([STRIDE, *map(len, self.words)])
        n = corpus.items
        self.vocab = {t: k for k, t in enumerate(sorted({t for w in self.words for t in w}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        for k, w in enumerate(self.words):
            tf = Counter(w)
            norm = K1 * (1 - B + B * len(w) / corpus.mean)
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            own = sum(raw.values())
            for t, x in raw.items():
                postings[self.vocab[t]].append((k, x / own))
        self.postings = postings
        self.blocks = (len(rows) + BLOCK - 1) // BLOCK
        # the largest share of a word in each block that has it: blocks and maxima of word t at first[t]:first[t + 1]
        maxima = [{} for _ in postings]
        for best, p in zip(maxima, postings, strict=True):
            for k, x in p:
                best[k // BLOCK] = max(best.get(k // BLOCK, 0.0), x)
        self.first = np.cumsum([0, *map(len, maxima)])
        self.block = np.array([b for m in maxima for b in m], dtype=np.int64)
        self.block_max = np.array([x for m in maxima for x in m.values()], dtype=np.float32)
        self.size = [min(SHINGLE, len(w)) for w in self.words]
        self.shingles = [list({tuple(w[a : a + n]) for a in range(len(w) - n + 1)}) for w, n in zip(self.words, self.size, strict=True)]

    def bounds(self, stride: np.ndarray, terms: np.ndarray, strides: int) -> np.ndarray:
        """Sums of the block maxima of distinct (stride, word) pairs, by stride and block."""
        n = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = np.repeat(stride, n) * self.blocks + self.block[at]
        return np.bincount(cell, self.block_max[at], strides * self.blocks).reshape(strides, self.blocks)

    def wand(self, terms: Iterable[int], low: int, high: int, floor: float) -> list[tuple[int, float]]:
        """Items of [low, high) whose score reaches ``floor``: cursors in item order, pivot by upper bounds."""
        lists = []
        for t in terms:
            every = self.postings[t]  # in the order of items
            p = every[bisect_left(every, (low,)) : bisect_left(every, (high,))]
            if p:
                lists.append([p, 0, max(x for _, x in p)])
        heads = [(c[0][0][0], k) for k, c in enumerate(lists)]
        heapq.heapify(heads)
        out = []
        while heads:
            order = sorted(heads)
            bound, pivot = 0.0, None
            for item, k in order:
                bound += lists[k][2]
                if bound >= floor - 1e-6:
                    pivot = item
                    break
            if pivot is None:
                break
            score, left = 0.0, []
            for item, k in order:
                p, at, _ = lists[k]
                while at < len(p) and p[at][0] < pivot:
                    at += 1
                if at < len(p) and p[at][0] == pivot:
                    score += p[at][1]
                    at += 1
                lists[k][1] = at
                if at < len(p):
                    left.append((p[at][0], k))
            heads = left
            if score >= floor - 1e-6:
                out.append((pivot, score))
        return out

    def search(self, words: list[bytes]) -> dict[int, tuple[float, float, float, float]]:
        """{item place: (score, shingle share, question share, answer share)} of the verified leaks in a text."""
        if not self.ids:
            return {}
        get = self.vocab.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return {}
        found: dict[int, tuple[float, float, float, float]] = {}
        keys = np.unique(at // self.stride * len(self.vocab) + ids[at])
        stride_of, terms = keys // len(self.vocab), keys % len(self.vocab)
        last = int(stride_of[-1])
        step = 256  # strides whose sums are held at once
        for first in range(0, last + 1, step):
            a, b = np.searchsorted(stride_of, [first, first + step + 1])
            if a == b:
                continue
            sums = self.bounds(stride_of[a:b] - first, terms[a:b], step + 2)
            bound = sums[:-2] + sums[1:-1]
            entered = np.argwhere(bound >= THRESHOLD - 1e-4)
            passage = -1
            mine: list[int] = []
            for w, block in entered.tolist():
                if w != passage:
                    passage = w
                    lo, hi = np.searchsorted(stride_of, [first + w, first + w + 2])
                    mine = np.unique(terms[lo:hi]).tolist()
                for item, score in self.wand(mine, block * BLOCK, (block + 1) * BLOCK, THRESHOLD):
                    start = (first + w) * self.stride
                    rates = self.verify(item, words[start : start + 2 * self.stride])
                    if rates and (score, *rates) > found.get(item, (0.0,)):
                        found[item] = (score, *rates)
        return found

    def verify(self, item: int, passage: list[bytes]) -> tuple[float, float, float] | None:
        """Shares of the item's shingles, question words and answer words in the passage; None where they don't suffice."""
        have = set(zip(*(passage[k:] for k in range(self.size[item])), strict=False))
        own = self.shingles[item]
        share = sum(s in have for s in own) / len(own)
        if share < SHINGLES:
            return None
        counts = Counter(passage)
        rates = []
        for part in self.parts[item]:
            c = Counter(part)
            rates.append(sum(min(n, counts[w]) for w, n in c.items()) / len(part) if part else 1.0)
        return (share, *rates) if min(rates) >= WORDS else None


def shards(items: DataFrame, item_id: str, item_text: str) -> Iterable[Index]:
    """Indexes of bounded size over the distinct items in order, all with the statistics of all items."""
    kind = items.schema[item_id].dataType.simpleString()

    def split(batches):
        for b in batches:
            words = [words_of(t or b"") for t in b.column(2).to_pylist()]
            kept = pa.array([bool(w) for w in words], pa.bool_())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.binary()))], names=["item", "body", "words"])
            yield out.filter(kept)

    rows = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("body")).distinct()
    rows = materialise(rows.withColumn("raw", F.col("body").cast("binary")).mapInArrow(split,
            f"item {kind}, body string, words array<binary>"), "items")
    seen = rows.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    corpus = Corpus(seen.n, seen.mean or 0.0)
    df = rows.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    each = rows.select("item", "body", F.size("words").alias("size"), F.explode(F.array_distinct("words")).alias("word"))
    each = join_classes(each, df.withColumn("n", F.col("df")), "word")  # a frequent word is in every item
    each = each.groupBy("item", "body").agg(F.first("size").alias("n"), F.collect_list("word").alias("words"), F.collect_list("df").alias("dfs"))
    held: list = []
    known: dict[bytes, int] = {}
    size = 0
    for r in each.orderBy("item", "body").toLocalIterator():
        if held and size + r.n > SHARD_WORDS:
            yield Index(held, corpus, known)
            held, known, size = [], {}, 0
        held.append((r.item, r.body))
        known.update(zip(map(bytes, r.words), r.dfs, strict=True))
        size += r.n
    if held:
        yield Index(held, corpus, known)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text") -> DataFrame:
    """One row per document and test item that it leaks: ids, best score and the shares that verified it."""
    spark = docs.sparkSession
    arrow_limits(spark)
    rates = ("score", "shingle_share", "question_share", "answer_share")
    schema = ", ".join([f"doc_id {docs.schema[id_col].dataType.simpleString()}", f"item_id {items.schema[item_id].dataType.simpleString()}",
        *(f"{x} double" for x in rates)])
    item_type = to_arrow_type(items.schema[item_id].dataType)
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    indexes = shards(items, item_id, item_text)
    out = None
    while part := list(itertools.islice(indexes, SHARDS_A_PASS)):
        shared = [spark.sparkContext.broadcast(x) for x in part]

        def run(batches, shared=shared):
            own = [x.value for x in shared]
            for b in batches:
                texts = [(k, words_of(t)) for k, t in enumerate(b.column(1).to_pylist()) if t]
                rows = [(k, index.ids[place], *x) for k, words in texts for index in own for place, x in sorted(index.search(words).items())]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type),
                        *(pa.array(c, pa.float64()) for c in cols[2:])], names=["doc_id", "item_id", *rates])

        got = body.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], schema)
