"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The frequent words (those that the public vocabulary has whole, the ones its makers
found frequent, and with ``frequent_words`` the most frequent others of all the texts, which
have several ids each) are compiled into a minimal acyclic automaton: words that end alike share their suffixes, and the
outputs that the arcs carry add up to a word's place in the table of ids. The
automaton is laid out as a double array of 32-bit numbers, broadcast once (its
size is that of the vocabulary, about 2 MB), written by each worker into its own
scratch space and memory-mapped from there. A word outside it is merged exactly,
pair by pair in the order of the vocabulary's merges, and kept in a bounded
cache of the worker.

Decoding turns ids back into bytes by table. Encoding then decoding returns the
text itself.

Defined results: a null text counts as empty and has no ids; the string of the
special token is one id, as the tokenizers library does it by default; texts of
any length are encoded whole; repeated rows give repeated results; an empty table
gives an empty result; columns other than id and text are not read unless kept.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Words that a worker remembers besides the lexicon.
CACHE_WORDS = 200_000
#: Symbols above which a word is merged alone, with a heap.
LONG_WORD = 400
#: Texts whose words are looked up together.
TEXTS_AT_ONCE = 250
#: Words that a task counts before it passes them on; words that join the lexicon, their least count and greatest length.
TASK_WORDS, MORE_WORDS, LEAST, LONGEST = 200_000, 20_000, 3, 64
#: The pattern that splits text before the merges; fixed by the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same over ASCII, where the standard module is faster.
SPLIT_ASCII = SPLIT.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace("?A-Za-z+", "?[A-Za-z]+").replace("?0-9+", "?[0-9]+")
_NONE = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = (x for x in range(256, 512))
    return {chr(b if b in shown else next(free)): b for b in range(256)}


class Vocabulary:
    """Ids, merges and special strings of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.file = open(path, encoding="utf-8").read()  # noqa: SIM115
        self._parse()

    def __getstate__(self):
        return {"file": self.file}

    def __setstate__(self, state):
        self.file = state["file"]
        self._parse()

    def _parse(self) -> None:
        spec = json.loads(self.file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for word, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in word)
        for word, i in special.items():
            self.pieces[i] = word.encode()
        self.special = special
        self.byte_id = [vocab[c] for c in sorted(letters, key=letters.get)]
        self.merges: dict[int, int] = {}
        self._table = None
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the earliest merge first, leftmost on ties, until none applies."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        get = self.merges.get
        found = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == _NONE:
                break
            i = found.index(best)
            ids[i : i + 2] = [best & 0xFFFFFFFF]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 32 | ids[i], _NONE)
            if i < len(found):
                found[i] = get(ids[i] << 32 | ids[i + 1], _NONE)
        return ids

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 32 | id of the merges of pairs, by open addressing in two flat tables."""
        if self._table is None:
            keys = np.array(list(self.merges), dtype=np.int64)
            values = np.array(list(self.merges.values()), dtype=np.int64)
            bits = max(8, int(len(keys)).bit_length() + 2)
            slots, found = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, _NONE, dtype=np.int64)
            at = self._slot(keys, bits)
            left = np.arange(len(keys))
            while len(left):
                free = left[slots[at[left]] == -1]
                slots[at[free]] = keys[free]  # of several keys for a slot the last one stays
                won = slots[at[left]] == keys[left]
                found[at[left[won]]] = values[left[won]]
                left = left[~won]
                at[left] = (at[left] + 1) & ((1 << bits) - 1)
            self._table = bits, slots, found
        bits, slots, found = self._table
        keys = a << 32 | b
        at = self._slot(keys, bits)
        out = np.full(len(keys), _NONE, dtype=np.int64)
        left = np.arange(len(keys))
        while len(left):
            here = slots[at[left]]
            hit = here == keys[left]
            out[left[hit]] = found[at[left[hit]]]
            left = left[~hit & (here != -1)]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)
        return out

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many words at once, each as little-endian 32-bit ids: in every round each word takes its next merge."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[k] = array.array("I", self.merge(w)).tobytes()
            elif w:
                short.append(k)
        if not short:
            return out
        number = np.array(short, dtype=np.int64)
        n = np.array([len(words[k]) for k in short], dtype=np.int64)
        ids = np.array(self.byte_id, dtype=np.int64)[np.frombuffer(b"".join([words[k] for k in short]), dtype=np.uint8)]
        done_ids, done_n, done_number = [], [], []
        start = np.cumsum(n) - n
        rank = np.full(len(ids), _NONE, dtype=np.int64)  # of the pair that begins here; none at a word's end
        inner = np.ones(len(ids), dtype=bool)
        inner[start + n - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self._ranks(ids[at], ids[at + 1])
        while len(number):
            best = np.minimum.reduceat(rank, start)
            over = best == _NONE
            if over.any():
                gone = np.repeat(over, n)
                done_ids.append(ids[gone])
                done_n.append(n[over])
                done_number.append(number[over])
                ids, rank, n, number, best = ids[~gone], rank[~gone], n[~over], number[~over], best[~over]
                start = np.cumsum(n) - n
                if not len(number):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, n))
            word = np.searchsorted(start, hits, side="right") - 1
            i = hits[np.diff(word, prepend=-1) > 0]  # the leftmost of each word
            ids[i] = best & 0xFFFFFFFF
            keep = np.ones(len(ids), dtype=bool)
            keep[i + 1] = False
            i = i - np.arange(len(i))  # its place once the second symbols are gone
            ids, rank = ids[keep], rank[keep]
            n = n - 1
            start = np.cumsum(n) - n
            last = start + n - 1
            rank[i] = _NONE
            right = i[i < last]
            rank[right] = self._ranks(ids[right], ids[right + 1])
            left = i[i > start]
            rank[left - 1] = self._ranks(ids[left - 1], ids[left])
        flat, sizes, owners = np.concatenate(done_ids).astype("<u4").tobytes(), np.concatenate(done_n), np.concatenate(done_number)
        ends = np.cumsum(sizes) * 4
        for k, a, b in zip(owners.tolist(), (ends - sizes * 4).tolist(), ends.tolist(), strict=True):
            out[k] = flat[a:b]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << 32 | ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or get(ids[i] << 32 | ids[j], _NONE) != m:
                continue
            ids[i], ids[j] = m & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := get(ids[a] << 32 | ids[b], _NONE)) != _NONE:
                    heapq.heappush(heap, (m, a))
        return [x for x in ids if x >= 0]


class Lexicon:
    """A minimal acyclic transducer from words to ids, as flat 32-bit arrays.

    ``base`` and ``check`` are the double array: the arc of state s for byte b is
    at base[s] + b and exists if check there is s + 1; ``target`` and ``gain`` are
    its end and its output, ``final`` marks the states that end a word. The outputs
    along a word add up to its rank in byte order, which ``start`` and ``ids`` map to its ids.
    """

    PARTS = ("base", "final", "check", "target", "gain", "start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for k in self.PARTS:
            setattr(self, k, arrays[k])

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        order = sorted(w for w in words if w)
        register: dict[tuple, int] = {}
        arcs_of: list[tuple[tuple[int, int], ...]] = []
        final_of: list[bool] = []
        below: list[int] = []  # words that can be read from a state on

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(arcs_of)
                arcs_of.append(key[1])
                final_of.append(key[0])
                below.append(key[0] + sum(below[t] for _, t in key[1]))
            return register[key]

        path: list[list] = [[False, []]]  # nodes along the last word that may still get arcs
        last = b""
        for w in order:
            k = next((i for i, (a, b) in enumerate(zip(last, w, strict=False)) if a != b), min(len(last), len(w)))
            while len(path) > k + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], close(node)))
            path.extend([False, []] for _ in w[k:])
            path[-1][0] = True
            last = w
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        root = close(path[0])
        n = len(arcs_of)
        place = [root, *(i for i in range(n) if i != root)]  # the root becomes state 0
        number = {s: i for i, s in enumerate(place)}
        size = 1 << 12
        check, target, gain, base = [0] * size, [0] * size, [0] * size, [0] * n
        free = 0
        for i in sorted(range(n), key=lambda i: -len(arcs_of[place[i]])):
            arcs = arcs_of[place[i]]
            if not arcs:
                continue
            while free < size and check[free]:
                free += 1
            at = first = max(0, free - arcs[0][0])
            while True:
                while at + 256 >= size:
                    for x in (check, target, gain):
                        x.extend([0] * size)
                    size *= 2
                if not any(check[at + b] for b, _ in arcs):
                    break
                at += 1
            base[i] = at
            passed = int(final_of[place[i]])
            for b, t in arcs:
                check[at + b], target[at + b], gain[at + b] = i + 1, number[t], passed
                passed += below[t]
            if at - first > 50:  # a crowded stretch is left behind; its last gaps stay unused
                free += (at - first) // 4
        u4 = lambda x: np.asarray(x, dtype=np.uint32)
        ids = [words[w] for w in order]
        return cls({"base": u4(base), "final": u4([final_of[s] for s in place]), "check": u4(check), "target": u4(target), "gain": u4(gain),
            "start": u4(np.cumsum([0, *map(len, ids)])), "ids": u4([x for y in ids for x in y])})

    @property
    def states(self) -> int:
        return len(self.base)

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, k), dtype="<u4") for k in self.PARTS]
        return np.array([len(p) for p in parts], dtype="<u4").tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def mapped(cls, blob: bytes) -> Lexicon:
        """The lexicon over a memory-mapped copy of ``blob`` in the worker's scratch space."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)).cast("I")
        sizes, at, out = view[: len(cls.PARTS)], len(cls.PARTS), {}
        for k, n in zip(cls.PARTS, sizes, strict=True):
            out[k] = view[at : at + n]
            at += n
        return cls(out)

    def find(self, word: bytes):
        """The ids of ``word``, or None where the lexicon doesn't have it."""
        base, check, target, gain = self.base, self.check, self.target, self.gain
        state = rank = 0
        for b in word:
            at = base[state] + b
            if check[at] != state + 1:
                return None
            rank += gain[at]
            state = target[at]
        if not self.final[state]:
            return None
        return self.ids[self.start[rank] : self.start[rank + 1]]


def whole_words(vocab: Vocabulary, more: Iterable[bytes] = ()) -> dict[bytes, list[int]]:
    """The lexicon's entries: vocabulary words that merge to their own id, and ``more`` with the ids they merge to."""
    split = regex.compile(SPLIT)
    out = {}
    for i, w in enumerate(vocab.pieces):
        if w and w.decode("utf-8", "ignore").encode() == w and len(split.findall(w.decode())) == 1 and vocab.merge(w) == [i]:
            out[w] = [i]
    # a word of the texts that holds a character of unknown class is left to the library's splitter
    out.update((w, vocab.merge(w)) for w in more if w not in out and not any(unicodedata.category(c) == "Cn" for c in w.decode()))
    return out


def frequent_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[bytes]:
    """The most frequent words, as the pattern splits them, of all texts; each is counted wherever it occurs."""
    from pyspark.sql import functions as F

    def counted(n: Counter) -> pa.RecordBatch:
        kept = [(w, k) for w, k in n.items() if len(w) <= LONGEST]
        return pa.RecordBatch.from_pydict({"w": pa.array([w for w, _ in kept], pa.string()), "n": pa.array([k for _, k in kept], pa.int64())})

    def run(batches):
        split, n = regex.compile(SPLIT).findall, Counter()
        ascii_split = re.compile(SPLIT_ASCII, re.A).findall
        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(ascii_split(t) if t.isascii() else split(t))
            if len(n) > TASK_WORDS:  # what a task holds is bounded, what is counted is not: the parts are added up
                yield counted(n)
                n.clear()
        yield counted(n)

    found = df.select(F.col(text_col).alias("t")).where(F.col(text_col).isNotNull()).mapInArrow(run, "w string, n long")
    found = found.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    return [r.w.encode() for r in found.orderBy(F.desc("n"), "w").limit(MORE_WORDS).collect()]


class Encoder:
    """Encodes and decodes whole texts in a worker."""

    def __init__(self, vocab: Vocabulary, blob: bytes):
        self.vocab, self.lexicon = vocab, Lexicon.mapped(blob)
        self.split = regex.compile(SPLIT)
        self.split_ascii = re.compile(SPLIT_ASCII, re.A).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        # characters without a Unicode class here may be classed otherwise by the library, which then splits the text
        bare, low = [], None
        for c in range(0x110001):
            un = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
            if un and low is None:
                low = c
            elif not un and low is not None:
                bare.append((low, c - 1))
                low = None
        self.odd = re.compile("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in bare) + "]")
        self.library = None
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        return self.split_ascii(text) if text.isascii() else self.split.findall(text)

    def _by_library(self, text: str) -> bytes:
        """The ids of a text with characters that the library may class otherwise: it splits them itself."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.vocab.file).pre_tokenizer
        words = [text[a:b].encode() for _, (a, b) in self.library.pre_tokenize_str(text)]
        distinct = list(dict.fromkeys(words))
        return b"".join(map(dict(zip(distinct, self.vocab.merge_many(distinct), strict=True)).__getitem__, words))

    def learn(self, lists: list[list[str]]) -> list[list[bytes | None]]:
        """What is known of the words of texts; what isn't is looked up or merged first, all at once."""
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        found = [list(map(self.known.get, words)) for words in lists]
        holes = [[k for k, x in enumerate(got) if x is None] if None in got else [] for got in found]
        pending = {words[k]: None for words, hole in zip(lists, holes, strict=True) for k in hole}
        new = []
        for w in pending:
            if not w.isascii() and self.odd.search(w):
                continue  # stays unknown, which sends its texts to the library's splitter
            raw = w.encode()
            ids = self.lexicon.find(raw)
            if ids is None:
                new.append((w, raw))
            else:
                self.known[w] = ids.tobytes()
        self.known.update(zip((w for w, _ in new), self.vocab.merge_many([r for _, r in new]), strict=True))
        for words, got, hole in zip(lists, found, holes, strict=True):
            for k in hole:
                got[k] = self.known.get(words[k])
        return found

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            split = []  # (words, special id after them) of each text
            for t in texts[at : at + TEXTS_AT_ONCE]:
                if any(x in t for x in self.vocab.special):
                    parts = self.special.split(t)
                    split.append([(self.words(a), self.vocab.special.get(b)) for a, b in zip(parts[::2], [*parts[1::2], None], strict=True)])
                else:
                    split.append([(self.words(t), None)])
            found = iter(self.learn([words for parts in split for words, _ in parts]))
            for parts in split:
                ids = []
                for words, special in parts:
                    try:
                        ids.append(b"".join(next(found)))
                    except TypeError:  # a word that stayed unknown
                        ids.append(self._by_library("".join(words)))
                    if special is not None:
                        ids.append(special.to_bytes(4, "little"))
                out.append(b"".join(ids))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; bytes that aren't UTF-8 become replacement characters."""
        raw = b"".join(map(self.vocab.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


_HERE: dict[int, Encoder] = {}


def _shared(spark, path: str, more: Iterable[bytes] = ()):
    vocab = Vocabulary(path)
    return spark.sparkContext.broadcast((vocab.file, Lexicon.build(whole_words(vocab, more)).to_bytes()))


def _encoder(shared) -> Encoder:
    """The worker's encoder, kept between the tasks that a Python worker runs."""
    file, blob = shared.value
    key = hash((len(file), blob))
    if key not in _HERE:
        _HERE.clear()
        vocab = Vocabulary.__new__(Vocabulary)
        vocab.__setstate__({"file": file})
        _HERE[key] = Encoder(vocab, blob)
    return _HERE[key]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", more: Iterable[bytes] = ()) -> DataFrame:
    """id, ``n_tokens`` and ``token_ids`` of every whole text."""
    shared = _shared(df.sparkSession, path, more)

    def make():
        e = _encoder(shared)

        def f(_, texts):
            ids = [np.frombuffer(x, dtype="<i4") for x in e.encode_many([t.decode() for t in texts])]
            return {"n_tokens": [len(x) for x in ids], "token_ids": ids}

        return f

    return map_texts(df, id_col, text_col, make, [("n_tokens", "long", pa.int64()), ("token_ids", "array<int>", pa.list_(pa.int32()))])


def counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", more: Iterable[bytes] = ()) -> DataFrame:
    """All columns of ``df`` but the text, and ``n_tokens``, the number of ids of the whole text."""
    shared = _shared(df.sparkSession, path, more)

    def make():
        e = _encoder(shared)
        return lambda _, texts: {"n_tokens": [len(x) // 4 for x in e.encode_many([t.decode() for t in texts])]}

    return map_texts(df, id_col, text_col, make, [("n_tokens", "long", pa.int64())], keep=True, drop=(text_col,))


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", out: str = "text") -> DataFrame:
    """``df`` with the text of an id array added (null ids: an empty text)."""
    from pyspark.sql import functions as F

    shared = _shared(df.sparkSession, path)
    kept = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + f", `{out}` string"

    def run(batches):
        e = _encoder(shared)
        for b in batches:
            texts = [e.decode(np.asarray(x or [], dtype="<u4").tobytes()).decode() for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*kept, out])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def encoded_and_checked(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", more: Iterable[bytes] = ()) -> DataFrame:
    """id, ``n_tokens``, ``token_ids`` and ``round_trip``: whether decoding the ids gives the text."""
    shared = _shared(df.sparkSession, path, more)

    def make():
        e = _encoder(shared)

        def f(_, texts):
            ids = e.encode_many([t.decode() for t in texts])
            return {"n_tokens": [len(x) // 4 for x in ids], "token_ids": [np.frombuffer(x, dtype="<i4") for x in ids],
                "round_trip": [e.decode(x) == t for x, t in zip(ids, texts, strict=True)]}

        return f

    return map_texts(df, id_col, text_col, make, [("n_tokens", "long", pa.int64()), ("token_ids", "array<int>", pa.list_(pa.int32())),
            ("round_trip", "boolean", pa.bool_())])


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", more: Iterable[bytes] = ()) -> DataFrame:
    """id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every whole text, encoded and decoded back."""
    shared = _shared(df.sparkSession, path, more)

    def make():
        e = _encoder(shared)
        sha = hashlib.sha256

        def f(_, texts):
            n, a, b = [], [], []
            for ids in e.encode_many([t.decode() for t in texts]):
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(e.decode(ids)).hexdigest())
            return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return f

    return map_texts(df, id_col, text_col, make, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()),
            ("decoded_sha256", "string", pa.string())])
