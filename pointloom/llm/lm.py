"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed trigram model. Its automaton has the empty state, a state for every
word seen ``ARC_MIN`` times or more in training, the end of a text included, and a state for every pair of such
words that was seen as often. A state has an arc for every word that followed it ``ARC_MIN`` times or more, and a
failure arc to the state of its last word, or from there to the empty state, which has arcs for all words. Each arc's
count is discounted; what the arcs of a state leave is the weight of its failure arc and is spread
as the state below has it, over the arcs' words, too. The empty state's words are smoothed additively. So the
probabilities of every state sum to one over the words seen in training and one unseen class. States and arcs
grow with the corpus and are never in one place: each block of texts gets the counts of its own arcs, and the sums for
the failure arcs of its own states, by joins.

1. Texts become sequences of word numbers in blocks of about ``BLOCK_TOKENS`` tokens, each with
   a word list of its own; sequences and lists are written to the shared folder.
2. One shuffle of the lists by word adds up training counts over the whole corpus and
   gives every block the counts of its words and their numbers in the corpus.
3. For pairs, and then for triples whose two pairs are arcs: blocks deal what follows each of their states, packed,
   to buckets by state, which add up the counts and answer each packet in its own order. What follows a very
   frequent state is dealt to several buckets, and the sums meet in a bucket of their own. An n-gram with a part that is
   no arc can't be an arc itself and stays.
4. Each block, with all that, follows the automaton through its texts and adds up log-probabilities. The state that is carried
   to a token is told by the two words before it, so the steps of all tokens are evaluated together, as array expressions.

A step's shuffled files are deleted when its table is written, so the disk holds those of one step.

Defined results: a null or empty text is one end token; texts without any training text
(N = 0) score on the unseen class; repeated rows are scored each; null ids belong to the
training part unless crc32 of the empty text says otherwise; ids keep their type; an empty table gives an
empty result; columns other than id and text are not read. N-grams are known by 64 mixed bits of their words' numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import drop_path, materialise, scratch_path
from .common import arrow_limits, crc32_text, shuffles_removed

#: Tokens after which a block of texts is closed.
BLOCK_TOKENS = 1_250_000
#: Tokens for each bucket of what follows states; there are as many buckets as the corpus needs.
BUCKET_TOKENS = 1_500_000
#: Occurrences of a state for each bucket that what follows it is dealt to.
SPREAD = 200_000
#: Training occurrences from which on an n-gram is an arc.
ARC_MIN = 2
#: Additive smoothing of words and absolute discount of arcs.
ADD, DISCOUNT = 0.1, 0.5
#: The end token, which no word equals.
END = b""


def _blocks(folds: int, id_type: pa.DataType):
    """Texts to word numbers and word lists, block by block."""

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        names = ["kind", "block", "doc_id", "held_out", "n_tokens", "seq", "word", "local", "n"]
        kinds = [pa.int32(), pa.int64(), id_type, pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]

        def rows(kind: int, count: int, **given):
            cols = [pa.array([kind] * count, pa.int32()), pa.array([part << 19 | k] * count, pa.int64())]
            cols += [pa.array(given[n], t) if n in given else pa.nulls(count, t) for n, t in zip(names[2:], kinds[2:], strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=names)

        def close():
            words = list(known)
            tally = np.zeros(len(words), dtype=np.int64)
            for held, seq in zip(helds, seqs, strict=True):
                if not held:
                    if len(seq) > 1000:
                        tally[:] += np.bincount(seq, minlength=len(words))
                    else:
                        np.add.at(tally, seq, 1)
            for a in range(0, len(seqs), 1000):
                part_of = seqs[a : a + 1000]
                yield rows(0, len(part_of), doc_id=ids[a : a + 1000], held_out=helds[a : a + 1000], n_tokens=[len(s) for s in part_of],
                    seq=[_bytes(s) for s in part_of])
            for a in range(0, len(words), 50_000):
                b = min(len(words), a + 50_000)
                yield rows(1, b - a, word=words[a:b], local=np.arange(a, b, dtype=np.int32), n=tally[a:b])

        known: dict[bytes, int] = {}
        ids, helds, seqs, size = [], [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (t or b"").lower().split()
                words.append(END)
                number = known.setdefault
                seqs.append(np.array([number(w, len(known)) for w in words], dtype=np.int32))
                ids.append(i)
                helds.append(crc32_text(i) % folds == 0)
                size += len(words)
                if size >= BLOCK_TOKENS:
                    yield from close()
                    known, ids, helds, seqs, size, k = {}, [], [], [], 0, k + 1
        if ids:
            yield from close()

    return run


PACKED = "block long, locals binary, counts binary, words binary, distinct long"
#: What blocks and buckets send to each other; ``ID`` stands for the type of the ids.
PACKET = "kind int, bucket long, block long, doc_id ID, held_out boolean, n_tokens long, a binary, b binary, c binary"
#: Kinds of packets: texts and counted words; to buckets what follows states, what follows frequent states, and requests
#: for the sums of these; parts of such sums; answers to the three. Those for triples count on by ``LEVEL``.
TEXT, WORDS, FOLLOW, SPREAD_OUT, ASK, PARTS, ARCS, SPREAD_ARCS, SUMS = range(9)
LEVEL = 10
#: What stands for no word.
NOTHING = 0xFFFFFFFF


def _pack(batches):
    """Counted words to one row for each block: numbers, counts and corpus numbers as arrays."""
    names, kinds = [x.split()[0] for x in PACKED.split(", ")], [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]

    def flush(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        block, local, c, word = (t.column(n).to_numpy() for n in ("block", "local", "c", "word_id"))
        first = (block << 24 | local) == word
        order = np.argsort(block, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            rows = rows[np.argsort(local[rows])]
            row = [block[rows[0]], _bytes(np.diff(local[rows], prepend=np.int32(0))), _bytes(c[rows]), _bytes(word[rows]),
                int((first[rows] & (c[rows] > 0)).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= 1_000_000:
            yield from flush(held)
            held, n = [], 0
    if held:
        yield from flush(held)


def _packets(rows: list[dict], id_type: pa.DataType) -> pa.Table:
    pa.default_memory_pool().release_unused()
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "ID": id_type}
    return pa.table({n: pa.array([r.get(n) for r in rows], types[t]) for n, t in (x.split() for x in PACKET.split(", "))})


def _bytes(x: np.ndarray) -> bytes:
    """An array by planes of bytes, compressed: the high bytes of most numbers are alike."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _array(raw: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(raw[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(pa.decompress(raw[4:], decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _arrays(t: pa.Table, col: str, kind) -> list[np.ndarray]:
    return [_array(x, kind) for x in t.column(col).to_pylist()]


def _steps(t: pa.Table, col: str) -> list[np.ndarray]:
    """Ascending numbers kept as steps."""
    return [np.cumsum(x, dtype=np.int32) for x in _arrays(t, col, np.int32)]


def _joined(t: pa.Table, col: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *_arrays(t, col, kind)])


def _of_kind(t: pa.Table, kind: int) -> pa.Table:
    return t.filter(pa.array(t.column("kind").to_numpy() == kind))


def _mixed(number: np.ndarray) -> np.ndarray:
    x = number.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def _dealt(number: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, rows) of numbers mixed over the buckets."""
    if not len(number):
        return []
    bucket = ((_mixed(number) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int16 if buckets < 1 << 15 else np.int64)
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    at = bucket[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    return [(int(at[k]), rows) for k, rows in zip([0, *cuts.tolist()], np.split(order, cuts), strict=True)]


def _first(x: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers starts."""
    new = np.empty(len(x), dtype=bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def _ranged(number: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, rows) of 63 mixed bits by ranges, and ascending in each, which packs well."""
    order = np.argsort(number).astype(np.int32)  # equal numbers in any order, but the same each time
    at = (number[order].astype(np.uint64) // np.uint64((1 << 63) // buckets + 1)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(at)) + 1
    return [(int(at[k]), rows) for k, rows in zip([0, *cuts.tolist()], np.split(order, cuts), strict=True)] if len(number) else []


class _Level:
    """What follows the states of a block: distinct (state, word) codes, ascending, and the place of each position's code.

    A state that no open word follows has a code with ``NOTHING``, so that its sums come back, too.
    """

    def __init__(self, position: np.ndarray, state: np.ndarray, word: np.ndarray, is_open: np.ndarray):
        self.position, self.open = position, is_open
        code = state.astype(np.int64) << 32
        code |= np.where(is_open, word.astype(np.int64), NOTHING)
        order = np.argsort(code)
        code = code[order]
        new = _first(code)
        codes = code[new]
        del code
        state = codes >> 32
        idle = ((codes & NOTHING) == NOTHING) & ~_first(state)
        place = (np.cumsum(~idle, dtype=np.int32) - np.int32(1))[np.cumsum(new, dtype=np.int32) - np.int32(1)]
        self.at = np.empty(len(order), dtype=np.int32)
        self.at[order] = place
        self.state, self.word = state[~idle].astype(np.int32), (codes[~idle] & NOTHING).astype(np.uint32)
        self.known = self.word != NOTHING

    def follow(self, number: np.ndarray, seen: np.ndarray, words: np.ndarray, buckets: int, deal=_dealt):
        """The packets in their order: (kind, bucket, places of codes), by the states' numbers and how often they were seen."""
        several = (1 + seen // SPREAD)[self.state]
        mine = number[self.state]
        if not (several > 1).any():
            return [(FOLLOW, b, r) for b, r in deal(mine, buckets)]
        of = np.flatnonzero(several == 1)
        out = [(FOLLOW, b, of[r]) for b, r in deal(mine[of], buckets)]
        of = np.flatnonzero(several > 1)
        asked = of[_first(self.state[of])]
        out += [(ASK, b, asked[r]) for b, r in _dealt(mine[asked], buckets)]
        of = of[self.known[of]]
        word = words[self.word[of].astype(np.int64)]
        return out + [(SPREAD_OUT, b, of[r]) for b, r in _dealt(mine[of] * 31 + word % several[of] + 1, buckets)]

    def answers(self, t: pa.Table, level: int, packets: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the arcs by code (0: none), and by state the sums and the number of all its arcs."""
        count = np.zeros(len(self.state), dtype=np.int64)
        total, arcs = (np.zeros(int(self.state[-1]) + 1 if len(self.state) else 0, dtype=np.int64) for _ in range(2))
        given = {}
        kinds, buckets = t.column("kind").to_numpy() - LEVEL * (level - 1), t.column("bucket").to_numpy()
        for k in np.flatnonzero((kinds >= ARCS) & (kinds <= SUMS)).tolist():
            given[int(kinds[k]), int(buckets[k])] = [t.column(c)[k].as_py() for c in "abc"]
        for kind, bucket, places in packets:
            got = given.get(({FOLLOW: ARCS, SPREAD_OUT: SPREAD_ARCS, ASK: SUMS}[kind], bucket))
            if got is None:
                continue
            if kind != ASK:
                count[places] = _array(got[0], np.int64)
            if kind != SPREAD_OUT:
                state = self.state[places]
                state = state[_first(state)]
                total[state], arcs[state] = _array(got[1], np.int64), _array(got[2], np.int64)
        return count, total, arcs


class _Block:
    """A block's texts and words: sequences, counts and corpus numbers."""

    def __init__(self, t: pa.Table):
        words, self.texts = _of_kind(t, WORDS), _of_kind(t, TEXT)
        local = np.concatenate([np.zeros(0, dtype=np.int32), *_steps(words, "a")])
        self.c, self.word = np.zeros(len(local), dtype=np.int64), np.zeros(len(local), dtype=np.int64)
        self.c[local], self.word[local] = _joined(words, "b", np.int64), _joined(words, "c", np.int64)
        seqs = _arrays(self.texts, "a", np.int32)
        self.bounds = np.cumsum([0, *map(len, seqs)])
        self.seq = np.concatenate(seqs)
        self.before = np.empty_like(self.seq)
        self.before[1:] = self.seq[:-1]
        self.before[self.bounds[:-1]] = self.seq[-1]  # each text ends with the end token, and starts after one

    def held(self) -> np.ndarray:
        return np.repeat(self.texts.column("held_out").to_numpy(), np.diff(self.bounds))

    def pairs(self, buckets: int) -> tuple[_Level, list]:
        """Words that are states, and what follows them."""
        often = self.c >= ARC_MIN
        position = np.flatnonzero(often[self.before]).astype(np.int32)
        word = self.seq[position]
        level = _Level(position, self.before[position], word, often[word])
        return level, level.follow(self.word, self.c, self.word, buckets)

    def triples(self, pairs: _Level, n: np.ndarray, buckets: int) -> tuple[_Level, list]:
        """Pairs that are states (``n``: counts of the pairs that are arcs, else 0), and what follows them."""
        arc = np.full(len(self.seq), -1, dtype=np.int32)
        hit = pairs.open & (n[pairs.at] > 0)
        arc[pairs.position[hit]] = pairs.at[hit]
        state = np.empty_like(arc)
        state[1:] = arc[:-1]
        state[self.bounds[:-1]] = -1  # the first word of a text follows the end token only
        position = np.flatnonzero(state >= 0).astype(np.int32)
        level = _Level(position, state[position], self.seq[position], arc[position] >= 0)
        self.pair_number = self.numbers(pairs)
        return level, level.follow(self.pair_number, n, self.word, buckets, _ranged)

    def numbers(self, pairs: _Level) -> np.ndarray:
        """The numbers of pairs: 63 mixed bits of their words' numbers."""
        second = self.word[np.where(pairs.known, pairs.word, 0).astype(np.int64)].astype(np.uint64)
        return (_mixed(_mixed(self.word[pairs.state]) + second) >> np.uint64(1)).astype(np.int64)


def _deal(level: int, buckets: int, id_type: pa.DataType):
    """What follows the states of a block, packed for the buckets."""

    def run(t: pa.Table) -> pa.Table:
        x, block = _Block(t), t.column("block")[0].as_py()
        held = x.held()
        now, packets = x.pairs(buckets)
        number = x.word
        if level == 2:
            n, _, _ = now.answers(t, 1, packets)
            now, packets = x.triples(now, n, buckets)
            number = x.pair_number
        seen = np.bincount(now.at[now.open], ~held[now.position[now.open]], len(now.state)).astype(np.int32)
        word = np.where(now.known, x.word[np.where(now.known, now.word, 0).astype(np.int64)], -1)
        rows = []
        for kind, bucket, k in packets:
            row = {"kind": kind, "bucket": bucket, "block": block, "a": _bytes(np.diff(number[now.state[k]], prepend=np.int64(0)))}
            rows.append(row if kind == ASK else row | {"b": _bytes(word[k]), "c": _bytes(seen[k])})
        return _packets(rows, id_type)

    return run


def _add(level: int, buckets: int, id_type: pa.DataType):
    """Counts of a bucket over all blocks: answers to the packets, and parts of the sums of frequent states."""
    to_block = LEVEL * (level - 1)

    def run(t: pa.Table) -> pa.Table:
        rows = []
        bucket = t.column("bucket")[0].as_py()
        for kind in (FOLLOW, SPREAD_OUT):
            got = _of_kind(t, kind)
            if not got.num_rows:
                continue
            state = np.concatenate([np.cumsum(a) for a in _arrays(got, "a", np.int64)])
            word, n = _joined(got, "b", np.int64), _joined(got, "c", np.int32)
            key = _mixed(state)
            key += word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            order = np.argsort(key)
            new = _first(key[order])
            starts = np.flatnonzero(new)
            total = np.add.reduceat(n[order].astype(np.int64), starts)
            first = order[starts]
            total[(total < ARC_MIN) | (word[first] < 0)] = 0
            mine = np.empty(len(state), dtype=np.int64)
            mine[order] = total[np.cumsum(new) - 1]
            arc = total > 0
            states, at = np.unique(state[first[arc]], return_inverse=True)
            sums, arcs = np.bincount(at, total[arc], len(states)).astype(np.int64), np.bincount(at, minlength=len(states))
            if kind == SPREAD_OUT:
                rows += [{"kind": PARTS, "bucket": b, **{c: _bytes(y[r]) for c, y in zip("abc", (states, sums, arcs), strict=True)}} for b,
                    r in _dealt(states, buckets)]
            low = 0
            for block, size in zip(got.column("block").to_pylist(), _sizes(got, "b"), strict=True):
                here = slice(low, low := low + size)
                row = {"kind": to_block + (ARCS if kind == FOLLOW else SPREAD_ARCS), "bucket": bucket, "block": block, "a": _bytes(mine[here])}
                if kind == FOLLOW:
                    own = state[here]
                    row |= dict(zip("bc", map(_bytes, _looked_up(own[_first(own)], states, sums, arcs)), strict=True))
                rows.append(row)
        asked = _of_kind(t, ASK)
        rows += [{"kind": ASK, "bucket": bucket, "block": b, "a": a} for b,
            a in zip(asked.column("block").to_pylist(), asked.column("a").to_pylist(), strict=True)]
        return _packets(rows, id_type)

    return run


def _sizes(t: pa.Table, col: str) -> list[int]:
    return [int.from_bytes(x[:4], "little") for x in t.column(col).to_pylist()]


def _looked_up(state: np.ndarray, states: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Values by state (``states`` ascending), zero for what isn't there."""
    if not len(states):
        return [np.zeros(len(state), dtype=np.int64) for _ in values]
    k = np.minimum(np.searchsorted(states, state), len(states) - 1)
    hit = states[k] == state
    return [np.where(hit, v[k], 0) for v in values]


def _add_parts(level: int, id_type: pa.DataType):
    """Sums of frequent states over all their buckets, to the blocks that asked."""

    def run(t: pa.Table) -> pa.Table:
        parts, asked = _of_kind(t, PARTS), _of_kind(t, ASK)
        states, at = np.unique(_joined(parts, "a", np.int64), return_inverse=True)
        values = [np.bincount(at, _joined(parts, c, np.int64), len(states)).astype(np.int64) for c in "bc"]
        rows = []
        for block, state in zip(asked.column("block").to_pylist(), _arrays(asked, "a", np.int64), strict=True):
            found = _looked_up(np.cumsum(state), states, *values)
            rows.append({"kind": SUMS + LEVEL * (level - 1), "bucket": t.column("bucket")[0].as_py(), "block": block,
                **{c: _bytes(v) for c, v in zip("bc", found, strict=True)}})
        return _packets(rows, id_type)

    return run


SCORED = "doc_id ID, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _traverse(total: int, distinct: int, buckets: int):
    z = total + ADD * (distinct + 1)

    def follow(p: np.ndarray, level: _Level, seen: np.ndarray, count: np.ndarray, sums: np.ndarray, arcs: np.ndarray) -> None:
        """The probabilities of positions with a state: what its failure arc passes of those below, and what its arcs add."""
        times = seen[: len(sums)]
        fail = np.ones(len(sums))
        has = arcs > 0
        fail[has] = 1 - (sums[has] - DISCOUNT * arcs[has]) / times[has]
        p[level.position] *= fail[level.state[level.at]]
        arc = count > 0
        more = np.zeros(len(count))
        more[arc] = (count[arc] - DISCOUNT) / seen[level.state[arc]]
        p[level.position[level.open]] += more[level.at[level.open]]

    def run(t: pa.Table) -> pa.Table:
        x = _Block(t)
        p = (x.c + ADD) / z
        base = np.log10(p)
        p = p[x.seq]
        pairs, packets = x.pairs(buckets)
        n, sums, arcs = pairs.answers(t, 1, packets)
        follow(p, pairs, x.c, n, sums, arcs)
        triples, packets = x.triples(pairs, n, buckets)
        follow(p, triples, n, *triples.answers(t, 2, packets))
        weight, plain, known = np.log10(p), base[x.seq], (x.c > 0)[x.seq]
        starts = x.bounds[:-1]
        return pa.table({
            "doc_id": x.texts.column("doc_id"), "held_out": x.texts.column("held_out"), "n_tokens": x.texts.column("n_tokens"),
            "n_known": pa.array(np.add.reduceat(known.astype(np.int64), starts)), "base_score": pa.array(np.add.reduceat(plain, starts)),
                "score": pa.array(np.add.reduceat(weight, starts)),
        })

    return run


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    spark = df.sparkSession
    arrow_limits(spark)
    path = scratch_path(spark, "lm-blocks")
    kind_of_id = df.schema[id_col].dataType
    id_name, id_type = kind_of_id.simpleString(), to_arrow_type(kind_of_id)
    packet = PACKET.replace("ID", id_name)
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"kind int, block long, doc_id {id_name}, held_out boolean, n_tokens long, seq binary, word binary, local int, n long"
    texts.mapInArrow(_blocks(folds, id_type), schema).write.partitionBy("kind").parquet(path)
    blocks = spark.read.schema(schema).parquet(path)
    docs = blocks.where("kind = 0").select("block", "doc_id", "held_out", "n_tokens", "seq")
    lists = blocks.where("kind = 1").select("block", "word", "local", "n")
    seen = docs.agg(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))).alias("train"), F.sum("n_tokens").alias("every")).first()
    total, buckets = seen.train or 0, 1 + (seen.every or 0) // BUCKET_TOKENS
    #: Tasks for blocks and for buckets: so many that few hold more than two.
    tasks = 2 * (1 + (seen.every or 0) // BLOCK_TOKENS)

    by_word = Window.partitionBy("word")
    rows = (
        lists.withColumn("c", F.sum("n").over(by_word))
        .withColumn("word_id", F.min(F.shiftleft("block", 24).bitwiseOR(F.col("local").cast("long"))).over(by_word))
        .select("block", "local", "c", "word_id")
    )
    with shuffles_removed(spark):
        counted = materialise(rows.mapInArrow(_pack, PACKED), "lm-counts")
    distinct = counted.agg(F.sum("distinct")).first()[0] or 0
    drop_path(spark, f"{path}/kind=1")

    def packets(given: DataFrame, kind: int, **columns: str) -> DataFrame:
        cols = {"block": "block", **columns}
        return given.select(*[(F.lit(kind) if n == "kind" else F.col(cols[n]) if n in cols else F.lit(None)).cast(t).alias(n) for n,
            t in (x.split() for x in packet.split(", "))])

    def by(given: DataFrame, key: str, run, out: str = packet) -> DataFrame:
        return given.repartition(tasks, key).groupBy(key).applyInArrow(run, out)

    own = packets(docs, TEXT, doc_id="doc_id", held_out="held_out", n_tokens="n_tokens",
        a="seq").unionByName(packets(counted, WORDS, a="locals", b="counts", c="words"))
    known = own  # what the blocks have so far
    for level in (1, 2):
        dealt = by(known, "block", _deal(level, buckets, id_type))
        with shuffles_removed(spark):
            added = _written(by(dealt, "bucket", _add(level, buckets, id_type)), "lm-arcs")
        frequent = F.col("kind").isin(ASK, PARTS)
        known = known.unionByName(added.where(~frequent)).unionByName(by(added.where(frequent), "bucket", _add_parts(level, id_type)))
    scored = by(known, "block", _traverse(total, distinct, buckets), SCORED.replace("ID", id_name))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` in shared storage, by kind."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    out._scratch_path = path
    return out
