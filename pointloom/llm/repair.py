"""Repair of the turn structure of conversations at least cost, by cost layers over a grammar of roles.

A conversation is repaired by edits of its turns, taken in order, so that the initials of its roles become ``(s?(ua)+)?``:

* Keep costs 0, or TRUNCATED (5) where the turn breaks off;
* Rerole to user or assistant costs 1, or 6 where the turn breaks off;
* Delete costs 2 and is the only edit of a blank or repeated turn;
* Insert of an empty turn by user or assistant costs 5, anywhere.

The search is a Wu-Manber-style approximate match, read from the last turn to the first. For every turn an integer holds
one layer of four bits for each cost: the grammar states from which the rest can be brought to an end at that very cost. An edit
shifts all layers at once. States differ by at most 12 in what they still cost (two inserted turns and a deletion lead from any
state to any other that matters), so WIDTH layers over the cheapest suffice and a turn takes constant time. The first
layer that holds the start state is the cost; a walk along the bits, always by the ASCII-least letter that stays on a cheapest path, gives
the audit (D, I, K, R). Blank and repeated turns don't move the state, so they are only counted.

A conversation may hold a third of all turns, so none is collected into one task:

1. turns that are equal in everything become one row with a number (combined before the shuffle), then the table is
   dealt by ranges of (conversation, turn, role, start of the text) and sorted; a task streams over it;
2. a conversation that lies within a range and within PIECE_ROWS turns is finished there; others become pieces;
3. turns repeated from an earlier piece are found by their digests; a piece gives a 4 x 4 table of what leads from state to
   state; the tables, a few numbers each, are chained backwards and the states forwards; then every piece is walked on
   its own. Only the digest of the repaired text is sequential by its nature: one task streams over the pieces' bytes.

Defined cases: a null role or text is one space; a null conversation id is one conversation of its own; a null turn comes
first and counts for no gap; turns of equal number go by role, then by text (in the order of their bytes); an
empty table gives no rows; other columns are ignored, whatever their names. ``turn`` is an integer.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import arrow_limits

#: Costs of the edits, and what an undeleted turn that breaks off costs more.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Layers that are kept above the cheapest.
WIDTH = 32
#: Turns (and bytes of text) of a piece.
PIECE_ROWS, PIECE_BYTES = 512, 4 << 20
#: Characters of a text that take part in the ranges; equal beginnings stay together.
PREFIX = 64
WHITE = " \t\n\x0b\x0c\r"

# Grammar states: before anything, after s, after u, after ua. The first and the last accept.
START, SYSTEM, USER, ASSISTANT = range(4)
_EACH = int("1" * WIDTH, 16)
_ALL = (1 << 4 * WIDTH) - 1
_STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_NEXT = [(USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user")]  # what rerole and insert lead to
_FREE = 1 << 60  # no way


def _before(symbol: str, layers: int) -> int:
    """The states from which ``symbol`` leads into ``layers``."""
    if symbol == "u":
        x = layers >> USER & _EACH
        return x | x << SYSTEM | x << ASSISTANT
    if symbol == "a":
        return (layers >> ASSISTANT & _EACH) << USER
    return layers >> SYSTEM & _EACH if symbol == "s" else 0


def _inserted(layers: int) -> int:
    """``layers`` with turns inserted in front: three lead anywhere that inserting can lead."""
    for _ in range(3):
        layers |= (_before("u", layers) | _before("a", layers)) << 4 * INSERT
    return layers


def _settled(layers: int, base: int) -> tuple[int, int]:
    """``layers`` from its cheapest layer on, and the cost of that layer."""
    low = ((layers & -layers).bit_length() - 1) // 4 if layers else 0
    return layers >> 4 * low & _ALL, base + low


def _from_costs(costs: list[int]) -> tuple[int, int]:
    least = min(costs)
    return sum(1 << 4 * (c - least) + q for q, c in enumerate(costs) if c - least < WIDTH), least


def _cost_of(state: int, layers: int, base: int) -> int:
    own = layers >> state & _EACH
    return base + ((own & -own).bit_length() - 1) // 4 if own else _FREE


#: What is left to pay at the end of a conversation: nothing where the state accepts, else inserted turns.
END = [0, 2 * INSERT, INSERT, 0]


def cost_layers(turns: list[tuple[str, bool]], end: list[int]) -> list[tuple[int, int]]:
    """(layers, base) before each turn (initial, breaks off) and after the last, for the costs ``end`` of the states there."""
    out = [_from_costs(end)]
    for symbol, broken in reversed(turns):
        layers, base = out[-1]
        more = TRUNCATED if broken else 0
        now = layers << 4 * DELETE | _before(symbol, layers) << 4 * more
        now |= (_before("u", layers) | _before("a", layers)) << 4 * (REROLE + more)
        out.append(_settled(_inserted(now), base))
    out.reverse()
    return out


def walk(turns: list[tuple[str, bool]], layers: list[tuple[int, int]], state: int, last: bool):
    """The ASCII-least cheapest edits from ``state``: (edits, final state).

    An edit is (letter, number of the turn, role or None); ``last``: turns may be inserted at the end, too.
    """
    has = lambda i, q, c: 0 <= c - layers[i][1] < WIDTH and layers[i][0] >> 4 * (c - layers[i][1]) + q & 1
    left, edits, i, n = _cost_of(state, *layers[0]), [], 0, len(turns)
    while i < n:
        symbol, broken = turns[i]
        more, (after, role) = TRUNCATED if broken else 0, _NEXT[state]
        if has(i + 1, state, left - DELETE):
            edits.append(("D", i, None))
            left, i = left - DELETE, i + 1
        elif has(i, after, left - INSERT):
            edits.append(("I", i, role))
            left, state = left - INSERT, after
        elif (kept := _STEP.get((state, symbol))) is not None and has(i + 1, kept, left - more):
            edits.append(("K", i, None))
            left, state, i = left - more, kept, i + 1
        else:
            edits.append(("R", i, role))
            left, state, i = left - REROLE - more, after, i + 1
    while last and left:
        after, role = _NEXT[state]
        edits.append(("I", n, role))
        left, state = left - INSERT, after
    return edits, state


def digest_of(conv, role: str, text: str) -> bytes:
    """Digest that tells (conversation, role, text) apart."""
    head = f"{conv!r}\x00{len(role)}\x00{role}\x00".encode("utf-8", "surrogatepass")
    return hashlib.sha256(head + text.encode("utf-8", "surrogatepass")).digest()[:16]


class Piece:
    """Consecutive turns of a conversation with their faults: rows (turn, role, text, copies)."""

    def __init__(self, rows: list[tuple], seen=lambda role, text: False):
        self.rows = rows
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.live: list[tuple[str, bool]] = []  # turns that have a choice
        self.at: list[int] = []  # their rows
        self.forced: list[int] = [0]  # turns to delete before each of them, and after the last
        own, before = set(), None
        for k, (_, role, text, copies) in enumerate(rows):
            initial, rest = role[:1], text.rstrip(WHITE)
            self.illegal += (before is not None and before + initial not in ("su", "ua", "au")) + copies - 1
            before = initial
            if not rest:
                self.blank += copies
                self.forced[-1] += copies
            elif (role, text) in own or seen(role, text):
                self.duplicate += copies
                self.forced[-1] += copies
            else:
                own.add((role, text))
                broken = rest[-1] not in ".!?"
                self.truncated += broken
                self.duplicate += copies - 1
                self.live.append((initial, broken))
                self.at.append(k)
                self.forced.append(copies - 1)
        numbers = [r[0] for r in rows if r[0] is not None]
        self.first, self.last, self.distinct = (numbers[0], numbers[-1], len(set(numbers))) if numbers else (None, None, 0)

    @property
    def must(self) -> int:
        """Cost of the turns that have to go."""
        return DELETE * sum(self.forced)

    def costs(self, end: list[int]) -> list[int]:
        """Least cost from each state to the end."""
        first = cost_layers(self.live, end)[0]
        return [min(_FREE, _cost_of(q, *first) + self.must) for q in range(4)]

    def table(self) -> list[int]:
        """Least cost from each state (rows) to each state at the end (columns), which inserts nothing there."""
        ways = [self.costs([0 if q == e else _FREE for q in range(4)]) for e in range(4)]
        return [ways[e][q] for q in range(4) for e in range(4)]

    def repaired(self, end: list[int], state: int, last: bool):
        """(audit, [(role, text)], final state) from ``state`` on."""
        edits, state = walk(self.live, cost_layers(self.live, end), state, last)
        audit, turns, reached = ["D" * self.forced[0]], [], 0
        for letter, i, role in edits:
            audit.append(letter)
            if letter != "D":
                _, own, text, _ = self.rows[self.at[i]] if letter != "I" else (None, role, "", 1)
                turns.append((own if letter == "K" else role, text))
            if letter != "I":
                reached += 1
                audit.append("D" * self.forced[reached])
        return "".join(audit), turns, state


def _lines(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in turns).encode("utf-8", "surrogatepass")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
    ("audit", pa.string()), ("repaired_sha256", pa.string())]
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of ``df`` as the operator takes them: (conv_id, turn, role, text, copies, gone)."""
    word = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return df.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), word(role).alias("role"), word(text).alias("text"),
        F.lit(1).cast("long").alias("copies"), F.lit(False).alias("gone"))


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32(``conv_id:turn``) mod 20: 0 drops the turn (its conversation stays known), 1 empties
    its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = turns_of(df).withColumn("k", F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20)
    text = F.when(F.col("k").isin(0, 1), "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 0, "").when(F.col("k") == 4, "user").otherwise(F.col("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("copies"),
        (F.col("k") == 0).alias("gone"))


def _batched(rows, size_of, most_rows: int = 1000, most_bytes: int = 8 << 20):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += size_of(r)
        if len(held) >= most_rows or size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _record(names, types, rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _rows(batches):
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _finish(piece: Piece, keep: bool) -> list:
    """The results of a conversation that is one piece."""
    audit, turns, _ = piece.repaired(END, START, True)
    gaps = 0 if piece.first is None else piece.last - piece.first + 1 - piece.distinct
    return [gaps, piece.blank, piece.duplicate, piece.truncated, piece.illegal, piece.costs(END)[START], audit,
        hashlib.sha256(_lines(turns)).hexdigest(), [{"role": r, "text": t} for r, t in turns] if keep else None]


def _split(kind: str, arrow, keep: bool, piece_rows: int):
    """Kernel over sorted turns: finished conversations, and pieces of those that another task or another piece may share."""
    names = ["conv_id", *[n for n, _ in _RESULT], "turns", "part", "number", "rows"]
    types = [arrow, *[t for _, t in _RESULT], _TURNS, pa.int32(), pa.int32(), _ROWS]
    schema = f"conv_id {kind}, {RESULT}, turns array<struct<role:string,text:string>>, part int, number int, rows array<struct<turn:long,role:string,text:string,copies:long>>"

    def cut(batches):
        part, number, waiting = TaskContext.get().partitionId(), 0, None  # the range's last conversation may go on in the next range
        for first, (conv, group) in enumerate(groupby(_rows(batches), key=lambda r: r[0])):
            if waiting is not None:
                yield (waiting[0], *_finish(Piece(waiting[1]), keep), None, None, None)
            held, size, cuts = [], 0, 0
            for _, turn, role, text, copies, gone in group:
                if gone:
                    continue
                held.append((turn, role, text, copies))
                size += len(text)
                if len(held) >= piece_rows or size >= PIECE_BYTES:
                    yield (conv, *[None] * 9, part, number, held)
                    number, cuts, held, size = number + 1, cuts + 1, [], 0
            waiting = (conv, held)
            if first == 0 or cuts:  # it may have begun in the range before, or has begun in other pieces
                yield (conv, *[None] * 9, part, number, held)
                number, waiting = number + 1, None
        if waiting is not None:
            yield (waiting[0], *[None] * 9, part, number, waiting[1])

    def run(batches):
        for rows in _batched(cut(batches), lambda r: sum(len(x[2]) for x in r[12] or ())):
            yield _record(names, types, [(*r[:12], r[12] and [dict(zip(("turn", "role", "text", "copies"), x, strict=True)) for x in r[12]]) for r in rows])
        pa.default_memory_pool().release_unused()

    return run, schema


_PIECE = ["blank", "duplicate", "truncated", "illegal", "first", "last", "distinct", "opens", "closes"]


def _facts(arrow):
    """Kernel: what a piece adds to its conversation, and its table."""
    names = ["conv_id", "part", "number", *_PIECE, "ways"]
    types = [arrow, pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.int64())]

    def run(batches):
        for b in batches:
            out = []
            for conv, part, number, rows, known in _rows([b]):
                rows, known = [(r["turn"], r["role"], r["text"], r["copies"]) for r in rows], set(known or [])
                p = Piece(rows, (lambda r, t, c=conv, k=known: digest_of(c, r, t) in k) if known else lambda r, t: False)
                ends = (rows[0][1][:1], rows[-1][1][:1]) if rows else (None, None)
                out.append((conv, part, number, p.blank, p.duplicate, p.truncated, p.illegal, p.first, p.last, p.distinct, *ends, p.table()))
            yield _record(names, types, out)

    return run


def _backwards(arrow):
    """Kernel over the pieces of conversations, last first: what each state still costs at the end of a piece."""
    types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.int64()]

    def run(batches):
        before = ()
        for b in batches:
            out = []
            for conv, part, number, ways in _rows([b]):
                last = before != (conv,)
                if last:
                    before, costs = (conv,), END
                after = costs
                costs = [min(min(_FREE, ways[4 * q + e] + after[e]) for e in range(4)) for q in range(4)]
                out.append((part, number, after, last, costs[START]))
            yield _record(["part", "number", "after", "final", "total"], types, out)

    return run


def _exits(batches):
    """Kernel: the state at the end of a piece for each state at its beginning."""
    for b in batches:
        out = []
        for part, number, rows, known, conv, after, final in _rows([b]):
            p = _piece(conv, rows, known)
            out.append((part, number, [p.repaired(after, q, final)[2] for q in range(4)]))
        yield _record(["part", "number", "exits"], [pa.int32(), pa.int32(), pa.list_(pa.int32())], out)


def _forwards(batches):
    """Kernel over the pieces of conversations in order: the state at the beginning of each."""
    before, state = (), START
    for b in batches:
        out = []
        for conv, part, number, exits in _rows([b]):
            state = START if before != (conv,) else state
            before = (conv,)
            out.append((part, number, state))
            state = exits[state]
        yield _record(["part", "number", "state"], [pa.int32(), pa.int32(), pa.int32()], out)


def _piece(conv, rows, known) -> Piece:
    known = set(known or [])
    return Piece([(r["turn"], r["role"], r["text"], r["copies"]) for r in rows], (lambda r, t: digest_of(conv, r, t) in known) if known else lambda r, t: False)


def _segments(arrow):
    """Kernel: audit and repaired turns of every piece."""

    def run(batches):
        for b in batches:
            out = []
            for part, number, rows, known, conv, after, final, state in _rows([b]):
                audit, turns, _ = _piece(conv, rows, known).repaired(after, state, final)
                out.append((conv, part, number, audit, [{"role": r, "text": t} for r, t in turns]))
            yield _record(["conv_id", "part", "number", "segment", "turns"], [arrow, pa.int32(), pa.int32(), pa.string(), _TURNS], out)

    return run


def _joined(arrow):
    """Kernel over the segments of conversations in order; bytes are passed to the digest and forgotten."""
    names, types = ["conv_id", *[n for n, _ in _RESULT]], [arrow, *[t for _, t in _RESULT]]

    def conversations(batches):
        for (conv,), group in groupby(_rows(batches), key=lambda r: (r[0],)):
            sha, audit, cost, some = hashlib.sha256(), [], 0, False
            sums, least, most, distinct, closes = [0, 0, 0, 0], None, None, 0, None
            for _, _, _, segment, turns, total, *facts in group:
                if turns:
                    sha.update((b"\n" if some else b"") + _lines([(t["role"], t["text"]) for t in turns]))
                    some = True
                if not audit:
                    cost = total  # what the first piece leads to
                audit.append(segment)
                blank, duplicate, truncated, illegal, first, last, own, opens, shuts = facts
                sums = [a + x for a, x in zip(sums, (blank, duplicate, truncated, illegal), strict=True)]
                if opens is not None:
                    sums[3] += closes is not None and closes + opens not in ("su", "ua", "au")
                    closes = shuts
                if first is not None:
                    distinct += own - (most == first)
                    least, most = first if least is None else least, last
            gaps = 0 if least is None else most - least + 1 - distinct
            yield (conv, gaps, *sums, cost, "".join(audit), sha.hexdigest())

    def run(batches):
        for rows in _batched(conversations(batches), lambda r: len(r[7])):
            yield _record(names, types, rows)

    return run


def repair(turns: DataFrame, keep_turns: bool = False, parts: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row a conversation of ``turns`` (as ``turns_of`` or ``damaged`` give them): conv_id and RESULT.

    With ``keep_turns`` instead one row for each repaired turn: conv_id, ``part``, ``number``, ``at`` (its order), ``role``, ``text``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = turns.sparkSession
    arrow_limits(spark)
    kind = turns.schema["conv_id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role"]
    counted = turns.groupBy(*keys, "text", "gone").agg(F.sum("copies").alias("copies")).select(*keys, "text", "copies", "gone")
    dealt = counted.repartitionByRange(n, *keys, F.substring("text", 1, PREFIX)).sortWithinPartitions(*keys, "text")
    run, schema = _split(name, arrow, keep_turns, piece_rows)
    first = materialise(dealt.mapInArrow(run, schema), "conversations")
    pieces = first.where(F.col("rows").isNotNull()).select("conv_id", "part", "number", "rows")
    place = ["part", "number"]

    # turns that an earlier piece has: the first piece of each digest keeps them
    def digests(batches):
        for b in batches:
            out = [(part, number, d) for conv, part, number, rows in _rows([b])
                for d in {digest_of(conv, r["role"], r["text"]) for r in rows if r["text"].rstrip(WHITE)}]
            yield _record(["part", "number", "digest"], [pa.int32(), pa.int32(), pa.binary()], out)

    marks = materialise(pieces.mapInArrow(digests, "part int, number int, digest binary"), "digests")
    firsts = marks.groupBy("digest").agg(F.min(F.struct("part", "number")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = marks.join(firsts, "digest").where(F.struct("part", "number") != F.col("first"))
    known = later.groupBy(*place).agg(F.collect_list("digest").alias("known"))
    pieces = materialise(pieces.join(known, place, "left").select("conv_id", *place, "rows", "known"), "pieces")

    ordered = lambda df, *cols: df.repartition("conv_id").sortWithinPartitions(*cols)
    facts_schema = f"conv_id {name}, part int, number int, blank long, duplicate long, truncated long, illegal long, first long, last long, distinct long, opens string, closes string, ways array<long>"
    facts = materialise(pieces.mapInArrow(_facts(arrow), facts_schema), "facts")
    ends = ordered(facts.select("conv_id", *place, "ways"), "conv_id", F.desc("part"), F.desc("number")).mapInArrow(_backwards(arrow), "part int, number int, after array<long>, final boolean, total long")
    ends = materialise(ends, "ends")
    known_pieces = pieces.join(ends.drop("total"), place).select(*place, "rows", "known", "conv_id", "after", "final")
    exits = pieces.select("conv_id", *place).join(known_pieces.mapInArrow(_exits, "part int, number int, exits array<int>"), place)
    states = ordered(exits.select("conv_id", *place, "exits"), "conv_id", *place).mapInArrow(_forwards, "part int, number int, state int")
    segments = known_pieces.join(states, place).mapInArrow(_segments(arrow), f"conv_id {name}, part int, number int, segment string, turns array<struct<role:string,text:string>>")
    if keep_turns:
        both = first.where(F.col("rows").isNull()).select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("number"), "turns").unionByName(
            segments.select("conv_id", *place, "turns"))
        return both.select("conv_id", *place, F.posexplode("turns").alias("at", "t")).select("conv_id", *place, "at", "t.role", "t.text")
    whole = segments.join(ends.select(*place, "total"), place).join(facts.drop("conv_id", "ways"), place)
    joined = ordered(whole.select("conv_id", *place, "segment", "turns", "total", *_PIECE), "conv_id", *place).mapInArrow(_joined(arrow), f"conv_id {name}, {RESULT}")
    return first.where(F.col("rows").isNull()).select("conv_id", *[c for c, _ in _RESULT]).unionByName(joined)
