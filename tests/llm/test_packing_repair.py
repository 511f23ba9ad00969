"""Packing against one-by-one best fit and the tokenizers library; repair of conversations against a plain search."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pointloom.llm import packing, repair
from pointloom.llm.queries import tokenizer_path


def placed(lengths, capacity):
    """{sequence: [(offset, length)]} by the plan."""
    counts, out = Counter(lengths), {}
    runs, n = packing.plan(counts, capacity)
    for length, of in runs.items():
        for rank in range(counts[length]):
            first, at, each, start = of[np.searchsorted(of[:, 0], rank, "right") - 1].tolist()
            out.setdefault(at + (rank - first) // each, []).append((start + (rank - first) % each * length, length))
    assert sorted(out) == list(range(n))
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    rooms = []
    for held in placed(lengths, capacity).values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= capacity
        rooms.append(capacity - end)
    assert sorted(rooms) == sorted(packing.best_fit_one_by_one(lengths, capacity))


def test_plan_stays_small_for_any_number_of_documents():
    runs, n = packing.plan({w: 10**9 + w for w in range(1, 1025)})
    assert n > 10**11 and sum(map(len, runs.values())) < 3 * 1024 * 1024 // 2


def test_tightest_is_the_least_room():
    free = packing.OpenSequences(20)
    for room in (3, 8, 20):
        free.put(room, (room, room + 1))
    assert [free.tightest(n) for n in (1, 3, 4, 8, 9, 20)] == [3, 3, 8, 8, 20, 20]
    assert free.take(20) == (20, 21) and free.tightest(9) is None


TEXTS = ["", None, "a", "one two three.", "word " * 3000, "é" * 5000, "<|endoftext|> x", "͸ odd \U0001f600", "x" * 250_000, " " * 3000, "same", "same"]


def test_pieces_hold_what_the_library_gives(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    docs = spark.createDataFrame([(i, x, "no", 7) for i, x in enumerate(TEXTS)], "doc_id long, text string, length string, sequence_id int")
    rows = packing.pack(docs, tokenizer_path(), ids=True).collect()
    expected, lengths = {}, []
    for i, x in enumerate(TEXTS):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(cut, len(ids), 1024)]):
            body = ids[start : cut if k == 0 else start + 1024]
            expected[i, k] = start, len(body), zlib.crc32(np.array(body, "<u4").tobytes()), body
            lengths.append(len(body))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32, r.token_ids) for r in rows} == expected
    assert len({r.sequence_id for r in rows}) == len(packing.best_fit_one_by_one(lengths))
    whole = {r.sequence_id: r for r in packing.sequences(docs, tokenizer_path()).collect()}
    for r in whole.values():
        assert len(r.token_ids) <= 1024
        for d in r.docs:
            body = expected[d.doc_id, d.piece][3]
            assert r.token_ids[d.offset : d.offset + len(body)] == body


@pytest.mark.parametrize("kind", ["long", "string"])
def test_packing_of_odd_tables(spark, kind):
    empty = spark.createDataFrame([], f"doc_id {kind}, text string")
    assert packing.pack(empty, tokenizer_path()).collect() == []
    key = (lambda x: x) if kind == "long" else (lambda x: None if x is None else str(x))
    rows = packing.pack(spark.createDataFrame([(key(None), "a"), (key(None), None), (key(3), "a"), (key(3), "a")], f"doc_id {kind}, text string"), tokenizer_path()).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == {(key(None), 2): 1, (key(None), 1): 1, (key(3), 2): 2} and {r.sequence_id for r in rows} == {0}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [row] * (2 if k == 3 else 1)
    return out


def by_search(rows):
    """The contract by plain dynamic programming over whole edit strings."""
    found = {r[0]: [] for r in rows}
    for r in damage(rows):
        found[r[0]].append(r)
    step, out = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}, {}
    for conv, own in found.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in own:
            rest = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0

        def put(ways, q, new):
            if q not in ways or new[:2] < ways[q][:2]:
                ways[q] = new

        def inserted(ways):
            for _ in range(3):
                for q, (c, a, said) in list(ways.items()):
                    for role in ("user", "assistant"):
                        if (q, role[0]) in step:
                            put(ways, step[q, role[0]], (c + 5, a + "I", (*said, f"{role}:")))
            return ways

        ways = inserted({0: (0, "", ())})
        for (_, _, role, text), fault in zip(own, faults, strict=True):
            new: dict = {}
            for q, (c, a, said) in ways.items():
                put(new, q, (c + 2, a + "D", said))
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault == "truncated" else 0
                    for letter, cost, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                        if (q, name[:1]) in step:
                            put(new, step[q, name[:1]], (c + cost + more, a + letter, (*said, f"{name}:{text}")))
            ways = inserted(new)
        cost, audit, said = min(ways[q] for q in (0, 3) if q in ways)
        out[conv] = gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()
    return out


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ux"]
SAID = ["a.", "b!", "c?", "d", "e ", "  ", "\t\n", None, "", "f. ", "g.\x1c", "é.", "\U0001f600"]


def conversations():
    r, rows = random.Random(5), []
    for c in range(300):
        tied = c % 5 == 0
        for i in range(r.randint(0, 14)):
            rows.append((c, r.choice([None, 1, 2, 3]) if tied else i + r.choice([0, 0, 0, 3]), r.choice(ROLES), r.choice([*SAID, f"{i}.", f"{i}{c}."])))
    rows += [(400, i, r.choice(ROLES), r.choice([*SAID, f"{i}.", f"{i // 2}."])) for i in range(700)]
    rows += [(401, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(600)]
    rows += [(402, None, "user", "same.")] * 1500 + [(None, 1, "user", "a."), (None, None, None, None)]
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("parts", "piece_rows"), [(3, 512), (11, 5)])
def test_repair_is_the_cheapest_and_least(spark, parts, piece_rows):
    rows = conversations()
    found = repair.repair(repair.damaged(spark.createDataFrame(rows, SCHEMA)), parts=parts, piece_rows=piece_rows).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == by_search(rows) and len(found) == len({r[0] for r in rows})


def test_repaired_turns(spark):
    rows = conversations()
    turns = repair.repair(repair.damaged(spark.createDataFrame(rows, SCHEMA)), keep_turns=True, parts=5, piece_rows=7).orderBy("part", "number", "at").collect()
    said = {}
    for t in turns:
        said.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
    assert all(hashlib.sha256("\n".join(said.get(k, [])).encode()).hexdigest() == v[-1] for k, v in by_search(rows).items())


def test_undamaged_conversation_is_kept(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "a?"), (1, 2, "assistant", "b."), (2, 0, "user", "cut"), (3, 5, "assistant", "x.")]
    found = {r.conv_id: (r.cost, r.audit) for r in repair.repair(repair.turns_of(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert found == {1: (0, "KKK"), 2: (2, "D"), 3: (2, "D")}


def test_repair_of_odd_tables(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    clashing = spark.createDataFrame([("x", 1, "user", "a.", "?", 3), ("x", 2, "assistant", "b.", "?", 4)], "conv_id string, turn int, role string, text string, audit string, part int")
    (row,) = repair.repair(repair.turns_of(clashing)).collect()
    assert (row.conv_id, row.audit, row.cost) == ("x", "KK", 0)
    dropped = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    (row,) = repair.repair(repair.damaged(spark.createDataFrame([(9, dropped, "user", "a.")], SCHEMA))).collect()
    assert tuple(row) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
