"""Secrets whose neighbours, nesting or alphabet could hide them; hot payloads of archives."""

import base64
import json
import random
import time

import pytest

from pointloom.llm import secrets, warc


def b64(x) -> str:
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


def part(x) -> str:
    return base64.urlsafe_b64encode(x if isinstance(x, bytes) else x.encode()).decode().rstrip("=")


SECRET = b64("password=hunter2222")
SIGNED = ".".join([part(json.dumps({"alg": "HS256", "typ": "JWT"})), part('{"sub":"1"}'), part(bytes(range(32)))])


def added(text):
    base, every = secrets.find(text)
    return [(secrets.KINDS[k], text[a:b]) for a, k, b in every if (a, k, b) not in base]


@pytest.mark.parametrize("before", ["", "/", "a/b/", "x-", "v1_", "https://h.io/p/", ":", '"', "k=", "q+"])
@pytest.mark.parametrize("after", ["", "&x", "?q=1", " then", '"'])
def test_neighbours_dont_hide_a_run(before, after):
    assert ("nested", SECRET) in added(before + SECRET + after)


@pytest.mark.parametrize("after", ["/c/d.txt", "-tail", "_1", "+"])
def test_a_run_that_goes_on(after):
    assert ("nested", SECRET.rstrip("=")) in added("a/b/" + SECRET.rstrip("=") + after)


@pytest.mark.parametrize("before", ["", "session_cookie.", "www.example.com.", "abc-", "abc_d.", "x.y-"])
@pytest.mark.parametrize("after", ["", ".y", " ", ";"])
def test_dotted_names_before_a_token(before, after):
    assert ("jwt", SIGNED) in added(before + SIGNED + after)


def test_nesting_up_to_the_stated_depth():
    text = "password=hunter2222"
    for depth in range(1, 5):
        text = b64(text)
        assert bool(added(text)) == (depth <= secrets.DEPTH), depth
    assert added(b64(SIGNED)) and added(b64("see a/b/" + SECRET))


def test_text_beyond_ascii():
    assert added(b64("é 漢字 password=hunter2222")) and added("x/" + b64("né: token = abcdef123"))
    assert not added(b64("é 漢字 nothing of the kind, only words"))


def plain_runs(text: str) -> set[tuple[int, int]]:
    """Every stretch between separators of a run of letters that is base64 of printable text with an assignment."""
    out = set()
    for m in secrets.RUN.finditer(text):
        marks = [m.start(), *(x.end() for x in secrets.APART.finditer(text, *m.span()))]
        ends = [*(x.start() for x in secrets.APART.finditer(text, *m.span())), m.end()]
        for a in marks:
            for b in ends:
                raw = secrets.unbase64(text[a:b]) if b - a >= 16 else None
                try:
                    said = raw.decode() if raw else ""
                except UnicodeDecodeError:
                    continue
                if all(c.isprintable() or c in "\r\n\t" for c in said) and any(len(x[2]) >= 6 for x in secrets.ASSIGN.finditer(said)):
                    out.add((a, b))
    return out


def test_runs_against_every_stretch():
    """A run is reported exactly where some stretch of it holds an assignment, and what is reported is such a stretch."""
    r = random.Random(3)
    for _ in range(400):
        pieces = []
        for _ in range(r.randint(1, 5)):
            pieces.append(r.choice([SECRET.rstrip("="), b64(f"token={r.randbytes(4).hex()} é").rstrip("="), b64(r.randbytes(30)), "lib", "usr", b64("only plain words here").rstrip("=")]))
            pieces.append(r.choice(["/", "-", "_", " ", ".", ":"]))
        text = "".join(pieces)
        own = {(a, b) for a, k, b in secrets.find(text)[1] if k == 5}
        every = plain_runs(text)
        assert own <= every, text
        assert all(any(a < e and s < b for s, e in own) for a, b in every), text


def test_random_runs_are_left_alone():
    r = random.Random(1)
    assert not any(added(b64(r.randbytes(r.randint(12, 200)))) for _ in range(3000))


@pytest.mark.parametrize("text", ["/a/b-c_d+e" * 30_000, "-eyJ" * 50_000, "Pz8/" * 50_000, "MII/" * 50_000, "eyJhbGci." * 30_000, "a." * 100_000])
def test_time_stays_linear(text):
    began = time.process_time()
    assert not added(text) and time.process_time() - began < 5


def test_hot_payloads_are_split(spark):
    rows = spark.createDataFrame([(i, "d" if i % 3 == 0 else f"x{i % 40}") for i in range(300)], "id long, digest string")
    repeated = rows.groupBy("digest").agg({"id": "min", "*": "count"}).toDF("digest", "n", "first").select("digest", "first", "n").where("n > 1")
    one = sorted(map(tuple, warc.with_first(rows, repeated).select("id", "digest", "first").collect()))
    assert sorted(map(tuple, warc.with_first(rows, repeated, most=0).select("id", "digest", "first").collect())) == one and len(one) == 300
