"""Secret scan with structural confirmation.

The base patterns mark assignments, access keys and long hex runs. Beyond them,
base64 and hex runs, key blocks and dotted tokens are only candidates: each is
decoded, and it is reported when what comes out has the structure of a secret:

* ``jwt``: a signed token whose header and payload decode to JSON objects, the header naming an algorithm;
* ``key``: a private key: DER whose nested lengths add up and whose fields are those of
  PKCS#1, PKCS#8 or SEC 1, or the OpenSSH container with its length-prefixed fields; bare, in a
  BEGIN/END block, in base64 or in hex;
* ``nested``: base64 or hex of printable UTF-8 text that itself holds an assignment, an access key, a key block, a signed token, or,
  up to ``DEPTH`` times, another such run.

What stands beside a candidate doesn't hide it. A run of base64 letters may be part of a path or of a dotted or dashed name, so it is read from
its start and from after each ``/ + - _`` in it; where only its beginning decodes, it is read up to the next of these. The first 48 bytes tell
whether a start is worth reading on, and a text that was read is not read again from inside. Dotted chains are tried at every three parts, and the first of them after each
``- _`` in it.

All candidates but assignments and key blocks are free of white space and of 16 characters or more,
so texts without such a chunk need no search for them. All scans are linear in the text.

Defined results: a null or empty text has no spans; offsets count code points, ends
are exclusive; spans of different kinds may overlap; repeated rows repeat results;
an empty table gives an empty result; other columns are not read unless kept.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh, map_texts

#: Kinds in the order that breaks ties of a start: base kinds, then confirmed structures.
KINDS = ("assign", "access", "hex", "jwt", "key", "nested")
#: Keywords of assignments; fixed by the base pattern.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Shortest candidates that can hold a secret: the 12 bytes of "token=" and six characters.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{24,}|[0-9A-F]{24,})(?![0-9A-Za-z])")
#: Three dotted parts or more; the parts of a signed token are at least so long.
CHAIN = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
HEADER, PAYLOAD = 10, 4
#: What may part a candidate from its neighbours inside of a run.
APART = re.compile(r"[/+_-]")
#: Beginning of a JSON object with a member.
OBJECT = re.compile(rb'\{\s*"')
#: Runs in decoded text are followed so many times.
DEPTH = 3
#: A key block; in a string literal its line ends, tabs and slashes may be escaped.
MARK = re.compile(r"-----(BEGIN|END) ([A-Z ]{0,40}PRIVATE KEY)-----")
BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,-]|\\+[nrt/])*")
#: Headers of an encrypted block in the old style; the cipher's start value is 8 or 16 bytes.
SEALED = re.compile(r"\s*Proc-Type:\s*4,\s*ENCRYPTED\s+DEK-Info:\s*[A-Z0-9-]+,\s*(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{16})\s+([A-Za-z0-9+/=\s]+)")
ESCAPED = re.compile(r"\\+([nrt/])")
PLAIN = {"n": "\n", "r": "\r", "t": "\t", "/": "/"}


def unbase64(run: str) -> bytes | None:
    """Standard or URL-safe base64, padded or not; None where it is neither."""
    body = run.rstrip("=")
    if len(body) % 4 == 1 or ("-" in body or "_" in body) and ("+" in body or "/" in body):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(raw: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill ``raw`` exactly; None where a length doesn't fit."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, n = raw[at], raw[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(raw):
                return None
            n, at = int.from_bytes(raw[at : at + k], "big"), at + k
        if at + n > len(raw):
            return None
        out.append((tag, raw[at : at + n]))
        at += n
    return out


def is_key(raw: bytes) -> bool:
    """Whether the bytes are a private key by structure."""
    if raw.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(raw) or (end := at + 4 + int.from_bytes(raw[at : at + 4], "big")) > len(raw):
                return False
            at = end
        return at + 4 <= len(raw) and int.from_bytes(raw[at : at + 4], "big") >= 1
    if len(raw) < 24 or raw[0] != 0x30:
        return False
    top = der_items(raw)
    if not top or len(top) != 1 or not (items := der_items(top[0][1])):
        return False
    tags = [t for t, _ in items]
    if len(items) >= 9 and all(t == 2 for t in tags[:9]) and items[0][1] in (b"\0", b"\1"):
        return True  # PKCS#1: version and eight integers
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8: version, algorithm, key
        algorithm = der_items(items[1][1])
        return bool(algorithm) and algorithm[0][0] == 6
    if tags[:2] == [0x30, 0x04] and len(items) == 2:  # PKCS#8, encrypted
        algorithm = der_items(items[0][1])
        return bool(algorithm) and algorithm[0][0] == 6 and len(items[1][1]) >= 16
    return tags[:2] == [0x02, 0x04] and items[0][1] == b"\1" and len(items[1][1]) in (24, 28, 32, 48, 66)  # SEC 1


def is_token(header: str, payload: str, signature: str) -> bool:
    """Whether three dotted parts are a signed token: JSON objects, an algorithm, a signature unless that is none."""
    parts = []
    for x in (header, payload):
        raw = unbase64(x)
        try:
            parts.append(json.loads(raw) if raw is not None else None)
        except (ValueError, RecursionError):
            return False
    if not all(isinstance(x, dict) for x in parts) or not isinstance(parts[0].get("alg"), str):
        return False
    return not signature if parts[0]["alg"].lower() == "none" else len(unbase64(signature) or b"") >= 16


def printable(raw: bytes) -> str:
    """The longest beginning of ``raw`` that is printable UTF-8 text."""
    try:
        text = raw.decode()
    except UnicodeDecodeError as e:
        text = raw[: e.start].decode()
    if text.isprintable():
        return text
    end = next((k for k, c in enumerate(text) if not (c.isprintable() or c in "\r\n\t")), len(text))
    return text[:end]


def holds_secret(raw: bytes, depth: int = DEPTH) -> bool:
    """Whether decoded bytes are printable text with a secret in it."""
    text = printable(raw)
    if len(text.encode()) < len(raw):
        return False
    if any(len(m[2]) >= 6 for m in ASSIGN.finditer(text)) or any(len(m[0]) >= 20 for m in ACCESS.finditer(text)) or blocks(text):
        return True
    return depth > 1 and bool(confirmed_spans(text, depth - 1))


def loose(run: str) -> bytes:
    """What base64 letters of either kind decode to, without a last letter that is no byte."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def key_bytes(raw: bytes) -> int:
    """How many bytes an outermost DER item takes; 0 where it is none or doesn't fit."""
    k = raw[1] & 0x7F if raw[1] & 0x80 else 0
    if k > 4 or len(raw) < 2 + k:
        return 0
    n = 2 + k + (int.from_bytes(raw[2 : 2 + k], "big") if k else raw[1])
    return n if n <= len(raw) else 0


def opens_key(head: bytes) -> bool:
    """Whether bytes begin like a key: the container's name, or a sequence whose first item is a version or a sequence."""
    if head[:1] != b"\x30" or len(head) < 9:
        return head.startswith(b"openssh-key-v1\0")
    k = 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)
    return k <= 6 and (head[k : k + 2] == b"\2\1" and head[k + 2] <= 1 or head[k] == 0x30)


def run_spans(text: str, start: int, end: int, depth: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) of keys and of texts with secrets in a run of base64 letters."""
    out: list[tuple[int, int, int]] = []
    past = start  # nothing before it is looked at again
    read = [0, 0, 0, 0]  # where texts that were read end, by start modulo 4
    for at in [start, *(m.end() for m in APART.finditer(text, start, end))]:
        if at < past or end - at < 16 or read[at % 4] > at:
            continue
        head = loose(text[at : min(end, at + 64)])
        if opens_key(head):
            raw = unbase64(text[at:end])
            if raw and is_key(raw):
                out.append((at, 4, end))
                past = end
            elif head[0] == 0x30 and 0 < (n := key_bytes(raw := loose(text[at:end]))) and is_key(raw[:n]):
                past = at + -(-n * 4 // 3)
                past += len(text[past:end]) - len(text[past:end].lstrip("="))
                out.append((at, 4, past))
            if past > at:
                continue
        if len(printable(head).encode()) < 12:
            continue  # shorter than any secret
        raw = loose(text[at:end])
        said = printable(raw).encode()
        whole = at + len(said) // 3 * 4  # the group of letters in which the text ends
        ends = [e for e in range(min(end, whole + 4), whole - 1, -1) if e == end or text[e] in "/+_-="]
        if len(said) == len(raw) and end not in ends:
            ends.insert(0, end)
        if holds_secret(said, depth):  # then it may also end earlier: what follows can be letters that happen to decode
            ends += [m.start() for m in reversed(list(APART.finditer(text, at + 16, whole)))]
        else:
            read[at % 4] = whole
        for e in ends:
            told = unbase64(text[at:e])
            if told and holds_secret(told, depth):
                out.append((at, 5, e))
                past = e
                break
    return out


def token_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of signed tokens in dotted chains."""
    out = []
    for m in CHAIN.finditer(text):
        parts = m[0].split(".")
        at, taken = m.start(), 0
        for k in range(len(parts) - 2):
            header, payload, signature = parts[k : k + 3]
            if k >= taken and len(header) >= HEADER and len(payload) >= PAYLOAD:
                for start in [0, *(x.end() for x in APART.finditer(header))]:
                    own = header[start:]
                    if len(own) >= HEADER and own[0] == "e" and OBJECT.match(loose(own[:16])) and is_token(own, payload, signature):
                        out.append((at + start, 3, at + len(header) + len(payload) + len(signature) + 2))
                        taken = k + 3
                        break
            at += len(header) + 1
    return out


def blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, body) of key blocks: a mark of the beginning, and as the next mark the end of the same name."""
    marks = list(MARK.finditer(text))
    return [(a.start(), b.end(), text[a.end() : b.start()]) for a,
        b in zip(marks, marks[1:], strict=False) if a[1] == "BEGIN" and b[1] == "END" and a[2] == b[2] and BODY.fullmatch(text, a.end(),
            b.start())]


def is_block(body: str) -> bool:
    """Whether the body of a key block decodes to a key, or is sealed: headers of a cipher and whole blocks of bytes."""
    plain = ESCAPED.sub(lambda e: PLAIN[e[1]], body)
    if sealed := SEALED.fullmatch(plain):
        raw = unbase64(re.sub(r"\s", "", sealed[1])) or b""
        return len(raw) >= 24 and len(raw) % 8 == 0
    lines = "".join(x for x in plain.split("\n") if ":" not in x)
    raw = unbase64(re.sub(r"\s", "", lines))
    return bool(raw) and is_key(raw)


def base_spans(text: str, chunks: bool) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; ``chunks``: a chunk of 20 characters without white space exists."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if chunks:
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return out


def confirmed_spans(text: str, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what decodes to a secret."""
    out = [(start, 4, end) for start, end, body in blocks(text) if is_block(body)]
    if "." in text:
        out += token_spans(text)
    for m in RUN.finditer(text):
        start = m.start() + (text[max(0, m.start() - 1)] == "\\" and m[0][0] in "nrt")  # the letter of an escape is no part of the run
        out += run_spans(text, start, m.end(), depth)
    for m in ANY_HEX.finditer(text):
        raw = bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 else b""
        if is_key(raw):
            out.append((m.start(), 4, m.end()))
        elif raw and holds_secret(raw, depth):
            out.append((m.start(), 5, m.end()))
    return list(dict.fromkeys(out))


def find(text: str) -> tuple[list, list]:
    """Base spans and all spans as (start, kind, end), each sorted."""
    longest = max(map(len, text.split()), default=0)
    base = base_spans(text, longest >= 20)
    more = confirmed_spans(text) if longest >= 16 or "-----BEGIN" in text else []
    return sorted(base), sorted(base + more)


def redact(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, n_assign, n_access, n_hex, base_sha256, spans and n_confirmed."""

    def make():
        def f(_, texts):
            found = [find(t.decode()) for t in texts]
            out = {f"n_{KINDS[k]}": [sum(x[1] == k for x in base) for base, _ in found] for k in range(3)}
            out["base_sha256"] = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [joined(every) for _, every in found]
            out["n_confirmed"] = [len(every) - len(base) for base, every in found]
            return out

        return f

    longs = [(f"n_{k}", "long", pa.int64()) for k in KINDS[:3]]
    return map_texts(df, id_col, text_col, make, [*longs, ("base_sha256", "string", pa.string()), ("spans", "string", pa.string()),
            ("n_confirmed", "long", pa.int64())])


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the secrets of the text replaced; texts without any stay as they are, null included."""
    from pyspark.sql import functions as F

    def make():
        def f(_, texts):
            out = []
            for t in texts:
                text = t.decode()
                spans = find(text)[1]
                out.append(redact(text, spans) if spans else None)
            return {clean: out}

        return f

    clean = fresh(df, "__clean")
    got = map_texts(df, id_col, text_col, make, [(clean, "string", pa.string())], keep=True)
    return got.withColumn(text_col, F.coalesce(clean, text_col)).select(*[F.col(f"`{c}`") for c in df.columns])
