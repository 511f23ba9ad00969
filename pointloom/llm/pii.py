"""Personal data by candidate gradient boosting.

The base patterns always report. Beyond them, high-recall generators propose
overlapping spans: mail addresses in any spelling (``at``, ``dot``), digit groups
with all common separators, dotted and colon-separated addresses, account numbers
that start with letters. Each candidate is described by its format (length, digits,
groups, separators, checksums) and its context (words before it, characters around
it), and boosted regression trees rate it. Isotonic regression on candidates kept out of the fit turns
ratings into probabilities, kind by kind, and a candidate is added where its probability
reaches ``PROBABILITY``.

The trees are trained here, on candidates that a documented generator writes
(``examples``): forms of every kind beside look-alikes such as order numbers,
versions, dates, sums and hashes, each in a context that hints at its kind, at something else, or at
nothing. No table labels such data, so how often a form in a context is personal is stated as
``RATES``, and labels are drawn with them: that is what the probabilities mean. The
examples are a bounded set of their own, so nothing of the corpus is needed to fit and the model has a fixed size.

Defined results: a null or empty text has no spans; offsets count code points, ends
are exclusive; candidates that touch a base span are not added; repeated rows repeat
results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: Kinds in the order that breaks ties of a start.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A leftmost match starts where a run of digits does, so no start inside a run is tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Probability from which on a candidate is added.
PROBABILITY = 0.9
#: How often a form is personal data after a word that hints at its kind, after any other word, and after one of DOUBTS.
RATES = {
    "spelt address in brackets": (0.99, 0.97, 0.92), "spelt address in words": (0.97, 0.70, 0.30), "words around at": (0.06, 0.02, 0.01),
        "eight hexadecimal groups": (0.98, 0.94, 0.80), "clock time": (0.02, 0.01, 0.01),
    "card number with its check digit": (0.99, 0.92, 0.40), "digits like a card": (0.05, 0.01, 0.01),
        "grouped phone number": (0.97, 0.35, 0.08), "date or sum": (0.03, 0.01, 0.01), "bracketed phone number": (0.99, 0.95, 0.60),
    "account number with its check digits": (0.99, 0.98, 0.90), "letters and digits like an account": (0.10, 0.03, 0.01),
        "social number": (0.98, 0.45, 0.10), "number out of the social range": (0.05, 0.02, 0.01),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping within a kind."""
    out = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):  # a match starts where the run of local characters before its @ does
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                last = m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


DIGIT = re.compile(r"[0-9]")
#: Bracketed words of spelt mail addresses, in lower-case text.
AT, DOT = (re.compile(rf"[(\[{{]\x20?{w}\x20?[)\]}}]") for w in ("at", "dot"))
#: High-recall generators, by the kind that they propose.
GENERATORS = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20|\x20@\x20?|@\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,63}){1,4}",
            re.I)),
    (1, re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")),
    (2, re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([\x20./-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20./-])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.\-/])[0-9]{2,4}(?:[\x20.\-/][0-9]{2,6}){1,3}(?![0-9A-Za-z])")),
    (4, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    (5, re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])")),
)
#: Words whose nearness speaks for a kind.
HINTS = (
    ("mail", "contact", "write", "reach", "correo"),
    ("ip", "host", "server", "address", "client", "login"),
    ("card", "visa", "credit", "payment", "pay", "karte", "carte", "tarjeta"),
    ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "ruf"),
    ("iban", "account", "bank", "konto", "cuenta", "compte"),
    ("ssn", "social", "security", "id", "passport"),
)
#: Ends of common domains.
ENDS = ("com", "org", "net", "de", "fr", "es", "it", "uk", "eu", "edu", "gov", "info", "io")
#: Words whose nearness speaks against all.
DOUBTS = ("order", "version", "invoice", "total", "isbn", "page", "part", "serial", "item", "date", "build", "model", "sum", "number", "no")


def iban_valid(span: str) -> bool:
    s = span.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context features of a candidate."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", span)
    before = re.findall(r"[a-z]+", text[max(0, start - 40) : start].lower())[-4:]
    seps = [span.count(c) for c in " -./():"]
    return [
        float(kind), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
            len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        *map(float, seps), float(len({c for c in span if c in " -./"})), float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0,
            float(iban_valid(span)) if kind == 4 else -1.0,
        float("at" in span.lower()), float("dot" in span.lower()), float(any(c in "([{" for c in span)), float(span.lower().endswith(ENDS)),
            float(len(re.split(r"[ .]", span)[-1])),
        float(any(h in before for h in HINTS[kind])), float(any(h in before for k, hs in enumerate(HINTS) if k != kind for h in hs)),
            float(any(h in before for h in DOUBTS)),
        float(bool(groups) and groups[0][:1] == "0"), float(int(digits[:4]) in range(1900, 2100)) if len(digits) >= 4 else 0.0,
            float(digits[:3] in ("000", "666") or digits[:1] == "9") if digits else 0.0,
        float(start > 0 and text[start - 1] in "#$€£=/\\"), float(end < len(text) and text[end] in "%$€£/\\="), float(len(set(digits)) <= 2),
    ]


def proposals(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of all generators that touch no base span; they may overlap each other."""
    has_digit = bool(DIGIT.search(text))
    out = []
    for kind, pattern in GENERATORS:
        if kind == 0:
            low = text.lower()
            if not ("@" in text or AT.search(low) or " at " in low and (" dot " in low or DOT.search(low))):
                continue
        elif not has_digit or kind == 1 and ":" not in text:
            continue
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return free(out, [(a, b) for a, _, b in taken])


def free(spans: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The spans that touch none of ``taken``."""
    starts, reach, last = [], [], 0  # by start, with the furthest end so far
    for a, b in sorted(taken):
        last = max(last, b)
        starts.append(a)
        reach.append(last)
    # of what starts before a span's end, none may reach beyond its start
    return [x for x in spans if not (k := bisect.bisect_left(starts, x[2])) or reach[k - 1] <= x[0]]


def examples(seed: int = 7, n: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of ``n`` written candidates, repeatable by the seed."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "en", "la", "de", "sch", "in")) for _ in range(r.randint(1, 4)))

    def card(valid: bool) -> str:
        d = r.choice("3456") + num(14)
        last = next(c for c in "0123456789" if luhn(d + c))
        d += last if valid else str((int(last) + r.randint(1, 9)) % 10)
        sep = r.choice((".", "/", "", ""))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def iban(valid: bool) -> str:
        body, land = num(18), r.choice(("DE", "FR", "ES", "GB"))
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        s = f"{land}{(check if valid else (check + r.randint(1, 90)) % 97):02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    def address(at: str, dot: str, end: str) -> str:
        name = f"{word()}{r.choice(('.', '_', ''))}{num(r.randint(0, 2)) if r.random() < 0.5 else ''}{at}{word()}{dot}{end}"
        return name.upper() if r.random() < 0.1 else name

    forms = {
        "spelt address in brackets": (0, lambda: address(*r.choice((("(at)", "(dot)"), (" [at] ", "."), (" (at) ", " dot "),
                    ("{at}", "{dot}"), (" (at) ", " (dot) "))), r.choice(ENDS))),
        "spelt address in words": (0, lambda: address(" at ", " dot ", r.choice(ENDS))),
        "words around at": (0, lambda: address(" at ", r.choice((".", " dot ")), word() + "xx")),
        "eight hexadecimal groups": (1, lambda: ":".join(f"{r.randrange(1 << 16):x}" for _ in range(8))),
        "clock time": (1, lambda: ":".join(f"{r.randint(0, 59):02d}" for _ in range(r.randint(3, 4)))),
        "card number with its check digit": (2, lambda: card(True)),
        "digits like a card": (2, lambda: card(False)),
        "grouped phone number": (3, lambda: r.choice((f"0{num(2)}%s{num(3)}%s{num(4)}",
                    f"{r.randint(2, 9)}{num(2)}%s555%s{num(4)}")).replace("%s", r.choice(" -."))),
        "bracketed phone number": (3, lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        "date or sum": (3, lambda: r.choice((f"{num(4)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{num(2)}.{num(2)}.{num(4)}",
                    f"{num(2)} {num(3)} {num(3)}", f"{num(4)}/{num(2)}/{num(2)}", f"{num(3)}.{num(3)}.{num(3)}.{num(2)}"))),
        "account number with its check digits": (4, lambda: iban(True)),
        "letters and digits like an account": (4, lambda: iban(False)),
        "social number": (5, lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"),
        "number out of the social range": (5,
            lambda: f"{r.choice((0, 666, 900 + r.randint(0, 99))):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"),
    }
    xs, ys = [], []
    while len(xs) < n:
        name = r.choice(list(forms))
        kind, make = forms[name]
        context = r.randrange(3)
        lead = f"{word()} {word()} {(r.choice(HINTS[kind]), word(), r.choice(DOUBTS))[context]}{r.choice((' ', ': '))}"
        body = make()
        text = f"{lead}{body} {word()}"
        for s, k, e in proposals(text, []):
            whole = k == kind and s <= len(lead) and e >= len(lead) + len(body) - 1
            xs.append(describe(text, s, k, e))
            ys.append(float(whole and r.random() < RATES[name][context]))  # another kind's part of a form is no datum of that kind
    return np.array(xs[:n]), np.array(ys[:n])


class Forest:
    """Boosted trees of logistic loss, with splits on quantile bins, and thresholds by kind."""

    def __init__(self, trees: list, start: float, rate: float):
        self.trees, self.start, self.rate, self.threshold, self.step = trees, start, rate, {}, {}

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Forest:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        p0 = y.mean()
        self = cls([], float(np.log(p0 / (1 - p0))), rate)
        score = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)

            def grow(rows: np.ndarray, left: int):
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best, cut = 1e-6, None
                for j in range(x.shape[1]) if left else ():
                    k = len(edges[j]) + 1
                    cg = np.cumsum(np.bincount(bins[rows, j], g[rows], k))[:-1]
                    ch = np.cumsum(np.bincount(bins[rows, j], h[rows], k))[:-1]
                    gain = cg**2 / (ch + ridge) + (total_g - cg) ** 2 / (total_h - ch + ridge) - total_g**2 / (total_h + ridge)
                    if len(gain) and gain.max() > best:
                        best, cut = gain.max(), (j, int(gain.argmax()))
                if cut is None:
                    value = total_g / (total_h + ridge)
                    score[rows] += rate * value
                    return float(value)
                j, b = cut
                low = bins[rows, j] <= b
                return (j, float(edges[j][b]), grow(rows[low], left - 1), grow(rows[~low], left - 1))

            self.trees.append(grow(np.arange(len(y)), depth))
        return self

    def odds(self, row: list[float]) -> float:
        s = self.start
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            s += self.rate * node
        return s

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """For each kind the probability as a rising step function of the rating, and the rating from which on it reaches PROBABILITY."""
        s = np.array([self.odds(list(r)) for r in x])
        for kind in range(len(KINDS)):
            mine = x[:, 0] == kind
            order = np.argsort(s[mine], kind="stable")
            steps: list[list[float]] = []  # first rating, sum, number: neighbours are pooled until means rise
            for rating, label in zip(s[mine][order].tolist(), y[mine][order].tolist(), strict=True):
                steps.append([rating, label, 1.0])
                while len(steps) > 1 and (steps[-2][0] == steps[-1][0] or steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]):
                    _, total, count = steps.pop()
                    steps[-1][1] += total
                    steps[-1][2] += count
            values = [(a + 1) / (c + 2) if c < 20 else a / c for _, a, c in steps]  # a small step is drawn towards a half
            self.step[kind] = ([x[0] for x in steps], np.maximum.accumulate(values).tolist() if values else [])
            self.threshold[kind] = next((at for at, v in zip(*self.step[kind], strict=True) if v >= PROBABILITY), float("inf"))

    def probability(self, kind: int, odds: float) -> float:
        """The calibrated probability of a rating."""
        at, value = self.step[kind]
        k = bisect.bisect_right(at, odds)
        return value[k - 1] if k else 0.0


@functools.cache
def model() -> Forest:
    """Fitted on half of the examples, calibrated on the rest."""
    x, y = examples()
    cut = len(x) // 2
    forest = Forest.fit(x[:cut], y[:cut])
    forest.calibrate(x[cut:], y[cut:])
    return forest


def find(text: str, forest: Forest) -> tuple[list, list]:
    """Base spans and all spans, as sorted (start, kind, end)."""
    base = base_spans(text)
    rated = [(forest.odds(describe(text, *c)), c) for c in proposals(text, base)]
    added: list = []  # sorted and disjoint
    for _, c in sorted((x for x in rated if x[0] >= forest.threshold[x[1][1]]), key=lambda x: (-x[0], x[1])):
        k = bisect.bisect_left(added, c)
        if (k == 0 or added[k - 1][2] <= c[0]) and (k == len(added) or c[2] <= added[k][0]):  # of overlapping candidates the likeliest stays
            added.insert(k, c)
    return base, sorted(base + added)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added."""
    shared = df.sparkSession.sparkContext.broadcast(model())

    def make():
        forest = shared.value

        def f(_, texts):
            found = [find(t.decode(), forest) for t in texts]
            out = {f"n_{KINDS[k]}": [sum(x[1] == k for x in base) for base, _ in found] for k in range(4)}
            out["base_sha256"] = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [joined(every) for _, every in found]
            out["n_added"] = [len(every) - len(base) for base, every in found]
            return out

        return f

    longs = [(f"n_{k}", "long", pa.int64()) for k in KINDS[:4]]
    return map_texts(df, id_col, text_col, make, [*longs, ("base_sha256", "string", pa.string()), ("spans", "string", pa.string()),
            ("n_added", "long", pa.int64())])
