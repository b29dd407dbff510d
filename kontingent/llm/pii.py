"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans, numbers at every border of
digit groups.  Spans of the strict base rules (four kinds) are certain and always kept.  Every other proposal gets
format features (digits, groups, separators, checksum) and context features
(cue words and characters around it); boosted trees score it, and a threshold
per kind, calibrated for precision on held-out examples, decides.

The trees are trained on examples that ``examples`` writes from templates with
a fixed seed (``TRAIN_EXAMPLES`` of them), so no table is collected; trees and
thresholds are a few kilobytes.

All scans are linear in the text, also in very long runs of one character
class.  Offsets are code points, ends exclusive.  Edge cases: a null or empty
text has no spans; a span proposed twice counts once; proposals that overlap a
base span or a higher-scored proposal are dropped, the longer one of equal
scores (ties) stays; rows are judged one by one, so repeated rows and null ids
need no care; an empty table gives an empty result; columns with the names of
outputs are replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .boosting import Boosted, calibrated_threshold
from .common import slices

KINDS = ("email", "ip", "card", "phone")
TRAIN_EXAMPLES = 6000
#: Precision that a kind's threshold reaches on the held-out examples.
PRECISION = 0.995
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by kind as in KINDS, then by start."""
    out = _emails(text)
    ips, cards = [], []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".") if m[0].count(".") >= 3 else ()
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k: k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                ips.append(("ip", at, end))
            at = end + 1
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            cards.append(("card", *m.span()))
    phones = [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return [*out, *ips, *cards, *phones]


_PROPOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}){1,4}")),
    ("ip", re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")),
    ("card", re.compile(r"[0-9](?:[\x20-]?[0-9]){12,18}")),
    ("phone", re.compile(r"[(0-9][0-9]{1,4}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){2,4}")),
)
_GROUP = re.compile("[0-9]+")
_PHONE_START = re.compile(r"(?<![0-9])\+?\(?(?=[0-9])")
_PHONES = tuple(re.compile(r"(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){%d}(?![0-9])" % k) for k in (2, 3, 4))
_AT = re.compile(r"[\[({]\x20?(?:at|AT|@)\x20?[\])}]")

# Words that often stand before personal data, and before numbers that are none.
_CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "whatsapp", "contact"),
    "email": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"),
    "ip": ("ip", "host", "address", "server", "from", "login"),
    "other": ("order", "invoice", "isbn", "version", "page", "no", "ref", "id", "date", "serial", "part", "article", "vol", "section"),
}


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data beyond the base rules; these may overlap."""
    out: list[Span] = []
    for m in _AT.finditer(text):  # the anchor bounds the work in long runs of letters
        lo = max(0, m.start() - 66)
        for got in _PROPOSE[0][1].finditer(text, lo, min(len(text), m.end() + 330)):
            out.append(("email", *got.span()))
    if ":" in text:
        out += [("ip", *m.span()) for m in _PROPOSE[1][1].finditer(text)]
    for kind, pattern in _PROPOSE[2:]:
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    for m in _CARD.finditer(text):  # numbers may stand next to each other: every run of whole groups
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        for i, (a, _) in enumerate(groups):
            size = 0
            for u, v in groups[i:]:
                size += v - u
                if size > 19:
                    break
                if size >= 13:
                    out.append(("card", a, v))
    for m in _PHONE_START.finditer(text):
        out += [("phone", m.start(), got.end()) for pattern in _PHONES if (got := pattern.match(text, m.start()))]
    return list(dict.fromkeys(out))


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s, before = text[a:b], text[max(0, a - 40): a].lower()
    after = text[b: b + 12]
    cues = re.findall(r"[^\W\d_][\w-]*", before)[-4:]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    prev, nxt = text[a - 1: a], text[b: b + 1]
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(d)), float(len(groups)), float(max(map(len, groups), default=0)),
        float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0),
        float(s.startswith("(")), float(s.startswith("0")), float("-" in s), float("." in s), float(" " in s), float("/" in s),
        float(bool(d) and luhn(d)), float(len(d) in (13, 14, 15)), float(d[:2] in ("34", "37") or d[:1] in ("4", "5")),
        float(len(set(d))), float(prev.isalnum() or prev in ("-", ".", "#", "/")), float(nxt.isalnum() or nxt in ("-", "/", "%", "€", "$")),
        *[float(any(c in words for c in cues)) for words in _CUES.values()],
        float(any("0" <= ch <= "9" for ch in text[max(0, a - 2): a])), float(any("0" <= ch <= "9" for ch in after[:2])),
        float(s.count("(") - s.count(")")), float(s.startswith("+")), float(prev in ("+", "(")), float(prev == "+" or text[max(0, a - 4): a].startswith("+")),
        float(len(d) == 16), float(all(len(g) == 4 for g in groups)),
        float(any(ch in after for ch in "=€$%")), float(s.count(":")), float("@" in s or "at" in s.lower()),
    ]


def _fake_luhn(rng: random.Random, n: int, good: bool) -> str:
    body = rng.choice("345") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    fit = next(c for c in "0123456789" if luhn(body + c))
    return body + (fit if good else str((int(fit) + rng.randint(1, 9)) % 10))


def examples(n: int = TRAIN_EXAMPLES, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of proposals in sentences written from templates."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8)))
    x, y, kinds = [], [], []
    while len(y) < n:
        kind, label = rng.choice(KINDS), rng.random() < 0.5
        cue = rng.choice(_CUES[kind]) if label else rng.choice([*_CUES["other"], word(), word()])
        if kind == "phone":
            sep = rng.choice(" -./")
            s = rng.choice((f"({num(3)}) {num(3)}-{num(4)}", f"0{num(3)}{sep}{num(3)}{sep}{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}")) if label else rng.choice(
                (f"{rng.randint(1900, 2030)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)}-{num(4)}-{num(4)}-{num(2)}", f"{num(4)} {num(4)} {num(4)} {num(4)}"))
        elif kind == "card":
            good = label or rng.random() < 0.1
            d = _fake_luhn(rng, rng.choice((13, 14, 15, 16, 16, 16, 17, 18, 19)) if label else rng.randint(13, 19), good)
            s = d if rng.random() < 0.6 else " ".join(d[i: i + 4] for i in range(0, len(d), 4))
        elif kind == "email":
            s = f"{word()}{rng.choice(('', '.', '_'))}{word()} {rng.choice(('(at)', '[at]', '{at}'))} {word()}{rng.choice(('.', ' (dot) ', ' [dot] '))}{rng.choice(('com', 'org', 'net', 'de'))}" if label else f"{word()} ({rng.choice(('at', 'AT'))}) {word()}.{word()}"
        else:
            s = ":".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, 4) if label else 2)) for _ in range(8))
        before = " ".join([word(), word(), cue]) + rng.choice((" ", ": ", " "))
        text, true = before + s, {(kind, len(before), len(before) + len(s))} if label else set()
        if kind in ("card", "phone") and rng.random() < 0.5:  # a number of another owner next to it
            other = rng.choice(("card", "phone", "ip", "plain"))
            more = {"card": _fake_luhn(rng, 16, True), "phone": f"+1 ({num(3)}) 555-{num(4)}", "ip": ".".join(str(rng.randint(1, 255)) for _ in range(4)), "plain": num(rng.randint(1, 4))}[other]
            if label and kind == "phone" and rng.random() < 0.7:
                s = f"+1 ({num(3)}) 555-{num(4)}"
            first, second = (s, more) if rng.random() < 0.5 else (more, s)
            text, at = f"{before}{first} {second}", len(before) + (0 if first == s else len(more) + 1)
            true = {(kind, at, at + len(s))} if label else set()
            at = len(before) + (len(s) + 1 if first == s else 0)
            true |= {(other, at, at + len(more))} if other in KINDS else set()
        end = len(text)
        text += rng.choice((" ", ". ", ", ")) + word()
        base = base_spans(text)
        for span in proposals(text):
            if span[1] < end and span[2] > len(before) and not any(a < span[2] and span[1] < b for _, a, b in base):
                x.append(features(text, span)), y.append(float(span in true)), kinds.append(KINDS.index(span[0]))
    return np.array(x), np.array(y), np.array(kinds)


@lru_cache(maxsize=4)
def model(precision: float = PRECISION) -> tuple[Boosted, tuple[float, ...]]:
    """Trees, and the threshold of each kind from the third of the examples that was held out."""
    x, y, kinds = examples()
    held = np.arange(len(y)) % 3 == 2
    trees = Boosted().fit(x[~held], y[~held])
    score = trees.predict(x[held])
    return trees, tuple(calibrated_threshold(score[kinds[held] == k], y[held][kinds[held] == k], precision) for k in range(len(KINDS)))


class Taken:
    """Places of a text that spans hold, as separate stretches in order, so that a look-up is a bisection."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a), self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> None:
        """A stretch that meets none."""
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a), self.ends.insert(k, b)


def all_spans(texts: list[str], trees: Boosted, thresholds) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; proposals of all texts are scored together."""
    found, taken, rows, where = [], [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text)
        found.append((base, list(base)))
        taken.append(Taken(base))
        for span in proposals(text):
            if not taken[k].meets(*span[1:]):
                rows.append(features(text, span)), where.append((k, span))
    if rows:
        score = trees.predict(np.array(rows))
        size = np.array([b - a for _, (_, a, b) in where])
        for i in np.lexsort((-size, -score)).tolist():  # the longer one of equals
            k, span = where[i]
            if score[i] >= thresholds[KINDS.index(span[0])] and not taken[k].meets(*span[1:]):
                found[k][1].append(span)
                taken[k].add(*span[1:])
    return [(base, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))) for base, spans in found]


def spans_text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact_text(text: str, spans) -> str:
    """Spans replaced by their kind in brackets; overlapping ones become one, named by the first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_FOUND = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]


def detect(docs: DataFrame, text: str = "text", precision: float = PRECISION, redact: bool = False) -> DataFrame:
    """``docs`` with counts of base spans, their digest, and all spans.

    The text is dropped, or with ``redact`` replaced by its redacted form.
    """
    made = {f.name for f in _FOUND}
    kept = [c for c in docs.columns if c not in made and (redact or c != text)]
    shared = docs.sparkSession.sparkContext.broadcast(model(precision))

    def run(batches):
        for b in slices(batches):
            at = b.schema.get_field_index
            raw = b.column(at(text)).to_pylist()
            both = all_spans([t or "" for t in raw], *shared.value)
            cols = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in KINDS]
            cols.append(pa.array([hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in both], pa.string()))
            cols.append(pa.array([spans_text(spans) for _, spans in both], pa.string()))
            if redact:
                raw = [redact_text(t, spans) if spans else t for t, (_, spans) in zip(raw, both)]
            same = [pa.array(raw, b.column(at(c)).type) if c == text else b.column(at(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(same + cols, names=[*kept, *[f.name for f in _FOUND]])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + _FOUND))
