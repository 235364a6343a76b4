"""Personal data by candidate gradient boosting.

Fixed patterns find the base spans of four kinds. Around them, generators of high recall propose
further, overlapping candidates (written-out addresses, numbers with unusual separators, local
phone numbers, keys and passwords, ...), all in time that grows with the text's length. Boosted trees judge each candidate by its format and its context; their
scores are calibrated per kind on held-out examples, and the candidate is taken where its
probability reaches the kind's threshold. Base spans always stay; of overlapping candidates the
most probable stays.

The trees learn from examples that :func:`training_examples` writes from rules with a fixed seed,
so training reads no table and its size is the parameter ``examples``.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import map_arrow

#: The kinds of the fixed patterns, and all: secrets are only ever added.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the fixed patterns: leftmost and non-overlapping within each kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out["email"].append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = re.sub(r"[\x20-]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
                out["phone"].append(m.span())
    return out


# --- candidates ------------------------------------------------------------------------------

_AT = re.compile(r"\s{0,3}(?:@|\(\s?at\s?\)|\[\s?at\s?\]|\{\s?at\s?\}|\bat\b)\s{0,3}", re.I)
_AFTER_AT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\s?(?:\(\s?dot\s?\)|\[\s?dot\s?\]|\{\s?dot\s?\}|\bdot\b)\s?)[A-Za-z0-9-]{1,63}){1,6}", re.I)
_STRING = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{8,512}+(?![A-Za-z0-9_+/=-])")
_GIVEN = re.compile(r"([A-Za-z]+)[\x20\"']{0,2}([=:]?)[\x20]{0,2}([\"']?)$")
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"(?<![0-9A-Za-z])[0-9]++(?![0-9A-Za-z])")
_GAP = re.compile(r"[\x20().\-/]{1,3}")
_LEFT, _RIGHT = re.compile(r"(?<![A-Za-z])([0-9]{1,20})([\x20().\-/]{1,3})$"), re.compile(r"([\x20().\-/]{1,3})([0-9]{1,20}+)(?![A-Za-z])")
_QUAD = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\)|,)\s?[0-9]{1,3}){3}(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::|[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")
#: Numbers are written in at most so many groups of digits.
GROUPS = 8
#: Candidates judged at once.
JUDGED = 20_000
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]*$")
#: Words beside which a number or an address is meant as such.
_CUES = {
    "secret": frozenset("token key secret password passwd pwd apikey bearer credential auth".split()),
    "email": frozenset("email mail e contact write reach courriel correo".split()),
    "ip": frozenset("ip host server address addr from client peer".split()),
    "card": frozenset("card visa mastercard amex credit debit cc karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax dial telefon telefono whatsapp".split()),
}
_AGAINST = frozenset("order invoice isbn issue version ref id total no number sum page vol build article commit checksum digest hash md5 sha etag".split())


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Overlapping proposals ``(kind, start, end)``; one stretch may be proposed for several kinds."""
    low = text.lower()
    if "@" in low or "dot" in low or "(at" in low or "[at" in low or "{at" in low:
        for m in _AT.finditer(text):
            start = m.start()
            while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            found = _AFTER_AT.match(text, m.end()) if start < m.start() else None
            if found:
                yield "email", start, found.end()
    if ":" in text:
        yield from (("ip", *m.span()) for m in _IPV6.finditer(text))
    yield from (("secret", *m.span()) for m in _STRING.finditer(text) if _telling(text, *m.span()))
    if _DIGIT.search(text):
        yield from _number_runs(text)
        yield from (("ip", *m.span()) for m in _QUAD.finditer(text))


def _telling(text: str, start: int, end: int) -> bool:
    """Whether a string may be a secret: long and of letters and digits, or given as the value of a name."""
    digits = sum(map(str.isdigit, text[start:end]))
    if end - start >= 16 and 0 < digits < end - start:
        return True
    given = _GIVEN.search(text, max(0, start - 24), start)
    return bool(given and given[1].lower() in _CUES["secret"])


def _number_runs(text: str) -> Iterator[tuple[str, int, int]]:
    """Every run of up to ``GROUPS`` neighbouring digit groups with as many digits as a card or a phone number has."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    for i, (start, end) in enumerate(groups):
        digits, j, first = end - start, i, start
        while start - first < 2 and first > 0 and text[first - 1] in "+(":
            first -= 1
        if first < start and first > 0 and text[first - 1].isascii() and text[first - 1].isalnum():
            first = start
        while digits <= 19:
            if 12 <= digits:
                yield "card", first, end
            if 7 <= digits <= 15:
                yield "phone", first, end
            j += 1
            if j == len(groups) or j - i == GROUPS or not _GAP.fullmatch(text, end, groups[j][0]):
                break
            end = groups[j][1]
            digits += end - groups[j][0]


def _beside(text: str, start: int, end: int) -> list[float]:
    """The digit groups that stand close before and after: their lengths, and how they are joined."""
    left, right = _LEFT.search(text[max(0, start - 23) : start]), _RIGHT.match(text, end)
    tight = lambda gap: 0.0 if not gap else 1.0 if not gap.strip() else 2.0 if "/" in gap or " " in gap else 3.0
    a, b = (left[1], left[2]) if left else ("", ""), (right[2], right[1]) if right else ("", "")
    return [float(len(a[0])), tight(a[1]), float(len(b[0])), tight(b[1])]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    groups = re.findall(r"[0-9]+", span)
    before = text[max(0, start - 40) : start]
    cue = _WORD_BEFORE.search(before)
    words = {cue[1].lower()} if cue else set()
    words |= {w.lower() for w in re.findall(r"[A-Za-z]+", before)[-3:]}
    parts = [int(g) for g in groups if len(g) < 9]
    seps = re.findall(r"[^0-9A-Za-z]+", span)
    tail = re.findall(r"[A-Za-z]+", span)
    given = _GIVEN.search(text, max(0, start - 24), start)
    return [
        float(KINDS.index(kind)), float(end - start), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(len(digits) >= 12 and luhn(digits)), float(len(parts) == 4 and max(parts, default=999) <= 255), float(max(parts, default=-1)),
        float(span.startswith(("+", "00"))), float("(" in span), float(span.count("-")), float(span.count(".")), float(span.count(" ")), float(span.count("/")),
        float(len({s.strip() or " " for s in seps}) if seps else 0), float(len(groups[-1]) if groups else 0), float(len(groups[0]) if groups else 0),
        float(bool(words & _CUES[kind])), float(bool(words & _AGAINST)), float(span.count(":")), float("@" in span),
        float(bool(re.search(r"[(\[{]\s*(?:at|dot|\.)\s*[)\]}]", span, re.I))), float(bool(re.search(r"\sdot\s", span, re.I))), float(len(tail[-1]) if tail else 0),
        float(text[max(0, start - 1) : start] in ("#", "$", "€", "£", "=", '"')), float(text[end : end + 1] in ("%", "°", "€")),
        float(bool(given and given[2])), float(bool(given and given[3])), float(bool(given and given[1].lower() in _CUES["secret"])), sum(map(str.isalpha, span)) / max(1, end - start),
        float(len(set(span))), float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span))), float(span != span.lower() and span != span.upper()),
        *_beside(text, start, end),
    ]


def training_examples(count: int = 8000, seed: int = 7) -> list[tuple[str, str, int, int, int]]:
    """``(text, kind, start, end, wanted)`` of ``count`` texts written by rules: formats that people
    use for each kind, and numbers and phrases that look alike, alone or one after the other."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    syllables = ["the", "re", "ti", "on", "an", "de", "lo", "ver", "ma", "sch", "ión", "que", "la", "est", "and"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def valid(n: int) -> str:
        head = digits(n - 1)
        return next(head + d for d in "0123456789" if luhn(head + d))

    def grouped(s: str, sizes: list[int], sep: str) -> str:
        out, at = [], 0
        for z in sizes:
            out.append(s[at : at + z])
            at += z
        return sep.join(out)

    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    string = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    quad = lambda sep: sep.join(str(rng.randint(0, 255)) for _ in range(4))
    name = lambda: rng.choice([f"{word()}.{word()}", word(), f"{word()}{digits(2)}"]).replace("ión", "io")
    host = lambda dot: dot.join([word().replace("ión", "io"), rng.choice(["example", "mail", "post"]), rng.choice(["com", "org", "net", "de", "fr"])][rng.randint(0, 1) :])
    good = {
        "email": [lambda: f"{name()} (at) {host(' (dot) ')}", lambda: f"{name()}[at]{host('[dot]')}", lambda: f"{name()} at {host(' dot ')}", lambda: f"{name()} @ {host('.')}", lambda: f"{name()}(at){host('.')}"],
        "ip": [lambda: quad("[.]"), lambda: quad("(.)"), lambda: quad(" . "), lambda: ":".join(f"{rng.randint(4096, 65535):x}" for _ in range(8))],
        "card": [lambda: grouped(valid(16), [4, 4, 4, 4], "."), lambda: grouped(valid(16), [4, 4, 4, 4], "  "), lambda: grouped(valid(15), [4, 6, 5], "/"), lambda: grouped(valid(16), [4, 4, 4, 4], " - ")],
        "secret": [lambda: string("0123456789abcdef", rng.choice((32, 40, 64))), lambda: string(mixed, rng.randint(20, 48)), lambda: "sk-" + string(mixed, 32), lambda: string("0123456789ABCDEF", 40), lambda: string(mixed, rng.randint(8, 15))],
        "phone": [lambda: f"({digits(3)}) 555-{digits(4)}", lambda: f"{rng.randint(200, 989)}-{digits(3)}-{digits(4)}", lambda: f"0049 {digits(3)} {digits(7)}", lambda: f"({digits(3)}){digits(3)}.{digits(4)}", lambda: f"{rng.randint(200, 989)}.{digits(3)}.{digits(4)}", lambda: f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"],
    }
    bad = {
        "secret": [lambda: string("0123456789abcdef", rng.choice((32, 40, 64))), lambda: f"{word()}-{word()}-{digits(4)}", lambda: f"{word()}_{word()}_{word()}{digits(2)}", lambda: f"{word()}/{word()}/{digits(6)}/{word()}", lambda: word() * 3, lambda: f"v{digits(1)}-{digits(8)}-{word()}"],
        "email": [lambda: f"{word()} at {word()}.{word()}".replace("ión", "io"), lambda: f"{word()} at {word()}. {word()}".replace("ión", "io"), lambda: f"{word()} at {digits(2)}.{digits(2)}"],
        "ip": [lambda: ", ".join(digits(rng.randint(1, 3)) for _ in range(4)), lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: f"{digits(2)}, {digits(3)}, {digits(1)}, {digits(3)}"],
        "card": [lambda: digits(16), lambda: digits(14), lambda: grouped(digits(16), [4, 4, 4, 4], " "), lambda: digits(13), lambda: f"{digits(5)} {digits(4)} {digits(5)}", lambda: grouped(valid(16), [2, 7, 5, 2], " ")],
        "phone": [lambda: digits(rng.randint(7, 15)), lambda: f"{rng.randint(1900, 2030)}-0{digits(1)}-{digits(2)}", lambda: f"{digits(1)}.{digits(3)}.{digits(4)}", lambda: f"{digits(4)} {digits(4)}", lambda: f"{rng.randint(1, 9)} {digits(3)} {digits(3)}", lambda: f"{digits(2)}/{digits(2)}/{rng.randint(1900, 2030)}", lambda: f"{digits(4)} - {digits(4)}", lambda: grouped(digits(12), [4, 4, 4], " "), lambda: quad(".")],
    }
    out: list[tuple[str, str, int, int, int]] = []
    for _ in range(count):
        text, meant = "", []
        for _ in range(rng.choice((1, 1, 2, 3))):
            kind = rng.choice(KINDS) if not meant or rng.random() < 0.3 else rng.choice(("card", "phone"))
            wanted = rng.random() < 0.45
            value = rng.choice((good if wanted else bad)[kind])()
            if kind != "secret" and (not meant or rng.random() < 0.2):
                cue = rng.choice(sorted(_CUES[kind])) if rng.random() < (0.5 if wanted else 0.1) else rng.choice(sorted(_AGAINST)) if not wanted and rng.random() < 0.5 else word()
                text += " ".join(word() for _ in range(rng.randint(0, 6))) + f" {cue}{rng.choice([' ', ': ', ' '])}"
            quote = ""
            if kind == "secret":  # a secret is told by the name it is given to, or by its form; a digest is not one
                cue = rng.choice(sorted(_CUES[kind])) if wanted else rng.choice(["commit", "checksum", "digest", "sha", "md5", "file", "see", word()])
                quote = rng.choice(["", '"', '"', "'"])
                case = rng.choice([str, str, str.upper])
                text += " ".join(word() for _ in range(rng.randint(0, 4))) + " " + case(cue) + rng.choice([" = ", "=", ": ", " = "] if wanted else [" ", " ", ": "]) + quote
            meant.append((kind, wanted, len(text), len(text) + len(value)))
            text += value + quote + rng.choice([" ", " ", ", ", " / ", "; "])
        text = f"{text.rstrip(' /,;')}{rng.choice([' ', '. ', ', '])}{word()}"
        for k, a, b in candidates(text):
            near = [m for m in meant if a < m[3] and b > m[2]]
            if near:
                exact = len(near) == 1 and a in (near[0][2], near[0][2] + 1) and b >= near[0][3] - 1
                out.append((text, k, a, b, int(exact and near[0][1] and k == near[0][0])))
    return out


class SpanModel:
    """Boosted trees with, per kind, a logistic calibration and the probability to reach."""

    def __init__(self, examples: int = 8000, precision: float = 0.97):
        rows = training_examples(examples)
        x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
        y = np.array([r[4] for r in rows], float)
        fit = np.arange(len(rows)) % 4 != 0
        self.trees = BoostedTrees().fit(x[fit], y[fit])
        raw, held = self.trees.raw(x[~fit]), y[~fit]
        self.scale, self.threshold = {}, {}
        kinds = x[~fit, 0].astype(int)
        for n, kind in enumerate(KINDS):
            r, t = raw[kinds == n], held[kinds == n]
            a, b = 1.0, 0.0
            for _ in range(50):  # Newton steps for p = sigmoid(a r + b)
                p = 1 / (1 + np.exp(-np.clip(a * r + b, -30, 30)))
                w = p * (1 - p) + 1e-6
                grad = np.array([((t - p) * r).sum() - 0.01 * (a - 1), (t - p).sum() - 0.01 * b])
                hess = np.array([[(w * r * r).sum() + 0.01, (w * r).sum()], [(w * r).sum(), w.sum() + 0.01]])
                da, db = np.linalg.solve(hess, grad)
                a, b = a + 0.5 * da, b + 0.5 * db
            self.scale[kind] = (float(a), float(b))
            p = 1 / (1 + np.exp(-np.clip(a * r + b, -30, 30)))
            order = np.argsort(-p, kind="stable")
            right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
            last = np.flatnonzero(right >= precision)
            self.threshold[kind] = max(0.5, float(p[order][last[-1]])) if len(last) else 2.0

    def probability(self, found: list[list[float]]) -> np.ndarray:
        x = np.array(found)
        scale = np.array([self.scale[k] for k in KINDS])[x[:, 0].astype(int)]
        return 1 / (1 + np.exp(-np.clip(scale[:, 0] * self.trees.raw(x) + scale[:, 1], -30, 30)))


@lru_cache(maxsize=4)
def span_model(examples: int = 8000) -> SpanModel:
    return SpanModel(examples)


def added_spans(texts: list[str], base: list[dict[str, list[tuple[int, int]]]], model: SpanModel) -> list[list[tuple[str, int, int]]]:
    """For each text the candidates that the model takes, none overlapping a base span or another."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    taken: list[tuple[float, int, str, int, int]] = []
    asked: list[tuple[int, str, int, int]] = []
    rows: list[list[float]] = []

    def judge() -> None:
        for i, p in enumerate(model.probability(rows).tolist() if rows else ()):
            if p >= model.threshold[asked[i][1]]:
                taken.append((p, *asked[i]))
        asked.clear(), rows.clear()

    for n, text in enumerate(texts):
        if not text:
            continue
        fixed = sorted(s for spans in base[n].values() for s in spans)
        ends = [s[1] for s in fixed]
        for kind, a, b in candidates(text):
            at = bisect.bisect_right(ends, a)
            if at < len(fixed) and fixed[at][0] < b:
                continue
            asked.append((n, kind, a, b))
            rows.append(features(text, kind, a, b))
            if len(rows) == JUDGED:
                judge()
    judge()
    starts, ends = ([[] for _ in texts] for _ in range(2))  # of the accepted spans, which do not overlap, in order
    for _, n, kind, a, b in sorted(taken, key=lambda t: -t[0]):
        at = bisect.bisect_left(ends[n], a + 1)  # the first span that ends after the candidate begins
        if at == len(starts[n]) or starts[n][at] >= b:
            starts[n].insert(at, a)
            ends[n].insert(at, b)
            out[n].append((kind, a, b))
    return out


def _line(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, ())))


def find_spans(texts: list[str], model: SpanModel) -> tuple[list[dict], list[dict]]:
    """Base spans and all spans of each text, by kind."""
    base = [base_spans(t) for t in texts]
    full = [{k: list(b.get(k, ())) for k in KINDS} for b in base]
    for spans, more in zip(full, added_spans(texts, base, model), strict=True):
        for kind, a, b in more:
            spans[kind].append((a, b))
    return base, full


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = 8000) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row.

    Offsets count code points, ends exclusive. Counts and hash cover base spans; ``spans`` lists
    base and added ones. Null and empty texts have none (the hash of the empty text); very long
    texts are read whole, in time that grows with their length. A null id stays null; repeated rows
    give repeated rows; of candidates of equal probability the first proposed stays; an empty table
    gives no rows; further columns, whatever their names, are not read.
    """
    model = span_model(examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                base, full = find_spans([t or "" for t in b.column("text").to_pylist()], model)
                cols = [b.column("doc_id"), *(pa.array([len(s[k]) for s in base], pa.int64()) for k in BASE_KINDS)]
                cols.append(pa.array([hashlib.sha256(_line(s).encode()).hexdigest() for s in base]))
                cols.append(pa.array([_line(s) for s in full]))
                cols.append(pa.array([sum(map(len, f.values())) - sum(map(len, s.values())) for f, s in zip(full, base, strict=True)], pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"])

    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, kind)


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are one."""
    marks = sorted((a, b, k) for k, v in spans.items() for a, b in v)
    out, at = [], 0
    for a, b, k in marks:
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a] + f"[{k.upper()}]")
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", examples: int = 8000) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; other columns stay, whatever their names.

    Null texts stay null and empty ones empty; very long texts are read whole; equal rows change
    alike; of overlapping spans one mark remains; an empty table stays empty.
    """
    model = span_model(examples)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                old = b.column(text_col).to_pylist()
                _, full = find_spans([t or "" for t in old], model)
                new = pa.array([None if t is None else redacted(t, s) for t, s in zip(old, full, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([new if c == text_col else b.column(c) for c in names], names)

    return map_arrow(docs, run, docs.schema)
