"""Secret scans: three patterns, and a battery of randomness tests for strings that no pattern knows.

A candidate is a longest run of encoding characters of 20 or more. The smallest encoding that holds it is inferred, and its
symbols' values are tested for what a random string shows: chi-squared uniformity over equal slices of the alphabet, the
number of runs about the middle of the alphabet, and lag-1 serial correlation. The battery's p-value is that of the least of the three, for
three tests; a string that it rejects at `REJECT` is no secret.

What is left has to be a discovery against ordinary text: its p-value is the inverse of the likelihood ratio of the uniform encoding against
one model of ordinary strings (letters of prose in either case, digits and separators, each in runs) times the battery's p-value, a bound by
Markov's inequality that shrinks with every further symbol and grows the less random the string looks. A weighted Benjamini-Hochberg step
over the candidates of a text, with weights in proportion to length, keeps the share of false discoveries below `FDR`.
"""

from __future__ import annotations

import math
import re
from functools import cache

from pyspark.sql import DataFrame

from .common import map_batches

#: Kinds in their order. Fixed patterns; `assign` needs 6 characters in its second group, the others the total length.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a longest run, so what is shorter fails as a whole
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

REJECT = 0.003
FDR = 0.001

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encodings by size of their alphabets.
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _LOWER.upper() + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _LOWER.upper(),
    "base62": _LOWER.upper() + _LOWER + _DIGITS,
    "base64": _LOWER.upper() + _LOWER + _DIGITS + "+/",
    "base64url": _LOWER.upper() + _LOWER + _DIGITS + "-_",
    "any": _LOWER.upper() + _LOWER + _DIGITS + "+/-_",
}
#: Letters of European prose from the most frequent on; a letter's frequency falls with its place in this order.
PROSE_ORDER = "etaoinshrdlucmfwygpbvkqjxz"


#: Classes of symbols in ordinary strings, and how often one follows another: letters of one case, digits and separators come in runs.
CLASSES = {"lower": _LOWER, "upper": _LOWER.upper(), "digit": _DIGITS, "separator": "+/-_"}
FOLLOWS = {
    "lower": {"lower": 0.86, "upper": 0.03, "digit": 0.04, "separator": 0.07},
    "upper": {"lower": 0.12, "upper": 0.80, "digit": 0.04, "separator": 0.04},
    "digit": {"lower": 0.03, "upper": 0.03, "digit": 0.85, "separator": 0.09},
    "separator": {"lower": 0.50, "upper": 0.20, "digit": 0.25, "separator": 0.05},
}
_CLASS = {c: name for name, chars in CLASSES.items() for c in chars}


@cache
def ordinary() -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """Logarithms of a symbol's frequency in its class, letters by place, and of the transitions between classes. One model for all encodings."""
    place = {c: 1 / (i + 3) for i, c in enumerate(PROSE_ORDER)}
    total = sum(place.values())
    own = {c: math.log(place[c.lower()] / total if c.isalpha() else 1 / len(CLASSES[name])) for c, name in _CLASS.items()}
    return own, {(a, b): math.log(f) for a, to in FOLLOWS.items() for b, f in to.items()}


def encoding_of(string: str) -> str:
    chars = set(string.rstrip("="))
    return next((name for name, alphabet in ENCODINGS.items() if chars <= set(alphabet)), "any")


def normal_tail(z: float) -> float:
    """Two-sided p-value."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_tail(x: float, df: int) -> float:
    """Wilson and Hilferty's approximation of the upper tail."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(string: str, alphabet: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for a random string of the alphabet."""
    place = {c: i for i, c in enumerate(alphabet)}
    values = [place[c] for c in string if c in place]
    n, m = len(values), len(alphabet)
    slices = max(4, min(m, n // 5))
    counts = [0] * slices
    for v in values:
        counts[v * slices // m] += 1
    sizes = [0] * slices
    for v in range(m):
        sizes[v * slices // m] += 1
    x = sum((c - n * s / m) ** 2 / (n * s / m) for c, s in zip(counts, sizes, strict=True))
    high = [v >= m / 2 for v in values]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 0.0
    mid = sum(values) / n
    spread = sum((v - mid) ** 2 for v in values)
    serial = sum((v - mid) * (w - mid) for v, w in zip(values, values[1:])) / spread if spread else 1.0
    return chi_squared_tail(x, slices - 1), p_runs, normal_tail(serial * math.sqrt(n))


def p_against_prose(string: str, alphabet: str) -> float:
    symbols = string.rstrip("=")
    if symbols.isdigit():
        return 1.0  # a number
    own, follows = ordinary()
    kinds = [_CLASS[c] for c in symbols]
    ratio = -len(symbols) * math.log(len(alphabet)) - sum(map(own.__getitem__, symbols)) - sum(map(follows.__getitem__, zip(kinds, kinds[1:]))) + math.log(len(CLASSES))
    return math.exp(-min(ratio, 700.0)) if ratio > 0 else 1.0


def p_value(string: str, alphabet: str) -> float:
    """What the discovery step takes: the likelihood ratio, lessened by the battery's p-value (that of the three tests' least, for all three). A ratio that is lessened
    is still bounded by Markov's inequality, so its inverse is a p-value under ordinary text. 1 if the battery rejects."""
    as_random = min(1.0, 3 * min(battery(string, alphabet)))
    return min(1.0, p_against_prose(string, alphabet) / as_random) if as_random >= REJECT else 1.0


def random_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the strings that the battery leaves and the discovery step takes."""
    found = []
    for match in CANDIDATE.finditer(text):
        string = match[0]
        if string.isalpha() and (string.islower() or string[1:].islower()):
            continue  # a word: far likelier as prose than by any encoding
        alphabet = ENCODINGS[encoding_of(string)]
        found.append((p_value(string, alphabet), match.span()))
    lengths = sum(b - a for _, (a, b) in found)
    weighted = sorted((p * lengths / (len(found) * (span[1] - span[0])), span) for p, span in found)
    last = max((k for k, (p, _) in enumerate(weighted, 1) if p <= FDR * k / len(weighted)), default=0)
    return [span for _, span in weighted[:last]]


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind; the patterns' matches and the battery's spans that overlap none of them."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    known = sorted(found)
    for start, end in random_spans(text):
        if not any(a < end and start < b for a, b, _ in known):
            found.append((start, end, "random"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """text with every secret replaced; overlapping spans count as one."""
    if not text:
        return text
    out, at = [], 0
    for start, end, _ in scan(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and spans (kind, start, end in code points) of every row. Null and empty texts have none; repeated rows stay; other columns are not read."""
    kind = dict(docs.dtypes)[id_column]
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_batches(docs.select(id_column, text_column), lambda c: {id_column: c[id_column], "spans": [[{"kind": k, "start": a, "end": b} for a, b, k in scan(t)] for t in c[text_column]]}, f"{id_column} {kind}, spans {spans}")


def redact_secrets(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """docs with every secret in the text replaced by [SECRET], and the length column, where there is one, brought up to date. Rows and other columns stay."""

    def clean(cols: dict) -> dict:
        texts = [redact(t) for t in cols[text_column]]
        if length_column not in cols.arrays:
            return {text_column: texts}
        return {text_column: texts, length_column: [n if a == b or b is None else len(b) for n, a, b in zip(cols[length_column], cols[text_column], texts, strict=True)]}

    return map_batches(docs, clean, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
