"""Secret scan: known formats, and sliding-window entropy over candidate strings.

Base spans are the fixed formats (assignments to secret-like names, access key
ids, long hexadecimal strings).  The entropy scan adds spans the formats miss:
every maximal run of token characters is a candidate; a window slides over it
and its Shannon entropy is kept by incremental counts, one character entering
and one leaving per step.  The threshold depends on the character class of the
window (hex, alphanumeric, base64-like), so a key is judged alike alone and behind
``NAME=`` or a path.  Windows that touch a base span do not count; overlapping
windows over the threshold join to one span.  Allow-listed runs, spans and values
(words and identifiers of one case, paths and URLs, repeated patterns, UUIDs,
version strings) are suppressed, and a documented placeholder with the value
between ``=`` that it is part of; a name with such a word suppresses no more than
itself.

Everything is local to a row, so no row is moved.  Edge rows: null and empty
texts have no spans; repeated rows give a row each; an empty table gives none;
further columns are not read; whole texts are scanned in linear time.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import texts_of

# Fixed formats of the base scan.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 16 or more is the same as a run of any length that has 16 or more.
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_MIN, ACCESS_MIN = 12, 18

# Entropy scan: window length, and bits a character by class.
WINDOW = 20
MIN_BITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_PART = r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})"
ALLOWED = [
    re.compile(r"[0-9+=/_-]*"),  # numbers and rules
    re.compile(rf"[-_/=+]*{_PART}(?:[-_/=+]+{_PART})*[-_/=+]*"),  # words, joined words
    re.compile(r"[a-z]*(?:[A-Z][a-z]{2,})*[0-9]{0,4}"),  # camel case
    re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"),  # UUID
]


PLACEHOLDER = re.compile(r"example|placeholder|changeme|dummy|x{6}|your[-_]?(?:key|token|secret)", re.IGNORECASE)
VALUE = re.compile(r"[^=]+=*")
SEGMENT = re.compile(r"[^=/+_-]+")


def allowed(s: str) -> bool:
    return any(p.fullmatch(s) for p in ALLOWED)


def undocumented(s: str) -> list[tuple[int, int]]:
    """The parts of a run outside the values between ``=`` that a placeholder within a random-looking string marks."""
    out, at = [], 0
    for m in VALUE.finditer(s):
        if any(not allowed(w[0]) for w in SEGMENT.finditer(s, *m.span()) if PLACEHOLDER.search(w[0])):
            out.append((at, m.start()))
            at = m.end()
    return [(a, b) for a, b in [*out, (at, len(s))] if b - a >= WINDOW]


# c log2 c for the counts a window can hold.
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def window_loads(s: str, size: int):
    """(start, sum(c log2 c)) of every window of ``size``, with counts c; a step changes two counts."""
    counts: dict[str, int] = {}
    load = 0.0
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        load += _CLOG[c + 1] - _CLOG[c]
        counts[ch] = c + 1
        if i + 1 >= size:
            a = i + 1 - size
            yield a, load
            gone = s[a]
            c = counts[gone]
            load += _CLOG[c - 1] - _CLOG[c]
            counts[gone] = c - 1


def most_load(bits: float, size: int) -> float:
    """The entropy is log2(size) - load / size."""
    return (math.log2(size) - bits) * size + 1e-9


def join_windows(starts, size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a in starts:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], a + size)
        else:
            out.append((a, a + size))
    return out


def entropy_windows(s: str, bits: float, size: int = WINDOW) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``size`` whose entropy is at least ``bits``."""
    most = most_load(bits, size)
    return join_windows((a for a, load in window_loads(s, size) if load <= most), size)


_MOST = {k: most_load(bits, WINDOW) for k, bits in MIN_BITS.items()}
_LOWER, _UPPER = set("0123456789abcdef"), set("0123456789ABCDEF")


def class_windows(s: str):
    """Starts of the windows of ``s`` whose entropy reaches the threshold of the window's class."""
    least = min(MIN_BITS, key=MIN_BITS.get)
    low = up = other = -1  # last character that is no lower-case hex digit, no upper-case one, not alphanumeric
    for a, load in window_loads(s, WINDOW):
        for i in range(0 if a == 0 else a + WINDOW - 1, a + WINDOW):
            ch = s[i]
            low = low if ch in _LOWER else i
            up = up if ch in _UPPER else i
            other = other if ch.isalnum() else i
        if load <= _MOST[least]:
            kind = "hex" if low < a or up < a else "alnum" if other < a else "base64"
            if load <= _MOST[kind]:
                yield a


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed formats, leftmost non-overlapping per kind."""
    out = []
    low = text.lower() if not text.islower() else text
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def covered(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The parts of the text that spans of any kind cover, in order, none touching another."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def clear_of(starts, parts: list[tuple[int, int]], at: int):
    """Of window starts in ascending order those whose window meets no part from the ``at``-th on."""
    for a in starts:
        while at < len(parts) and parts[at][1] <= a:
            at += 1
        if at == len(parts) or parts[at][0] >= a + WINDOW:
            yield a


def entropy_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of random-looking strings that touch no base span."""
    out, parts, at = [], covered(base), 0
    for m in CANDIDATE.finditer(text):
        s = m[0]
        while at < len(parts) and parts[at][1] <= m.start():
            at += 1
        if allowed(s):
            continue
        ends = [i for i, ch in enumerate(s) if ch in "=/"]
        known: dict[tuple[int, int], bool] = {}  # values that are judged
        for first, last in undocumented(s):
            starts = (m.start() + first + a for a in class_windows(s[first:last]))
            for a, b in join_windows(clear_of(starts, parts, at), WINDOW):
                a, b = a - m.start(), b - m.start()
                value = value_around(s, a, b, ends)
                if value not in known:
                    known[value] = allowed(s[value[0]:value[1]])
                if not known[value] and not allowed(s[a:b]):
                    out.append(("entropy", m.start() + a, m.start() + b))
    return out


def value_around(s: str, a: int, b: int, ends: list[int]) -> tuple[int, int]:
    """``s[a:b]`` up to the next of ``ends`` (the places of ``=`` and ``/``) on both sides."""
    low, high = bisect_left(ends, a), bisect_left(ends, b)
    return ends[low - 1] + 1 if low else 0, ends[high] if high < len(ends) else len(s)


def joined(spans: list[tuple[str, int, int]]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 (of the base spans) and spans (all) of every text."""
    fields = ("doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, "
              "base_sha256 string, spans string")

    def scan(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                base = base_spans(text)
                more = entropy_spans(text, base)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                rows.append((doc, *n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             [f.split()[0] for f in fields.split(", ")])

    return texts_of(docs).mapInArrow(scan, fields)
