"""Secret scans: fixed patterns, and passwords judged by the guesses an attacker needs.

Values in a credential context are cut into the cheapest sequence of dictionary words, dates, repeats, keyboard walks,
sequences and brute-force spans by dynamic programming; the fewest guesses over all cuts is the strength. A value that
takes ``MIN_GUESSES`` decimal digits of guesses or more is reported as a span of kind ``guess``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.llm.shared import in_batches

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16 or more
KINDS = ("assign", "access", "hex", "guess")
# What introduces a credential in running text.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|api[_-]?key|access[_-]?key|private[_-]?key)["']?"""
                     r"""[ \t]*(?:is[ \t]|:=|=>|[:=])[ \t]*["']?([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII)
TRIGGERS = ("pass", "pwd", "secret", "token", "credential", "bearer", "api", "key")
# Words that attackers try first, most common first.
WORDS = ("password", "admin", "welcome", "login", "master", "hello", "dragon", "monkey", "letmein", "shadow", "sunshine", "princess",
         "football", "baseball", "superman", "batman", "trustno", "iloveyou", "secret", "access", "flower", "summer", "winter", "spring",
         "autumn", "test", "user", "root", "guest", "default", "change", "changeme", "example", "sample", "dummy", "none", "null", "true",
         "false", "your", "here", "token", "key", "love", "angel", "computer", "internet", "server", "service", "house", "money", "freedom",
         "whatever", "ninja", "mustang", "jordan", "michael", "charlie", "thomas", "daniel", "george", "qwerty", "abc", "pass", "word")
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("01345789@$!", "oieastbgasi")
MIN_GUESSES = 8.0
REFERENCE_YEAR = 2020
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))


def _runs(value: str, step) -> Iterator[tuple[int, int]]:
    """Maximal ranges in which ``step`` holds between neighbours."""
    start = 0
    for i in range(1, len(value) + 1):
        if i == len(value) or not step(value[i - 1], value[i]):
            if i - start >= 3:
                yield start, i
            start = i


def _spans(value: str) -> Iterator[tuple[int, int, float]]:
    """Patterns as (start, end, log10 of guesses)."""
    low = value.lower()
    plain = low.translate(LEET)
    for i in range(len(value)):
        for j in range(i + 3, min(len(value), i + LONGEST) + 1):
            rank = RANKS.get(plain[i:j])
            if rank:
                part = value[i:j]
                odd = (0 if part.islower() else 1 if part.isupper() or part[:1].isupper() and part[1:].islower() else len(part) / 2)
                swapped = sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True))
                yield i, j, math.log10(rank) + math.log10(2) * (odd + swapped)
    for m in DATE.finditer(value):
        year = int(re.search(r"(?:19|20)\d\d", m[0])[0])
        yield m.start(), m.end(), math.log10(max(20, abs(year - REFERENCE_YEAR))) + (math.log10(365) if len(m[0]) > 4 else 0)
    for i, j in _runs(low, lambda a, b: a == b):
        yield i, j, math.log10(36 * (j - i))
    for i, j in _runs(low, lambda a, b: (a, b) in NEXT):
        yield i, j, math.log10(47 * (j - i)) + 0.3
    for d in (1, -1):
        for i, j in _runs(low, lambda a, b, d=d: ord(b) - ord(a) == d):
            yield i, j, math.log10(10 * (j - i))
    for size in (2, 3, 4, 5, 6, 8, 10, 12, 16):
        i = 0
        while i + 2 * size <= len(low):
            if low[i:i + size] != low[i + size:i + 2 * size]:
                i += 1
                continue
            j = i + 2 * size
            while low[j:j + size] == low[i:i + size]:
                j += size
            yield i, j, size * 1.0 + math.log10((j - i) / size)
            i = j


def guesses(value: str) -> float:
    """log10 of the guesses of the cheapest segmentation. Linear in the value apart from its patterns; empty: 0.

    A segment costs the guesses of its pattern, each brute-force character a factor of ten, and each further segment a
    factor of two for the unknown structure.
    """
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _spans(value):
        ends.setdefault(j, []).append((i, cost))
    best = [0.0] + [math.inf] * len(value)
    brute = [math.inf] * (len(value) + 1)  # cheapest cut that ends inside a brute-force span
    for j in range(1, len(value) + 1):
        brute[j] = 1.0 + min(brute[j - 1], best[j - 1] + math.log10(2))
        best[j] = min([brute[j], *(best[i] + max(cost, 0.3) + math.log10(2) for i, cost in ends.get(j, ()))])
    return max(0.0, best[-1] - math.log10(2)) if value else 0.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) by the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guessed_spans(text: str, base: list[tuple[int, int, int]], least: float = MIN_GUESSES) -> list[tuple[int, int, int]]:
    """Strong values in a credential context that no base span touches."""
    low = text.lower()
    if not any(t in low for t in TRIGGERS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        value = m[1].rstrip(".!?)]}")
        end = start + len(value)
        if any(s < end and start < e for s, _, e in base):
            continue
        # A long word of letters only is prose, not a key.
        if not value.isalpha() and any(c.isalnum() for c in value) and guesses(value) >= least:
            out.append((start, 3, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = MIN_GUESSES) -> DataFrame:
    """Per row: the spans (start, end in code points, end exclusive) with their kinds, base spans first counted.

    A null text has no spans. Null or repeated keys give rows of their own. Other columns are not returned.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digest, spans = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                base = base_spans(t)
                more = guessed_spans(t, base, least)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in (base if k < 3 else more)))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + more)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()),
                                              pa.array(spans, pa.string())], names=names)

    return (docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
            .transform(in_batches, run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"))
