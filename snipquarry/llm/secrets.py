"""Secret scans: fixed patterns, and windows of high entropy in candidate strings."""

import math
import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from snipquarry.llm.common import per_batch, strings

KINDS = ["assign", "access", "hex", "entropy"]

# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
# Least bits per character of a window, by the class of its characters.
BITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
# Candidates that are known not to be secrets: numbers, identifiers with separators, paths, UUIDs.
ALLOWED = [
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9+/_=-]+",
    r"(?:[A-Za-z]+|[0-9]{1,8})(?:[/_=+-]+(?:[A-Za-z]+|[0-9]{1,8}))*[/_=+-]*",
]

_LOG = [0.0, 0.0] + [n * math.log2(n) for n in range(2, 4096)]


def _class(c: str) -> int:
    """0 hex digit in lower case, 1 other letter or digit, 2 sign."""
    return 0 if c in "0123456789abcdef" else 1 if c.isalnum() else 2


def entropy_windows(text: str, window=WINDOW, bits=BITS, allowed=None) -> list[int]:
    """Where windows of high Shannon entropy start, in candidates that are not allowed.

    Counts of characters and of character classes move with the window, one character in and one
    out, so a candidate of any length takes one pass.  A window must hold both letters and digits;
    its class is the widest that it has: hex, letters and digits, or with signs.
    """
    allowed = allowed or re.compile("|".join(f"(?:{p})" for p in ALLOWED))
    starts = []
    for found in CANDIDATE.finditer(text):
        run = found.group()
        if allowed.fullmatch(run):
            continue
        start, counts, kinds, digits, weighted = found.start(), {}, [0, 0, 0], 0, 0.0
        for i, c in enumerate(run):
            n = counts.get(c, 0)
            counts[c] = n + 1
            weighted += _LOG[n + 1] - _LOG[n]
            kinds[_class(c)] += 1
            digits += "0" <= c <= "9"
            if i >= window:
                gone = run[i - window]
                n = counts[gone]
                counts[gone] = n - 1
                weighted += _LOG[n - 1] - _LOG[n]
                kinds[_class(gone)] -= 1
                digits -= "0" <= gone <= "9"
            if i < window - 1 or not 0 < digits < window - kinds[2]:
                continue
            need = bits["base64" if kinds[2] else "alnum" if kinds[1] else "hex"]
            if math.log2(window) - weighted / window >= need:
                starts.append(start + i + 1 - window)
    return starts


def _covered(starts: list[int], window: int) -> list[tuple[int, int]]:
    spans = []
    for a in starts:
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], a + window)
        else:
            spans.append((a, a + window))
    return spans


def entropy_spans(text: str, window=WINDOW, bits=BITS, allowed=None) -> list[tuple[int, int]]:
    """Maximal spans covered by windows of high Shannon entropy, in candidates that are not allowed."""
    return _covered(entropy_windows(text, window, bits, allowed), window)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start and then by kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def scan(documents: DataFrame, window=WINDOW, bits=BITS, allowed=tuple(ALLOWED)) -> DataFrame:
    """(doc_id, spans: array of (start, end, kind)) for every row of documents (doc_id, text).

    Places are code points, the end is exclusive.  Spans of the fixed patterns all stay.  Of an
    entropy span what they cover is known already; each part beside them that has a whole window of
    high entropy stays as a span, and shorter or plainer rests go.  A missing or empty text has no
    spans; repeated rows each give a row; other columns are not looked at.
    """
    pattern = "|".join(f"(?:{p})" for p in allowed)

    def run(batch):
        known, made = re.compile(pattern), []
        for text in strings(batch.column("text")):
            spans = base_spans(text)
            starts = entropy_windows(text, window, bits, known)
            more = _covered(starts, window)
            if more and spans:
                more = _beside(more, spans, starts, window)
            every = sorted([*spans, *((a, b, 3) for a, b in more)], key=lambda s: (s[0], s[2]))
            made.append([{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in every])
        return {"doc_id": batch.column("doc_id"), "spans": made}

    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", "text")
    return per_batch(rows, run, f"doc_id {kind}, spans array<struct<start: bigint, end: bigint, kind: string>>")


def _beside(spans, taken, starts, window):
    """Parts of spans (by start) that none of `taken` (by start) covers, where they hold a window."""
    kept, i, reach = [], 0, 0
    for a, b in spans:
        parts, at = [], max(a, min(reach, b))
        while i < len(taken) and taken[i][0] < b:
            if taken[i][0] > at:
                parts.append((at, taken[i][0]))
            reach = max(reach, taken[i][1])
            at = max(at, min(reach, b))
            i += 1
        if at < b:
            parts.append((at, b))
        for c, d in parts:
            first = bisect_left(starts, c)
            if first < len(starts) and starts[first] + window <= d:
                kept.append((c, d))
    return kept
