"""Secrets in texts: patterns, and strings of high entropy.

Base spans are assignments (a keyword, = or :, and a value), access key ids and
long runs of hexadecimal digits. The method adds what no pattern names: in each
candidate string (a run of ``CANDIDATE`` characters) the stretches of a character
class are passed by a window of fixed length, and the Shannon entropy of the
window's characters is kept up to date by counts: a step takes one character out
and one in, so that sum(c * log2(c)) changes by two terms. Windows at or over the
class's threshold that also have the letters and digits of a key are joined where
they overlap, and the span is reported unless the allow-list covers it: ids with a
fixed form (UUIDs), placeholders, runs of the alphabet, published digests of
nothing, what follows the host of a URL, and strings that the caller names. Spans within a base span are
left to it; base spans always stay.

The scan is a pass of the patterns over each text as it lies in an Arrow batch:
no shuffle, nothing is gathered, and a candidate is scanned in time linear in its
length.

Offsets are code points, ends exclusive.

Edge cases: null and empty texts have no spans; spans of different kinds may
overlap and are all reported; rows that repeat an id are rows of their own; very
long texts and candidates are scanned whole; a string exactly at a threshold
counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Only strings of these characters can hold the other kinds; they are at least as long as the shortest of them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")


class CharacterClass(NamedTuple):
    """window: characters; threshold: bits a character; digits and letters: the least a window must have of each; cases: whether it needs both cases."""

    name: str
    pattern: re.Pattern
    window: int
    threshold: float
    digits: int
    letters: int
    cases: bool


# Random strings over 16, 36 and 64 characters have about 3.5, 4.0 and 4.3 bits in such windows, words of a language under 3.3.
CLASSES = (
    CharacterClass("lower_hex", re.compile(r"[0-9a-f]{24,}"), 24, 3.1, 4, 4, False),
    CharacterClass("upper_hex", re.compile(r"[0-9A-F]{24,}"), 24, 3.1, 4, 4, False),
    CharacterClass("upper", re.compile(r"[0-9A-Z]{20,}"), 20, 3.7, 2, 4, False),
    CharacterClass("lower", re.compile(r"[0-9a-z]{24,}"), 24, 3.9, 4, 4, False),
    CharacterClass("mixed", re.compile(r"[A-Za-z0-9+/_-]{24,}"), 24, 4.0, 2, 4, True),
)

ALLOWED = (
    re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"),
    re.compile(r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{6}|your[-_]?(?:api|key|token|secret|password)"),
    re.compile(r"(?i)abcdefgh|stuvwxyz|01234567|12345678|98765432|qwertyui"),
    re.compile(r"d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
)
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:\Z")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out, low = [], text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    for c in CANDIDATE.finditer(text):
        a, b = c.span()
        out += [("access", *m.span()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 16]
        out += [("hex", *m.span()) for m in HEX.finditer(text, a, b)]
    return out


def hot_windows(said: str, kind: CharacterClass) -> list[tuple[int, int]]:
    """Where windows of a string of one class reach its threshold, joined."""
    w, counts, total = kind.window, {}, 0.0
    gain = [0.0] + [(c + 1) * log2(c + 1) - c * log2(c) if c else 0.0 for c in range(w + 1)]  # what c - 1 -> c adds to the sum of c * log2(c)
    most = w * (log2(w) - kind.threshold) + 1e-9
    digits = upper = lower = 0
    out: list[tuple[int, int]] = []
    for k, ch in enumerate(said):
        counts[ch] = c = counts.get(ch, 0) + 1
        total += gain[c]
        digits += "0" <= ch <= "9"
        upper += "A" <= ch <= "Z"
        lower += "a" <= ch <= "z"
        if k >= w:
            old = said[k - w]
            total -= gain[counts[old]]
            counts[old] -= 1
            digits -= "0" <= old <= "9"
            upper -= "A" <= old <= "Z"
            lower -= "a" <= old <= "z"
        if k >= w - 1 and total <= most and digits >= kind.digits and upper + lower >= kind.letters and (not kind.cases or (upper and lower)):
            a = k - w + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], k + 1)
            else:
                out.append((a, k + 1))
    return out


class Cover:
    """Spans, and whether one of them holds or meets a given one, in logarithmic time."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.starts, self.reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def _end(self, n: int) -> int:
        return self.reach[n - 1] if n else -1

    def holds(self, a: int, b: int) -> bool:
        return self._end(bisect_right(self.starts, a)) >= b

    def meets(self, a: int, b: int) -> bool:
        return self._end(bisect_left(self.starts, b)) > a


def allowed(text: str, start: int, end: int, allow: frozenset[str]) -> Cover:
    """What the allow-list covers of the candidate start..end."""
    if (allow and text[start:end] in allow) or (text.startswith("//", start) and SCHEME.search(text, max(0, start - 12), start)):
        return Cover([(start, end)])
    return Cover(m.span() for p in ALLOWED for m in p.finditer(text, start, end))


def entropy_spans(text: str, base: list[tuple[str, int, int]], allow: frozenset[str]) -> list[tuple[str, int, int]]:
    """Spans of kind entropy that no base span holds, by start."""
    out: list[tuple[str, int, int]] = []
    told = Cover((a, b) for _, a, b in base)
    for c in CANDIDATE.finditer(text):
        start, end = c.span()
        if end - start < min(k.window for k in CLASSES):
            continue
        found = [(m.start() + x, m.start() + y) for kind in CLASSES for m in kind.pattern.finditer(text, start, end) for x, y in hot_windows(m[0], kind)]
        if not found:
            continue
        calm = allowed(text, start, end, allow)
        for a, b in sorted(found):
            if told.holds(a, b) or calm.meets(a, b) or text[a:b] in allow:
                continue
            if out and a <= out[-1][2]:
                out[-1] = ("entropy", out[-1][1], max(b, out[-1][2]))
            else:
                out.append(("entropy", a, b))
    return out


def secrets(text: str, allow: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """kind, start, end by start, then kind: assign, access, hex, entropy."""
    order = {k: i for i, k in enumerate((*KINDS, "entropy"))}
    base = base_spans(text)
    return sorted(base + entropy_spans(text, base, allow), key=lambda s: (s[1], order[s[0]]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find(docs: DataFrame, allow: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id and spans, array<struct<kind, start, end>>, of each document. allow: strings that are no secrets."""

    def spans(texts: pa.Array) -> pa.Array:
        rows = (secrets(t, allow) if t else [] for t in texts.to_pylist())
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], pa.list_(SPAN))

    each = F.arrow_udf(spans, "array<struct<kind:string,start:bigint,end:bigint>>")
    return docs.select(docs["doc_id"], each(docs["text"]).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    found = find(docs)
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda s: F.array_join(F.transform(s, named), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("entropy"))
