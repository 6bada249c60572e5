"""Secret scans.

Base patterns find assignments, access keys and long hexadecimal runs. On top of them, candidate strings (runs of
the characters that keys are written in) are scanned with a sliding window whose Shannon entropy is kept by
incremental counts: one character enters, one leaves, and only their two terms of the sum change. Each character
class has a window and a threshold of its own. An allow list suppresses candidates that are wholly of a harmless form.
Parts that are known, as placeholders, are cut out of a candidate, and what is left on either side is judged on its own.

Spans are in code points, end exclusive. Null text counts as empty: no spans. Empty tables give empty results; other
columns are ignored by ``scan`` and kept by ``redact``, whatever their names; each row gives one row, repeated or not.
Whole texts are scanned, one at a time, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: What keys are written in. A candidate has a digit: runs of letters alone are words.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}")
_DIGIT = re.compile("[0-9]")


@dataclass(frozen=True)
class CharacterClass:
    """Candidates wholly in ``alphabet`` with each of ``needs``: some window must reach ``bits``."""

    alphabet: str
    needs: tuple[str, ...]
    window: int
    bits: float


#: The first that fits a candidate decides; the last fits all. Separators and words raise the entropy of a window, so
#: classes that allow them, or need few digits, ask for more.
CLASSES = (
    CharacterClass("0-9a-f", ("[0-9]", "[a-f]"), 20, 2.9),
    CharacterClass("0-9A-F", ("[0-9]", "[A-F]"), 20, 2.9),
    CharacterClass("0-9a-z", ("[0-9].*[0-9].*[0-9]", "[a-z]"), 20, 3.5),
    CharacterClass("0-9A-Z", ("[0-9].*[0-9].*[0-9]", "[A-Z]"), 20, 3.5),
    CharacterClass("0-9a-f+/_=-", ("[0-9]", "[a-f]"), 20, 3.3),
    CharacterClass("0-9A-F+/_=-", ("[0-9]", "[A-F]"), 20, 3.3),
    CharacterClass("0-9a-z+/_=-", ("[0-9].*[0-9].*[0-9]", "[a-z]"), 20, 3.7),
    CharacterClass("0-9A-Z+/_=-", ("[0-9].*[0-9].*[0-9]", "[A-Z]"), 20, 3.7),
    CharacterClass("A-Za-z0-9+/_=-", ("[0-9]", "[A-Z]", "[a-z]"), 20, 3.7),
    CharacterClass("A-Za-z0-9+/_=-", (), 20, 3.8),
)

#: Harmless candidates: runs of one character, numbers, paths and names made of words and short numbers.
ALLOWED = (
    r"(.)\1*",
    r"[0-9+/_=-]*",
    r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[/_=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[/_=+-]*",
)
#: Harmless parts, in any case: placeholders, the alphabet or the digits in order, identifiers in their usual notation, a
#: date (and time) that a candidate starts with.
KNOWN = (
    r"example|sample|dummy|placeholder|changeme|xxxx+",
    r"abcdefghij" + "".join(f"(?:{c}" for c in "klmnopqrstuvwxyz") + ")?" * 16,
    r"(?<![0-9])0?(?:1234567890)*(?:123456789|1234567890)(?![0-9])",
    r"(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[t_-]?[0-9]{2}(?:-?[0-9]{2}){1,2}z?|t[0-9]{2})?(?![0-9a-z])",
)
_SEPARATORS = "+/_=-"


class Scanner:
    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, known: tuple[str, ...] = KNOWN):
        self.classes = [(re.compile(f"[{c.alphabet}]*"), [re.compile(n) for n in c.needs], c) for c in classes]
        self.allowed = [re.compile(a) for a in allowed]
        self.known = re.compile("|".join(known), re.IGNORECASE | re.ASCII)

    @staticmethod
    def peak(text: str, window: int) -> float:
        """The highest Shannon entropy, in bits a character, of the windows of a text."""
        counts: dict[str, int] = {}
        weighted, best, term = 0.0, 0.0, [0.0] + [n * log2(n) for n in range(1, window + 1)]
        for i, c in enumerate(text):
            if i >= window:
                out = text[i - window]
                n = counts[out]
                weighted += term[n - 1] - term[n]
                counts[out] = n - 1
            n = counts.get(c, 0)
            weighted += term[n + 1] - term[n]
            counts[c] = n + 1
            if i >= window - 1:
                best = max(best, log2(window) - weighted / window)
        return best

    def dense(self, candidate: str) -> bool:
        for alphabet, needs, c in self.classes:
            if alphabet.fullmatch(candidate) and all(n.search(candidate) for n in needs):
                return self.peak(candidate, c.window) >= c.bits
        return False

    def rests(self, candidate: re.Match[str]) -> Iterator[tuple[int, int]]:
        """(start, end) in the text of what is left of a candidate without its known parts and the separators at the
        cuts, where it is long enough to be a candidate and has a digit."""
        text, at = candidate[0], 0
        cuts = [(m.start(), m.end()) for m in self.known.finditer(text)]
        for lo, hi in [*cuts, (len(text), len(text))]:
            rest = text[at:lo]
            start = at + (len(rest) - len(rest.lstrip(_SEPARATORS)) if at else 0)
            end = lo - (len(rest) - len(rest.rstrip(_SEPARATORS)) if lo < len(text) else 0)
            if end - start >= 20 and _DIGIT.search(text, start, end):
                yield candidate.start() + start, candidate.start() + end
            at = hi

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end), in order."""
        found: list[tuple[int, int, int]] = []
        low = text.lower()
        if any(w in low for w in _ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        if _DIGIT.search(text):
            base = sorted(found)
            at = covered = 0  # base spans that start so far, and the furthest of their ends
            for m in _CANDIDATE.finditer(text):
                for start, end in self.rests(m):
                    while at < len(base) and base[at][0] <= start:
                        covered, at = max(covered, base[at][2]), at + 1
                    rest = text[start:end]
                    if end <= covered or any(a.fullmatch(rest) for a in self.allowed):
                        continue
                    if self.dense(rest):
                        found.append((start, 3, end))
        return sorted(found)


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) for each row. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            all_ = [scanner.spans(t.as_py() or "") for t in batch.column("text")]
            counts = [pa.array([sum(k == n for _, k, _ in s) for s in all_], pa.int64()) for n in range(4)]
            base = [hashlib.sha256(_digest([x for x in s if x[1] < 3]).encode()).hexdigest() for s in all_]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *counts, pa.array(base, pa.string()), pa.array(map(_digest, all_), pa.string())], names)

    names = ["key", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows as they are, with each secret in ``text`` replaced by ``mark``; overlapping spans are replaced once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            out = []
            for t in batch.column(at):
                whole, parts, done = t.as_py(), [], 0
                for start, _, end in scanner.spans(whole) if whole else ():
                    if start >= done:
                        parts += [whole[done:start], mark]
                    done = max(done, end)
                out.append("".join([*parts, whole[done:]]) if parts else whole)
            columns = [pa.array(out, batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    at = df.columns.index(text)
    return df.mapInArrow(run, df.schema)
