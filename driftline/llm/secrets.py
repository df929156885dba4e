"""Secrets in whole texts: fixed patterns, and stretches of high entropy.

Candidates are the maximal runs of key characters with a digit and a letter in them. A window of 20 characters slides over a
candidate; one character comes in and one goes out, so the counts of characters, and with them the Shannon entropy, change by two table
look-ups a step. How many bits make a secret depends on the classes of the characters in the window (hexadecimal, one case
with digits, both cases with digits), which are counted likewise; words and plain numbers belong to no class. Windows that reach their
bound and overlap or touch are one span. Suppressed are windows that count up or down or repeat, candidates that an allow-list
names (placeholders, UUIDs), and candidates announced as checksums, commits or embedded data.

Sums are kept as integers (of 2^-20 bits), so no error builds up over long candidates. Work is linear in the text; a text is held
by one task, one at a time.

Defined cases: null text is empty and has no spans; matches of a base pattern that fail their length are dropped and not
retried; base spans are never suppressed; spans of different kinds may overlap, but an entropy span inside a base span is not
reported; places are code points, end exclusive; null ids and repeated rows are kept, other columns ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import text_slices

WINDOW = 20
UNIT = 1 << 20
#: Bits a window must reach, and digits it must hold, by the classes of its characters.
BITS = {"hex": 2.9, "lower_or_upper": 3.5, "mixed": 3.6}
DIGITS = {"hex": 1, "lower_or_upper": 3, "mixed": 2}
SYMBOLS = 3  # more of `+/_=-` in a window make it a path or a row of words
CONTEXT_LENGTH = 24

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run as a whole: shorter ones have no longer one inside
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|change_?me|your_?key|redacted|xxxx",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
ALLOW_BEFORE = (r"(?i)(sha-?[0-9]{1,3}|md5|integrity|checksum|digest|commit|etag)[\x20\"':=@-]*$", r";base64,$")

# c * log2(c) in units (a character comes in before the last one goes out), and how much a count of c adds when it rises by one.
WEIGHT = [0, *[round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 2)]]
_RISE = [b - a for a, b in zip(WEIGHT, WEIGHT[1:])]
#: The largest sum of weights of a window that reaches its bits.
LIMIT = {name: math.floor((math.log2(WINDOW) - bits) * WINDOW * UNIT) for name, bits in BITS.items()}
_DIGIT, _HEX_LOWER, _LOWER, _HEX_UPPER, _UPPER, _SYMBOL = range(6)


def _class_of(code: int) -> int:
    c = chr(code)
    if c.isdigit():
        return _DIGIT
    if c.isalpha():
        return (_HEX_LOWER if c in "abcdef" else _LOWER) if c.islower() else _HEX_UPPER if c in "ABCDEF" else _UPPER
    return _SYMBOL


_CLASS = [_class_of(code) for code in range(128)]
_HAS_DIGIT, _HAS_LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def class_limit(tally: Sequence[int]) -> int:
    """The largest sum of weights at which a window with these classes is a secret; -1 for words and numbers."""
    digits = tally[_DIGIT]
    lower, upper, symbols = tally[_HEX_LOWER] + tally[_LOWER], tally[_HEX_UPPER] + tally[_UPPER], tally[_SYMBOL]
    if not lower + upper or symbols > SYMBOLS:
        return -1
    if lower and upper:
        name = "mixed"
    elif symbols or tally[_LOWER] or tally[_UPPER]:
        name = "lower_or_upper"
    else:
        name = "hex"
    return LIMIT[name] if digits >= DIGITS[name] else -1


def bits_of(total: int, length: int = WINDOW) -> float:
    return round(max(0.0, math.log2(length) - total / (length * UNIT)), 4)


def entropy_spans(run: str) -> list[tuple[int, int, float]]:
    """(start, end, bits) of the stretches of windows that reach their bound; bits are those of the best window."""
    if len(run) < WINDOW or not _HAS_DIGIT.search(run) or not _HAS_LETTER.search(run):
        return []
    codes = run.encode("ascii")
    counts, tally = [0] * 128, [0] * 6
    total = steps = 0  # sum of weights; neighbours that are equal or next to each other
    out: list[tuple[int, int, int]] = []
    for i, code in enumerate(codes):
        total += _RISE[counts[code]]
        counts[code] += 1
        tally[_CLASS[code]] += 1
        if i and -1 <= code - codes[i - 1] <= 1:
            steps += 1
        if i >= WINDOW:
            old = codes[i - WINDOW]
            counts[old] -= 1
            total -= _RISE[counts[old]]
            tally[_CLASS[old]] -= 1
            if -1 <= codes[i - WINDOW + 1] - old <= 1:
                steps -= 1
        if i >= WINDOW - 1 and 2 * steps < WINDOW and total <= class_limit(tally):
            start = i - WINDOW + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1, min(out[-1][2], total))
            else:
                out.append((start, i + 1, total))
    return [(start, end, bits_of(total)) for start, end, total in out]


def _base_bits(value: str) -> float:
    """Entropy of a whole value, in bits a character."""
    counts = {c: value.count(c) for c in set(value)}
    return round(max(0.0, math.log2(len(value)) - sum(n * math.log2(n) for n in counts.values()) / len(value)), 4)


def secret_spans(
    text: str, allow: Sequence[re.Pattern], allow_before: Sequence[re.Pattern]
) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, bits) by start, then kind as in `KINDS`."""
    base = [("assign", m.start(), m.end(), _base_bits(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [("access", m.start(), m.end(), _base_bits(m[0])) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    base += [("hex", m.start(), m.end(), _base_bits(m[0])) for m in HEX.finditer(text)]
    covered = _union([(start, end) for _, start, end, _ in base])
    at = 0  # of the covered stretches; candidates come in order
    found = []
    for m in RUN.finditer(text):
        stretches = entropy_spans(m[0])
        if not stretches or any(p.search(m[0]) for p in allow):
            continue
        before = text[max(0, m.start() - CONTEXT_LENGTH) : m.start()]
        if any(p.search(before) for p in allow_before):
            continue
        for start, end, bits in stretches:
            start, end = start + m.start(), end + m.start()
            while at < len(covered) and covered[at][1] < end:
                at += 1
            if at == len(covered) or covered[at][0] > start:
                found.append(("entropy", start, end, bits))
    order = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(base + found, key=lambda s: (s[1], order[s[0]]))


def _union(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that no other one holds, by start."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches, key=lambda s: (s[0], -s[1])):
        if not out or end > out[-1][1]:
            out.append((start, end))
    return out


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    allow: Sequence[str] = ALLOW,
    allow_before: Sequence[str] = ALLOW_BEFORE,
) -> DataFrame:
    """id and `spans`, an array of (kind, start, end, bits) by start, then kind as in `KINDS`.

    `allow` are patterns searched in a candidate, `allow_before` in the text just before it; both suppress entropy spans only.
    """
    allow, allow_before = [re.compile(p) for p in allow], [re.compile(p) for p in allow_before]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            spans = [
                [dict(zip(("kind", "start", "end", "bits"), s)) for s in secret_spans(text or "", allow, allow_before)]
                for text in part.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, kind)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,bits:double>>"
    return rows.mapInArrow(scan, shape).withColumnRenamed("id", id_col)


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with every stretch that one or more spans cover replaced by `[SECRET]`; null text stays null."""
    allow = [re.compile(p) for p in options.get("allow", ALLOW)]
    allow_before = [re.compile(p) for p in options.get("allow_before", ALLOW_BEFORE)]

    def mask(text: str) -> str:
        out, at = [], 0
        for start, end in _merged(secret_spans(text, allow, allow_before)):
            out += [text[at:start], "[SECRET]"]
            at = end
        return "".join([*out, text[at:]])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col):
            at = part.schema.get_field_index(text_col)
            masked = pa.array([None if t is None else mask(t) for t in part.column(at).to_pylist()], part.schema.field(at).type)
            yield part.set_column(at, part.schema.field(at), masked)

    return docs.mapInArrow(scan, docs.schema)


def _merged(spans: list[tuple[str, int, int, float]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for _, start, end, _ in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out
