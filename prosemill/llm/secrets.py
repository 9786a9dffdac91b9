"""Secret scans: three known shapes, and sliding-window entropy of candidate strings.

Candidate strings are maximal runs of base64-like characters of at least
``MIN_CANDIDATE`` characters. A window slides over a candidate; counts of its
characters are kept up incrementally, and with them the Shannon entropy for the
window's character class (hex digits, letters and digits, base64 characters).
Windows at or above their class's threshold join to spans. Candidates on the
allow-list (words and paths, UUIDs, dates, one repeated unit) are passed over.
Spans are reported as the windows give them, beside the known shapes and over
them: where both stand, the windows tell how far the random part reaches.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, sliced

# The shapes of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
MIN_CANDIDATE = 20
#: Bits of a window's characters from which it counts as random, by class.
THRESHOLDS = {"hex": 2.9, "alnum": 3.5, "base64": 3.65}
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}")
ALLOWED = [
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE),
    re.compile(r"[A-Za-z]+"),  # letters alone: words of any length
    re.compile(r"[0-9_/=+-]+"),  # numbers, dates, rules
    re.compile(r"[/_+=-]*(?:[A-Za-z]+[0-9]{0,3}|[0-9]{1,8})(?:[/_+=-]+(?:[A-Za-z]+[0-9]{0,3}|[0-9]{1,8}))*[/_+=-]*"),  # paths and names of plain parts
    re.compile(r"(.{1,12}?)\1+"),  # one repeated unit
]
_HEX, _ALNUM = frozenset("0123456789abcdefABCDEF"), frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: x log2 x for the counts of a window.
_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def entropy_spans(candidate: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of windows with high entropy, joined where they touch. Ends are exclusive."""
    counts: dict[str, int] = {}
    spans: list[tuple[int, int]] = []
    total = outside_hex = outside_alnum = 0.0
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _NLOGN[n + 1] - _NLOGN[n]
        outside_hex += c not in _HEX
        outside_alnum += c not in _ALNUM
        if i >= window:
            d = candidate[i - window]
            n = counts[d]
            counts[d] = n - 1
            total += _NLOGN[n - 1] - _NLOGN[n]
            outside_hex -= d not in _HEX
            outside_alnum -= d not in _ALNUM
        if i >= window - 1:
            bits = math.log2(window) - total / window
            kind = "hex" if not outside_hex else "alnum" if not outside_alnum else "base64"
            if bits >= THRESHOLDS[kind] - 1e-9:
                start = i - window + 1
                if spans and start <= spans[-1][1]:
                    spans[-1] = spans[-1][0], i + 1
                else:
                    spans.append((start, i + 1))
    return spans


#: What an assignment needs, and what a byte is for a candidate: cheap scans tell most texts apart.
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUNS = bytes(120 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-" else 32 for b in range(256))


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed; ends are exclusive."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in _KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    data = text.encode("utf-8", "surrogatepass").translate(_RUNS)
    if b"x" * MIN_CANDIDATE in data:  # an access key and a hex run are such runs too
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
        for m in CANDIDATE.finditer(text):
            if not any(a.fullmatch(m[0]) for a in ALLOWED):
                found += [(m.start() + s, m.start() + e, 3) for s, e in entropy_spans(m[0])]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind>>), a row for each row of docs.

    Offsets are code points, ends exclusive. Spans of different kinds may
    overlap; those of one start are in the order of KINDS. Null and empty texts
    have no spans; very long texts are scanned whole, in proportion to their
    length; repeated rows are scanned each; other columns are not read.
    """
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(x)] for x in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), step, "doc_id long, spans array<struct<start:int,end:int,kind:string>>")


def listed(spans: str, base_only: bool):
    """Column with kind:start:end of the spans, comma-joined."""
    chosen = F.filter(spans, lambda s: s.kind != "entropy") if base_only else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def masked(text: str | None) -> str | None:
    """The text with each secret replaced by ``[kind]``; overlapping ones go together, named by the first."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in the text, and its length renewed where a text changed. No row goes.

    Null and empty texts stay as they are; equal rows are masked alike. A very
    long text is scanned at once and needs some times its size. Empty tables give
    none. Other columns pass through, whatever their names.
    """
    at = docs.columns.index(text)
    count = docs.columns.index(n_chars) if n_chars in docs.columns else None
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part in sliced(batch, at):
                before = part.column(at).to_pylist()
                after = [masked(x) for x in before]
                columns = list(part.columns)
                columns[at] = pa.array(after, pa.string())
                if count is not None:
                    columns[count] = pa.array([n if x == y else len(y) for n, x, y in zip(columns[count].to_pylist(), before, after, strict=True)], part.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
