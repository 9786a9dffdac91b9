"""Places of many literals at once: one pass by an Aho-Corasick automaton, whatever their number."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGES = pa.list_(pa.struct([("start_byte", pa.int64()), ("end_byte", pa.int64())]))
RANGES = "array<struct<start_byte:bigint,end_byte:bigint>>"


def automaton(terms: Sequence[str]) -> ahocorasick.Automaton:
    """One integer for each term: its length, its number, and whether it may overlap itself."""
    found = ahocorasick.Automaton()
    for number, term in enumerate(dict.fromkeys(t for t in terms if t)):
        bordered = any(term.startswith(term[k:]) for k in range(1, len(term)))
        found.add_word(term, len(term) << 32 | number << 1 | bordered)
    if len(found):
        found.make_automaton()
    return found


def spans(text: str, terms: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in bytes of the terms' occurrences, sorted, each once. Occurrences of one term don't overlap; those of different terms may."""
    hits = np.fromiter(chain.from_iterable(terms.iter(text)), np.int64).reshape(-1, 2)
    ends, values = hits[:, 0] + 1, hits[:, 1]
    starts = ends - (values >> 32)
    bordered = np.flatnonzero(values & 1)
    if len(bordered):
        taken: dict[int, int] = {}
        kept = np.ones(len(ends), dtype=bool)
        for i, value, start, end in zip(bordered.tolist(), values[bordered].tolist(), starts[bordered].tolist(), ends[bordered].tolist(), strict=True):
            if start < taken.get(value, 0):
                kept[i] = False
            else:
                taken[value] = end
        starts, ends = starts[kept], ends[kept]
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], ends[order]
    if not text.isascii():
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))))
        starts, ends = sizes[starts], sizes[ends]
    return starts, ends


def places(text: str, terms: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """(start, end) of ``spans``."""
    return list(zip(*(x.tolist() for x in spans(text, terms)), strict=True))


def glossary_ranges(terms: Sequence[str]) -> Callable[[Column], Column]:
    """A column function: the byte ranges of all terms in a text, sorted, each once. Null texts and empty terms have none."""
    terms = tuple(terms)
    if not any(terms):
        return lambda c: F.array().cast(RANGES)
    made: list[ahocorasick.Automaton] = []

    @F.arrow_udf(RANGES)
    def ranges(texts: pa.Array) -> pa.Array:
        if not made:  # once a worker
            made.append(automaton(terms))
        none = np.empty(0, dtype=np.int64)
        found = [spans(t, made[0]) if t else (none, none) for t in (x.as_py() for x in texts)]
        ends = np.cumsum([0, *(len(a) for a, _ in found)])
        columns = [pa.array(np.concatenate([none, *(x[k] for x in found)])) for k in (0, 1)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RANGES.value_type))).cast(_RANGES)

    return ranges
