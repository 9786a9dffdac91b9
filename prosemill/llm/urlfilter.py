"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into masks of several 64-bit words. Bit i of a rule
says that its first i symbols are matched. Reading a byte moves every bit on by
one where the byte fits the next symbol, and keeps the bits in front of a star;
one step of a few word operations does this for all rules and for all URLs of a
batch at once (multiword Shift-And).

A canonical URL is ``host#path`` and, with a query, ``?query`` after it: the
host has A-Z lower-cased and ends before ``/``, ``?`` or ``#``, the fragment is
left out, so ``#`` stands once and parts host and path. In globs ``*`` stands
for any bytes, ``?`` for one byte, and a backslash takes the next byte as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Cells of the state table that one step handles.
STATES_AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Rule:
    """A glob over canonical URLs. Of matching rules the largest rank wins, then the longest name, then block."""

    verdict: str
    pattern: str
    name: str
    rank: int = 0


def host_rule(verdict: str, host: str, path: str) -> list[Rule]:
    """Rules for a host with all its subdomains, and paths that start with ``path``."""
    quoted = [s.replace("\\", "\\\\").replace("*", "\\*").replace("?", "\\?") for s in (host, path)]
    return [Rule(verdict, f"{lead}{quoted[0]}#{quoted[1]}*", host + path, 1) for lead in ("", "*.")]


#: Rules of the contract.
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Globs for what no host rule decides; without a match a URL is allowed.
GLOBS = [
    Rule("block", p, p)
    for p in ("*#*.exe", "*#*.zip", "*#*/login*", "*#*/cart/*", "*#*/wp-admin/*", "*#*\\?*sessionid=*", "*#*\\?*utm_source=*", "*.onion#*", "*xn--*#*", "*#*/../*")
]


class Automaton:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        symbols: list[list[int | None]] = []
        loops: list[list[int]] = []
        for r in rules:
            data, at, own, loop = r.pattern.encode(), 0, [], []
            while at < len(data):
                c = data[at]
                if c == 42:
                    loop.append(len(own))
                elif c == 63:
                    own.append(None)
                else:
                    at += c == 92 and at + 1 < len(data)
                    own.append(data[at])
                at += 1
            symbols.append(own), loops.append(loop)
        starts = np.cumsum([0] + [len(s) + 1 for s in symbols])
        self.words = max(1, -(-int(starts[-1]) // 64))
        self.fits = np.zeros((256, self.words), dtype=np.uint64)
        self.loop = np.zeros(self.words, dtype=np.uint64)
        self.start = np.zeros(self.words, dtype=np.uint64)
        for own, loop, at in zip(symbols, loops, starts, strict=False):
            self._set(self.start, at)
            for i in loop:
                self._set(self.loop, at + i)
            for i, c in enumerate(own, 1):
                for byte in range(256) if c is None else (c,):
                    self._set(self.fits[byte], at + i)
        self.ends = [(int(at) + len(own)) for own, at in zip(symbols, starts, strict=False)]

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """Whether each rule (column) matches each URL (row) from end to end."""
        out = np.zeros((len(urls), len(self.rules)), dtype=bool)
        order = np.argsort([-len(u) for u in urls], kind="stable")
        step = max(1, STATES_AT_ONCE // self.words)
        for a in range(0, len(urls), step):
            rows = order[a : a + step]
            out[rows] = self._run([urls[i] for i in rows])
        return out

    def _run(self, urls: list[bytes]) -> np.ndarray:
        """URLs come longest first; those that have ended stand at the tail and stay as they are."""
        lengths = np.array([len(u) for u in urls])
        data = np.frombuffer(b"".join(urls), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -i, side="left"))
            live = state[:n]
            moved = live << one
            moved[:, 1:] |= live[:, :-1] >> top
            state[:n] = moved & self.fits[data[starts[:n] + i]] | live & self.loop
        return np.stack([(state[:, e // 64] >> np.uint64(e % 64)) & one for e in self.ends], axis=1).astype(bool) if self.rules else np.zeros((len(urls), 0), bool)


def parts(url: str | None) -> tuple[str, str, str]:
    """(host, path, query with its question mark); all empty for null or without ``://``."""
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0]
    rest, mark, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path, mark + query


_LOWER = {c: c + 32 for c in range(65, 91)}


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", host_rules=tuple(HOST_RULES), globs=tuple(GLOBS), default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, glob), a row for each row of pages.

    ``rule`` names the longest host rule that fits, else null; ``glob`` the glob
    that decided, null if a host rule or the default did. Null and malformed
    URLs have an empty host and path and get what the globs say of ``#``, by
    default the default. Repeated rows are judged each; other columns are not read.
    """
    rules = [r for h in host_rules for r in host_rule(*h)] + list(globs)
    # the best first, so that the first match decides
    rules.sort(key=lambda r: (-r.rank, -len(r.name), r.verdict != "block", r.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        for batch in batches:
            for part in sliced(batch, 1):
                split = [parts(x) for x in part.column(1).to_pylist()]
                found = automaton.matches([f"{h}#{p}{q}".encode("utf-8", "surrogatepass") for h, p, q in split])
                best = np.where(found.any(axis=1), found.argmax(axis=1), -1) if rules else np.full(len(split), -1)
                chosen = [rules[i] if i >= 0 else None for i in best]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([h for h, _, _ in split], pa.string()), pa.array([p for _, p, _ in split], pa.string()),
                    pa.array([r.name if r and r.rank else None for r in chosen], pa.string()), pa.array([r.verdict if r else default for r in chosen], pa.string()), pa.array([r.name if r and not r.rank else None for r in chosen], pa.string()),
                ], names=["page_id", "host", "path", "rule", "verdict", "glob"])

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, glob string")
