"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a text there is exactly one last token of its encoding. An
Aho-Corasick automaton over the vocabulary lists the pieces that end at a
position; the last token is the one that is compatible with the last token of
the prefix before it, where two tokens are compatible if encoding their
concatenation gives back just these two. The ids are then read off backwards.

No merge crosses two neighbouring characters that no piece has side by side.
Texts are cut there, and before a word mark that follows another character, and
the table is built once for each distinct unit that a task meets. Units are
kept in two generations: when the young one is full it becomes the old one, and
what is met again moves up, so usual words stay and memory is bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, sliced

MARK = "▁"
#: Units in a generation of a task's cache, and the longest unit that is kept.
CACHED_UNITS, CACHED_CHARS = 250_000, 64
#: What a normaliser may change: ligatures, widths, accents, spaces, controls.
_PROBES = (" ﬁ  a ", "Ａ①½", "e\u0301 é", "a\u00a0b\u3000c\u200bd", "x\ty\r\nz", "\ufeffq\x00\x7f")


class PrefixTable:
    """Encoder and decoder of one model file.

    It covers models whose normaliser keeps texts as they are, with a mark
    before the text and byte fallback; others are refused.
    """

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.end_id, self.unknown = sp.eos_id(), sp.unk_id()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        if any(i == self.unknown for i in self.byte_ids) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model has no byte fallback, or pieces that hold a mark after other characters")
        if any(sp.normalize(p) != MARK + p.replace(" ", MARK) for p in _PROBES):
            raise ValueError("the model's normaliser changes texts")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.young: dict[str, tuple[bytes, bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes, bytes]] = {}
        self.spoken = [b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.decimal = [b"%d " % i for i in range(n)]
        self.packed = [i.to_bytes(4, "little") for i in range(n)]
        self.cut = self.cutter()
        self.alone = [not special[i] and self.merged(p) == [p] for i, p in enumerate(self.pieces)]

    def spelled(self, token: int) -> str:
        """A token's characters; tokens beyond the vocabulary are characters that no piece covers."""
        return self.pieces[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def merged(self, text: str) -> list[str]:
        """Merges by score, then from the left, as training defined them; used on one or two pieces only."""
        parts = list(text)
        while len(parts) > 1:
            found = [(self.rank[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.rank]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether encoding the two tokens' characters gives back just these two."""
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        pair = [self.spelled(before), self.spelled(token)]
        known = self.compatible[before << 32 | token] = self.merged(pair[0] + pair[1]) == pair
        return known

    def last_tokens(self, unit: str) -> list[int]:
        """The table: the last token of the first i characters, for each i from 1; -1 stands for none."""
        beyond, known, alone = len(self.pieces), self.compatible, self.alone
        # a character stands for itself until a piece is found to end with it
        last = [-1, *[beyond + ord(c) for c in unit]]
        closed = 0
        for end, found in self.automaton.iter(unit):  # by end, the longest piece first
            if end < closed:
                continue
            length, token = found
            start = end + 1 - length
            if start:
                ok = known.get(last[start] << 32 | token)
                if ok is None:
                    ok = self.fits(last[start], token)
            else:
                ok = alone[token]
            if ok:
                closed = end + 1
                last[closed] = token
        return last

    def encode_unit(self, unit: str) -> list[int]:
        last, pieces, out = self.last_tokens(unit), self.pieces, []
        at, beyond = len(unit), len(pieces)
        while at:
            token = last[at]
            if token < beyond:
                out.append(token)
                at -= len(pieces[token])
            else:
                out += [self.byte_ids[b] for b in reversed(unit[at - 1].encode())]
                at -= 1
        return out[::-1]

    def cutter(self) -> re.Pattern:
        """Matches the units of a text with marks: runs of characters that pieces link, with the marks before them, others one by one.

        Characters are linked that stand side by side in some piece, marks left
        out. Between two that aren't, not even through others, no piece can reach.
        """
        group = {c: c for p in self.ids if len(p) > 1 for c in p if c != MARK}

        def root(c: str) -> str:
            while group[c] != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        for p in self.ids:
            own = p.lstrip(MARK)
            for x, y in zip(own, own[1:]):
                group[root(x)] = root(y)
        linked: dict[str, list[str]] = {}
        for c in sorted(group):
            linked.setdefault(root(c), []).append(c)
        runs = [f"{MARK}*[{''.join(re.escape(c) for c in chars)}]+" for chars in sorted(linked.values(), key=len, reverse=True)]
        return re.compile("|".join([*runs, f"{MARK}+", "."]), re.DOTALL)

    def units(self, text: str) -> list[str]:
        """The text with marks for spaces, cut where no piece reaches across."""
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def coded(self, unit: str) -> tuple[bytes, bytes, bytes]:
        """(ids as 4 bytes each, ids in decimal with a space after each, decoded bytes) of a unit that the young generation lacks."""
        found = self.old.get(unit)
        if found is None:
            ids = self.encode_unit(unit)
            found = b"".join([self.packed[i] for i in ids]), b"".join([self.decimal[i] for i in ids]), self.decode_bytes(ids)
        if len(unit) <= CACHED_CHARS:
            if len(self.young) >= CACHED_UNITS:
                self.old, self.young = self.young, {}
            self.young[unit] = found
        return found

    def coded_texts(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes, bytes]]:
        """Of each text what ``coded`` gives of a unit, with the end id, and without the mark before the text."""
        end = self.packed[self.end_id], self.decimal[self.end_id][:-1]
        for x in texts:
            if not x:
                yield *end, b""
                continue
            units = self.units(x)
            parts = list(map(self.young.get, units))
            if None in parts:
                parts = [p or self.young.get(u) or self.coded(u) for u, p in zip(units, parts, strict=True)]
            ids, decimal, back = zip(*parts, strict=True)
            plain = b"".join(back)
            yield b"".join(ids) + end[0], b"".join(decimal) + end[1], plain[1:] if plain[:1] == b" " else plain

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.encode_unit(u)] + [self.end_id]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Bytes of the ids, marks as spaces, the mark before the text still there."""
        return b"".join([self.spoken[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of any ids. The first space of a text that starts with a mark is left out."""
        data = self.decode_bytes(ids)
        first = next((i for i in ids if i not in self.silent), None)
        if first is not None and first not in self.byte_of and data[:1] == b" ":
            data = data[1:]
        return data.decode(errors="replace")


_TABLES: dict[str, PrefixTable] = {}


def prefix_table(model_file: str) -> PrefixTable:
    """One table for each model file and Python worker."""
    if model_file not in _TABLES:
        _TABLES[model_file] = PrefixTable(model_file)
    return _TABLES[model_file]


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "piece_ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each text (end id last) and the text decoded from them.

    ``model_file`` is a path that every worker can open. A null or empty text
    gives the end id alone and decodes to the empty text. Other columns pass
    through; rows are neither dropped nor merged, repeated ones are coded each.
    Very long texts are coded unit by unit; what they need beside themselves is
    their ids. Clashing names raise.
    """
    return _appended(docs, model_file, text, [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())], _outputs)


def encode_decode_sums(docs: DataFrame, model_file: str, text: str = "text", n_tokens: str = "n_tokens", ids_sha256: str = "ids_sha256", decoded_sha256: str = "decoded_sha256") -> DataFrame:
    """As ``encode_decode``, but with the number of ids, the digest of the ids in decimal with a space between, and that of the decoded text."""
    return _appended(docs, model_file, text, [T.StructField(n_tokens, T.LongType()), T.StructField(ids_sha256, T.StringType()), T.StructField(decoded_sha256, T.StringType())], _sums)


def _outputs(coded: list[tuple[bytes, bytes, bytes]]) -> list[pa.Array]:
    ends = np.cumsum([len(c[0]) // 4 for c in coded])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join([c[0] for c in coded]), dtype="<i4")))
    return [lists, pa.array([c[2].decode(errors="replace") for c in coded], pa.string())]


def _sums(coded: list[tuple[bytes, bytes, bytes]]) -> list[pa.Array]:
    return [pa.array([len(c[0]) // 4 for c in coded], pa.int64()), *(pa.array([hashlib.sha256(c[k]).hexdigest() for c in coded], pa.string()) for k in (1, 2))]


def _appended(docs: DataFrame, model_file: str, text: str, fields: list[T.StructField], outputs) -> DataFrame:
    if {f.name.lower() for f in fields} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already has one of the columns {', '.join(f.name for f in fields)}")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = prefix_table(model_file)
        for batch in batches:
            for part in sliced(batch, at, SLICE_BYTES):
                coded = list(t.coded_texts(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, *outputs(coded)], names=schema.names)

    return docs.mapInArrow(run, schema)


def digests(ids: str = "piece_ids", decoded: str = "decoded") -> list:
    """Columns that sum an encoding up, as ``encode_decode_sums`` has them."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    ]
