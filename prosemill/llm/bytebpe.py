"""Byte-level BPE encoding and decoding by a rank queue with a hierarchical bitmap.

A text is split by the tokenizer's pattern; each match, a pre-token, is merged
by itself. Its parts stand in a linked list. Of every two neighbours that the
vocabulary can merge, the place of the left one is put into the bucket of the
merge's rank; a bitmap of three levels of 64-bit words tells by two or three
find-first-set steps which is the least rank with a bucket. The leftmost place
of that bucket is merged; places whose parts have changed since are skipped. A
pre-token of n bytes costs n steps with the logarithm of one bucket each,
however long it is, and nothing is scanned twice.

Pre-tokens repeat, so each worker keeps what it has coded in two generations:
when the young one is full it becomes the old one, and what is met again moves
up. Memory is bounded, and usual words stay.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SLICE_BYTES, sliced

#: The pattern that goes with the public rank files; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens in a generation of a worker's cache, and the longest that is kept, in characters.
CACHED, CACHED_CHARS = 400_000, 64


class RankQueue:
    """Places by rank: the least rank is found by a bitmap of three levels, its leftmost place by a heap."""

    def __init__(self, ranks: int):
        if ranks > 1 << 18:
            raise ValueError("a rank queue holds 2^18 ranks at most")
        self.buckets: list[list[int] | None] = [None] * ranks
        self.low, self.middle, self.top = [0] * ((ranks >> 6) + 1), [0] * ((ranks >> 12) + 1), 0

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets[rank]
        if bucket is not None:
            heappush(bucket, place)
            return
        self.buckets[rank] = [place]
        word = rank >> 6
        if not self.low[word]:
            self.middle[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)
        self.low[word] |= 1 << (rank & 63)

    def pop(self) -> tuple[int, int] | None:
        """(least rank, its leftmost place), taken out; None of an empty queue."""
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        word = self.middle[high]
        mid = high << 6 | (word & -word).bit_length() - 1
        word = self.low[mid]
        rank = mid << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        self.buckets[rank] = None
        word &= word - 1
        self.low[mid] = word
        if not word:
            self.middle[high] &= self.middle[high] - 1
            if not self.middle[high]:
                self.top &= self.top - 1
        return rank, bucket[0]


class _Known(dict):
    """Coded pre-tokens; what is missing is coded."""

    def __init__(self, coded):
        self.coded = coded

    def __missing__(self, pre_token: str) -> tuple[bytes, bytes]:
        return self.coded(pre_token)


class ByteBpe:
    """Encoder and decoder of one rank file, with lines of a token in base64 and its rank."""

    def __init__(self, rank_file: str, pattern: str = PATTERN):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        size = max(self.ranks.values()) + 1
        if len(set(self.ranks.values())) < len(self.ranks) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the rank file gives a rank twice, or lacks a byte")
        self.tokens: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pairs = {(t[0], t[1]): r for t, r in self.ranks.items() if len(t) == 2}
        self.longest = max(map(len, self.ranks))
        self.queue = RankQueue(size)
        self.split, self.newer = regex.compile(pattern), unassigned()
        self.young, self.old = _Known(self.coded), _Known(self.coded)

    def pre_tokens(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if not text.isascii() and self.newer.search(text):
            # classes as the tokenizer's library knows them: such characters are no letters there and match like any sign
            return [text[m.start() : m.end()] for m in self.split.finditer(self.newer.sub("", text))]
        return self.split.findall(text)

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        get, longest, n = self.ranks.get, self.longest, len(data)
        whole = get(data) if n <= longest else None
        if whole is not None:
            return [whole]
        tokens, push, pop = self.tokens, self.queue.push, self.queue.pop
        # a part is known by its first byte's place; ends[i] is 0 once part i is merged away
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i, pair in enumerate(zip(data, data[1:])):
            rank = self.pairs.get(pair)
            if rank is not None:
                push(rank, i)
        while (least := pop()) is not None:
            rank, left = least
            right = ends[left]
            if not right or right == n:
                continue
            end = ends[right]
            if data[left:end] != tokens[rank]:
                continue  # stale: one of the two parts has grown since
            ends[left], ends[right] = end, 0
            if end < n:
                before[end] = left
                further = ends[end]
                if further - left <= longest and (rank := get(data[left:further])) is not None:
                    push(rank, left)
            if left:
                at = before[left]
                if end - at <= longest and (rank := get(data[at:end])) is not None:
                    push(rank, at)
        out, at = [], 0
        while at < n:
            out.append(self.ranks[data[at : ends[at]]])
            at = ends[at]
        return out

    def coded(self, pre_token: str) -> tuple[bytes, bytes]:
        """(ids as little-endian 32-bit integers, bytes decoded from the ids) of a pre-token that a generation lacks."""
        found = dict.get(self.young, pre_token) or dict.get(self.old, pre_token)
        if found is None:
            ids = self.encode_bytes(pre_token.encode())
            found = np.array(ids, "<u4").tobytes(), self.decode(ids)
        if len(pre_token) <= CACHED_CHARS:
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, _Known(self.coded)
            self.young[pre_token] = found
        return found

    def coded_texts(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Of each text what ``coded`` gives of a pre-token."""
        for text in texts:
            if not text:
                yield b"", b""
                continue
            ids, back = zip(*map(self.young.__getitem__, self.pre_tokens(text)), strict=True)
            yield b"".join(ids), b"".join(back)

    def encode(self, text: str) -> list[int]:
        return [i for u in self.pre_tokens(text) for i in self.encode_bytes(u.encode())]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of any ids; ids that no token has raise."""
        tokens = [self.tokens[i] if 0 <= i < len(self.tokens) else None for i in ids]
        if None in tokens:
            raise ValueError("an id stands for no token")
        return b"".join(tokens)


@lru_cache(maxsize=1)
def unassigned() -> regex.Pattern:
    """Matches characters that the ``regex`` module takes for letters, digits or spaces and the tokenizer's library does not.

    Both follow Unicode, in versions of their own. What the library's classes
    hold is read off from it: it drops what a pattern does not match.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    bytewise = {bytes([b]): b for b in range(256)}
    newer: set[str] = set()
    for letters in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = tiktoken.Encoding("class", pat_str=letters, mergeable_ranks=bytewise, special_tokens={})
        own, other = set(regex.findall(letters, every)), set(theirs.decode(theirs.encode_ordinary(every)))
        if other - own:
            raise ValueError("the tokenizer's library knows a newer Unicode than the module regex")
        newer |= own - other
    codes = sorted(map(ord, newer))
    starts = [c for c, p in zip(codes, [None, *codes]) if p is None or p + 1 != c]
    ends = [c for c, p in zip(codes, [*codes[1:], None]) if p is None or p - 1 != c]
    ranges = "".join(f"{regex.escape(chr(a))}-{regex.escape(chr(b))}" for a, b in zip(starts, ends, strict=True))
    return regex.compile(f"[{ranges}]" if ranges else r"(?!)")


@lru_cache(maxsize=4)
def byte_bpe(rank_file: str, pattern: str = PATTERN) -> ByteBpe:
    """One coder for each rank file, pattern and Python worker."""
    return ByteBpe(rank_file, pattern)


def encode_decode(docs: DataFrame, rank_file: str, text: str = "text", ids: str = "byte_ids", decoded: str = "decoded", pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the ids of each text and the bytes decoded from them.

    ``rank_file`` is a path that every worker can open. A null or empty text
    gives no ids and decodes to no bytes. Other columns pass through; rows are
    neither dropped nor merged, repeated ones are coded each. A very long text
    is coded pre-token by pre-token, and a very long pre-token needs some 300
    bytes of memory for each of its bytes. Merges of equal rank go from the left.
    Empty tables give none. Clashing names raise.
    """
    fields = [T.StructField(ids, T.ArrayType(T.LongType(), False)), T.StructField(decoded, T.BinaryType())]
    return _appended(docs, rank_file, text, pattern, fields, _outputs)


def encode_decode_sums(docs: DataFrame, rank_file: str, text: str = "text", n_tokens: str = "n_tokens", ids_sha256: str = "ids_sha256", decoded_sha256: str = "decoded_sha256", pattern: str = PATTERN) -> DataFrame:
    """As ``encode_decode``, but with the number of ids, the digest of the ids as little-endian 32-bit integers, and that of the decoded bytes."""
    fields = [T.StructField(n_tokens, T.LongType()), T.StructField(ids_sha256, T.StringType()), T.StructField(decoded_sha256, T.StringType())]
    return _appended(docs, rank_file, text, pattern, fields, _sums)


def _outputs(coded: list[tuple[bytes, bytes]]) -> list[pa.Array]:
    ends = np.cumsum([0, *(len(c[0]) // 4 for c in coded)])
    flat = np.frombuffer(b"".join([c[0] for c in coded]), dtype="<u4").astype(np.int64)
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array([c[1] for c in coded], pa.binary())]


def _sums(coded: list[tuple[bytes, bytes]]) -> list[pa.Array]:
    return [pa.array([len(c[0]) // 4 for c in coded], pa.int64()), *(pa.array([hashlib.sha256(c[k]).hexdigest() for c in coded], pa.string()) for k in (0, 1))]


def _appended(docs: DataFrame, rank_file: str, text: str, pattern: str, fields: list[T.StructField], outputs) -> DataFrame:
    if {f.name.lower() for f in fields} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already has one of the columns {', '.join(f.name for f in fields)}")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(rank_file, pattern)
        for batch in batches:
            for part in sliced(batch, at, SLICE_BYTES):
                coded = list(coder.coded_texts(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, *outputs(coded)], names=schema.names)

    return docs.mapInArrow(run, schema)
