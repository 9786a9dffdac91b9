"""Byte-level BPE, spelling variants and vector codes against a library or brute force, with nulls, empty and repeated rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from prosemill.llm import bytebpe, queries, spelling, vectorcodes
from prosemill.llm.common import stored

RANKS = queries.tokenizer_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    coder = bytebpe.byte_bpe(RANKS)
    return tiktoken.Encoding("own", pat_str=bytebpe.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def hard_texts():
    rng = random.Random(3)
    signs = "ab aA1  \n\t'sét中文😀Ա࢏՘꟎.,-_<|x"
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    return [*out, "a" * 30_000, "ab" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(40_000)), "é" * 9_000, " " * 5_000, "<|endoftext|>", "don't  stop\r\n\r\n", "\x00\x7f"]


def test_byte_bpe_codes_as_the_library(library):
    coder = bytebpe.byte_bpe(RANKS)
    for text in hard_texts():
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text) and coder.decode(ids) == text.encode()
        assert list(coder.coded_texts([text, text]))[1] == (np.array(ids, "<u4").tobytes(), text.encode())


def test_byte_bpe_merges_by_rank_then_from_the_left_for_any_ranks():
    """Vocabularies that no training gives: the same bytes from several pairs, and ranks that fall as tokens grow."""
    rng = random.Random(8)
    for _ in range(30):
        tokens = [bytes([b]) for b in range(256)]
        longer = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
        tokens += rng.sample(sorted(longer), len(longer))
        coder = bytebpe.ByteBpe.__new__(bytebpe.ByteBpe)
        coder.tokens, coder.ranks = tokens, {t: i for i, t in enumerate(tokens)}
        coder.longest, coder.queue = 5, bytebpe.RankQueue(len(tokens))
        coder.pairs = {(t[0], t[1]): i for i, t in enumerate(tokens) if len(t) == 2}
        for _ in range(20):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(6, 40)))
            parts = [data[i : i + 1] for i in range(len(data))]
            while found := [(coder.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in coder.ranks]:
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert coder.encode_bytes(data) == [coder.ranks[p] for p in parts]


def test_rank_queue_gives_least_ranks_first():
    rng, queue = random.Random(1), bytebpe.RankQueue(200_000)
    held = [(rng.choice([0, 1, 63, 64, 4095, 4096, 199_999, rng.randrange(200_000)]), i) for i in range(3_000)]
    for rank, place in rng.sample(held, len(held)):
        queue.push(rank, place)
    assert [queue.pop() for _ in held] == sorted(held) and queue.pop() is None
    with pytest.raises(ValueError):
        bytebpe.RankQueue((1 << 18) + 1)


def test_byte_bpe_keeps_rows_and_forgets_old_units(spark, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHED", 3)
    texts = [None, "", "one two three four five six one two", "one two three four five six one two", "x" * 100_000]
    frame = spark.createDataFrame([(i % 3, "n", t) for i, t in enumerate(texts)], "doc_id long, n_tokens string, text string")
    rows = bytebpe.encode_decode(frame, RANKS).collect()
    assert [(r.doc_id, r.n_tokens, list(r.byte_ids), bytes(r.decoded)) for r in rows] == [(i % 3, "n", library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)]
    coder = bytebpe.ByteBpe(RANKS)
    assert [c[0] for c in coder.coded_texts(texts)] == [np.array(library.encode_ordinary(t or ""), "<u4").tobytes() for t in texts] and len(coder.young) <= 3
    with pytest.raises(ValueError):
        bytebpe.encode_decode_sums(frame, RANKS)
    with pytest.raises(ValueError):
        coder.decode([50_256])
    assert bytebpe.encode_decode(frame.limit(0), RANKS).count() == 0


def test_byte_bpe_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op11_byte_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts, ratio=10):
    forms, n_near = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        forms[w], n_near[w] = best if best is not None and counts[best] >= ratio * n else None, len(others)

    def root(w):
        return root(forms[w]) if forms[w] else w

    return sorted((w, counts[w], forms[w] or "", counts.get(forms[w], 0), n_near[w], root(w)) for w in counts)


def told(rows):
    return sorted((r.word, r.n, r.form or "", r.form_n or 0, r.n_near, r.root) for r in rows)


@pytest.mark.parametrize("crowd", [2_000, 3])
def test_variants_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rng, counts = random.Random(5), {}
    for base in ("lighthouse", "straße", "Éclairés", "aaaaaaa", "abababab", "x", "ÿz", "", "÷a"):
        counts[base] = 10 ** rng.randint(2, 5)
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(1, 2)):
                i = rng.randint(0, len(w))
                w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é", "h"])
            counts.setdefault("".join(w), rng.choice([2, 2, 20, 200]))
    del counts[""]
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert told(spelling.variants(frame).collect()) == brute_variants(counts)
    assert spelling.variants(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(frame, ratio=1)


def test_forms_are_followed_to_the_last(spark):
    counts = {"a" * 7 + "b" * k: 10**k for k in range(9)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert told(spelling.variants(frame).collect()) == brute_variants(counts)
    assert {r.root for r in spelling.variants(frame).collect()} == {"aaaaaaabbbbbbbb"}


def test_word_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Lighthouse", "lighthouse", "ÉCLAIRÉS", "éclairés", "a1wonder-full", "café", "naïveté", "straßenbahn", "x×y÷z"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1]), (900, None), (901, ""), (902, "mountain " * 200_000)]
    frame = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string")
    expected = Counter()
    for d, t in rows:
        for w in spelling.LETTERS.findall(t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            expected[w] += 1
    kept = {w: n for w, n in expected.items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in spelling.word_counts(frame, drop_every=31).collect()} == kept and len(kept) > 15


def brute_codes(rows, parts, entries, rounds):
    """Rows of (id, label, integers), with Python's integers."""
    width = len(rows[0][2]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])[:entries]
    books = [[cut(r[2])[p] for r in first] for p in range(parts)]

    def best(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for r in rows:
                members.setdefault(best(cut(r[2])[p], books[p])[1], []).append(cut(r[2])[p])
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i], strict=True)] if i in members else e for i, e in enumerate(books[p])]
    out = []
    for r in rows:
        found = [best(cut(r[2])[p], books[p]) for p in range(parts)]
        out.append((r[0], r[1], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    sums = Counter()
    for r in out:
        sums[r[1]] += r[3]
    return [(*r, sums[r[1]]) for r in out], books


def test_vector_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "COMMON", 3), monkeypatch.setattr(vectorcodes, "STEP", 40)
    rng = random.Random(4)
    vectors = [[rng.choice([0.0, -0.001, rng.uniform(-1, 1), rng.uniform(-900, 900)]) for _ in range(8)] for _ in range(60)]
    vectors += [vectors[3]] * 20 + [[0.0] * 8] * 5
    rows = [(i, rng.choice([None, None, None, 1, 2, 3, 4]), v) for i, v in enumerate(vectors)]
    rows.append((None, 1, vectors[5]))
    odd = [(-5, 1, None), (-4, 1, [0.0] * 7 + [None]), (-3, 1, [0.0] * 7 + [float("nan")]), (-2, 1, [float("inf")] * 8), (-1, None, []), (900, 1, [0.5] * 16), (901, 1, [0.5] * 7)]
    frame = spark.createDataFrame([(*r, "c") for r in rows + odd], "vec_id long, label int, embedding array<float>, code string").repartition(3)
    coded, books = vectorcodes.encode(frame, parts=4, entries=6, rounds=2)
    got = vectorcodes.with_label_sums(stored(coded, "codes")).collect()
    whole = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows]
    expected, brute = brute_codes(whole, 4, 6, 2)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected)) and books.entries.tolist() == brute
    back = vectorcodes.decode(coded, books).where("vec_id is not null").collect()
    known = {i: v for i, _, v in whole}
    assert all(sum((x - y) ** 2 for x, y in zip(r.decoded, known[r.vec_id], strict=True)) == r.error for r in back)


def test_vector_codes_of_few_and_of_no_vectors(spark):
    frame = spark.createDataFrame([(1, None, [1.0, 2.0]), (1, None, [1.0, 2.0])], "vec_id long, label int, embedding array<double>")
    coded, books = vectorcodes.encode(frame, parts=2)
    assert [tuple(r) for r in coded.collect()] == [(1, None, "0000", 0)] * 2 and books.entries.shape == (2, 2, 1)
    for none in (frame.limit(0), frame.where("vec_id = 9"), frame.withColumn("embedding", F.lit(None).cast("array<double>"))):
        coded, books = vectorcodes.encode(none, parts=2)
        assert coded.count() == 0 and books is None
    with pytest.raises(ValueError):
        vectorcodes.encode(frame, entries=257)


@pytest.mark.parametrize(("width", "size"), [(4, 2**28), (64, 2**25), (3, 200), (1, 0), (5, 2**28)])
def test_limb_products_are_exact(width, size):
    rng = np.random.default_rng(7)
    x, c = rng.integers(-size, size + 1, (50, width)), rng.integers(-size, size + 1, (9, width))
    x[0], c[0] = -size, size
    assert vectorcodes.exact_products(x, c).tolist() == [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in c] for r in x]
    assert width * 2 ** (2 * vectorcodes.limb_bits(width)) <= 2**53
    at, far = vectorcodes.nearest(x, c)
    brute = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)), i) for i, s in enumerate(c)) for r in x]
    assert list(zip(far.tolist(), at.tolist(), strict=True)) == brute
    with pytest.raises(ValueError):
        vectorcodes.nearest(x + 2**40, c)
