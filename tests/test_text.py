"""Column functions against plain Python twins."""

import re

import pytest
from pyspark.sql import functions as F

from prosemill.functions import globs
from prosemill.functions import text as T
from prosemill.operators import policy, validation

TEXTS = ["", "plain", "é http://a.b 😀 http://c.d, x", "a\r\nb\n", "a\rb", "x\r\ny\r\n", "see ./a/b.md and lib/x.go", "mail bob@ex.org now", "{{x}} ${y} %(z)s <NAME> --flag @s/p foo_bar camelCase f()", None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


@pytest.mark.parametrize("family", list(T.PROTECTED))
def test_match_ranges_are_those_of_a_regex_scan(texts, family):
    pattern = re.compile(T.PROTECTED[family].replace("\\z", "\\Z"), re.ASCII)
    for r in texts.select("t", T.match_ranges("t", T.PROTECTED[family]).alias("r")).collect():
        want = [(len(r.t[: m.start()].encode()), len(r.t[: m.end()].encode())) for m in pattern.finditer(r.t)] if r.t else []
        assert [(x.start_byte, x.end_byte) for x in r.r] == want


def test_eol_and_utf16(texts):
    rows = texts.select("t", T.eol_style("t").alias("e"), T.utf16_length("t").alias("n")).collect()
    assert [r.e for r in rows] == ["none", "none", "none", "mixed", "cr", "crlf", "none", "none", "none", None]
    assert [r.n for r in rows[:-1]] == [len(t.encode("utf-16-le")) // 2 for t in TEXTS[:-1]]


def test_splice_keeps_other_bytes(spark):
    edits = F.expr("array(named_struct('start_byte', 2L, 'end_byte', 6L, 'replacement', 'x'), named_struct('start_byte', 7L, 'end_byte', 7L, 'replacement', 'yz'))")
    got = spark.createDataFrame([("é😀 ab",)], "t string").select(T.spliced("t", edits).cast("string").alias("o")).first().o
    assert got == "éx yzab"


def test_greedy_groups_reset_their_budget(spark):
    rows = spark.createDataFrame([([5, 5, 1, 20, 3, 3, 3, 3],)], "a array<bigint>")
    assert rows.select(T.greedy_groups("a", [(lambda x: x, 10)], 3).alias("g")).first().g == [0, 0, 1, 2, 3, 3, 3, 4]


def test_globs():
    match = lambda g, p: any(re.search(x.replace("\\z", "\\Z"), p) for x in globs.patterns([g]))
    assert match("**/*.md", "a.md") and match("**/*.md", "x/y/a.md") and not match("*.md", "x/a.md")
    assert match("src/{a,b}/?.go", "src/b/x.go") and not match("src/{a,b}/?.go", "src/c/x.go")
    assert match("a[1].md", "a[1].md") and not match("a[1].md", "a1.md")
    for bad in ("!a", "/a", "a/../b", "a:b", "{a,{b}}", "{a,}", "", "{a,b}" * 5):
        with pytest.raises(globs.GlobError):
            globs.expanded(bad)


@pytest.mark.parametrize(
    ("path", "code"),
    [("a/../b.md", "unsafe_path"), ("a//b.md", "unsafe_path"), ("vendor/a.md", "mandatory_directory"), ("x/go.sum", "mandatory_file"), ("foo.lock/a.md", "mandatory_file"), ("secrets/a.md", "credential_file"), (".x/a.md", "hidden_path"), ("a.pb.go", "generated_path"), ("drafts/a.md", "config_exclude"), ("a.txt", "plain_text_unsupported"), ("a.bin", "unsupported_format"), (".md", "hidden_path"), ("A.MD", "not_included"), ("docs/a.md", None)],
)
def test_first_reason_wins(spark, path, code):
    assert spark.createDataFrame([(path,)], "p string").select(policy.scan_code("p", exclude=["drafts/**"]).alias("c")).first().c == code


@pytest.mark.parametrize(
    ("original", "replacement", "code"),
    [("teh", "teh", "unchanged_proposal"), ("teh", "the\x07", "unsafe_replacement"), ("teh", " the", "whitespace_changed"), ("a\nb", "a b", "line_structure_changed"), ("teh", "t" * 200, "replacement_too_large"), ("teh", "t*h", "unsafe_delimiter_change"), ("nope", "nop", "original_not_found"), ("aa", "ab", "ambiguous_original"), ("foo_bar", "foo bar", "unsafe_delimiter_change"), ("bob.md", "bobxmd", "protected_range"), ("teh", "the", None)],
)
def test_reject_codes(spark, original, replacement, code):
    rows = spark.createDataFrame([("say teh aaa foo_bar a\nb bob.md", original, replacement)], "t string, o string, r string")
    assert rows.select(validation.proposal_code("t", "o", "r", T.protected_ranges("t"), F.lit(0)).alias("c")).first().c == code


def test_glossary_equals_a_regex_for_each_term(spark):
    import random
    import re

    from prosemill.functions import glossary

    rng = random.Random(6)
    for _ in range(200):
        terms = ["".join(rng.choice("aé.😀") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))]
        text = "".join(rng.choice("aé.😀 ") for _ in range(rng.randint(0, 80)))
        want = sorted({(len(text[: m.start()].encode()), len(text[: m.end()].encode())) for t in terms for m in re.finditer(re.escape(t), text)})
        assert sorted(glossary.places(text, glossary.automaton(terms))) == want
    rows = spark.createDataFrame([("aaé aé",), (None,), ("",)], "t string")
    got = rows.select(T.protected_ranges("t", families=(), glossary=("aé", "a", ""))).collect()
    assert [[tuple(r) for r in x[0]] if x[0] is not None else None for x in got][0] == [(0, 1), (1, 2), (1, 4), (5, 6), (5, 8)]


def test_dense_terms_take_no_square_time(spark):
    import time

    text = "the é. " * 10_000
    rows = spark.createDataFrame([(text,)], "t string")
    ranges = lambda *terms: rows.select(T.protected_ranges("t", families=("email",), glossary=terms)).first()[0]
    assert ranges("x") == []
    start = time.time()
    got = ranges("the", "he", "é", "aa", ".")
    assert (len(got), sum(r.end_byte - r.start_byte for r in got)) == (40_000, 80_000) and time.time() - start < 20
