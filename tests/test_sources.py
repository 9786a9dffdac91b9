"""The file tree source, commits, preferences, screening and the audit stream."""

import hashlib
import json
import os

import pytest

from prosemill.operators import policy, screen
from prosemill.sources import apply, config, tree
from prosemill.streaming import audit


def test_tree(spark, tmp_path):
    (tmp_path / "docs/.git").mkdir(parents=True)
    (tmp_path / "docs/.git/x.md").write_text("no")
    (tmp_path / "docs/_a.md").write_text("héllo")
    (tmp_path / ".hidden.md").write_text("x")
    (tmp_path / "bin.md").write_bytes(b"a\x00b")
    (tmp_path / "bad.md").write_bytes(b"\xff")
    os.symlink(tmp_path / "bin.md", tmp_path / "link.md")
    os.link(tmp_path / "bad.md", tmp_path / "hard.md")
    rows = tree.read_tree(spark, str(tmp_path), (".git",))
    coded = rows.selectExpr("*", "code as c").withColumn("c", policy.F.coalesce("c", policy.content_code("content")))
    got = {r.path: (r.path_type, r.c) for r in coded.collect()}
    assert got == {
        ".hidden.md": ("file", None), "bad.md": ("file", "hard_link"), "bin.md": ("file", "binary"), "docs/.git": ("directory", "mandatory_directory"),
        "docs/_a.md": ("file", None), "hard.md": ("file", "hard_link"), "link.md": ("unknown", "symlink"),
    }


def test_commit(spark, tmp_path):
    state = str(tmp_path / "state")
    (tmp_path / "a.md").write_text("teh end")
    os.chmod(tmp_path / "a.md", 0o640)
    digest = hashlib.sha256(b"teh end").hexdigest()
    rows = spark.createDataFrame([("a.md", digest, bytearray(b"the end"), 1), ("b.md", digest, bytearray(b"x"), 1), ("c.md", digest, bytearray(b""), 0)], "path string, before_sha256 string, candidate binary, proposals int")
    got = dict(apply.apply_candidates(rows, str(tmp_path), state))
    assert got == {"a.md": hashlib.sha256(b"the end").hexdigest(), "b.md": "unsafe_write_target", "c.md": "unchanged"}
    assert (tmp_path / "a.md").read_text() == "the end" and os.stat(tmp_path / "a.md").st_mode & 0o777 == 0o640
    with pytest.raises(apply.CommitError, match="file_changed"):
        apply.replace_file(str(tmp_path), "a.md", digest, b"zzz", 1, state)
    log = next(p for p in os.listdir(state) if p.startswith("audit"))
    events = [json.loads(x) for x in (tmp_path / "state" / log).read_text().splitlines()]
    assert [e["event"] for e in events] == ["write_intent", "write_complete", "write_intent", "write_aborted"] and "teh" not in json.dumps(events)
    with apply.write_lock(state), pytest.raises(apply.CommitError), apply.write_lock(state):
        pass


def test_preferences(tmp_path):
    (tmp_path / ".prose.json").write_text('﻿{"schema_version": 2, "exclude": ["a/**"], "dialect": "en-GB", "glossary": ["Foo"]}')
    got = config.load(str(tmp_path), {"exclude": ["b/**", "a/**"], "dialect": "en-US", "glossary": None})
    assert (got.exclude, got.dialect, got.glossary) == (("a/**", "b/**"), "en-US", ("Foo",))
    for bad in ({"nope": 1}, {"exclude": ["/x"]}, {"dialect": "fr"}):
        with pytest.raises(ValueError):
            config.merged({}, bad)


def test_screening(spark):
    files = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("c", "1", "1"), ("d", "1", "1")], "f string, sha256 string, expected_sha256 string")
    rows = spark.createDataFrame([("a", 1, "teh cat"), ("a", 2, "fine words"), ("b", 1, "teh"), ("c", 1, "all is fine")], "f string, segment int, text string")
    got = {r.f: (r.verdict, r.code) for r in screen.screened(files, rows, "f", screen.share_of_known_errors(frozenset({"teh"})), most=10).collect()}
    assert got == {"a": ("flagged", None), "b": ("flagged", "snapshot_mismatch"), "c": ("clean", None), "d": ("no_segments", None)}


def test_audit_stream(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    at = lambda h, e, p: json.dumps({"timestamp": f"2024-01-01T{h}:00Z", "event": e, "path": p, "candidateHash": p, "afterHash": p if e == "write_complete" else None, "proposalCount": 1})
    (folder / "1.jsonl").write_text("\n".join([at("01:00", "write_intent", "x"), at("01:01", "write_complete", "x"), at("01:02", "write_intent", "y")]))
    (folder / "2.jsonl").write_text(at("09:00", "write_intent", "z"))
    query = audit.unfinished(audit.events(spark, str(folder))).writeStream.format("memory").queryName("open_writes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.path for r in spark.sql("select path from open_writes").collect()] == ["y"]


def test_targets_are_read_once(spark, tmp_path):
    for name in ("a/b/c.md", "a/b/d.md", "a/e.md", "f.md", "g/h.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    read = lambda *targets: sorted(r.path for r in tree.read_tree(spark, str(tmp_path), targets=targets).collect())
    assert read() == read(".") == read("a", ".", "g") == ["a/b/c.md", "a/b/d.md", "a/e.md", "f.md", "g/h.md"]
    assert read("a/b/c.md", "a/b", "a/b/c.md", "f.md") == ["a/b/c.md", "a/b/d.md", "f.md"] and read("a/b/c.md") == ["a/b/c.md"]
    gone = {r.path: r.code for r in tree.read_tree(spark, str(tmp_path), targets=("nope.md", "f.md/x")).collect()}
    assert gone == {"nope.md": "read_failed", "f.md": None}
    pruned = {r.path: r.code for r in tree.read_tree(spark, str(tmp_path), names=("b",), targets=("a/b/c.md", "a/b/d.md")).collect()}
    assert set(pruned.values()) == {"mandatory_directory"}
    assert tree.outermost(["b/c", "b", "a", "b/c/d", "ab"]) == ["a", "ab", "b"] and tree.outermost([]) == ["."]
    for bad in ("../x", "/x", "a//b", "a/./b", "a\\b", "a\nb"):
        with pytest.raises(ValueError, match="unsafe_path"):
            tree.outermost([bad])


def test_folders_that_change_under_a_scan(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "other").mkdir()
    for folder in ("a/b", "other"):
        (tmp_path / folder / "x.md").write_text("words")
    reader = tree.TreeReader(str(tmp_path), {})
    [entry] = [p for p in reader.partitions() if p.value == "a/b"]
    assert [(r[0], r[2]) for r in reader.read(entry)] == [("a/b/x.md", None)]
    (tmp_path / "a").rename(tmp_path / "old")
    os.symlink(tmp_path / "old", tmp_path / "a")
    assert [(r[0], r[2], r[4]) for r in reader.read(entry)] == [("a/b", "path_changed", None)]
    (tmp_path / "a").unlink()
    (tmp_path / "other").rename(tmp_path / "a")
    (tmp_path / "a/b").mkdir()
    (tmp_path / "a/b/x.md").write_text("words")
    assert [r[2] for r in reader.read(entry)] == ["path_changed"]
    with pytest.raises(ValueError, match="symlink"):
        os.symlink(tmp_path, tmp_path / "loop")
        tree.chain_of(str(tmp_path / "loop/a"))
    assert tree.read_file(str(tmp_path), "a/b/x.md") == (None, 5, b"words") and tree.read_file(str(tmp_path), "a/b")[0] is not None


def stub(plan):
    """A scorer that answers by a word of the prose; ``plan`` has the statuses of words that fail at first or always."""

    def transport(state):
        word = state["prose"].split()[0]
        statuses = plan.get(word, [])
        calls = state_of.setdefault(word, 0)
        state_of[word] = calls + 1
        status = statuses[calls] if calls < len(statuses) else 200
        return status, {"probability": 0.9 if "teh" in state["prose"] else 0.1, "model": f"m-{word}", "input_tokens": len(state["prose"])} if status == 200 else None

    state_of: dict = {}
    transport.calls = state_of
    return transport


def test_calls_are_repeated_and_fail_by_code():
    waits = []
    busy = stub({"a": [503, 429], "b": [500, 500, 500], "c": [401], "d": [404], "e": [None]})
    ask = lambda prose: screen.ask(busy, screen.scorer_state("en-US", (), prose), waits.append)
    assert ask("a teh") == screen.Answer(0.9, "m-a", 5) and waits == [0.5, 1.0]
    for prose, code in (("b", "unavailable"), ("c", "auth_failed"), ("d", "invalid_response"), ("e", "unreachable")):
        with pytest.raises(screen.ScorerError, match=code):
            ask(prose)
    assert busy.calls == {"a": 3, "b": 3, "c": 1, "d": 1, "e": 1}
    for body in (None, {}, {"probability": 2, "model": "m"}, {"probability": 0.5, "model": ""}, {"probability": "x", "model": "m"}, {"probability": 0.5, "model": "m", "input_tokens": -1}):
        with pytest.raises(screen.ScorerError, match="invalid_response"):
            screen.read_answer(body)


def test_screening_by_calls(spark):
    files = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("c", "1", "1"), ("d", "1", "1")], "f string, sha256 string, expected_sha256 string")
    rows = spark.createDataFrame([("a", 1, "teh cat"), ("a", 2, "fine words"), ("b", 1, "teh"), ("c", 1, "all is fine")], "f string, segment int, text string")
    items, tokens, model = screen.screened_by_calls(files, rows, "f", stub({"all": [503]}), "en-GB", most=10, sleep=lambda s: None)
    assert {r.f: (r.verdict, r.error_probability, r.code) for r in items.collect()} == {"a": ("flagged", 0.9, None), "b": ("flagged", None, "snapshot_mismatch"), "c": ("clean", 0.1, None), "d": ("no_segments", None, None)}
    assert (tokens, model) == (28, "m-teh")
    with pytest.raises(screen.ScorerError, match="auth_failed"):
        screen.screened_by_calls(files, rows, "f", stub({"all": [403]}), "en-US", most=10, sleep=lambda s: None)
    # after a failure, a task begins no more calls
    many = spark.createDataFrame([(str(i), 0, "bad") for i in range(400)], "f string, chunk int, prose string").coalesce(1)
    codes = [r.code for r in screen.asked(many, "f", stub({"bad": [404] * 400}), "en-US").collect()]
    assert 1 <= codes.count("invalid_response") <= 4 and codes.count("cancelled") == 400 - codes.count("invalid_response")


def test_hourly_counts(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    line = lambda t, e: json.dumps({"timestamp": f"2024-01-01T{t}:00Z", "event": e, "path": "x"})
    (folder / "1.jsonl").write_text("\n".join([line("01:00", "write_intent"), line("01:59", "write_intent"), line("02:00", "write_complete")]))
    (folder / "2.jsonl").write_text(line("09:00", "write_intent"))
    query = audit.hourly(audit.events(spark, str(folder))).writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.hour.hour, r.event, r.n) for r in spark.sql("select * from hours").collect()) == [(1, "write_intent", 2), (2, "write_complete", 1)]


def test_lock_states(spark, tmp_path):
    from prosemill.streaming import locks

    folder = tmp_path / "log"
    folder.mkdir()
    line = lambda t, e, owner, root="x": json.dumps({"timestamp": f"2024-01-01T{t}Z", "event": f"lock_{e}", "tree": root, "owner": owner})
    batches = [
        [line("01:00:05", "acquire", "b"), line("01:00:00", "acquire", "a"), line("01:00:07", "refused", "c"), line("01:01:00", "release", "a"), line("01:01:00", "acquire", "b"), line("01:02:00", "release", "zz"), line("01:00:00", "acquire", "q", "y"), json.dumps({"timestamp": "2024-01-01T01:00:00Z", "event": "lock_acquire"})],
        [line("01:30:00", "acquire", "d", "z")],  # moves the watermark: b never gave its lock back
        [line("01:01:30", "release", "b"), line("01:31:00", "acquire", "a"), line("01:45:00", "acquire", "c")],  # the release is too late
        [line("03:00:00", "acquire", "e", "w")],
    ]
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    try:
        for i, lines in enumerate(batches):
            (folder / f"{i}.jsonl").write_text("\n".join(lines))
            query = locks.lock_states(locks.events(spark, str(folder))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            query.awaitTermination(200)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    told = sorted((r.tree, r["at"].strftime("%H:%M:%S"), r.state, r.owner) for r in rows)
    assert [t for t in told if t[0] == "x"] == [
        ("x", "01:00:00", "held", "a"), ("x", "01:00:05", "contended", "b"), ("x", "01:00:07", "contended", "c"), ("x", "01:01:00", "free", "a"), ("x", "01:01:00", "held", "b"),
        ("x", "01:11:00", "stale", "b"), ("x", "01:31:00", "held", "a"), ("x", "01:45:00", "taken_over", "c"), ("x", "01:55:00", "stale", "c"),
    ]
    assert ("y", "01:10:00", "stale", "q") in told and ("z", "01:40:00", "stale", "d") in told


@pytest.mark.parametrize("root", ["relative", "/no/such/folder", "/tmp/../tmp", "/tmp/a\nb"])
def test_roots_that_are_refused(root):
    with pytest.raises(ValueError):
        tree.TreeReader(root, {}).partitions()
