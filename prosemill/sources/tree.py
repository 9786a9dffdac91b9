"""A tree of files as a Spark source: ``spark.read.format("prose_tree").option("path", root)``.

A scan keeps to its targets, files or folders; targets inside others are read
once. Entries of a target folder and of the folders in it are partitions, so
subtrees are walked in parallel. Names that hidden-file rules of other sources
leave out are reported; links and special files are reported, not followed;
contents are read up to a limit, with the file's identity checked before and
after, and that of every folder above it.
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, path_type string, code string, byte_length bigint, content binary"
MOST_BYTES, MOST_DEPTH, MOST_PATHS = 1 << 20, 128, 100_000
#: Folders above an entry: (path, device, inode).
Chain = tuple[tuple[str, int, int], ...]


class TreeSource(DataSource):
    """Options: path, the root folder; prune, a JSON object of what is not entered: names, hidden (a flag), patterns of paths."""

    @classmethod
    def name(cls) -> str:
        return "prose_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], json.loads(self.options.get("prune", "{}")), json.loads(self.options.get("targets", "[]")))


def outermost(targets: list[str]) -> list[str]:
    """Targets in order, each once, without those that lie inside of others; none stand for the root, ``.``.

    A tree of path components finds what is inside: a target ends the way of all longer ones.
    """
    tree: dict = {}
    for target in targets or ["."]:
        parts = [] if target == "." else target.split("/")
        if target != "." and (any(p in ("", ".", "..") for p in parts) or re.search("[\\\\\x00-\x1f\x7f]", target)):
            raise ValueError(f"unsafe_path: {target!r}")
        here = tree
        for part in parts:
            if "" in here:
                break
            here = here.setdefault(part, {})
        if "" not in here:
            here.clear()
            here[""] = target
    out: list[str] = []
    waiting = [tree]
    while waiting:
        here = waiting.pop()
        out += [here[""]] if "" in here else []
        waiting += [v for k, v in here.items() if k]
    return sorted(out, key=lambda p: p.encode("utf-16-be", "surrogatepass"))


def chain_of(full: str) -> Chain:
    """The folders from the file system's root down to ``full``, none of which may be a link."""
    out, at = [], os.sep
    for part in ["", *full.split(os.sep)[1:]]:
        at = os.path.join(at, part) if part else at
        info = os.lstat(at)
        if stat.S_ISLNK(info.st_mode):
            raise ValueError(f"symlink: {at}")
        out.append((at, info.st_dev, info.st_ino))
    return tuple(out)


def unchanged(chain: Chain) -> bool:
    """Whether all folders of a chain are still what they were, and no links."""
    try:
        return all((i := os.lstat(at)).st_dev == dev and i.st_ino == ino and not stat.S_ISLNK(i.st_mode) for at, dev, ino in chain)
    except OSError:
        return False


class Prune:
    """Folders that are reported and not entered."""

    def __init__(self, options: dict):
        self.names, self.hidden = frozenset(options.get("names", ())), options.get("hidden", False)
        self.patterns = [re.compile(p.replace("\\z", "\\Z")) for p in options.get("patterns", ())]

    def code(self, path: str) -> str | None:
        name = os.path.basename(path)
        if name in self.names:
            return "mandatory_directory"
        if self.hidden and name.startswith("."):
            return "hidden_path"
        return "config_exclude" if any(p.search(path) for p in self.patterns) else None


class Entry(InputPartition):
    """One path below the root, with the folders above it as they were when partitions were made."""

    def __init__(self, name: str, chain: Chain):
        super().__init__(name)
        self.chain = chain


class TreeReader(DataSourceReader):
    def __init__(self, root: str, prune: dict, targets: list[str] = ()):
        self.root, self.prune, self.targets = root, prune, outermost(list(targets))

    def partitions(self) -> list[InputPartition]:
        """A partition for each entry of a target folder and of the folders in it, so that one deep folder is several tasks."""
        if not os.path.isabs(self.root) or os.path.normpath(self.root) != self.root or re.search("[\\x00-\\x1f\\x7f]", self.root) or os.path.islink(self.root) or not os.path.isdir(self.root):
            raise ValueError("path must be an absolute folder that is no link, without control characters")
        prune, chain, out = Prune(self.prune), chain_of(self.root), []
        for target in self.targets:
            out += self._entries(target, chain, prune)
            if len(out) > MOST_PATHS:
                raise ValueError("scope_too_large")
        return out or [Entry("", ())]

    def _entries(self, target: str, chain: Chain, prune: Prune) -> Iterator[Entry]:
        if target == ".":
            names, above = sorted(os.listdir(self.root)), chain
        else:
            parts = target.split("/")
            above = self._below(chain, parts[:-1])
            # folders of a target's path that policy doesn't enter, or that are links, are reported instead
            stop = next((i for i in range(1, len(parts)) if prune.code("/".join(parts[:i]))), None) if above else 1
            if stop or above is None:
                yield Entry("/".join(parts[: stop or 1]), chain)
                return
            names = [target]
        for name in names:
            full = os.path.join(self.root, name)
            inside = not os.path.islink(full) and os.path.isdir(full) and not prune.code(name)
            try:
                info = os.lstat(full)
                children = sorted(os.listdir(full)) if inside else None
            except OSError:
                children = None
            if children is None:
                yield Entry(name, above)
            for child in children or ():
                yield Entry(f"{name}/{child}", (*above, (full, info.st_dev, info.st_ino)))

    def _below(self, chain: Chain, parts: list[str]) -> Chain | None:
        """The chain down to a folder below the root; None if there is no such folder."""
        at = self.root
        for part in parts:
            at = os.path.join(at, part)
            try:
                info = os.lstat(at)
            except OSError:
                return None
            if not stat.S_ISDIR(info.st_mode):
                return None
            chain = (*chain, (at, info.st_dev, info.st_ino))
        return chain

    def read(self, partition: Entry) -> Iterator[tuple]:
        if partition.value:
            yield from walk(self.root, partition.value, Prune(self.prune), partition.value.count("/") + 1, partition.chain)


def walk(root: str, name: str, prune: Prune, depth: int = 1, chain: Chain = ()) -> Iterator[tuple]:
    """Rows of one entry and what is below it, depth first, names in order. ``chain`` holds the folders above, checked again after each read."""
    full = os.path.join(root, name)
    try:
        info = os.lstat(full)
    except OSError:
        yield name, "unknown", "read_failed", None, None
        return
    if stat.S_ISLNK(info.st_mode):
        yield name, "unknown", "symlink", None, None
    elif stat.S_ISDIR(info.st_mode):
        if code := prune.code(name):
            yield name, "directory", code, None, None
        elif depth >= MOST_DEPTH:
            yield name, "directory", "too_deep", None, None
        else:
            try:
                children = sorted(os.listdir(full))
            except OSError:
                yield name, "directory", "read_failed", None, None
                return
            own = (*chain, (full, info.st_dev, info.st_ino))
            if not unchanged(own):
                yield name, "directory", "path_changed", None, None
                return
            for child in children:
                yield from walk(root, f"{name}/{child}", prune, depth + 1, own)
    elif not stat.S_ISREG(info.st_mode):
        yield name, "other", "not_regular_file", None, None
    else:
        code, size, content = read_checked(full, info)
        if code is None and not unchanged(chain):
            code, content = "path_changed", None
        yield name, "file", code, size, content


def read_checked(full: str, seen: os.stat_result) -> tuple[str | None, int, bytes | None]:
    """(code, size, content): the content only if the file is the one that was seen, has one link and stays as it is."""
    if seen.st_nlink != 1:
        return "hard_link", seen.st_size, None
    if seen.st_size > MOST_BYTES:
        return "too_large", seen.st_size, None
    try:
        fd = os.open(full, os.O_RDONLY | os.O_NOFOLLOW)
    except OSError:
        return "path_changed", seen.st_size, None
    with os.fdopen(fd, "rb") as f:
        before = os.fstat(fd)
        content = f.read(MOST_BYTES + 1)
        after = os.fstat(fd)
    same = lambda a, b: (a.st_dev, a.st_ino, a.st_size, a.st_mtime_ns, a.st_ctime_ns) == (b.st_dev, b.st_ino, b.st_size, b.st_mtime_ns, b.st_ctime_ns)
    if not same(seen, before) or not same(before, after):
        return "file_changed", seen.st_size, None
    return None, len(content), content


def read_tree(spark: SparkSession, root: str, names: tuple[str, ...] = (), hidden: bool = False, patterns: tuple[str, ...] = (), targets: tuple[str, ...] = ()):
    """The tree at ``root``, or what is at ``targets`` in it; folders with one of the names, hidden ones if ``hidden`` is set, and those that fit a pattern are not entered."""
    spark.dataSource.register(TreeSource)
    prune = json.dumps({"names": names, "hidden": hidden, "patterns": patterns})
    return spark.read.format("prose_tree").option("path", root).option("prune", prune).option("targets", json.dumps(targets)).load()


def read_file(root: str, name: str) -> tuple[str | None, int | None, bytes | None]:
    """(code, size, content) of one file below ``root``, with the checks of a scan."""
    [name] = outermost([name])
    row = next(walk(root, name, Prune({}), 1, chain_of(os.path.dirname(os.path.join(root, name)))))
    return row[2:] if row[:2] == (name, "file") else (row[2] or "not_regular_file", None, None)
