"""Path policy: which paths are taken, and the first reason why others are not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.globs import patterns
from ..functions.text import col

# Fixed values of the policy, in natural order.
MANDATORY_DIRECTORIES = [".git", ".hg", ".svn", "node_modules", "vendor", "dist", "build", "target", ".venv", "venv", "__pycache__", ".ssh", ".aws", ".azure", ".gnupg", ".kube"]
MANDATORY_FILES = [".gitignore", ".gitattributes", ".gitmodules", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "Cargo.lock", "go.sum", "Pipfile.lock", "poetry.lock", "uv.lock", "composer.lock"]
CREDENTIAL = "(?i)^\\.env|^(?:credentials|secrets?)(?:[.-]|\\z)|^id_(?:rsa|dsa|ecdsa|ed25519)(?:\\.|\\z)|\\.(?:pem|key|p12|pfx)\\z"
GENERATED = [
    "(?:^|/)[^/]+(?:_grpc)?\\.pb\\.go\\z",
    "(?:^|/)[^/]+_pb2(?:_grpc)?\\.pyi?\\z",
    "(?:^|/)[^/]+_(?:grpc_)?pb\\.(?:d\\.ts|js|ts)\\z",
    "(?:^|/)[^/]+\\.generated\\.[^/]+\\z",
    "(?:^|/)[^/]+\\.gen\\.go\\z",
    "(?:^|/)[^/]+\\.min\\.(?:js|mjs|cjs)\\z",
]
FORMATS = {".md": "markdown", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".py": "python", ".pyi": "python", ".java": "java", ".go": "go", ".rs": "rust"}
DEFAULT_INCLUDE = ["**/*.md", "**/*.{js,jsx,mjs,cjs,ts,mts,cts,tsx,py,pyi,java,go,rs}"]
MOST_BYTES = 1 << 20


def parts(path: Column | str) -> Column:
    return F.split(col(path), "/")


def prefixes(path: Column | str) -> Column:
    """The path's folders and the path itself, shortest first."""
    p = parts(path)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, F.lit(1), n), "/"))


def is_safe(path: Column | str) -> Column:
    path = col(path)
    return F.length(path).between(1, 4096) & ~path.rlike("[\\\\:\\x00-\\x1f\\x7f]") & F.forall(parts(path), lambda x: ~x.isin("", ".", ".."))


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), "[^/](\\.[^./]*)\\z", 1))


def file_format(path: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.element_at(known, extension(path))


def _mandatory(path: Column, include_hidden: bool, own_state: tuple[str, ...] = ()) -> Column:
    """own_state: further names of folders and files that a tool keeps its state in."""
    names = parts(path)
    last = F.element_at(names, -1)
    reasons = F.when(F.exists(names, lambda x: x.isin([*MANDATORY_DIRECTORIES, *own_state])), "mandatory_directory").when(last.isin([*MANDATORY_FILES, *own_state]) | last.endswith(".lock"), "mandatory_file").when(last.rlike(CREDENTIAL), "credential_file")
    if not include_hidden:
        reasons = reasons.when(F.exists(names, lambda x: x.startswith(".")), "hidden_path")
    generated = F.lit(False)
    for p in GENERATED:
        generated = generated | path.rlike(p)
    return reasons.when(generated, "generated_path")


def matches_any(path: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns(globs):
        found = found | path.rlike(p)
    return found


def path_code(path: Column | str, exclude: list[str] = (), include_hidden: bool = False) -> Column:
    """unsafe_path, a mandatory reason, or config_exclude; null for a path that may be read. The order of the tests is their precedence."""
    path = col(path)
    whole = _mandatory(path, include_hidden)
    first = F.array_compact(F.transform(prefixes(path), lambda p: F.coalesce(_mandatory(p, include_hidden), F.when(matches_any(p, list(exclude)), "config_exclude"))))
    return F.when(~is_safe(path), "unsafe_path").otherwise(F.coalesce(whole, F.get(first, F.lit(0))))


def scan_code(path: Column | str, include: list[str] = tuple(DEFAULT_INCLUDE), exclude: list[str] = (), include_hidden: bool = False) -> Column:
    """path_code, then what the name and the include globs say."""
    path = col(path)
    return F.coalesce(
        path_code(path, exclude, include_hidden),
        F.when(extension(path) == ".txt", "plain_text_unsupported"),
        F.when(file_format(path).isNull(), "unsupported_format"),
        F.when(~matches_any(path, list(include)), "not_included"),
    )


def content_code(content: Column | str) -> Column:
    """too_large, binary or invalid_utf8, for binary content."""
    c = col(content)
    return F.when(F.octet_length(c) > MOST_BYTES, "too_large").when(F.position(F.unhex(F.lit("00")), c) > 0, "binary").when(~F.is_valid_utf8(c.cast("string")), "invalid_utf8")


# Codes that skip a path; others fail it.
SKIPS = ["unsafe_path", "mandatory_directory", "mandatory_file", "credential_file", "hidden_path", "generated_path", "config_exclude", "plain_text_unsupported", "unsupported_format", "not_included", "symlink", "not_regular_file", "hard_link", "too_large", "binary", "invalid_utf8", "generated_marker", "too_many_segments"]


def state(code: Column | str) -> Column:
    code = col(code)
    return F.when(code.isNull(), "eligible").when(code.isin(SKIPS), "skipped").otherwise("failed")
