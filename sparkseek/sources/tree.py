"""A directory tree as a data source, with pruning and ignore files; Spark's own listing drops names that begin with _ or a dot."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkseek.functions import vocabulary as V


def scoped_pattern(pattern: str, folder: str) -> str:
    """An ignore pattern of a nested folder as one of the root; a leading ``!`` stays first."""
    if not folder:
        return pattern
    negated, body = pattern.startswith("!"), pattern.removeprefix("!")
    bare = body.lstrip("/")
    anywhere = body == bare and "/" not in bare.rstrip("/")
    return ("!" if negated else "") + (f"{folder}/**/{bare}" if anywhere else f"{folder}/{bare}")


def ignore_regex(pattern: str) -> tuple[re.Pattern, bool]:
    """(regular expression over a path from the root, negated) of one ignore pattern."""
    negated = pattern.startswith("!")
    body = pattern.removeprefix("!").rstrip()
    only_dirs = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    head = "^" if anchored else "^(?:.*/)?"
    return re.compile(head + out + ("/.*$" if only_dirs else "(?:/.*)?$")), negated


class IgnoreRules:
    """Ignore patterns in order; the last that matches decides."""

    def __init__(self, patterns: list[str]) -> None:
        self.rules = [ignore_regex(p) for p in patterns]

    def ignored(self, path: str) -> bool:
        verdict = False
        for rule, negated in self.rules:
            if rule.match(path):
                verdict = not negated
        return verdict


def walk(root: str) -> Iterator[tuple[str, list[str]]]:
    """Folders (relative, with slashes) and their file names, without ignored and hidden folders."""
    for at, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in V.IGNORED_DIRS and (not d.startswith(".") or d in V.ALLOWED_DOT_DIRS))
        relative = os.path.relpath(at, root).replace(os.sep, "/")
        yield "" if relative == "." else relative, sorted(names)


def load_rules(root: str) -> IgnoreRules:
    """The rules of all ignore files of a tree."""
    patterns = []
    for folder, names in walk(root):
        if ".gitignore" in names:
            for line in (Path(root) / folder / ".gitignore").read_text(encoding="utf-8", errors="ignore").splitlines():
                if line.strip() and not line.strip().startswith("#"):
                    patterns.append(scoped_pattern(line.strip(), folder))
    return IgnoreRules(patterns)


def takes(path: str, size: int, rules: IgnoreRules) -> bool:
    """Whether a file belongs to the corpus: one rule for full scans and for single changes."""
    name = path.rsplit("/", 1)[-1]
    if name in V.LOCK_FILES or size > V.MAX_FILE_SIZE:
        return False
    if name in V.FORCED_FILES:
        return True
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
    return suffix in V.EXTENSION_LANGUAGE and not rules.ignored(path)


class _Folder(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, files_per_partition: int) -> None:
        self.root, self.files_per_partition = root, files_per_partition

    def partitions(self) -> list[InputPartition]:
        rules = load_rules(self.root)
        paths = []
        for folder, names in walk(self.root):
            for name in names:
                path = f"{folder}/{name}" if folder else name
                try:
                    if takes(path, (Path(self.root) / path).stat().st_size, rules):
                        paths.append(path)
                except OSError:
                    continue
        return [_Folder(paths[i : i + self.files_per_partition]) for i in range(0, len(paths), self.files_per_partition)] or [_Folder([])]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for path in partition.paths:
            full = Path(self.root) / path
            try:
                data, stat = full.read_bytes(), full.stat()
            except OSError:
                continue
            yield path, hashlib.sha256(data).hexdigest(), float(stat.st_mtime), stat.st_size, data.decode("utf-8", "ignore")


class TreeSource(DataSource):
    """``spark.read.format("source_tree").load(root)``: (file_path, file_hash, mtime, size, code) of the files that belong to a corpus."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "file_path string, file_hash string, mtime double, size long, code string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("filesPerPartition", "512")))
