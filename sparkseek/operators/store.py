"""Versioned snapshots of the index: each version is written whole, then one commit file that is never changed is created for it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_FORMAT = "1"


class ProfileMismatch(ValueError):
    """The index was built with another model, dimension, number type or format."""


class Snapshots:
    """The datasets of one index directory, on any file system Spark can write to. Readers take the highest commit file."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._claimed: dict[str, str] = {}
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read_text(self, name: str) -> str | None:
        if not self._fs.exists(self._path(f"{self.root}/{name}")):
            return None
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        """A new file; creating one that exists fails, so of two writers of one name only one succeeds."""
        out = self._fs.create(self._path(f"{self.root}/{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()

    def version(self) -> int:
        """The highest committed version; 0 for an empty index. Commit files are never changed, deleted or renamed."""
        folder = self._path(f"{self.root}/commits")
        # a file that is still being written is empty
        names = [f.getPath().getName() for f in self._fs.listStatus(folder) if f.getLen()] if self._fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def profile(self) -> dict[str, str]:
        """The profile of the committed version."""
        version = self.version()
        return json.loads(self._read_text(f"commits/{version}") or "{}").get("profile", {}) if version else {}

    def check_profile(self, profile: dict[str, str]) -> dict[str, str]:
        """The profile that the next commit carries. An index that has rows refuses another one; an empty model name is not compared."""
        wanted = {"index_format": INDEX_FORMAT} | {k: str(v) for k, v in profile.items()}
        stored = self.profile()
        for key, value in stored.items():
            if key in wanted and wanted[key] != value and not (key == "embed_model" and not wanted[key]):
                raise ProfileMismatch(f"{key}: the index has {value!r}, not {wanted[key]!r}")
        self._claimed = stored | self._claimed | wanted
        return self._claimed

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of the committed (or the given) version; None if it has none of the name."""
        commit = self._commit(self.version() if version is None else version)
        return self.spark.read.parquet(f"{self.root}/{commit['folder']}/{name}") if name in commit.get("tables", ()) else None

    def _commit(self, version: int) -> dict:
        return json.loads(self._read_text(f"commits/{version}") or "{}") if version else {}

    def commit(self, tables: dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]], profile: dict[str, str] | None = None, sorted_by: dict[str, str] | None = None, in_place: tuple[str, ...] = ()) -> int:
        """A new version of all tables: they are written to a folder of their own, then one commit file is created under the next
        number. Readers see the old version or the new one, never a part; a writer that was overtaken fails and changes nothing.
        ``sorted_by``: a table's column that its rows are spread and sorted by, so that a filter on it reads few row groups; those named
        ``in_place`` are sorted where they are, without a shuffle. A function makes its table from those written before it, which it
        gets by name."""
        version = self.version() + 1
        carried = self.check_profile(profile or {})
        folder = f"data/{version}-{uuid.uuid4().hex}"
        try:
            for name, made in tables.items():
                rows = made(lambda t: self.spark.read.parquet(f"{self.root}/{folder}/{t}")) if callable(made) else made
                column = (sorted_by or {}).get(name)
                spread = rows.repartition(F.col(column)) if column and name not in in_place else rows
                (spread.sortWithinPartitions(column) if column else spread).write.option("compression", "zstd").parquet(f"{self.root}/{folder}/{name}")
            self._write_text(f"commits/{version}", json.dumps({"folder": folder, "tables": sorted(tables), "profile": carried}))
        except Exception:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise
        return version
