"""The chunk store as DataFrames: cleaning, content-addressed insert, cascade delete, replacement, fingerprints, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.functions import columns as C
from sparkseek.functions import vocabulary as V


def keep_first(chunks: DataFrame) -> DataFrame:
    """The chunks an insert-ignore on ``blob_hash`` keeps: of each content the smallest id.

    Only (hash, id) pairs are aggregated, partially before the shuffle; code moves once, by id.
    """
    kept = chunks.groupBy("blob_hash").agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id")
    return chunks.join(kept, "chunk_id", "left_semi").dropDuplicates(["chunk_id"])


def clean(chunks: DataFrame) -> DataFrame:
    """Stored chunks: first of each content, language by extension, empty symbol for none, a computed end line for none."""
    lines = F.size(F.split(C.text(F.col("code")), "\n", -1))
    start = F.coalesce(F.col("start_line"), F.lit(1))
    return keep_first(chunks).select(
        "chunk_id", "blob_hash", "file_path", C.language_of(F.col("file_path")).alias("language"), C.text(F.col("symbol")).alias("symbol"),
        start.alias("start_line"), F.coalesce(F.col("end_line"), start + lines - 1).alias("end_line"), C.text(F.col("code")).alias("code"),
    )


def insert_ignore(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored chunks and those new ones whose content is not there yet."""
    fresh = keep_first(new).join(stored.select("blob_hash"), "blob_hash", "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def delete_files(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """``rows`` (with a file_path) without those of the given paths."""
    return rows.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def cascade_delete(chunks: DataFrame, dependents: dict[str, tuple[DataFrame, str]], paths: DataFrame) -> dict[str, DataFrame]:
    """Chunks without the given paths, and every dependent table (name -> (rows, id column)) without the ids that are gone."""
    gone = chunks.join(paths.select("file_path").distinct(), "file_path", "left_semi").select(F.col("chunk_id").alias("_gone")).distinct()
    out = {"chunks": delete_files(chunks, paths)}
    for name, (rows, key) in dependents.items():
        out[name] = rows.join(gone, rows[key] == gone["_gone"], "left_anti")
    return out


def replace_files(chunks: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """All chunks of ``paths`` replaced by those of ``new``; a path without new chunks is cleared."""
    return insert_ignore(delete_files(chunks, paths), new)


def latest_fingerprints(files: DataFrame) -> DataFrame:
    """One fingerprint per path: the newest by mtime, then by hash and size."""
    newest = F.max(F.struct(F.coalesce("mtime", F.lit(float("-inf"))).alias("m"), C.text(F.col("file_hash")).alias("h"), F.coalesce("size", F.lit(-1)).alias("s")))
    own = files.filter(F.col("file_path").isNotNull()).groupBy("file_path").agg(newest.alias("f"))
    return own.select("file_path", F.col("f.h").alias("file_hash"), F.when(F.col("f.m") != float("-inf"), F.col("f.m")).alias("mtime"), F.when(F.col("f.s") >= 0, F.col("f.s")).alias("size"))


def oldest_fingerprints(files: DataFrame) -> DataFrame:
    """One fingerprint per path: the oldest by mtime, then by hash and size."""
    oldest = F.min(F.struct(F.coalesce("mtime", F.lit(float("-inf"))).alias("m"), C.text(F.col("file_hash")).alias("h"), F.coalesce("size", F.lit(-1)).alias("s")))
    own = files.filter(F.col("file_path").isNotNull()).groupBy("file_path").agg(oldest.alias("f"))
    return own.select("file_path", F.col("f.h").alias("file_hash"), F.when(F.col("f.m") != float("-inf"), F.col("f.m")).alias("mtime"), F.when(F.col("f.s") >= 0, F.col("f.s")).alias("size"))


def upsert_fingerprints(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored fingerprints, those of ``new`` in place of older ones of the same path."""
    return stored.join(new.select("file_path"), "file_path", "left_anti").unionByName(new.select(*stored.columns))


def fingerprint_diff(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """``(file_path, status)`` of a current listing against stored fingerprints, by one full outer join: ``new``, ``deleted``,
    ``same`` (mtime and size agree, nothing is hashed), ``touched`` (only the hash agrees) or ``changed``."""
    a, b = listing.alias("a"), stored.alias("b")
    joined = a.join(b, F.col("a.file_path") == F.col("b.file_path"), "full_outer")
    status = (
        F.when(F.col("b.file_path").isNull(), "new")
        .when(F.col("a.file_path").isNull(), "deleted")
        .when(F.col("a.mtime").eqNullSafe(F.col("b.mtime")) & F.col("a.size").eqNullSafe(F.col("b.size")), "same")
        .when((F.col("a.file_hash") == F.col("b.file_hash")) & (F.col("a.file_hash") != ""), "touched")
        .otherwise("changed")
    )
    return joined.select(F.coalesce("a.file_path", "b.file_path").alias("file_path"), status.alias("status"))


def admitted(files: DataFrame) -> DataFrame:
    """``files`` with ``admitted``: not a lock file, of a known extension or forced, of allowed directories, not too large."""
    name = C.basename(F.col("file_path"))
    forced = name.isin(*V.FORCED_FILES)
    known = C.extension(F.col("file_path")).isin(*V.EXTENSION_LANGUAGE)
    folders = F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))
    pruned = F.exists(folders, lambda d: d.isin(*V.IGNORED_DIRS) | (F.startswith(d, F.lit(".")) & ~d.isin(*V.ALLOWED_DOT_DIRS)))
    small = F.coalesce(F.col("size"), F.lit(0)) <= V.MAX_FILE_SIZE
    return files.withColumn("admitted", ~name.isin(*V.LOCK_FILES) & (forced | known) & ~pruned & small)


def whole_files(chunks: DataFrame) -> DataFrame:
    """``(file_path, code)``: each file's lines once each, in order of file line; of overlapping pieces the earliest one's line is
    taken. Lines are reduced by (file, line) before a file is put together, so repeated pieces move once."""
    rows = chunks.filter(F.col("file_path").isNotNull() & F.col("code").isNotNull()).select("file_path", F.coalesce("start_line", F.lit(1)).alias("start_line"), "code")
    lines = rows.select("file_path", "start_line", F.posexplode(F.split("code", "\n", -1)).alias("i", "line"))
    once = lines.groupBy("file_path", (F.col("start_line") + F.col("i")).alias("at")).agg(F.min(F.struct("start_line", "line")).alias("first"))
    own = once.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("at", F.col("first.line").alias("line")))).alias("lines"))
    return own.select("file_path", F.array_join(F.transform("lines", lambda x: x.line), "\n").alias("code"))


def stats(chunks: DataFrame) -> DataFrame:
    """Numbers of stored chunks, files and symbols."""
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.countDistinct(F.when(F.col("symbol") != "", F.col("symbol"))).alias("symbols"))
