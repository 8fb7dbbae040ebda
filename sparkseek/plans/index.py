"""The stored index: chunks, vectors, edges, postings, lengths and fingerprints of a corpus, kept in step with its files.

A sync reads the listing of the files, compares fingerprints, and cuts, links, embeds and tokenises only what is new or changed; one
commit replaces all tables together, so a reader never sees some of them changed, and a sync that fails leaves the old version.

Defined cases
    null and blank files have no chunks and only a fingerprint; a file that lost all its chunks is cleared; files with equal text keep
    their chunks apart, as the path is part of a chunk's content address; a path listed twice counts once (the newest fingerprint); an
    empty listing empties the index; a chunk's id is a hash of its content address, so the same content has the same id in any sync.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions import columns as C
from sparkseek.operators import chunking, corpus, embedding, graph, retrieval
from sparkseek.operators.store import Snapshots
from sparkseek.session import cut, ensure_checkpoint_dir, release

#: The tables of an index and the column their rows are spread and sorted by.
SORTED_BY = {"chunks": "chunk_id", "vectors": "chunk_id", "edges": "callee_name", "postings": "term", "lengths": "id", "files": "file_path"}


def windows(files: DataFrame) -> DataFrame:
    """``chunk_files`` by line windows only, whatever the language."""
    rows = files.filter(C.text(F.col("code")).rlike(r"\S"))
    out = chunking.line_windows(rows, "file_path", "code")
    return out.select("file_path", C.language_of(F.col("file_path")).alias("language"), "symbol", "start_line", "end_line", "code", C.blob_hash(F.col("file_path"), F.col("code")).alias("blob_hash"))


def derived(chunks: DataFrame, embedder: embedding.Embedder | None) -> dict[str, DataFrame]:
    """What is stored besides the chunks themselves."""
    out = {"edges": chunking.call_edges(chunks), "postings": retrieval.stored_postings(chunks), "lengths": retrieval.lengths(chunks, "chunk_id", retrieval.FIELDS)}
    if embedder is not None:
        text = C.embed_text(F.col("file_path"), F.col("symbol"), F.col("language"), F.col("code"))
        out["vectors"] = embedding.embedded(chunks.select("chunk_id", "file_path", "symbol", "language", "code"), text, embedder).select("chunk_id", "embedding")
    return out


@dataclass
class Index:
    """An index directory, its embedder and its chunker (``(file_path, code)`` to chunks)."""

    store: Snapshots
    embedder: embedding.Embedder | None = field(default_factory=embedding.HashingEmbedder)
    chunker: Callable[[DataFrame], DataFrame] = chunking.chunk_files

    def sync(self, listing: DataFrame) -> dict[str, int]:
        """Brings the index in step with a whole listing (file_path, file_hash, mtime, size, code): what is missing from it is
        deleted, files whose time and size agree are not looked at, those whose hash agrees only get their new fingerprint."""
        stored = self._fingerprints(listing)
        known = corpus.latest_fingerprints(listing)
        status = cut(corpus.fingerprint_diff(known, stored))
        touched = known.join(status.filter("status in ('new', 'changed', 'touched')").select("file_path"), "file_path", "left_semi")
        return self._apply(listing, status.filter("status in ('new', 'changed')").select("file_path"), status.filter("status = 'deleted'").select("file_path"), touched)

    def sync_dirty(self, listing: DataFrame, dirty: DataFrame, deleted: DataFrame) -> dict[str, int]:
        """Brings only the given paths (file_path) in step: dirty ones that are listed and have another hash are cut again; deleted
        ones, and dirty ones that are no longer listed, are removed."""
        known = corpus.latest_fingerprints(listing.join(dirty.select("file_path").distinct(), "file_path", "left_semi"))
        old = self._fingerprints(listing).select("file_path", F.col("file_hash").alias("old_hash"))
        fresh = cut(known.join(old, "file_path", "left").filter(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("file_hash"))).drop("old_hash"))
        gone = cut(deleted.select("file_path").unionByName(dirty.select("file_path").join(known.select("file_path"), "file_path", "left_anti")).distinct())
        return self._apply(listing, fresh.select("file_path"), gone, fresh)

    def _fingerprints(self, like: DataFrame) -> DataFrame:
        stored = self.store.read("files")
        return like.sparkSession.createDataFrame([], "file_path string, file_hash string, mtime double, size long") if stored is None else stored

    def _apply(self, listing: DataFrame, changed: DataFrame, gone: DataFrame, fingerprints: DataFrame) -> dict[str, int]:
        texts = listing.join(changed, "file_path", "left_semi").groupBy("file_path").agg(F.max_by("code", F.struct(F.coalesce("mtime", F.lit(float("-inf"))), C.text(F.col("file_hash")))).alias("code"))
        made = self.chunker(texts)
        # written once, as five tables are made from it
        new = cut(made.select(F.xxhash64("blob_hash").alias("chunk_id"), "blob_hash", "file_path", "language", "symbol", "start_line", "end_line", "code").dropDuplicates(["chunk_id"]))
        old_chunks = self.store.read("chunks")
        replaced = changed.unionByName(gone).distinct()
        tables = {"chunks": new} | derived(new, self.embedder)
        if old_chunks is not None:
            removed = cut(old_chunks.select("chunk_id", "file_path").join(replaced, "file_path", "left_semi").select("chunk_id"))
            for name, key in {"chunks": "chunk_id", "edges": "caller_id", "postings": "id", "lengths": "id", "vectors": "chunk_id"}.items():
                rows = self.store.read(name)
                if name in tables and rows is not None:
                    kept = rows.join(removed, rows[key] == removed["chunk_id"], "left_anti")
                    tables[name] = kept.unionByName(tables[name].select(*kept.columns))
        files = self._fingerprints(listing).join(gone.select("file_path"), "file_path", "left_anti")
        tables["files"] = corpus.upsert_fingerprints(files, fingerprints)
        profile = {"dim": str(getattr(self.embedder, "dim", 0)), "embed_model": type(self.embedder).__name__ if self.embedder else ""}
        version = self.store.commit(tables, profile, {k: v for k, v in SORTED_BY.items() if k in tables})
        counts = corpus.stats(self.store.read("chunks")).first().asDict()
        return counts | {"changed": changed.count(), "deleted": gone.count(), "version": version}

    def apply_batch(self, listing: Callable[[], DataFrame]) -> Callable[[DataFrame, DataFrame], None]:
        """The function that ``streaming.changes.apply_changes`` gives each batch's dirty and deleted paths to."""
        return lambda dirty, deleted: self.sync_dirty(listing(), dirty, deleted) and None


_STORED: dict[tuple[str, str], Snapshots] = {}


def of_tables(spark: SparkSession, key: str, chunks: DataFrame, vectors: DataFrame, edges: DataFrame) -> Snapshots:
    """An index of tables that are already cut, linked and embedded, built once per session and ``key`` in the shared checkpoint
    folder, then read by every search. ``key`` names the tables' state; another one builds another index."""
    held = spark.sparkContext.applicationId, key
    if held not in _STORED:
        name = hashlib.blake2b(key.encode(), digest_size=12).hexdigest()
        store = Snapshots(spark, f"{ensure_checkpoint_dir(spark)}/index-{name}")
        after = lambda rows: (release(spark), rows)[1]  # noqa: E731  # the shuffle of the table before is not kept
        # texts are shuffled once, with the chunks; what is made from them stays where the stored chunks are read
        tables = {
            "chunks": chunks, "vectors": lambda _: after(vectors), "edges": lambda _: after(graph.usable_edges(edges)), "postings": lambda stored: after(retrieval.stored_postings(stored("chunks"))),
            "lengths": lambda stored: retrieval.lengths(stored("chunks"), "chunk_id", retrieval.FIELDS),
        }
        store.commit(tables, {}, {k: v for k, v in SORTED_BY.items() if k in tables}, ("postings", "lengths"))
        _STORED[held] = store
    return _STORED[held]
