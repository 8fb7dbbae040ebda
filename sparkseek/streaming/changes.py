"""The change log as a stream: last operation per path, debounced bursts, flush by count, incremental application."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkseek.functions import vocabulary as V


def normal_op(op: Column) -> Column:
    """``deleted`` or ``dirty``: whatever is not a deletion makes a path dirty."""
    return F.when(F.lower(F.trim(op)) == "deleted", "deleted").otherwise("dirty")


def usable(changes: DataFrame) -> DataFrame:
    """Changes once each, with path and operation."""
    rows = changes.filter(F.col("file_path").isNotNull() & F.col("op").isNotNull())
    return rows.select("change_id", "file_path", normal_op(F.col("op")).alias("state"), F.col("seen_at").cast("timestamp").alias("seen_at")).dropDuplicates(["change_id", "file_path", "seen_at", "state"])


def last_state(changes: DataFrame) -> DataFrame:
    """``(file_path, state, changes)``: the operation seen last decides; partial aggregation bears a path with a third of the rows."""
    newest = F.max_by("state", F.struct("seen_at", "change_id"))
    return usable(changes).groupBy("file_path").agg(newest.alias("state"), F.count("*").alias("changes"))


def bursts(changes: DataFrame, seconds: int = V.DEBOUNCE_SECONDS) -> DataFrame:
    """``(repo, started, ended, changes)``: runs of changes of a repository without a pause of ``seconds``, as session windows."""
    rows = usable(changes).withColumn("repo", F.split("file_path", "/")[0])
    grouped = rows.groupBy("repo", F.session_window("seen_at", f"{seconds} seconds").alias("w")).agg(F.min("seen_at").alias("started"), F.max("seen_at").alias("ended"), F.count("*").alias("changes"))
    return grouped.select("repo", "started", "ended", "changes")


def stream_changes(spark, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """The change log of a directory as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def watermarked_bursts(stream: DataFrame, seconds: int = V.DEBOUNCE_SECONDS, late: str = "2 hours") -> DataFrame:
    """``bursts`` over a stream: changes may be ``late``; state of older bursts is dropped."""
    rows = stream.filter("file_path is not null and op is not null").withColumn("seen_at", F.col("seen_at").cast("timestamp")).withColumn("repo", F.split("file_path", "/")[0])
    grouped = rows.withWatermark("seen_at", late).groupBy("repo", F.session_window("seen_at", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("changes"))
    return grouped.select("repo", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes")


def count_flushes(stream: DataFrame, most: int = V.FLUSH_COUNT, key: str = "repo") -> DataFrame:
    """``(repo, flush, changes)``: a row whenever ``most`` changes of a key have gathered since its last flush; the count is kept
    as state, so batches of any size give the same flushes."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending, flushes = state.get if state.exists else (0, 0)
        out = []
        for pdf in batches:
            pending += len(pdf)
        while pending >= most:
            pending, flushes = pending - most, flushes + 1
            out.append((keys[0], flushes, most))
        state.update((pending, flushes))
        yield pd.DataFrame(out, columns=[key, "flush", "changes"])

    rows = stream.filter("file_path is not null and op is not null").select(F.split("file_path", "/")[0].alias(key), "change_id")
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} string, flush long, changes long", "pending long, flushes long", "append", "NoTimeout")


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch reduced to one state per path and given to ``apply(dirty paths, deleted paths)``. A batch that fails is
    given again, so no change is lost."""

    def each(batch: DataFrame, _: int) -> None:
        state = last_state(batch)
        state.persist()
        try:
            apply(state.filter("state = 'dirty'").select("file_path"), state.filter("state = 'deleted'").select("file_path"))
        finally:
            state.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
