"""Session helpers shared by every operator: table reads and lineage cuts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the one already set, else the one that ``spark.checkpoint.dir`` names.

    Only a session that runs on one machine (master ``local``) gets a folder of its own where none is named; on a cluster that would
    be a folder its executors do not share, so it is refused.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[[^,\]]*(,\s*\d+)?\])?$", sc.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkseek-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Shuffle files that no plan refers to any more leave the disks. Spark removes them when the driver collects its garbage, which it
    may not do for long; so this is for the end of steps that shuffle much."""
    spark._jvm.System.gc()


def _bytes(kind: DataType, c: Column) -> Column:
    """About the bytes that a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType)):
            return F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + _bytes(kind.elementType, x).cast("int")), F.lit(0)) + 8
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 8
    return F.lit(8)


def broadcast_if_small(df: DataFrame, most: int = 200_000, most_bytes: int = 32_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows and ``most_bytes``, which a count over no more than one row beyond
    that decides; otherwise as it is, so that the join shuffles. What is costly to make should be cut before."""
    size = sum((_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema), F.lit(0))
    rows, used = df.select(size.cast("long").alias("n")).limit(most + 1).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and used <= most_bytes else df
