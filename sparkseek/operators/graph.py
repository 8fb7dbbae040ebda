"""One hop along call edges, whose targets are names: fan-out limits, hot names, callers, callees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions import columns as C
from sparkseek.functions import vocabulary as V
from sparkseek.session import cut


def usable_edges(edges: DataFrame) -> DataFrame:
    """Each (caller, name) once, without empty names."""
    return edges.filter(F.col("caller_id").isNotNull() & (C.text(F.col("callee_name")) != "")).select("caller_id", "callee_name").distinct()


def hot_names(edges: DataFrame, most: int = V.HOT_CALLERS) -> DataFrame:
    """``(callee_name, callers)`` of the names that more than ``most`` different chunks call. Exact, counted in two steps, so a
    name with a third of all rows is spread over the tasks."""
    return usable_edges(edges).groupBy("callee_name").agg(F.count("*").alias("callers")).filter(F.col("callers") > most)


def symbol_fanout(chunks: DataFrame, most: int = V.MAX_FANOUT) -> DataFrame:
    """``(symbol, definitions, resolvable)``: how many chunks define a symbol, and whether a call to it can be resolved."""
    counted = chunks.filter(C.text(F.col("symbol")) != "").groupBy("symbol").agg(F.count("*").alias("definitions"))
    return counted.withColumn("resolvable", F.col("definitions") <= most)


def callers_of(edges: DataFrame, names: DataFrame, limit: int = V.CALLERS_LIMIT, stored: bool = False) -> DataFrame:
    """``(qid, callee_name, id, n)``: the first ``limit`` callers of each name (qid, callee_name), by id."""
    found = (edges if stored else usable_edges(edges)).join(names.select("qid", "callee_name").distinct(), "callee_name").select("qid", "callee_name", F.col("caller_id").alias("id"))
    order = Window.partitionBy("qid", "callee_name").orderBy("id")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)


def related(chunks: DataFrame, edges: DataFrame, origins: DataFrame, fused: DataFrame, limit: int = V.GRAPH_LIMIT, stored: bool = False, own: DataFrame | None = None) -> DataFrame:
    """``(qid, id, relation, rank)``: the chunks one call away from each query's origins (qid, id), at most ``limit``.

    Callees are resolved by symbol unless the name is an accessor, hot, or defined too often; callers are those of the origins'
    symbols and declared names. What is an origin, or already a callee, is not added again; equal content counts once; the order
    is by fused score, callers first. Only edges and symbols of the names in question are counted. ``stored``: the edges are those of
    an index, each once. ``own``: the origins' (qid, symbol, language, code), where they are at hand.
    """
    calls = edges if stored else usable_edges(edges)
    origin_rows = origins.select("qid", "id").distinct()
    called = calls.join(origin_rows, calls["caller_id"] == origin_rows["id"]).select("qid", "callee_name").distinct()
    own = chunks.join(origin_rows, chunks["chunk_id"] == origin_rows["id"]).select("qid", "symbol", "language", "code") if own is None else own
    names = own.select("qid", F.explode(F.array_union(F.array("symbol"), C.declared_names(F.col("code"), F.col("language")))).alias("callee_name")).filter("callee_name != ''").distinct()
    # (qid, name, way) of the names in question, read by each step below
    asked = cut(called.withColumn("way", F.lit("callee")).unionByName(names.withColumn("way", F.lit("caller"))).filter(~C.is_boilerplate(F.col("callee_name"))))
    wanted = asked.select("callee_name").distinct()
    hot = calls.join(wanted, "callee_name", "left_semi").groupBy("callee_name").agg(F.count("*").alias("callers")).filter(F.col("callers") > V.HOT_CALLERS).select("callee_name")
    cold = asked.join(hot, "callee_name", "left_anti")
    places = chunks.select(F.col("symbol").alias("callee_name"), F.col("chunk_id").alias("id")).join(wanted, "callee_name", "left_semi")
    resolvable = places.groupBy("callee_name").agg(F.count("*").alias("n")).filter(F.col("n") <= V.MAX_FANOUT).select("callee_name")
    callees = cold.filter("way = 'callee'").join(resolvable, "callee_name", "left_semi").join(places, "callee_name").select("qid", "id").distinct()
    callees = callees.join(origin_rows, ["qid", "id"], "left_anti").withColumn("relation", F.lit("callee"))
    callers = calls.join(cold.filter("way = 'caller'"), "callee_name").select("qid", F.col("caller_id").alias("id")).distinct()
    callers = callers.join(origin_rows, ["qid", "id"], "left_anti").join(callees, ["qid", "id"], "left_anti").withColumn("relation", F.lit("caller"))
    found = callees.unionByName(callers)
    wide = limit * 3
    first = Window.partitionBy("qid").orderBy((F.col("relation") == "caller").cast("int"), "id")
    found = found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= wide * 3)
    keyed = found.join(chunks.select(F.col("chunk_id").alias("id"), "symbol", F.substring("code", 1, 200).alias("head")), "id")
    same = Window.partitionBy("qid", "symbol", "head").orderBy("n")
    kept = keyed.withColumn("copy", F.row_number().over(same)).filter("copy = 1").withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("n"))).filter(F.col("n") <= wide)
    ranked = kept.join(fused.select("qid", "id", F.col("score").alias("fused")), ["qid", "id"], "left")
    order = Window.partitionBy("qid").orderBy(F.desc(F.coalesce("fused", F.lit(0.0))), F.desc((F.col("relation") == "caller").cast("int")), "n")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("qid", "id", "relation", "rank")


def content_once(chunks: DataFrame) -> DataFrame:
    """Of chunks with one symbol and the same first 200 signs, the smallest id. Ids are aggregated, code is only hashed."""
    key = F.sha2(F.concat(C.text(F.col("symbol")), F.lit("\x00"), F.substring("code", 1, 200)), 256)
    return chunks.groupBy(key.alias("content")).agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("copies")).select("chunk_id", "copies")
