"""Results as text: per file, in line order, without repeated lines, within line and character budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions import columns as C
from sparkseek.functions import vocabulary as V

R = V.RENDER
#: Labels of related chunks (fixed values).
RELATION = {"callee": "→ 被调用", "caller": "← 调用者"}


def clip_overlaps(rows: DataFrame, group: list[str]) -> DataFrame:
    """Chunks of a group in line order with ``first`` (first line still to show), ``skipped`` lines and ``gap`` (lines are missing
    before it), by a running maximum of the end lines before."""
    before = Window.partitionBy(*group).orderBy("start_line", "id").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.max("end_line").over(before)
    skipped = F.greatest(F.coalesce(shown - F.col("start_line") + 1, F.lit(0)), F.lit(0))
    return rows.withColumn("skipped", skipped).withColumn("first", F.col("start_line") + skipped).withColumn("gap", F.coalesce(F.col("start_line") > shown + 1, F.lit(False)))


def line_budgets(rows: DataFrame, group: list[str]) -> DataFrame:
    """``taken``: how many lines of each chunk fit into its file's budget after the chunks before it (``position`` of the file
    decides the budget, ``entity`` the chunk's own)."""
    file_budget = F.when(F.col("position") <= R["full_files"], R["file_lines"]).otherwise(R["file_lines_tail"])
    own = F.greatest(F.col("n_lines") - F.col("skipped"), F.lit(0))
    wish = F.least(own, F.when(F.col("entity"), R["entity_lines"]).otherwise(R["chunk_lines"]))
    before = Window.partitionBy(*group).orderBy("start_line", "id").rowsBetween(Window.unboundedPreceding, -1)
    # each chunk's wish is bounded, so what is left for a chunk is the budget less the wishes before it
    left = file_budget - F.coalesce(F.sum(wish).over(before), F.lit(0))
    return rows.withColumn("taken", F.greatest(F.least(wish, left), F.lit(0)))


def file_blocks(results: DataFrame) -> DataFrame:
    """``(qid, position, file_path, block)``: one block per file of the main results (qid, rank, id, file_path, language, symbol,
    start_line, end_line, code, score, entity); files stand in the order of their best rank."""
    main = results.filter(F.col("relation").isNull()) if "relation" in results.columns else results
    files = main.groupBy("qid", "file_path").agg(F.min("rank").alias("best_rank"), F.max("score").alias("best"))
    files = files.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("best_rank")))
    rows = main.join(files, ["qid", "file_path"]).withColumn("n_lines", F.size(F.split("code", "\n", -1)))
    group = ["qid", "file_path"]
    rows = line_budgets(clip_overlaps(rows, group), group)
    rest = F.array_join(F.slice(F.split("code", "\n", -1), F.col("skipped") + 1, F.greatest(F.col("n_lines") - F.col("skipped"), F.lit(0))), "\n")
    lines = F.when(F.col("taken") > 0, F.concat(F.when(F.col("gap"), F.array(F.lit("..."))).otherwise(F.array().cast("array<string>")), C.numbered_lines(rest, F.col("first"), F.col("taken")))).otherwise(F.array().cast("array<string>"))
    parts = rows.withColumn("lines", lines).groupBy("qid", "file_path", "position").agg(
        F.max("best").alias("best"),
        F.array_sort(F.collect_list(F.struct("start_line", "id", "symbol", "language", "lines"))).alias("parts"),
    )
    # a file has at most MAX_PER_FILE chunks per query, so these lists are short
    body = F.flatten(F.transform("parts", lambda p: p.lines))
    sizes = F.transform(body, lambda x: F.length(x) + 1)
    used = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x))
    kept = F.slice(body, F.lit(1), F.size(F.filter(used, lambda x: x <= R["file_chars"])))
    text = F.when(F.size(kept) < F.size(body), F.concat(kept, F.array(F.lit("... (file output budget reached)")))).otherwise(kept)
    symbols = F.array_join(F.array_distinct(F.filter(F.transform("parts", lambda p: p.symbol), lambda s: C.text(s) != "")), ", ")
    header = F.format_string("## %d. %s :: %s (score=%.3f)", F.col("position"), F.col("file_path"), symbols, F.col("best"))
    block = F.concat(header, F.lit("\n```"), C.text(F.col("parts")[0].language), F.lit("\n"), F.array_join(text, "\n"), F.lit("\n```"))
    return parts.select("qid", "position", "file_path", block.alias("block"))


def related_blocks(results: DataFrame) -> DataFrame:
    """``(qid, position, file_path, block)`` of the related results, behind the main ones."""
    label = F.create_map(*[F.lit(x) for pair in RELATION.items() for x in pair])[F.col("relation")]
    lines = F.array_join(C.numbered_lines(F.col("code"), F.col("start_line"), R["related_lines"]), "\n")
    header = F.concat(F.lit("## [关联 "), label, F.lit("] "), F.col("file_path"), F.lit(" :: "), C.text(F.col("symbol")), F.format_string(" (L%d-%d)", F.col("start_line"), F.col("end_line")))
    block = F.concat(header, F.lit("\n```"), C.text(F.col("language")), F.lit("\n"), lines, F.lit("\n```"))
    return results.filter(F.col("relation").isNotNull()).select("qid", (F.col("rank") + 1_000_000).alias("position"), "file_path", block.alias("block"))


def markdown(results: DataFrame) -> DataFrame:
    """``(qid, text)``: the whole answer of each query."""
    blocks = file_blocks(results).unionByName(related_blocks(results)) if "relation" in results.columns else file_blocks(results)
    ordered = F.array_sort(F.collect_list(F.struct("position", "file_path", "block")))
    return blocks.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda b: b.block), "\n\n").alias("text"))
