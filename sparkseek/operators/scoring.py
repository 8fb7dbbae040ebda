"""Score rules over candidates (qid, query, id, file_path, language, symbol, start_line, end_line, code, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions import columns as C
from sparkseek.functions import vocabulary as V

X = V.FACTORS


def name_boost(query: Column, symbol: Column, path: Column) -> Column:
    """1.5 if the query names the symbol, else 1 and a tenth for each of up to three shared parts of symbol and file name."""
    parts, asked = C.ident_parts(symbol), C.query_tokens(query)
    flat = F.array_join(parts, "")
    shared = F.size(F.array_intersect(F.array_union(parts, C.ident_parts(C.file_stem(path))), asked))
    boost = F.lit(1.0) + X["name_part"] * F.least(shared, F.lit(V.NAME_PARTS_MOST))
    return F.when(F.size(asked) == 0, 1.0).when((flat != "") & F.array_contains(asked, flat), X["exact_name"]).otherwise(boost)


def traits(chunks: DataFrame) -> DataFrame:
    """``chunks`` with what the rules need of their code: ``declares``, ``entity`` and ``n_lines``."""
    code, lang = F.col("code"), F.col("language")
    return chunks.withColumn("declares", C.is_declaration(code, lang)).withColumn("entity", C.is_entity(code, lang)).withColumn("n_lines", F.size(F.split(C.text(code), "\n", -1)))


def declaration_factor(query: Column, declares: Column) -> Column:
    """The part of the rules that an implementation takes back when it follows its interface."""
    impl = F.when(C.has_intent(query, "impl"), X["declaration"] * X["impl_extra"]).otherwise(X["declaration"])
    return F.when(~C.has_intent(query, "decl") & declares, impl).otherwise(1.0)


def intent_factor(query: Column, path: Column, language: Column, symbol: Column, declares: Column, is_entity: Column, lines: Column) -> Column:
    """The product of all rules for one candidate, the declaration rule included."""
    test = F.when(C.is_test_file(path), F.when(C.has_intent(query, "test"), X["test_wanted"]).otherwise(X["test"])).otherwise(1.0)
    barrel = F.when(C.is_barrel_file(path), X["barrel"]).otherwise(1.0)
    config = C.has_intent(query, "config") & language.isin(*V.CONFIG_LANGUAGES)
    non_code = F.when(language.isin(*V.NON_CODE), F.when(C.has_intent(query, "doc"), X["doc_wanted"]).when(config, X["config_wanted"]).otherwise(X["non_code"])).otherwise(1.0)
    entity = F.when(
        ~C.has_intent(query, "decl") & ~declares & is_entity,
        F.when(C.has_intent(query, "impl"), X["entity"] * X["impl_extra"]).otherwise(X["entity"]),
    ).otherwise(1.0)
    tiny = F.when(lines <= V.TINY_LINES, X["tiny"]).otherwise(1.0)
    return test * barrel * non_code * declaration_factor(query, declares) * entity * tiny * name_boost(query, symbol, path)


def score(candidates: DataFrame) -> DataFrame:
    """Candidates with ``decl_mult`` and their score times all rules; one projection, no shuffle. Candidates without code carry the
    ``traits`` of their chunks."""
    rows = candidates if "declares" in candidates.columns else traits(candidates)
    q, p, lang, s, declares, entity, lines = (F.col(c) for c in ("query", "file_path", "language", "symbol", "declares", "entity", "n_lines"))
    rows = rows.withColumn("decl_mult", declaration_factor(q, declares)).withColumn("score", F.col("score") * intent_factor(q, p, lang, s, declares, entity, lines))
    return rows.select(*candidates.columns, "decl_mult")


def pair_implementations(scored: DataFrame) -> DataFrame:
    """Where a query's candidates hold file stems X and XImpl, the best chunk of XImpl rises just above the undecayed best of X."""
    rows = scored.withColumn("stem", C.file_stem(F.col("file_path"))).withColumn("_ord", F.coalesce(F.col("rank"), F.lit(0)))
    best = rows.groupBy("qid", "stem").agg(F.max(F.col("score") / F.col("decl_mult")).alias("base"), F.max_by("id", F.struct("score", -F.col("_ord"), -F.col("id"))).alias("best_id"))
    impl = best.filter(F.col("stem").rlike(".Impl$")).select("qid", F.regexp_replace("stem", "Impl$", "").alias("stem"), F.col("best_id").alias("impl_id"))
    lift = impl.join(best.select("qid", "stem", "base"), ["qid", "stem"]).groupBy("qid", F.col("impl_id").alias("id")).agg(F.max("base").alias("base"))
    out = rows.drop("stem", "_ord").join(lift, ["qid", "id"], "left")
    return out.withColumn("score", F.when(F.col("base") > F.col("score"), F.col("base") * X["pair"]).otherwise(F.col("score"))).drop("base")


def diversify(scored: DataFrame, top_n: int, per_file: int = V.MAX_PER_FILE, path_filter: str | None = None) -> DataFrame:
    """The first ``top_n`` of each query after the path filter, at most ``per_file`` of a file (any number for 0 or less). Equal scores
    keep the order ``ord`` of the candidates, where they have one, and then that of their ids."""
    rows = scored.filter(C.path_matches(F.col("file_path"), path_filter)) if path_filter else scored
    order = [F.desc("score"), *([F.col("ord")] if "ord" in rows.columns else []), F.col("id")]
    if per_file > 0:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "file_path").orderBy(*order))).filter(F.col("_n") <= per_file).drop("_n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= top_n)


def inject(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Structured hits (qid, id) get the fixed top score; those that are no candidates yet are added, behind all others in ``ord``."""
    carried = [c for c in candidates.columns if c not in ("qid", "id", "score")]
    a, b = candidates.select("qid", "id", "score", *carried), hits.select("qid", "id").distinct().withColumn("hit", F.lit(True))
    out = a.join(b, ["qid", "id"], "full_outer").select("qid", "id", F.when(F.col("hit"), F.lit(V.INTENT_SCORE)).otherwise(F.col("score")).alias("score"), *carried)
    return out.withColumn("ord", F.coalesce("ord", F.lit(2**31 - 1))) if "ord" in carried else out


def mix_subquery_scores(candidates: DataFrame, sub_scores: DataFrame, least: float) -> DataFrame:
    """Scores raised by sub-query scores (qid, sub, id, s): top * s / best s of the sub-query * 0.95 where s is enough; ``sub_score``
    is the best s of a candidate."""
    top = candidates.groupBy("qid").agg(F.max("score").alias("top"))
    best = sub_scores.groupBy("qid", "sub").agg(F.max("s").alias("best"))
    usable = sub_scores.join(best, ["qid", "sub"]).join(top, "qid").filter((F.col("s") >= least) & (F.col("best") > 0))
    raised = usable.groupBy("qid", "id").agg(F.max(F.col("top") * F.col("s") / F.col("best") * X["sub_mix"]).alias("raised"), F.max("s").alias("sub_score"))
    return candidates.join(raised, ["qid", "id"], "left").withColumn("score", F.greatest("score", "raised")).drop("raised")


def rescue(results: DataFrame, candidates: DataFrame, probes: DataFrame, top_n: int, least: float, subs: int = 2) -> DataFrame:
    """For each sub-query whose probes' files (qid, sub, id, file_path) no result holds: the best of its probes that are candidates (qid,
    id, file_path, score, sub_score) is added, in place of the lowest result that was not rescued if there are already ``top_n``. Sub-queries follow one
    another, as each rescue changes what is held."""
    cols = ["qid", "id", "file_path", "score"]
    current = results.select(*cols).withColumn("rescued", F.lit(False))
    for sub in range(subs):
        asked = probes.filter(F.col("sub") == sub)
        own = asked.select("qid", "file_path").distinct()
        held = own.join(current.select("qid", "file_path").distinct(), ["qid", "file_path"], "left_semi").select("qid").distinct()
        missing = own.select("qid").distinct().join(held, "qid", "left_anti")
        pool = candidates.filter(F.col("sub_score") >= least).join(asked.select("qid", "id").distinct(), ["qid", "id"], "left_semi").join(missing, "qid", "left_semi")
        pool = pool.join(current.select("qid", "id"), ["qid", "id"], "left_anti")
        best = pool.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sub_score"), "id"))).filter("_n = 1")
        best = best.select(*cols).withColumn("rescued", F.lit(True))
        counted = current.withColumn("_all", F.count("*").over(Window.partitionBy("qid"))).withColumn("_low", F.row_number().over(Window.partitionBy("qid", "rescued").orderBy("score", F.desc("id"))))
        full = counted.join(best.select(F.col("qid").alias("_q")), F.col("qid") == F.col("_q"), "left")
        kept = full.filter(~(F.col("_q").isNotNull() & (F.col("_all") >= top_n) & ~F.col("rescued") & (F.col("_low") == 1))).select(*cols, "rescued")
        current = kept.unionByName(best)
    return current.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
