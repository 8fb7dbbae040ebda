"""The search as one lazy plan: recall paths, fusion, hydration, rules, diversity, graph."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions import columns as C
from sparkseek.functions import vocabulary as V
from sparkseek.operators import embedding, graph, render, retrieval, scoring
from sparkseek.operators.store import Snapshots
from sparkseek.session import broadcast_if_small, cut


@dataclass(frozen=True)
class Options:
    """What a search may be asked for."""

    top_k: int = 100
    top_n: int = 10
    max_per_file: int = V.MAX_PER_FILE
    path_filter: str | None = None
    expand_graph: bool = True
    graph_limit: int = V.GRAPH_LIMIT
    #: Least score of a probe against its own half of a compound query.
    sub_least: float = V.SUB_LEAST["default"]


def intent_hits(queries: DataFrame, edges: DataFrame, stored: bool = False) -> DataFrame:
    """``(qid, id)``: callers of the identifiers that a who-calls query names."""
    asked = queries.filter(C.has_intent(F.col("query"), "caller"))
    names = asked.select("qid", F.explode(C.intent_symbols(F.col("query"))).alias("callee_name"))
    return graph.callers_of(edges, names, stored=stored).select("qid", "id").distinct()


def parsed_expansion(reply: Column) -> Column:
    """``(variants, hypothetical_code)`` of an expander's reply: the outermost JSON object, whatever stands around it, at most two
    variants; null where there is none."""
    body = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "variants array<string>, hypothetical_code string")
    return F.when(body.isNotNull() & (body["variants"].isNotNull() | body["hypothetical_code"].isNotNull()), F.struct(F.slice(F.coalesce(body["variants"], F.array().cast("array<string>")), 1, 2).alias("variants"), C.text(body["hypothetical_code"]).alias("hypothetical_code")))


@dataclass(frozen=True)
class Corpus:
    """What a search reads: tables of an index, or DataFrames made on the way. Without ``vectors`` nothing is searched by vector, without
    ``postings`` and ``lengths`` the words of the chunks are counted anew. ``stored`` says that each edge occurs once."""

    chunks: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    postings: DataFrame | None = None
    lengths: DataFrame | None = None
    stored: bool = False

    @staticmethod
    def of(store: Snapshots) -> Corpus:
        """The tables of the committed version."""
        version = store.version()
        return Corpus(*[store.read(t, version) for t in ("chunks", "edges", "vectors", "postings", "lengths")], stored=True)

    def words(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.bm25(self.chunks, queries, k, stored=None if self.postings is None else (self.postings, self.lengths))


def of_results(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """The chunks that are results (with an id), found where the chunks are read as far as the ids can be broadcast: other code is not
    shuffled. ``results`` should be cut before."""
    ids = results.select(F.col("id").alias("chunk_id")).distinct()
    return chunks.join(broadcast_if_small(ids, 1_000_000), "chunk_id", "left_semi")


class Expander(Protocol):
    """Rewrites a query: the reply is text that holds a JSON object (see ``parsed_expansion``), or None."""

    def expand(self, query: str) -> str | None: ...


def expansions(queries: DataFrame, expander: Expander, embedder: embedding.Embedder) -> DataFrame:
    """``(qid, variant, query, qvec)`` of the rewritten queries: variants 0 and 1 embedded as queries, the hypothetical code (2, without
    a query text) embedded as a document. A query whose expansion fails has none."""

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                return expander.expand(text)
            except Exception:  # an expansion is never needed
                return None

        return texts.map(one)

    replies = cut(queries.select("qid", parsed_expansion(ask(F.col("query"))).alias("e")).filter("e is not null"))
    variants = replies.select("qid", F.posexplode("e.variants").alias("variant", "query")).filter("query != ''")
    code = replies.filter("e.hypothetical_code != ''").select("qid", F.col("e.hypothetical_code").alias("code"))
    asked = embedding.embedded(variants, F.col("query"), embedder, "query", "qvec")
    made = embedding.embedded(code, F.col("code"), embedder, "document", "qvec").select("qid", F.lit(2).alias("variant"), F.lit(None).cast("string").alias("query"), "qvec")
    return asked.unionByName(made)


def halves_of(queries: DataFrame, embedder: embedding.Embedder | None = None) -> DataFrame:
    """``(qid, sub, query[, qvec])``: the two halves of each compound query."""
    halves = queries.select("qid", F.posexplode(C.compound_parts(F.col("query"))).alias("sub", "query"))
    return halves if embedder is None else embedding.embedded(halves, F.col("query"), embedder, "query", "qvec")


def recall(corpus: Corpus, queries: DataFrame, k: int, variants: DataFrame | None = None, halves: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(fused candidates, probes) of ``queries`` (qid, query[, qvec]): nearest vectors, words, and substrings where the query has Han
    signs. With ``variants`` (see ``expansions``) the own lists weigh twice; a variant has a vector and a word list, hypothetical code a
    vector list only. Each half of a compound query (see ``halves_of``) adds a vector list and one list of substrings or words, with
    less weight; the first ten of the half's own lists are its probes (qid, sub, id)."""
    base = V.WEIGHTS["base_expanded"] if variants is not None else V.WEIGHTS["base"]
    near = lambda asked: retrieval.knn(corpus.vectors, asked, k).select("qid", "id", "rank")
    words = lambda asked: corpus.words(asked.select("qid", "query"), k).select("qid", "id", "rank")
    parts = lambda asked: retrieval.substring_bm25(corpus.chunks, asked.select("qid", "query"), k).select("qid", "id", "rank")
    by_vector = lambda asked: corpus.vectors is not None and "qvec" in asked.columns
    han = F.col("query").rlike(V.CJK)
    paths = [(near(queries), base)] if by_vector(queries) else []
    paths.append((words(queries), base))
    if variants is not None:
        for number in (0, 1):
            own = variants.filter(F.col("variant") == number)
            paths += [(near(own), V.WEIGHTS["variant"]), (words(own), V.WEIGHTS["variant"])]
        paths.append((near(variants.filter("variant = 2")), V.WEIGHTS["variant"]))
    asked_han = queries.filter(han)
    if not asked_han.isEmpty():
        paths.append((parts(asked_han), base))
    probes = None
    halves = halves_of(queries) if halves is None else halves
    if not halves.isEmpty():
        halves = cut(halves)
        for sub in (0, 1):
            own = halves.filter(F.col("sub") == sub)
            lists = [(near(own), V.WEIGHTS["sub"])] if by_vector(own) else []
            text = words(own.filter(~han))
            own_han = own.filter(han)
            lists.append((text if own_han.isEmpty() else text.unionByName(parts(own_han)), V.WEIGHTS["sub"]))
            lists = [(cut(rows), weight) for rows, weight in lists]  # fused twice
            paths += lists
            own_probes = retrieval.fuse([(rows, 1.0) for rows, _ in lists], V.PROBES).select("qid", F.lit(sub).alias("sub"), "id")
            probes = own_probes if probes is None else probes.unionByName(own_probes)
    return retrieval.fuse(paths), probes


def reranked(candidates: DataFrame, rerank: embedding.Rerank, top_n: int, probes: DataFrame | None, halves: DataFrame, least: float) -> DataFrame:
    """Candidates (qid, id, query, file_path, symbol, code, score, ord) with the scores of a reranker. A query keeps its first
    max(3 top_n, 20) by these; its probes stay with 0 even where they fall out; then the probes' scores against their own half are
    mixed in. Where the reranker fails (null) the fused scores stay."""
    text = C.rerank_text(F.col("file_path"), F.col("symbol"), F.col("code"))
    scored = rerank(candidates.withColumn("text", text), "query", "text", "new").drop("text")
    failed = F.max(F.col("new").isNull()).over(Window.partitionBy("qid"))
    scored = scored.withColumn("failed", failed).withColumn("new", F.when(F.col("failed"), F.col("score")).otherwise(F.col("new")))
    scored = scored.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("new"), "ord")))
    kept = F.col("failed") | (F.col("place") <= max(3 * top_n, 20))
    if probes is None:
        return scored.filter(kept).withColumn("score", F.col("new")).drop("new", "failed", "place").withColumn("sub_score", F.lit(None).cast("double"))
    own = probes.select("qid", "id").distinct().withColumn("probe", F.lit(True))
    scored = scored.join(own, ["qid", "id"], "left").filter(kept | F.col("probe"))
    scored = cut(scored.withColumn("score", F.when(kept, F.col("new")).otherwise(0.0)).drop("new", "failed", "place", "probe"))
    pairs = probes.join(scored.drop("query"), ["qid", "id"]).join(halves.select("qid", "sub", "query"), ["qid", "sub"])
    subs = rerank(pairs.withColumn("text", text), "query", "text", "s").select("qid", "sub", "id", "s").filter("s is not null")
    return scoring.mix_subquery_scores(scored, subs, least)


def search(corpus: Corpus, queries: DataFrame, options: Options = Options(), variants: DataFrame | None = None, halves: DataFrame | None = None, rerank: embedding.Rerank | None = None) -> DataFrame:
    """``(qid, rank, id, file_path, language, symbol, start_line, end_line, code, score, entity, relation)`` for every query (qid,
    query[, qvec]). Code joins only the results; candidates carry what the rules need of it."""
    chunks = corpus.chunks
    small = scoring.traits(chunks).select("chunk_id", "file_path", "language", "symbol", "start_line", "end_line", "declares", "entity", "n_lines")
    halves = cut(halves_of(queries) if halves is None else halves)
    fused, probes = recall(corpus, queries, options.top_k, variants, halves)
    fused = cut(fused)  # read three times below
    candidates = fused.filter(F.col("rank") <= options.top_k).select("qid", "id", "score", F.col("rank").alias("ord"))
    hydrated = lambda rows: rows.join(chunks, rows["id"] == chunks["chunk_id"]).join(queries.select("qid", "query"), "qid")
    if rerank is not None:
        probes = probes if probes is None else cut(probes)
        candidates = cut(reranked(hydrated(candidates), rerank, options.top_n, probes, halves, options.sub_least).select("qid", "id", "score", "ord", "sub_score"))
    if not queries.filter(C.has_intent(F.col("query"), "caller")).isEmpty():
        candidates = scoring.inject(candidates, intent_hits(queries, corpus.edges, corpus.stored))
    narrow = candidates.join(small, candidates["id"] == small["chunk_id"]).join(queries.select("qid", "query"), "qid")
    scored = scoring.pair_implementations(scoring.score(narrow.withColumn("rank", F.col("ord"))).drop("query"))
    results = scoring.diversify(scored, options.top_n, options.max_per_file, options.path_filter)
    if rerank is not None and probes is not None:
        allowed = scored.filter(C.path_matches(F.col("file_path"), options.path_filter)) if options.path_filter else scored
        allowed = cut(allowed.select("qid", "id", "file_path", "score", "sub_score"))
        found = probes.join(chunks.select(F.col("chunk_id").alias("id"), "file_path"), "id")
        kept = scoring.rescue(cut(results.select("qid", "id", "file_path", "score")), allowed, cut(found), options.top_n, options.sub_least)
        results = scored.drop("rank").join(kept.select("qid", "id", "rank"), ["qid", "id"])
    columns = ["qid", "rank", "id", "file_path", "language", "symbol", "start_line", "end_line", "code", "score"]
    results = cut(results.select("qid", "rank", "id", "score"))
    # few chunks are results where few queries are asked
    shown = chunks.join(broadcast_if_small(results.select(F.col("id").alias("chunk_id")).distinct()), "chunk_id", "left_semi")
    entity = C.is_entity(F.col("code"), F.col("language"))
    main = results.join(shown, results["id"] == shown["chunk_id"]).select(*columns, entity.alias("entity"), F.lit(None).cast("string").alias("relation"))
    if not options.expand_graph:
        return main
    main = cut(main)  # a few rows a query
    found = graph.related(chunks, corpus.edges, main.select("qid", "id"), fused, options.graph_limit, corpus.stored, main.select("qid", "symbol", "language", "code"))
    near = found.join(chunks, found["id"] == chunks["chunk_id"]).withColumn("score", F.lit(0.0)).withColumn("rank", F.col("rank") + options.top_n)
    return main.unionByName(near.select(*columns, F.lit(True).alias("entity"), "relation"))


def answers(found: DataFrame) -> DataFrame:
    """``(qid, text)``: the results of ``search`` as one text a query, files first, related chunks behind them."""
    return render.markdown(found)
