"""The registered queries of the engine's own operators and the equal SQL.

Every query reads the whole tables of a data directory. Searches take as queries every row whose id is divisible by 50, against
all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions import columns as C
from sparkseek.functions import vocabulary as V
from sparkseek.operators import chunking, corpus, embedding, evaluation, graph, render, retrieval, scoring
from sparkseek.operators.store import Snapshots
from sparkseek.plans import index
from sparkseek.plans import search as plans
from sparkseek.session import cut, ensure_checkpoint_dir, table
from sparkseek.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]

K = 20


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return corpus.clean(table(s, d, "chunks"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    """Usable vectors, one per chunk: 64 finite numbers, not all zero."""
    rows = table(s, d, "vec_chunks").filter(
        "embedding is not null and size(embedding) = 64 and forall(embedding, x -> x is not null and not isnan(x)) and exists(embedding, x -> x != 0)"
    )
    return rows.groupBy("chunk_id").agg(F.min("embedding").alias("embedding"))


def _stored(s: SparkSession, d: str) -> plans.Corpus:
    """The index of a data directory, built by the session's first search and read by all."""
    path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/chunks.parquet")
    at = path.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(path)
    return plans.Corpus.of(index.of_tables(s, f"{d} {at.getModificationTime()} {at.getLen()}", _chunks(s, d), _vectors(s, d), table(s, d, "edges")))


def _vector_queries(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).filter(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("qvec"))


def _text_queries(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "golden_items").filter("query is not null").select(F.col("item_id").alias("qid"), "query", "cat").distinct()
    return rows.filter(F.col("qid") % 50 == 0)


def _symbol_queries(s: SparkSession, d: str) -> DataFrame:
    """Queries by example: the symbol of every fiftieth chunk with one."""
    return _named(_chunks(s, d))


def _named(chunks: DataFrame) -> DataFrame:
    return chunks.filter("symbol != '' and chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), F.col("symbol").alias("query"))


def _example_queries(held: plans.Corpus) -> DataFrame:
    """Queries by example of an index, with their vectors."""
    return cut(_named(held.chunks).join(held.vectors.select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("qvec")), "qid"))


def chunk_lines(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    out = chunking.line_windows(docs, "doc_id", "text")
    return out.select("doc_id", "symbol", "start_line", "end_line", C.blob_hash(F.col("doc_id").cast("string"), F.col("code")).alias("blob_hash"))


def chunk_lines_short(s: SparkSession, d: str) -> DataFrame:
    out = chunking.line_windows(table(s, d, "documents"), "doc_id", "text", 12, 4)
    return out.select("doc_id", "symbol", "start_line", "end_line", F.length("code").alias("n_chars"))


def language_map(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", C.language_of(F.col("file_path")).alias("lang")).distinct()


def blob_dedup(s: SparkSession, d: str) -> DataFrame:
    return corpus.keep_first(table(s, d, "chunks")).select("chunk_id", "blob_hash", "file_path")


def insert_ignore(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks")
    stored = corpus.keep_first(rows.filter(F.col("start_line") == 1))
    return corpus.insert_ignore(stored, rows.filter(F.col("start_line") > 1)).select("chunk_id", "blob_hash")


def _deleted_paths(s: SparkSession, d: str) -> DataFrame:
    return changes.last_state(table(s, d, "change_log")).filter("state = 'deleted'").select("file_path")


def cascade_delete(s: SparkSession, d: str) -> DataFrame:
    out = corpus.cascade_delete(_chunks(s, d), {"edges": (graph.usable_edges(table(s, d, "edges")), "caller_id")}, _deleted_paths(s, d))
    left = out["chunks"].groupBy().agg(F.count("*").alias("n")).select(F.lit("chunks").alias("dataset"), "n")
    return left.unionByName(out["edges"].groupBy().agg(F.count("*").alias("n")).select(F.lit("edges").alias("dataset"), "n"))


def replace_files(s: SparkSession, d: str) -> DataFrame:
    """Files with a dirty last state are replaced by their chunks that begin at line 1."""
    rows = _chunks(s, d)
    dirty = changes.last_state(table(s, d, "change_log")).filter("state = 'dirty'").select("file_path")
    new = rows.join(dirty, "file_path", "left_semi").filter(F.col("start_line") == 1).select(*rows.columns)
    return corpus.replace_files(rows, new, dirty).select("chunk_id", "file_path")


def _shown(files: DataFrame) -> DataFrame:
    """Fingerprints with -1 for unknown times and sizes."""
    return files.select("file_path", "file_hash", F.coalesce("mtime", F.lit(-1.0)).alias("mtime"), F.coalesce("size", F.lit(-1)).cast("long").alias("size"))


def fingerprint_latest(s: SparkSession, d: str) -> DataFrame:
    return _shown(corpus.latest_fingerprints(table(s, d, "files")))


def fingerprint_diff(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "files")
    paths = table(s, d, "chunks").select("file_path").distinct()
    listing = paths.join(corpus.latest_fingerprints(files), "file_path", "left")
    return corpus.fingerprint_diff(listing, corpus.oldest_fingerprints(files))


def fingerprint_upsert(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "files")
    old = corpus.oldest_fingerprints(files.filter("mtime is not null"))
    return _shown(corpus.upsert_fingerprints(old, corpus.latest_fingerprints(files.filter("size is not null"))))


def file_admission(s: SparkSession, d: str) -> DataFrame:
    return corpus.admitted(table(s, d, "files").filter("file_path is not null")).select("file_path", F.coalesce("size", F.lit(-1)).cast("long").alias("size"), "admitted").distinct()


def stats(s: SparkSession, d: str) -> DataFrame:
    return corpus.stats(_chunks(s, d))


def meaningful(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("chunk_id", chunking.is_meaningful(F.col("code")).alias("meaningful"))


def edge_extract(s: SparkSession, d: str) -> DataFrame:
    return chunking.call_edges(_chunks(s, d))


def ast_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_files(corpus.whole_files(table(s, d, "chunks"))).select("file_path", "symbol", "start_line", "end_line", "blob_hash")


def whole_files(s: SparkSession, d: str) -> DataFrame:
    return corpus.whole_files(table(s, d, "chunks")).select("file_path", F.length("code").alias("n_chars"), F.md5("code").alias("code_md5"))


def batch_packing(s: SparkSession, d: str) -> DataFrame:
    return chunking.embedding_batches(table(s, d, "documents"), "doc_id", "text").groupBy("task", "batch").agg(F.count("*").alias("texts"), F.sum("n_chars").alias("chars"))


def embed_texts(s: SparkSession, d: str) -> DataFrame:
    c = _chunks(s, d)
    return c.select("chunk_id", F.md5(C.embed_text(F.col("file_path"), F.col("symbol"), F.col("language"), F.col("code"))).alias("embed_md5"), F.md5(C.rerank_text(F.col("file_path"), F.col("symbol"), F.col("code"))).alias("rerank_md5"))


def embed_hash(s: SparkSession, d: str) -> DataFrame:
    c = _chunks(s, d)
    return embedding.embedded(c, C.embed_text(F.col("file_path"), F.col("symbol"), F.col("language"), F.col("code")), embedding.HashingEmbedder()).select("chunk_id", "embedding")


def ident_split(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("chunk_id", F.array_join(C.ident_parts(F.col("symbol")), " ").alias("parts"), C.basename(F.col("file_path")).alias("base"), C.file_stem(F.col("file_path")).alias("stem"))


def fts_tokens(s: SparkSession, d: str) -> DataFrame:
    tokens = C.word_tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


def declared_names(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("chunk_id", F.array_join(C.declared_names(F.col("code"), F.col("language")), " ").alias("names"))


def file_classes(s: SparkSession, d: str) -> DataFrame:
    c = _chunks(s, d)
    return c.select(
        "chunk_id", C.is_test_file(F.col("file_path")).alias("test"), C.is_barrel_file(F.col("file_path")).alias("barrel"),
        C.is_declaration(F.col("code"), F.col("language")).alias("declaration"), C.is_entity(F.col("code"), F.col("language")).alias("entity"), C.is_boilerplate(F.col("symbol")).alias("boilerplate"),
    )


def query_intents(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "golden_items").select("item_id", "query").distinct()
    return rows.select("item_id", *[C.has_intent(F.col("query"), k).alias(k) for k in V.INTENTS], F.array_join(C.compound_parts(F.col("query")), "|").alias("halves"), F.array_join(F.array_sort(C.intent_symbols(F.col("query"))), "|").alias("named"))


def vector_serialise(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select("chunk_id", F.aggregate(C.quantised(F.col("embedding")), F.lit(0), lambda a, x: a + x.cast("int")).alias("total"), F.aggregate(C.quantised(F.col("embedding")), F.lit(0), lambda a, x: a + x.cast("int") * x.cast("int")).alias("squares"))


def knn_l2(s: SparkSession, d: str) -> DataFrame:
    return retrieval.knn(_vectors(s, d), _vector_queries(s, d), 10)


def knn_int8(s: SparkSession, d: str) -> DataFrame:
    small = _vectors(s, d).withColumn("embedding", C.quantised(F.col("embedding")))
    asked = _vector_queries(s, d).withColumn("qvec", C.quantised(F.col("qvec")))
    return retrieval.knn(small, asked, 10)


def topk_agreement(s: SparkSession, d: str) -> DataFrame:
    return evaluation.agreement(knn_l2(s, d), knn_int8(s, d), 5)


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _stored(s, d).words(_text_queries(s, d), K)


def bm25_symbols(s: SparkSession, d: str) -> DataFrame:
    held = _stored(s, d)
    return held.words(_named(held.chunks), K)


def trigram_match(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "golden_items").filter("lang = 'zh' and query is not null").select(F.col("item_id").alias("qid"), "query").distinct()
    docs = table(s, d, "documents").filter("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    return retrieval.substring_bm25(docs, asked, K, "doc_id", ("text",))


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    held = _stored(s, d)
    asked = _example_queries(held)
    near = retrieval.knn(retrieval.gathered(held.vectors, asked, K), asked, K)
    words = held.words(asked, K)
    return retrieval.fuse([(near, V.WEIGHTS["base"]), (words, V.WEIGHTS["sub"])], K).select("qid", "id", F.round("score", 6).alias("score"), "path", "path_rank")


def _scored(s: SparkSession, d: str) -> DataFrame:
    found = bm25_topk(s, d).select("qid", "id", F.round(-F.col("score"), 6).alias("score"), "rank")
    full = found.join(_chunks(s, d), F.col("id") == F.col("chunk_id")).join(_text_queries(s, d), "qid")
    return scoring.score(full)


def intent_score(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select("qid", "id", F.round("decl_mult", 6).alias("decl_mult"), F.round("score", 6).alias("score"))


def _symbol_scored(s: SparkSession, d: str) -> DataFrame:
    found = bm25_symbols(s, d).select("qid", "id", F.round(-F.col("score"), 6).alias("score"), "rank")
    return found.join(_stored(s, d).chunks.select("chunk_id", "file_path"), F.col("id") == F.col("chunk_id")).drop("chunk_id")


def per_group_cap(s: SparkSession, d: str) -> DataFrame:
    return scoring.diversify(_symbol_scored(s, d), 10).select("qid", "id", "rank")


def path_filter_glob(s: SparkSession, d: str) -> DataFrame:
    return scoring.diversify(_symbol_scored(s, d), 10, path_filter="*/src/*.[jt]s").select("qid", "id", "rank")


def path_filter_part(s: SparkSession, d: str) -> DataFrame:
    return scoring.diversify(_symbol_scored(s, d), 10, path_filter="Core/").select("qid", "id", "rank")


def impl_pairing(s: SparkSession, d: str) -> DataFrame:
    """All chunks as candidates of one query per repository; every third stands in a file whose name ends in Impl."""
    bare = F.regexp_replace("file_path", r"\.[^./]*$", "")
    rows = _chunks(s, d).select(
        F.split("file_path", "/")[0].alias("qid"), F.col("chunk_id").alias("id"), F.lit(0).alias("rank"), F.concat(bare, F.when(F.col("chunk_id") % 3 == 0, "Impl.java").otherwise(".java")).alias("file_path"),
        F.when(F.col("chunk_id") % 2 == 0, 0.75).otherwise(1.0).alias("decl_mult"), (F.col("chunk_id") % 97 / 97.0).alias("score"),
    )
    return scoring.pair_implementations(rows).select(F.col("qid").alias("repo"), "id", F.round("score", 6).alias("score"))


def hot_symbols(s: SparkSession, d: str) -> DataFrame:
    return graph.hot_names(table(s, d, "edges"))


def symbol_fanout(s: SparkSession, d: str) -> DataFrame:
    return graph.symbol_fanout(_chunks(s, d))


def callers_of(s: SparkSession, d: str) -> DataFrame:
    names = _symbol_queries(s, d).select("qid", F.col("query").alias("callee_name"))
    return graph.callers_of(table(s, d, "edges"), names).select("qid", "callee_name", "id")


def graph_expand(s: SparkSession, d: str) -> DataFrame:
    c = _chunks(s, d)
    origins = c.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), F.col("chunk_id").alias("id"))
    none = s.createDataFrame([], "qid long, id long, score double")
    return graph.related(c, table(s, d, "edges"), origins, none).select("qid", "id", "relation", "rank")


def intent_inject(s: SparkSession, d: str) -> DataFrame:
    """Every caller query of the golden items against the call edges, injected into its word candidates."""
    asked = table(s, d, "golden_items").filter("query is not null").select(F.col("item_id").alias("qid"), F.concat(F.lit("who calls "), F.col("query")).alias("query")).distinct()
    hits = plans.intent_hits(asked, table(s, d, "edges"))
    found = bm25_topk(s, d).select("qid", "id", F.round(-F.col("score"), 6).alias("score"))
    return scoring.inject(found, hits)


def content_dedup(s: SparkSession, d: str) -> DataFrame:
    return graph.content_once(_chunks(s, d))


def rerank_mix(s: SparkSession, d: str) -> DataFrame:
    """Sub-query scores by token overlap with each half of a query's words, mixed into the word scores."""
    c = _scored(s, d)
    words = C.query_phrases(F.col("query"))
    half = F.ceil(F.size(words) / 2).cast("int")
    subs = c.select("qid", "id", "code", F.explode(F.array(F.struct(F.lit(0).alias("sub"), F.slice(words, F.lit(1), half).alias("w")), F.struct(F.lit(1).alias("sub"), F.slice(words, half + 1, F.size(words)).alias("w")))).alias("p"))
    scores = subs.select("qid", "id", F.col("p.sub").alias("sub"), embedding.token_overlap(F.array_join("p.w", " "), F.col("code")).alias("s"))
    return scoring.mix_subquery_scores(c.select("qid", "id", "file_path", "score"), scores, 0.2).select("qid", "id", F.round("score", 6).alias("score"), F.round("sub_score", 6).alias("sub_score"))


def rescue(s: SparkSession, d: str) -> DataFrame:
    """The files of each query's ranks 11 to 20 as the probe of a sub-query that its first ten results do not hold."""
    c = cut(_symbol_scored(s, d).withColumn("sub_score", F.lit(0.5) - F.col("rank") / 100))  # read several times below
    top = scoring.diversify(c.filter("rank <= 10"), 10)
    probes = c.filter("rank > 10").select("qid", F.lit(0).alias("sub"), "id", "file_path")
    return scoring.rescue(top, c, probes, 10, 0.2, 1).select("qid", "id", "rescued", "rank")


def _rendered(s: SparkSession, d: str) -> DataFrame:
    """The first ten results of every symbol query, with their code."""
    top = cut(scoring.diversify(_symbol_scored(s, d), 10).select("qid", "id", "rank", "score"))  # a few rows a query
    return top.join(plans.of_results(_stored(s, d).chunks, top), F.col("id") == F.col("chunk_id")).withColumn("entity", C.is_entity(F.col("code"), F.col("language")))


def numbered_lines(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("chunk_id", F.md5(F.array_join(C.numbered_lines(F.col("code"), F.col("start_line"), 20), "\n")).alias("shown_md5"))


def render_overlap(s: SparkSession, d: str) -> DataFrame:
    rows = _chunks(s, d).withColumn("id", F.col("chunk_id"))
    return render.clip_overlaps(rows, ["file_path"]).select("chunk_id", "skipped", "first", "gap")


def render_markdown(s: SparkSession, d: str) -> DataFrame:
    return render.markdown(_rendered(s, d))


def last_op_wins(s: SparkSession, d: str) -> DataFrame:
    return changes.last_state(table(s, d, "change_log"))


def debounce_bursts(s: SparkSession, d: str) -> DataFrame:
    return changes.bursts(table(s, d, "change_log"))


def count_flush(s: SparkSession, d: str) -> DataFrame:
    """Flushes by count per repository over the whole log, by aggregation: the rule of ``changes.count_flushes``, which runs over streams."""
    n = changes.usable(table(s, d, "change_log")).groupBy(F.split("file_path", "/")[0].alias("repo")).agg(F.count("*").alias("n"))
    return n.select("repo", F.floor(F.col("n") / V.FLUSH_COUNT).alias("flushes"), (F.col("n") % V.FLUSH_COUNT).alias("pending"))


def eval_metrics(s: SparkSession, d: str) -> DataFrame:
    golden = table(s, d, "golden_items").filter("query is not null").select(F.col("item_id").alias("qid"), "cat", "expected", "query").distinct()
    found = _stored(s, d).words(golden.select("qid", "query").distinct(), 10).join(_chunks(s, d).select("chunk_id", "file_path"), F.col("id") == F.col("chunk_id"))
    return evaluation.metrics(evaluation.first_hits(found, golden), ["cat"])


def _shown_results(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", "id", "file_path", "symbol", F.round("score", 6).alias("score"), "relation")


def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    """Every fiftieth chunk's symbol and vector as a query of the index."""
    held = _stored(s, d)
    return _shown_results(plans.search(held, _example_queries(held), plans.Options(top_k=50)))


def _golden_queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "golden_items").filter("query is not null").select(F.col("item_id").alias("qid"), "query").distinct()


def hybrid_search_golden(s: SparkSession, d: str) -> DataFrame:
    """Every query of the golden items: words, substrings where it has Han signs, the halves of compound ones, callers, the rules."""
    return _shown_results(plans.search(_stored(s, d), cut(_golden_queries(s, d)), plans.Options(top_k=50)))


def reranked_search(s: SparkSession, d: str) -> DataFrame:
    """The golden queries with the offline reranker, mixed sub-query scores and rescue, as one text each."""
    return plans.answers(plans.search(_stored(s, d), cut(_golden_queries(s, d)), plans.Options(top_k=50), rerank=embedding.overlap_rerank))


def sync_incremental(s: SparkSession, d: str) -> DataFrame:
    """An index of all files, then brought in step with the change log: deleted paths go, dirty ones get a further line."""
    texts = corpus.whole_files(table(s, d, "chunks"))
    fingerprints = corpus.latest_fingerprints(table(s, d, "files")).select("file_path", "mtime", "size")
    listed = lambda rows: rows.join(fingerprints, "file_path", "left").withColumn("file_hash", F.md5("code"))
    states = changes.last_state(table(s, d, "change_log"))
    dirty, deleted = (states.filter(F.col("state") == x).select("file_path") for x in ("dirty", "deleted"))
    changed = dirty.withColumn("more", F.lit("\nlast line changed"))
    after = texts.join(deleted, "file_path", "left_anti").join(changed, "file_path", "left").withColumn("code", F.concat("code", F.coalesce("more", F.lit("")))).drop("more")
    built = index.Index(Snapshots(s, f"{ensure_checkpoint_dir(s)}/sync-{uuid.uuid4().hex}"), None, index.windows)
    built.sync(listed(texts))
    built.sync_dirty(listed(after), dirty, deleted)
    return built.store.read("chunks").select("file_path", "symbol", "start_line", "end_line", F.md5("code").alias("code_md5"))


QUERIES: list[Query] = [
    chunk_lines, chunk_lines_short, language_map, blob_dedup, insert_ignore, cascade_delete, replace_files, fingerprint_latest, fingerprint_diff, fingerprint_upsert,
    file_admission, stats, meaningful, edge_extract, whole_files, ast_chunks, batch_packing, embed_texts, embed_hash, ident_split, fts_tokens, declared_names, file_classes,
    query_intents, vector_serialise, knn_l2, knn_int8, topk_agreement, bm25_topk, bm25_symbols, trigram_match, rrf_fusion, intent_score, per_group_cap,
    path_filter_glob, path_filter_part, impl_pairing, hot_symbols, symbol_fanout, callers_of, graph_expand, intent_inject, content_dedup, rerank_mix, rescue,
    numbered_lines, render_overlap, render_markdown, last_op_wins, debounce_bursts, count_flush, eval_metrics, hybrid_search, hybrid_search_golden, reranked_search, sync_incremental,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    from sparkseek.oracle import SQL

    return SQL
