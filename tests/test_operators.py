"""Operators on small fixtures: ties, boundaries, empty inputs."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.operators import chunking, corpus, embedding, evaluation, graph, render, retrieval, scoring
from sparkseek.operators.store import ProfileMismatch, Snapshots
from sparkseek.plans import index

CHUNKS = "chunk_id long, blob_hash string, file_path string, language string, symbol string, start_line int, end_line int, code string"


def test_windows_stop_at_the_last_line(spark):
    docs = spark.createDataFrame([(1, "\n".join(map(str, range(110)))), (2, "x"), (3, " \n "), (4, None), (5, "\n".join(map(str, range(111))))], "doc_id long, text string")
    got = {(r.doc_id, r.start_line, r.end_line) for r in chunking.line_windows(docs, "doc_id", "text").collect()}
    assert got == {(1, 1, 60), (1, 51, 110), (2, 1, 1), (5, 1, 60), (5, 51, 110), (5, 101, 111)}


def test_definitions_give_way_to_inner_ones():
    body = "\n".join(f"    def m{i}(self):\n" + "\n".join("        x = 1" for _ in range(60)) for i in range(4))
    found = chunking.definitions("class Big:\n" + body, "python")
    assert [f[0] for f in found] == ["m0", "m1", "m2", "m3"]
    assert [f[0] for f in chunking.definitions("@dec\ndef f():\n    return 1\n\nx = 2", "python")] == ["f"]


def test_chunk_files_falls_back_to_windows(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    a = 1\n    return a\n"), ("b.md", "# t\ntext\nmore"), ("c.py", "x = 1")], "file_path string, code string")
    got = {(r.file_path, r.symbol) for r in chunking.chunk_files(files).collect()}
    assert got == {("a.py", "f"), ("b.md", "lines_1"), ("c.py", "lines_1")}


def test_batches_respect_both_bounds(spark):
    rows = spark.createDataFrame([(i, "x" * 40) for i in range(10)], "id long, t string").coalesce(1)
    got = chunking.embedding_batches(rows, "id", "t", texts=3, chars=100).groupBy("batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c")).collect()
    assert all(r.n <= 3 and r.c <= 100 for r in got) and sum(r.n for r in got) == 10


def test_diff_statuses(spark):
    schema = "file_path string, file_hash string, mtime double, size long"
    now = spark.createDataFrame([("a", "1", 1.0, 1), ("b", "2", 5.0, 2), ("c", "9", 5.0, 2), ("d", "4", 1.0, 1)], schema)
    old = spark.createDataFrame([("a", "1", 1.0, 1), ("b", "2", 1.0, 2), ("c", "3", 1.0, 2), ("e", "5", 1.0, 1)], schema)
    assert {tuple(r) for r in corpus.fingerprint_diff(now, old).collect()} == {("a", "same"), ("b", "touched"), ("c", "changed"), ("d", "new"), ("e", "deleted")}


def test_bm25_phrase_and_repeated_terms(spark):
    rows = spark.createDataFrame([(1, "foo_bar", "", ""), (2, "foo x bar", "", ""), (3, "Ünïcode beta", "", ""), (4, "other", "", ""), (5, "more", "", "")], "chunk_id long, code string, file_path string, symbol string")
    ask = lambda q: {r.id: r.score for r in retrieval.bm25(rows, spark.createDataFrame([(1, q)], "qid long, query string"), 10).collect()}
    assert set(ask("foo_bar")) == {1} and set(ask("foo bar")) == {1, 2}
    assert set(ask("unicode")) == {3} and ask("") == {} and ask("a") == {}
    assert math.isclose(ask("beta beta")[3], 2 * ask("beta")[3], abs_tol=2e-6)


def test_bm25_equals_formula(spark):
    texts = ["beta gamma", "beta", "gamma gamma delta", "delta", "beta beta beta delta"]
    rows = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], "chunk_id long, code string, file_path string, symbol string")
    got = {r.id: r.score for r in retrieval.bm25(rows, spark.createDataFrame([(1, "gamma")], "qid long, query string"), 10).collect()}
    avg = sum(len(t.split()) for t in texts) / 5
    idf = math.log((5 - 2 + 0.5) / 2.5)
    for i in (0, 2):
        tf, d = texts[i].split().count("gamma"), len(texts[i].split())
        assert math.isclose(got[i], -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / avg)), abs_tol=2e-6)


def test_knn_is_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(200)]
    df = spark.createDataFrame(vectors, "chunk_id long, embedding array<double>").repartition(7)
    asked = df.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("qvec"))
    got = {(r.qid, r.rank): r.id for r in retrieval.knn(df, asked, 5).collect()}
    for q in (0, 50, 100, 150):
        order = sorted(range(200), key=lambda i: (round(math.dist(vectors[q][1], vectors[i][1]), 6), i))
        assert [got[q, r] for r in range(1, 6)] == order[:5]


def test_knn_keeps_the_smallest_ids_of_many_ties(spark):
    rng = np.random.default_rng(2)
    one = [[float(s * (i == j)) for j in range(64)] for i in range(64) for s in (1, -1)]  # 128 vectors, all as far from 0
    ids = rng.permutation(1_000).tolist()
    rows = [(ids[i], one[i % 128] if i < 600 else [0.5] * 64) for i in range(1_000)]  # and a group of 400 equal vectors
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [0.0] * 64), (2, [0.5] * 64)], "qid long, qvec array<double>")
    got = {(r.qid, r.rank): r.id for r in retrieval.knn(df, asked, 5).collect()}
    assert [got[1, r] for r in range(1, 6)] == sorted(ids[:600])[:5]
    assert [got[2, r] for r in range(1, 6)] == sorted(ids[600:])[:5]


def test_fusion_orders_ties_by_first_list(spark):
    lists = [[(1, 1), (2, 2)], [(1, 1), (3, 2)], [(9, 1), (8, 2)]]
    frames = [spark.createDataFrame([(7, i, r) for i, r in part], "qid long, id long, rank int") for part in lists]
    got = [r.id for r in retrieval.fuse(list(zip(frames, [2.0, 2.0, 1.0], strict=True))).orderBy("rank").collect()]
    assert got == [1, 2, 3, 9, 8]


def _candidates(spark, rows):
    schema = "qid long, query string, id long, rank int, file_path string, language string, symbol string, start_line int, end_line int, code string, score double"
    return spark.createDataFrame([(1, q, i, i, p, lang, s, 1, 9, c, sc) for q, i, p, lang, s, c, sc in rows], schema)


def test_score_rules(spark):
    rows = [
        ("find parser", 1, "a/test_x.py", "python", "", "a\nb\nc", 1.0), ("find parser", 2, "a/index.ts", "typescript", "", "a\nb\nc", 1.0), ("find parser", 3, "a.md", "markdown", "", "a\nb\nc", 1.0),
        ("find parser", 4, "a.go", "go", "parser", "a\nb\nc", 1.0), ("find parser", 5, "A.java", "java", "", "public interface A {\nb\nc", 1.0), ("find parser", 6, "z.go", "go", "", "a", 1.0), ("how tests work", 7, "a/test_x.py", "python", "", "a\nb\nc", 1.0),
    ]
    got = {r.id: round(r.score, 6) for r in scoring.score(_candidates(spark, rows)).collect()}
    assert got == {1: 0.5, 2: 0.85, 3: 0.7, 4: 1.5, 5: 0.75, 6: 0.85, 7: 1.2}


def test_implementation_rises_above_its_interface(spark):
    rows = [("q", 1, "x/Order.java", "java", "", "interface Order {\nb\nc", 1.0), ("q", 2, "x/OrderImpl.java", "java", "", "class\nb\nc", 0.5)]
    got = {r.id: round(r.score, 4) for r in scoring.pair_implementations(scoring.score(_candidates(spark, rows))).collect()}
    assert got == {1: 0.75, 2: 1.01}


def test_at_most_two_of_a_file(spark):
    rows = [("q", i, "same.py" if i < 5 else f"f{i}.py", "python", "", "", 10.0 - i) for i in range(8)]
    got = [r.id for r in scoring.diversify(_candidates(spark, rows), 4).orderBy("rank").collect()]
    assert got == [0, 1, 5, 6]
    assert scoring.diversify(_candidates(spark, rows), 4, per_file=0).count() == 4


def test_rescue_replaces_the_lowest(spark):
    schema = "qid long, id long, file_path string, score double, sub_score double"
    results = spark.createDataFrame([(1, 1, "a", 3.0), (1, 2, "b", 2.0)], "qid long, id long, file_path string, score double")
    pool = spark.createDataFrame([(1, 1, "a", 3.0, 0.9), (1, 5, "c", 1.0, 0.5), (1, 6, "c", 1.0, 0.1), (1, 7, "c", 1.0, 0.9)], schema)
    # 7 stands in a probe's file but is no probe itself
    probes = spark.createDataFrame([(1, 0, 5, "c"), (1, 0, 6, "c"), (1, 1, 1, "a")], "qid long, sub int, id long, file_path string")
    got = {(r.id, r.rescued) for r in scoring.rescue(results, pool, probes, 2, 0.2).collect()}
    assert got == {(1, False), (5, True)}


def test_hot_names_and_fanout_boundaries(spark):
    edges = spark.createDataFrame([(i, "a") for i in range(20)] + [(i, "b") for i in range(21)] + [(1, ""), (1, None), (3, "a")], "caller_id long, callee_name string")
    assert [r.callee_name for r in graph.hot_names(edges).collect()] == ["b"]
    chunks = spark.createDataFrame([(i, "five") for i in range(5)] + [(i + 9, "six") for i in range(6)], "chunk_id long, symbol string")
    assert {r.symbol: r.resolvable for r in graph.symbol_fanout(chunks).collect()} == {"five": True, "six": False}


def test_related_chunks(spark):
    chunks = spark.createDataFrame([(1, "h1", "a.py", "python", "caller_one", 1, 3, "x"), (2, "h2", "b.py", "python", "target", 1, 3, "y"), (3, "h3", "c.py", "python", "origin", 1, 3, "z"), (4, "h4", "d.py", "python", "target", 1, 3, "y")], CHUNKS)
    edges = spark.createDataFrame([(3, "target"), (1, "origin"), (3, "origin"), (3, "getName")], "caller_id long, callee_name string")
    origins = spark.createDataFrame([(9, 3)], "qid long, id long")
    fused = spark.createDataFrame([(9, 2, 0.5)], "qid long, id long, score double")
    got = [(r.id, r.relation) for r in graph.related(chunks, edges, origins, fused).orderBy("rank").collect()]
    assert got == [(2, "callee"), (1, "caller")]  # 4 repeats the content of 2


def test_markdown_clips_overlaps(spark):
    schema = "qid long, rank int, id long, file_path string, language string, symbol string, start_line int, end_line int, code string, score double, entity boolean"
    rows = [(1, 1, 1, "a.md", "markdown", "s1", 1, 3, "l1\nl2\nl3", 0.5, False), (1, 2, 2, "a.md", "markdown", "s2", 3, 4, "l3\nl4", 0.4, False), (1, 3, 3, "b.md", "markdown", "", 7, 7, "z", 0.3, False), (1, 4, 4, "b.md", "markdown", "", 9, 9, "y", 0.3, False)]
    text = render.markdown(spark.createDataFrame(rows, schema)).first().text
    assert text.count("l3") == 1 and "## 1. a.md :: s1, s2 (score=0.500)" in text and "\n...\n" in text


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, "x/a.py"), (1, 2, "x/b.py"), (2, 1, "c")], "qid long, rank int, file_path string")
    golden = spark.createDataFrame([(1, "k", ["b.py"]), (2, "k", ["zzz"]), (3, "k", [])], "qid long, cat string, expected array<string>")
    m = evaluation.metrics(evaluation.first_hits(results, golden)).first()
    assert (m["items"], m.top1, round(m.recall5, 4), round(m.mrr, 4)) == (3, 0.0, 0.3333, 0.1667)


def test_hashing_embedder_has_unit_vectors(spark):
    v = embedding.HashingEmbedder().embed(["parse request", "", "parseRequest"])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 1]) and np.allclose(v[0], v[2])


def test_snapshots_swap_and_refuse_other_profiles(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "index"))
    store.check_profile({"embed_model": "m", "dim": "8"})
    assert store.commit({"chunks": spark.range(3)}) == 1
    old = store.read("chunks")
    assert store.commit({"chunks": spark.range(5)}) == 2
    assert store.read("chunks").count() == 5 and old.count() == 3
    store.check_profile({"embed_model": "", "dim": "8"})
    with pytest.raises(ProfileMismatch):
        store.check_profile({"embed_model": "m", "dim": "16"})
    with pytest.raises(Exception):
        store.commit({"chunks": spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))})
    assert store.version() == 2


def test_cascade_and_replace(spark):
    chunks = spark.createDataFrame([(1, "h1", "a"), (2, "h2", "b")], "chunk_id long, blob_hash string, file_path string")
    edges = spark.createDataFrame([(1, "x"), (2, "y")], "caller_id long, callee_name string")
    gone = spark.createDataFrame([("a",)], "file_path string")
    out = corpus.cascade_delete(chunks, {"edges": (edges, "caller_id")}, gone)
    assert [r.chunk_id for r in out["chunks"].collect()] == [2] and [r.caller_id for r in out["edges"].collect()] == [2]
    new = spark.createDataFrame([(3, "h3", "a"), (4, "h3", "a")], "chunk_id long, blob_hash string, file_path string")
    assert sorted(r.chunk_id for r in corpus.replace_files(chunks, new, gone).collect()) == [2, 3]


def _shuffled(spark):
    """Rows that all stages so far wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_stored_bm25_sends_the_tokens_of_phrases_once(spark, tmp_path):
    """F2, F4 to F9: 400 queries of two texts; the parts of their phrases stand everywhere, the phrases in few rows."""
    code = lambda i: " ".join(["read"] * 20 + ["two"] * 20 + (["read_two_x"] if i % 50 == 0 else []) + (["alpha_x", "alpha_x"] if i == 7 else []))
    rows = spark.createDataFrame([(i, code(i), "a.py", "") for i in range(200)], "chunk_id long, code string, file_path string, symbol string")
    for name, df in (("postings", retrieval.stored_postings(rows)), ("lengths", retrieval.lengths(rows, "chunk_id", retrieval.FIELDS))):
        df.write.parquet(str(tmp_path / name))
    stored = spark.read.parquet(str(tmp_path / "postings")), spark.read.parquet(str(tmp_path / "lengths"))
    queries = spark.createDataFrame([(i, "read_two_x" if i % 2 else "alpha_x read alpha_x") for i in range(400)] + [(900, None), (901, "nowhere_here")], "qid long, query string")
    before = _shuffled(spark)
    got = {tuple(r) for r in retrieval.bm25(None, queries, 5, stored=stored).collect()}
    assert _shuffled(spark) - before < 20_000  # 400 queries times 200 rows times 20 positions before
    assert got == {tuple(r) for r in retrieval.bm25(rows, queries, 5).collect()} and len({r[0] for r in got}) == 400
    assert {r[1] for r in got if r[0] == 1} == {0, 50, 100, 150} and (0, 7) in {(r[0], r[1]) for r in got if r[3] == 1}


def test_an_index_shuffles_texts_once_and_packs_the_tokens_of_phrases(spark):
    """every posting was a shuffled row, and so was every token that a phrase asks for."""
    words = [f"w{i}" for i in range(300)]
    rows = spark.createDataFrame([(i, f"h{i}", "a.py", "python", "", 1, 1, " ".join([*words, "read", f"two_{i % 9}"])) for i in range(200)], CHUNKS)
    vectors = spark.createDataFrame([(1, [1.0] * 64)], "chunk_id long, embedding array<double>")
    edges = spark.createDataFrame([(1, "f")], "caller_id long, callee_name string")
    before = _shuffled(spark)
    store = index.of_tables(spark, uuid.uuid4().hex, rows, vectors, edges)
    assert _shuffled(spark) - before < 2_000  # 60,000 postings before
    assert store.read("postings").count() == 200 * 303 + 2 * 200  # code, and the two parts of a path
    queries = spark.createDataFrame([(i, f"read_two_{i}_w1") for i in range(9)] + [(20, "w7_w8_w9"), (21, "w7_w9")], "qid long, query string")
    stored = store.read("postings"), store.read("lengths")
    before = _shuffled(spark)
    got = {tuple(r) for r in retrieval.bm25(None, queries, 500, stored=stored).collect()}
    assert _shuffled(spark) - before < 2_500  # 200 rows of the 9 phrases' 13 terms before
    assert got == {tuple(r) for r in retrieval.bm25(rows, queries, 500).collect()} and len(got) == 200


def test_rescue_makes_its_candidates_once(spark, monkeypatch):
    """they were searched for again by every read."""
    from sparkseek import queries

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(rank):
        made.add(1)
        return 1.0 / rank

    rows = spark.createDataFrame([(q, 100 * q + r, r, f"f{r}.py") for q in (1, 2) for r in range(1, 21)], "qid long, id long, rank int, file_path string")
    monkeypatch.setattr(queries, "_symbol_scored", lambda s, d: rows.withColumn("score", counted("rank")))
    got = queries.rescue(spark, "").collect()
    assert made.value == 40 and {r.qid for r in got if r.rescued} == {1, 2} and len(got) == 20
