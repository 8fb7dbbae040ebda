"""The search plan on a small corpus."""

import random

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from sparkseek import queries as registered
from sparkseek.operators import embedding, retrieval
from sparkseek.plans import search as P

CODE = {
    1: ("src/parser.py", "python", "parse_request", "def parse_request(data):\n    return decode_body(data)\n    # parse"),
    2: ("src/body.py", "python", "decode_body", "def decode_body(data):\n    return data.decode()\n    # body"),
    3: ("tests/test_parser.py", "python", "test_parse", "def test_parse():\n    assert parse_request(b'')\n    # parse request"),
    4: ("docs/guide.md", "markdown", "", "# Guide\nHow to parse a request\nand more"),
    5: ("src/cache.py", "python", "evict", "def evict(cache):\n    cache.clear()\n    # 清理缓存数据"),
}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"h{i}", p, lang, s, 1, 3, c) for i, (p, lang, s, c) in CODE.items()]
    chunks = spark.createDataFrame(rows, "chunk_id long, blob_hash string, file_path string, language string, symbol string, start_line int, end_line int, code string")
    vectors = embedding.embedded(chunks, F.col("code"), embedding.HashingEmbedder()).select("chunk_id", "embedding")
    edges = spark.createDataFrame([(1, "decode_body"), (3, "parse_request")], "caller_id long, callee_name string")
    return P.Corpus(chunks, edges, vectors)


def ask(spark, corpus, query, **options):
    asked = embedding.embedded(spark.createDataFrame([(1, query)], "qid long, query string"), F.col("query"), embedding.HashingEmbedder(), "query", "qvec")
    return P.search(corpus, asked, P.Options(**options)).orderBy("rank").collect()


def test_implementation_first_then_related(spark, corpus):
    got = ask(spark, corpus, "parse_request", top_n=1)
    assert got[0].id == 1 and got[0].relation is None
    assert {(r.id, r.relation) for r in got[1:]} == {(2, "callee"), (3, "caller")}
    assert len(ask(spark, corpus, "parse_request", top_n=1, expand_graph=False)) == 1


def test_caller_intent_puts_callers_first(spark, corpus):
    assert ask(spark, corpus, "who calls parse_request", expand_graph=False)[0].id == 3


def test_path_filter(spark, corpus):
    assert {r.file_path for r in ask(spark, corpus, "parse request", path_filter="docs/*", expand_graph=False)} == {"docs/guide.md"}


def test_compound_and_substring_paths(spark, corpus):
    assert ask(spark, corpus, "解析请求并且清理缓存", top_n=1, expand_graph=False)[0].id == 5


def test_variants_weigh_less(spark, corpus):
    asked = embedding.embedded(spark.createDataFrame([(1, "evict")], "qid long, query string"), F.col("query"), embedding.HashingEmbedder(), "query", "qvec")
    variants = embedding.embedded(spark.createDataFrame([(1, 0, "decode_body")], "qid long, variant int, query string"), F.col("query"), embedding.HashingEmbedder(), "query", "qvec")
    got = [r.id for r in P.recall(corpus, asked, 10, variants)[0].orderBy("rank").collect()]
    assert got[0] == 5 and 2 in got


def test_expander_replies(spark):
    reply = "Sure!\n```json\n{\"variants\": [\"a\", \"b\", \"c\"], \"hypothetical_code\": \"x = 1\"}\n```"
    df = spark.createDataFrame([(1, reply), (2, "no json"), (3, ""), (4, None), (5, "{broken")], "i int, r string")
    got = {r.i: r.e for r in df.select("i", P.parsed_expansion(F.col("r")).alias("e")).collect()}
    assert list(got[1].variants) == ["a", "b"] and got[1].hypothetical_code == "x = 1" and [got[i] for i in (2, 3, 4, 5)] == [None] * 4


def holding(wanted, broken=False):
    """A reranker that knows which words a text should hold."""

    class Words:
        def scores(self, pairs):
            if broken:
                raise RuntimeError("no service")
            return [float(wanted in text) * 0.9 + 0.05 for _, text in pairs]

    return Words()


def reranked(spark, corpus, query, reranker, **options):
    asked = spark.createDataFrame([(1, query)], "qid long, query string")
    return P.search(corpus, asked, P.Options(expand_graph=False, **options), rerank=embedding.batched_rerank(reranker)).orderBy("rank").collect()


def test_reranker_decides_and_may_fail(spark, corpus):
    plain = [r.id for r in P.search(corpus, spark.createDataFrame([(1, "parse request body")], "qid long, query string"), P.Options(expand_graph=False)).orderBy("rank").collect()]
    assert reranked(spark, corpus, "parse request body", holding("data.decode"))[0].id == 2
    assert [r.id for r in reranked(spark, corpus, "parse request body", holding("", broken=True))] == plain


def test_a_half_without_results_is_rescued(spark, corpus):
    # the whole query's scores favour one half; the other half's best probe takes the last place
    got = reranked(spark, corpus, "parse_request+evict", holding("parse_request"), top_n=2)
    assert len(got) == 2 and "src/cache.py" not in {r.file_path for r in got}  # evict scores under the bound
    asked = spark.createDataFrame([(1, "parse_request+evict cache")], "qid long, query string")
    got = P.search(corpus, asked, P.Options(expand_graph=False, top_n=2), rerank=embedding.overlap_rerank).collect()
    assert "src/cache.py" in {r.file_path for r in got}


def test_expansions_of_a_failing_and_a_working_expander(spark, corpus):
    class Expander:
        def expand(self, query):
            if query == "broken":
                raise RuntimeError("no service")
            return '{"variants": ["decode_body", ""], "hypothetical_code": "def evict(cache): pass"}'

    asked = spark.createDataFrame([(1, "anything"), (2, "broken")], "qid long, query string")
    got = P.expansions(asked, Expander(), embedding.HashingEmbedder())
    rows = {(r.qid, r.variant): r.query for r in got.collect()}
    assert rows == {(1, 0): "decode_body", (1, 2): None}
    found = P.search(corpus, asked, P.Options(expand_graph=False), variants=got).collect()
    assert {r.id for r in found if r.qid == 1} >= {2, 5}


def test_answers_are_text(spark, corpus):
    asked = spark.createDataFrame([(1, "parse_request")], "qid long, query string")
    text = P.answers(P.search(corpus, asked)).first().text
    assert text.startswith("## 1. src/parser.py") and "body.py" in text


def test_candidates_carry_no_code(spark, tmp_path):
    """the code of every candidate went through each window of the search."""
    rng = random.Random(5)
    code = lambda: "common " + " ".join(f"{rng.getrandbits(64):016x}" for _ in range(250))
    rows = [(i, f"h{i}", f"d/f{i // 2}.py", "python", f"s{i}", 1, 1, code()) for i in range(400)]
    path = str(tmp_path / "chunks")
    spark.createDataFrame(rows, "chunk_id long, blob_hash string, file_path string, language string, symbol string, start_line int, end_line int, code string").write.parquet(path)
    edges = spark.createDataFrame([(1, "s2")], "caller_id long, callee_name string")
    asked = spark.createDataFrame([(i, "common") for i in range(10)], "qid long, query string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    found = P.search(P.Corpus(spark.read.parquet(path), edges), asked, P.Options(top_k=300)).collect()
    assert {r.id: r.code for r in found}.items() <= {r[0]: r[-1] for r in rows}.items()
    assert len([r for r in found if r.relation is None]) == 100
    assert written() - before < 8_000_000  # 3,000 candidates with 4 kB each, several times, before


def test_searches_read_raw_tables_for_the_index_only(spark, monkeypatch):
    """F7, F8: render_markdown and rrf_fusion cleaned the chunks and gathered the vectors again for every step."""
    registered.rrf_fusion(spark, SMALL).collect()
    read = []
    monkeypatch.setattr(registered, "_chunks", lambda s, d, f=registered._chunks: read.append("chunks") or f(s, d))
    monkeypatch.setattr(registered, "_vectors", lambda s, d, f=registered._vectors: read.append("vectors") or f(s, d))
    monkeypatch.setattr(registered, "_stored", lambda s, d, f=registered._stored: (f(s, d), read.clear())[0])
    for query in (registered.rrf_fusion, registered.render_markdown):
        assert query(spark, SMALL).count() > 0 and not read


def writing(spark):
    """The (bytes, rows) that every stage so far wrote to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    rows = [stages.apply(i) for i in range(stages.size())]
    return {x.stageId(): (x.shuffleWriteBytes(), x.shuffleWriteRecords()) for x in rows}


def indexed(spark, monkeypatch, path, rows, vectors=None):
    """The stored index of rows (chunk_id, file_path, symbol, code) for registered queries."""
    given = [(i, f"h{i}", p, "python", s, 1, 1, c) for i, p, s, c in rows]
    spark.createDataFrame(given, "chunk_id long, blob_hash string, file_path string, language string, symbol string, start_line int, end_line int, code string").write.parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    held = P.Corpus(chunks, None, vectors, retrieval.stored_postings(chunks), retrieval.lengths(chunks, "chunk_id", retrieval.FIELDS), True)
    monkeypatch.setattr(registered, "_stored", lambda s, d: held)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # these tables are small


def test_rendering_shuffles_the_code_of_results_only(spark, monkeypatch, tmp_path):
    """all chunks were shuffled with their code to join the ten results of each query."""
    rng = random.Random(7)
    rows = [(i, f"d/f{i}.py", f"s{i}", " ".join(f"{rng.getrandbits(64):016x}" for _ in range(250))) for i in range(1, 1001)]
    try:
        indexed(spark, monkeypatch, tmp_path, rows)
        before = writing(spark)
        found = {r.qid: r.text for r in registered.render_markdown(spark, "").collect()}
        written = sum(n for k, (n, _) in writing(spark).items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.keys() == set(range(50, 1001, 50)) and all(f"## 1. d/f{q}.py" in text and rows[q - 1][3][:16] in text for q, text in found.items())
    assert written < 1_000_000  # 4 kB for each of 1,000 chunks before


def test_fusion_sends_nearest_vectors_in_proportion(spark, monkeypatch, tmp_path):
    """F8: every partition of the vectors sent k rows of each query, so the shuffle grew with queries times partitions."""
    rng = random.Random(8)
    points = [(i, [rng.random() for _ in range(4)]) for i in range(1, 2001)]
    spark.createDataFrame(points, "chunk_id long, embedding array<float>").repartition(40).write.parquet(f"{tmp_path}/vectors")
    files = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a partition for each file
        vectors = spark.read.parquet(f"{tmp_path}/vectors")
        indexed(spark, monkeypatch, tmp_path, [(i, f"d/f{i}.py", f"s{i}", "code") for i, _ in points], vectors)
        before = writing(spark)
        found = registered.rrf_fusion(spark, "").collect()
        most = max(n for k, (_, n) in writing(spark).items() if k not in before)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", files)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    held = {i: v for i, v in vectors.collect()}
    for qid in range(50, 2001, 50):
        near = sorted(held, key=lambda i: (round(sum((a - b) ** 2 for a, b in zip(held[i], held[qid], strict=True)) ** 0.5, 6), i))[: registered.K]
        assert {r.id for r in found if r.qid == qid} == set(near)  # its word finds the query itself
    assert most <= 10_000  # 40 queries by 20 rows from each of 40 partitions before
