"""The stored index: syncs, one commit for all tables, the change stream."""

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import columns as C
from sparkseek.operators import chunking, embedding, retrieval
from sparkseek.operators.store import ProfileMismatch, Snapshots
from sparkseek.plans import index as I
from sparkseek.plans import search as P
from sparkseek.streaming import changes

FILES = "file_path string, file_hash string, mtime double, size long, code string"
A = "def alpha(x):\n    return beta(x)\n    # one\n\n\ndef beta(x):\n    return x\n    # two\n"
B = "def gamma(x):\n    return alpha(x)\n    # three\n"


def listing(spark, **files):
    return spark.createDataFrame([(f"{n}.py", f"h{len(c or '')}{c}", float(len(c or "")), len(c or ""), c) for n, c in files.items()] or [], FILES)


def state(index):
    store = index.store
    chunks = {(r.file_path, r.symbol): r.chunk_id for r in store.read("chunks").collect()}
    ids = set(chunks.values())
    assert {r.chunk_id for r in store.read("vectors").collect()} == ids == {r.id for r in store.read("lengths").collect()} == {r.id for r in store.read("postings").collect()}
    assert {r.caller_id for r in store.read("edges").collect()} <= ids
    return chunks, {(r.caller_id, r.callee_name) for r in store.read("edges").collect()}, {r.file_path: r.file_hash for r in store.read("files").collect()}


def test_sync_follows_the_files(spark, tmp_path):
    index = I.Index(Snapshots(spark, str(tmp_path / "index")))
    counts = index.sync(listing(spark, a=A, b=B, empty=None))
    chunks, edges, files = state(index)
    assert set(chunks) == {("a.py", "alpha"), ("a.py", "beta"), ("b.py", "gamma")} and counts["changed"] == 3 and set(files) == {"a.py", "b.py", "empty.py"}
    assert edges == {(chunks["a.py", "alpha"], "beta"), (chunks["b.py", "gamma"], "alpha")}
    # nothing changed; then one file changed, one gone, one new
    assert index.sync(listing(spark, a=A, b=B, empty=None))["changed"] == 0
    counts = index.sync(listing(spark, a=A.replace("beta", "delta"), c=B))
    again, edges, files = state(index)
    assert set(again) == {("a.py", "alpha"), ("a.py", "delta"), ("c.py", "gamma")} and set(files) == {"a.py", "c.py"}
    assert (counts["changed"], counts["deleted"]) == (2, 2) and again["a.py", "alpha"] != chunks["a.py", "alpha"]
    # the same content has the same id in any sync
    index.sync(listing(spark, a=A, b=B))
    assert state(index)[0] == chunks
    index.sync(listing(spark))
    assert state(index) == ({}, set(), {})


def test_a_touched_file_is_not_cut_again(spark, tmp_path):
    made = []

    def chunker(files):
        made.append(files.count())
        return chunking.chunk_files(files)

    index = I.Index(Snapshots(spark, str(tmp_path / "index")), chunker=chunker)
    index.sync(listing(spark, a=A))
    index.sync(listing(spark, a=A).withColumn("mtime", F.lit(99.0)))
    assert made == [1, 0] and index.store.read("files").first().mtime == 99.0


def test_dirty_and_deleted_paths(spark, tmp_path):
    index = I.Index(Snapshots(spark, str(tmp_path / "index")))
    index.sync(listing(spark, a=A, b=B))
    paths = lambda *names: spark.createDataFrame([(n,) for n in names], "file_path string")
    now = listing(spark, a=A.replace("beta", "delta"), b=B.replace("gamma", "other"), c=B)
    counts = index.sync_dirty(now, paths("a.py", "c.py", "missing.py"), paths("b.py"))
    chunks, _, files = state(index)
    assert set(chunks) == {("a.py", "alpha"), ("a.py", "delta"), ("c.py", "gamma")} and set(files) == {"a.py", "c.py"} and counts["changed"] == 2
    version = index.store.version()
    assert index.sync_dirty(now, paths("a.py"), paths())["changed"] == 0 and index.store.version() == version + 1


@pytest.mark.parametrize("table", ["chunks", "postings"])
def test_a_sync_that_dies_between_steps_changes_nothing(spark, tmp_path, monkeypatch, table):
    index = I.Index(Snapshots(spark, str(tmp_path / "index")))
    index.sync(listing(spark, a=A))
    before = state(index)
    commit = index.store.commit

    def broken(tables, *rest):
        return commit(tables | {table: tables[table].withColumn(tables[table].columns[0], F.raise_error(F.lit("lost")))}, *rest)

    monkeypatch.setattr(index.store, "commit", broken)
    with pytest.raises(Exception):
        index.sync(listing(spark, a=B))
    assert state(index) == before and index.store.version() == 1


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    one, two = Snapshots(spark, str(tmp_path / "index")), Snapshots(spark, str(tmp_path / "index"))
    one.commit({"t": spark.range(1)})
    two.version = lambda: 0  # it looked before the first one committed
    with pytest.raises(Exception):
        two.commit({"t": spark.range(5)})
    assert one.read("t").count() == 1 and one.version() == 1


def test_an_embedder_of_another_length_or_profile_is_refused(spark, tmp_path):
    class Short(embedding.HashingEmbedder):
        def embed(self, texts, mode="document"):
            return super().embed(texts, mode)[:-1]

    index = I.Index(Snapshots(spark, str(tmp_path / "index")), Short())
    with pytest.raises(Exception, match="the embedder gave"):
        index.sync(listing(spark, a=A))
    assert index.store.version() == 0
    I.Index(index.store).sync(listing(spark, a=A))
    with pytest.raises(ProfileMismatch):
        I.Index(index.store, embedding.HashingEmbedder(32)).sync(listing(spark, a=B))


def test_the_change_stream_drives_the_index(spark, tmp_path):
    index = I.Index(Snapshots(spark, str(tmp_path / "index")))
    index.sync(listing(spark, a=A, b=B))
    log = spark.createDataFrame([(1, "a.py", "modified", "2026-01-01 00:00:00"), (2, "b.py", "modified", "2026-01-01 00:00:01"), (3, "b.py", "Deleted", "2026-01-01 00:00:02"), (4, None, "created", "2026-01-01 00:00:03")], "change_id long, file_path string, op string, seen_at string").withColumn("seen_at", F.to_timestamp("seen_at"))
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = changes.stream_changes(spark, str(tmp_path / "log"), log.schema)
    changes.apply_changes(stream, index.apply_batch(lambda: listing(spark, a=A.replace("beta", "delta"), b=B)), str(tmp_path / "offsets")).awaitTermination()
    assert set(state(index)[0]) == {("a.py", "alpha"), ("a.py", "delta")}


def test_search_reads_the_index(spark, tmp_path):
    index = I.Index(Snapshots(spark, str(tmp_path / "index")))
    index.sync(listing(spark, a=A, b=B))
    held = P.Corpus.of(index.store)
    asked = embedding.embedded(spark.createDataFrame([(1, "gamma")], "qid long, query string"), F.col("query"), index.embedder, "query", "qvec")
    got = P.search(held, asked, P.Options(top_n=1)).orderBy("rank").collect()
    assert got[0].symbol == "gamma" and [(r.symbol, r.relation) for r in got[1:]] == [("alpha", "callee")]
    words = lambda stored: {(r.qid, r.id, r.score, r["rank"]) for r in retrieval.bm25(held.chunks, asked.select("qid", F.lit("return alpha_x two").alias("query")), 10, stored=stored).collect()}
    assert words(None) == words((held.postings, held.lengths)) != set()


JAVA = """public class Svc {
    private final PriceRuleEvaluator priceRuleEvaluator = new PriceRuleEvaluator();
    public void run(String v) {
        java.util.List<CustomItem> items = new java.util.ArrayList<CustomItem>();
        EvaluateResult r = priceRuleEvaluator.evaluate(1, 2, v, null, null); // not called(here)
        String s = "nor called(there)";
        process(r);
    }
}
"""


def test_called_names(spark):
    cases = {
        "java": (JAVA, {"evaluate", "priceRuleEvaluator", "PriceRuleEvaluator", "ArrayList", "process"}),
        "python": ("def run(a):\n    # call(no)\n    s = 'call(no)'\n    return a.b(c(1))\n", {"b", "c"}),
        "go": ("func (a *A) Run(x int) error {\n\treturn fmt.Errorf(wrap(x))\n}\n", {"Errorf", "wrap"}),
        "typescript": ("export async function f(a: B) {\n  const m = new Map<string, C>(load<D>(a));\n  `call(no)`;\n}\n", {"Map", "load"}),
        "rust": ("fn run(a: A) -> B {\n    let v = vec![make(a)];\n    v.first().unwrap()\n}\n", {"vec", "make", "first", "unwrap"}),
        "c": ("static int run(struct a *p) {\n    /* call(no) */\n    return helper(p, sizeof(int));\n}\n", {"helper"}),
        "markdown": ("call(no)", set()),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "language string, code string")
    got = {r.language: set(r.names) for r in df.select("language", C.called_names(F.col("code"), F.col("language")).alias("names")).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


DEFINED = {
    "rust": ("use a;\npub struct P {\n    x: i32,\n}\n\nimpl P {\n    pub fn f(&self) -> i32 {\n        self.x\n    }\n}\n\nfn main() {\n    f();\n}\n", ["P", "P", "main"]),
    "cpp": ("#include <a>\nclass A {\npublic:\n    int f() { return 1; }\n};\n\nint g(int a) {\n    return a;\n}\n", ["A", "g"]),
    "csharp": ("namespace N {\n    public class A {\n        public int F(int a) {\n            return a;\n        }\n    }\n    interface I {\n        void G();\n    }\n}\n", ["A", "I"]),
    "ruby": ("require 'a'\nmodule M\n  class A\n    def f(x)\n      x\n    end\n  end\nend\n\ndef g\n  1\nend\n", ["M", "g"]),
    "php": ("<?php\nclass A {\n    public function f($a) {\n        return $a;\n    }\n}\nfunction g() {\n    return 1;\n}\n", ["A", "g"]),
    "kotlin": ("package a\n\ndata class P(val x: Int) {\n    fun f(): Int {\n        return x\n    }\n}\n\nfun g() {\n    f()\n}\n", ["P", "g"]),
    "scala": ("object O {\n  def f(x: Int): Int = {\n    x\n  }\n}\n\ntrait T {\n  def g: Int\n}\n", ["O", "T"]),
    "swift": ("import A\n\nclass P {\n    func f() -> Int {\n        return 1\n    }\n}\n\nfunc g() {\n    f()\n}\n", ["P", "g"]),
    "lua": ("local M = {}\nfunction M.f(a)\n  return a\nend\n\nlocal function g()\n  return 1\nend\n\nM.h = function(x)\n  return x\nend\n", ["M.f", "g", "M.h"]),
}


@pytest.mark.parametrize("language", DEFINED)
def test_definitions_of_more_languages(language):
    code, symbols = DEFINED[language]
    got = chunking.definitions(code, language)
    assert [d[0] for d in got] == symbols
    lines = code.split("\n")
    assert all(d[3] == "\n".join(lines[d[1] - 1 : d[2]]) for d in got)
    assert not lines[got[-1][2]].strip() if got[-1][2] < len(lines) and language != "csharp" else True
