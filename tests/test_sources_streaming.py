"""The tree source and the change stream."""

from sparkseek.sources.tree import IgnoreRules, TreeSource, scoped_pattern
from sparkseek.streaming import changes

LOG = "change_id long, file_path string, op string, changed_at timestamp, seen_at timestamp"


def _write(root, files):
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_tree_reads_hidden_and_ignored_names(spark, tmp_path):
    _write(tmp_path, {"__init__.py": "a", "_p.py": "b", ".github/x.yml": "c: 1", ".git/c.py": "no", "node_modules/m.js": "no", "yarn.lock": "no", "AGENTS.md": "yes", ".gitignore": "*.log.py\nout/\n", "x.log.py": "no",
                      "sub/.gitignore": "*.go\n!keep.go\n", "sub/a.go": "no", "sub/keep.go": "yes", "bad.py": b"a\xffb", "big.py": "x" * 1_000_001, "noext": "no"})
    spark.dataSource.register(TreeSource)
    rows = {r.file_path: r.code for r in spark.read.format("source_tree").load(str(tmp_path)).collect()}
    assert set(rows) == {"__init__.py", "_p.py", ".github/x.yml", "AGENTS.md", "sub/keep.go", "bad.py"} and rows["bad.py"] == "ab"


def test_scoped_patterns():
    assert [scoped_pattern(p, "sub") for p in ("*.log", "!keep.log", "/build", "a/b", "tmp/")] == ["sub/**/*.log", "!sub/**/keep.log", "sub/build", "sub/a/b", "sub/**/tmp/"]
    assert scoped_pattern("*.log", "") == "*.log"
    rules = IgnoreRules(["*.log", "!keep.log", "/top", "dir/", "a/**/z"])
    assert [rules.ignored(p) for p in ("x/y.log", "x/keep.log", "top/f", "sub/top/f", "x/dir/f", "a/b/c/z", "a/z")] == [True, False, True, False, True, True, True]


def _log(spark, rows):
    return spark.createDataFrame([(i, p, op, None, F_ts(s)) for i, (p, op, s) in enumerate(rows)], LOG)


def F_ts(seconds):
    import datetime

    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=seconds)


def test_last_state_wins(spark):
    log = _log(spark, [("r/a", "deleted", 1), ("r/a", "Created", 2), ("r/b", "created", 1), ("r/b", "DELETED", 3), (None, "created", 1), ("r/c", None, 1)])
    assert {(r.file_path, r.state) for r in changes.last_state(log).collect()} == {("r/a", "dirty"), ("r/b", "deleted")}


def test_bursts_end_after_a_pause(spark):
    log = _log(spark, [("r/a", "created", 0), ("r/b", "created", 1), ("r/a", "modified", 3), ("r/a", "modified", 9)])
    assert sorted(r.changes for r in changes.bursts(log).collect()) == [1, 3]


def test_stream_flushes_by_count_and_applies_batches(spark, tmp_path):
    rows = [("r/a" if i % 2 else "r/b", "modified", i) for i in range(120)] + [("s/a", "created", i) for i in range(49)]
    for k in range(3):
        _log(spark, rows[k::3]).write.parquet(str(tmp_path / "log" / f"part={k}"))
    stream = changes.stream_changes(spark, str(tmp_path / "log" / "*"), LOG)
    spark.conf.set("spark.sql.streaming.stateStore.stateSchemaCheck", "false")
    q = changes.count_flushes(stream).writeStream.format("memory").queryName("flushes").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.repo, r.flush) for r in spark.table("flushes").collect()) == [("r", 1), ("r", 2)]
    seen = {"dirty": set(), "deleted": set()}

    def apply(dirty, deleted):
        seen["dirty"] |= {r[0] for r in dirty.collect()}
        seen["deleted"] |= {r[0] for r in deleted.collect()}

    changes.apply_changes(changes.stream_changes(spark, str(tmp_path / "log" / "*"), LOG, 3), apply, str(tmp_path / "c2")).awaitTermination(120)
    assert seen == {"dirty": {"r/a", "r/b", "s/a"}, "deleted": set()}


def test_watermarked_bursts_run(spark, tmp_path):
    _log(spark, [("r/a", "created", 0), ("r/a", "created", 1), ("r/a", "created", 20_000)]).coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = changes.watermarked_bursts(changes.stream_changes(spark, str(tmp_path / "log"), LOG))
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.changes for r in spark.table("bursts").collect()] == [2]
