import pytest

from sparkseek.llm import splitting as P

SCHEMA = "chunk_id long, file_path string, symbol string, start_line int, end_line int, code string, language string, piece int"


def covers(code, start, pieces, limit=4_000):
    lines = code.split("\n")
    at = 0
    for p in pieces:
        assert len(p["code"]) <= limit and p["shared_lines"] <= 10
        first = p["start_line"] - start
        if max(map(len, lines)) < 1_000:
            assert p["code"].split("\n") == lines[first : p["end_line"] - start + 1]
            assert first + p["shared_lines"] == at
            at = p["end_line"] - start + 1
    assert pieces[0]["start_line"] == start and pieces[-1]["end_line"] == start + len(lines) - 1


PY = "import os\n\n\n" + "\n".join(f"# about {i}\n@dec\ndef f{i}(a):\n" + "\n".join(f"    x = {j} + 1" for j in range(40)) + "\n" for i in range(12))


def test_pieces_cover_the_chunk_and_begin_at_definitions():
    pieces = P.pieces(PY, "a.py", "top", 11)
    covers(PY, 11, pieces)
    assert len(pieces) > 1
    for p in pieces[1:]:
        assert p["code"].split("\n")[p["shared_lines"]].startswith("# about")
    assert pieces[1]["symbol"].startswith("f")


@pytest.mark.parametrize("size", [3_999, 4_000])
def test_small_chunks_stay_whole(size):
    assert len(P.pieces("x" * size, "a.py", None, 1)) == 1


def test_long_lines_are_cut_between_characters():
    code = "a = 1\n" + "y" * 9_500 + "\nb = 2"
    pieces = P.pieces(code, "a.js", None, 1)
    covers(code, 1, pieces)
    assert sum(p["code"].count("y") for p in pieces) == 9_500


def test_natural_lines():
    java = "/**\n * Doc.\n */\n@A(1)\npublic class X {\n\n    // note\n    @Override\n    public List<String> f(int a) {\n        g(a);\n        return new A(b);\n    }\n\n    X() {\n    }\n}\n\ninterface Y {\n}\n"
    assert sorted(P.natural_lines(java, "X.java")) == [0, 6, 13, 17]
    go = "package a\n\n// doc\nfunc (a *A) F() {\n\tfor {\n\t}\n}\n\ntype B struct {\n}\n\nvar x = `\nfunc no() {\n`\n"
    assert sorted(P.natural_lines(go, "a.go")) == [2, 8]
    c = "#include <a.h>\nstruct a {\n};\n\n/* doc */\nstatic int f(struct a *b)\n{\n    g(b);\n    return 0;\n}\nint h(void);\n"
    assert sorted(P.natural_lines(c, "a.c")) == [1, 4]
    ts = "export interface A {\n}\nconst s = `\nclass No {\n`;\nexport async function f(a: string) {\n  if (a) {\n  }\n}\nclass B {\n  // x\n  private g(a: A): void {\n  }\n}\ntype T = A | B;\n"
    assert sorted(P.natural_lines(ts, "a.ts")) == [0, 5, 9, 10, 14]
    md = "# One\ntext\n```\n# not\n```\n    # not\n## Two\n#nor this\n"
    assert sorted(P.natural_lines(md, "a.md")) == [0, 6]
    py = "class A:\n    # c\n    async def f(self):\n        '''\n        def no():\n        '''\n\n    x = 1\n"
    assert sorted(P.natural_lines(py, "a.py")) == [0, 1]
    assert P.natural_lines("def f():\n", None) == {} and P.natural_lines("a: 1\n", "a.yml") == {}


def test_a_chunk_that_begins_inside_a_comment():
    code = " * more\n */\npublic void f() {\n}\n"
    assert sorted(P.natural_lines(code, "A.java")) == [0]


def test_dirty_rows(spark):
    rows = [(1, "a.py", None, 1, None, PY, "x", 3)] * 2 + [(2, None, "s", None, 5, "word " * 2_000, None, 3), (3, "a.py", "", 1, 1, None, None, 3), (4, "a.py", "", 1, 1, "", None, 3), (5, "a.py", "", 1, 1, "x = 1", None, 3), (None, "a.py", "", 1, 1, PY, None, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {tuple(r) for r in P.natural_boundaries(df).collect()}
    assert (1, 1) in found and (2, 1) in found and {c for c, _ in found} == {1, 2} and len([1 for c, _ in found if c == 1]) == 13
    out = P.split_oversized(df).collect()
    assert {r.chunk_id for r in out} == {1, 2} and len(out) == len({(r.chunk_id, r.piece) for r in out})
    assert P.natural_boundaries(df.limit(0)).count() == 0 and P.split_oversized(df.limit(0)).count() == 0


def test_boundaries_come_out_of_the_merging(spark):
    code = "".join(f"def f{i}(a):\n    x = a\n\n    return x + {i}\n\n\n" for i in range(200))
    df = spark.createDataFrame([(1, "a.py", "f", 1, code), (1, "a.py", "f", 1, code), (2, "b.py", None, 1, "x = 1\n")], "chunk_id long, file_path string, symbol string, start_line int, code string")
    rows = P.boundaries(df).collect()
    found = {r.line_no for r in P.natural_boundaries(df).collect()}
    assert {r.chunk_id for r in rows} == {1} and found == {r.line_no for r in rows if r.natural} and len(found) == 200
    starts = {p["start_line"] + p["shared_lines"] for p in P.pieces(code, "a.py", "f", 1)}
    assert {r.line_no for r in rows if r.kept} == starts and all(r.natural for r in rows if r.kept)
    report = {(r.language, r.natural): (r.boundaries, r.cuts) for r in P.cut_report(df).collect()}
    assert report["python", True][1] == len(starts) and report["python", False][1] == 0
