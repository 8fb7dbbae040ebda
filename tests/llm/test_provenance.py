from sparkseek.llm import provenance as V

SCHEMA = "chunk_id long, file_path string, start_line int, code string, language string, owner string, names long"

WORDS = "parse request cache window handler buffer segment router worker session ledger planner".split()


def hand(i):
    a, b, c = WORDS[i % 12], WORDS[(i * 5 + 1) % 12], WORDS[(i * 7 + 2) % 12]
    return f"import os\n\ndef {a}_{b}({c}, limit=3):\n    {b}_{c} = {c}.{a}(limit)\n    for {a} in {b}_{c}:\n        if {a}.{c} > limit:\n            return {a}\n    return None\n"


def js(i):
    a, b = WORDS[i % 12], WORDS[(i * 5 + 1) % 12]
    return f"export function {a}{b.title()}({b}, limit) {{\n  const {b}{a.title()} = {b}.{a}(limit);\n  return {b}{a.title()};\n}}\n"


GENERATED = "".join(f"def get_field{i}(self):\n    return self.field{i}\n\n" for i in range(30))
MINIFIED = "!function(t,e){" + "".join(f"var {chr(97 + i % 26)}{chr(97 + i // 26)}=function(p){{return p?p.x({i}):null}};" for i in range(200)) + "}(this);"
DATA = "DATA = (\n" + "".join('    "' + "Ab3+/xYz" * 8 + '"\n' for _ in range(40)) + ")\n"


def found(spark, extra):
    rows = [(i, f"r/src/m{i}.py", 1, hand(i), None, "x", 1) for i in range(40)] + [(100 + i, f"r/src/m{i}.js", 1, js(i), None, "x", 1) for i in range(40)]
    rows += [(1000 + k, p, 1, c, None, "x", 1) for k, (p, c) in enumerate(extra)]
    return {r.file_path for r in V.not_handwritten(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_kinds(spark):
    cases = {
        "r/src/a.py": GENERATED, "r/src/b.js": MINIFIED, "r/src/c.py": DATA, "r/src/d.py": "# Code generated by wire. DO NOT EDIT.\n" + hand(1), "r/src/e.py": "# Automatisch erzeugt aus x.xml, nicht bearbeiten!\n" + hand(2),
        "r/src/f.py": "# Copyright (c) the other-project authors.\n" + hand(3), "r/node_modules/x/g.js": js(3), "r/third_party/x/h.py": hand(4), "r/src/generated/i.py": hand(5), "r/src/j.py": "# Copied unchanged from lib 2.1; report bugs upstream.\n" + hand(6),
    }
    clean = {
        "r/vendors/k.py": hand(7), "r/src/vendor_l.py": hand(8), "r/src/min_m.py": hand(9), "r/src/n.py": "# Copyright (c) the r authors.\n" + hand(10), "r/src/o.py": "# This list used to be generated; it is maintained by hand.\n" + hand(11),
        "r/src/p.py": hand(12) + "HEADER = '// Code generated by %s. DO NOT EDIT.'\n", "r/generated.md": "# Generated by hand\n", "r/src/q.py": hand(13) + "STEPS = [" + ", ".join(str(i * i) for i in range(20)) + "]\n",
    }
    assert found(spark, [*cases.items(), *clean.items()]) == set(cases)


def test_names_of_minified_code_have_high_cross_entropy(spark):
    rows = [("javascript", g, 1) for i in range(40) for n in V.names(js(i)) for g in V.trigrams(n)]
    model = V.NameModel(rows)
    assert sum(model.bits("javascript", n) for n in ("parseRequest", "cacheWindow")) < sum(model.bits("javascript", n) for n in ("qz", "xk"))
    assert len({c for n in ("aZ9_$é", "HTTPServer2") for g in V.trigrams(n) for c in g}) <= 40


def test_dirty_rows(spark):
    rows = [(1, "r/a.py", None, GENERATED, None, None, None)] * 2 + [(2, None, 1, GENERATED, None, None, None), (3, "r/b.py", 1, None, None, None, None), (4, "r/c.py", 1, "", None, None, None), (5, "r/d.py", 1, "  \n ", None, None, None), (6, "noext", 1, "x", None, None, None), (7, "r/e.py", 1, hand(1), None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.file_path for r in V.not_handwritten(df).collect()] == ["r/a.py"]
    assert V.not_handwritten(df.limit(0)).count() == 0


def measured(spark, extra, files=None):
    rows = [(i, f"r/src/m{i}.py", 1, hand(i), None, "x", 1) for i in range(40)] + [(100 + i, f"r/src/m{i}.js", 1, js(i), None, "x", 1) for i in range(40)]
    rows += [(1000 + k, p, 1, c, None, "x", 1) for k, (p, c) in enumerate(extra.items())]
    return {r.file_path: r for r in V.file_measures(spark.createDataFrame(rows, SCHEMA), files).collect()}


def test_the_models_decide_without_notices_and_paths(spark):
    stems = "alpha bravo carrier delta engine filter gamma harbor index journal kernel ledger".split()
    series = "".join(f"def read_{s}_field(buf, pos):\n    return buf.{s}_slot\n\n" for s in stems)  # no numbers at all
    got = measured(spark, {"r/src/a.py": GENERATED, "r/src/b.js": MINIFIED, "r/src/c.py": DATA, "r/src/s.py": series})
    verdicts = {p: list(r.reasons) for p, r in got.items() if r.reasons}
    assert verdicts == {"r/src/a.py": ["names of a template"], "r/src/b.js": ["mangled names"], "r/src/c.py": ["data"], "r/src/s.py": ["names of a template"]}
    assert got["r/src/b.js"].cross_entropy > got["r/src/m3.js"].cross_entropy + V.MANGLED_BITS
    assert got["r/src/a.py"].diversity < V.TEMPLATE * got["r/src/m3.py"].diversity


def test_a_foreign_naming_style_is_vendored(spark):
    camel = "".join(f"def {WORDS[i % 12]}{WORDS[(i * 5 + 1) % 12].title()}{WORDS[(i * 7 + 3) % 12].title()}({WORDS[i % 12]}):\n    return {WORDS[i % 12]}.{WORDS[(i + 2) % 12]}{WORDS[(i * 3 + 1) % 12].title()}\n\n" for i in range(24))
    assert list(measured(spark, {"r/src/z.py": camel})["r/src/z.py"].reasons) == ["foreign style"]


def test_sizes_of_files(spark):
    files = spark.createDataFrame([("r/src/m1.py", "h", 1.0, 100), ("r/src/m1.py", "h", 2.0, 150), ("r/src/m2.py", "h", 1.0, 10**9), ("r/src/m3.py", "h", None, None)], "file_path string, file_hash string, mtime double, size long")
    got = measured(spark, {}, files)
    assert got["r/src/m1.py"].size == 150 and got["r/src/m2.py"].size == got["r/src/m2.py"].chars and got["r/src/m3.py"].size == got["r/src/m3.py"].chars


def test_a_notice_behind_a_long_leading_comment(spark):
    text = "# licence text\n" * 200 + "# " + "x" * 600 + "\n# Code generated by wire. DO NOT EDIT.\n" + hand(1)
    assert V.top_notes(text)[0] and not V.top_notes("a = 1\n" * 9 + "# Code generated by wire.\n")[0]
