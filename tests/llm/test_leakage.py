import random

from sparkseek.llm import leakage as L

DOCS, ITEMS = "doc_id long, text string, lang string, item_id long", "item_id long, text string, query string, lang string"
random.seed(5)
WORDS = [f"{a}{b}" for a in ("har", "bel", "tor", "quin", "mos", "var", "del", "sel") for b in ("ba", "kin", "dor", "mel", "tus", "nif", "gra", "po")]
ITEM = " ".join(random.choice(WORDS) for _ in range(60)) + ". It takes 35 seconds in FooBar."
OTHER = " ".join(random.choice(WORDS) for _ in range(80))
HAN = random.Random(3)
ZH = "".join(HAN.choice("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动") for _ in range(80))


def leaks(spark, docs, items=((1, ITEM), (2, ZH))):
    d = spark.createDataFrame([(i, t, None, 7) for i, t in docs], DOCS)
    return {tuple(r) for r in L.leaked(d, spark.createDataFrame([(i, t, "q", None) for i, t in items], ITEMS)).collect()}


def test_copies_in_any_dress(spark):
    w = ITEM.split()
    exchanged = w[:]
    for i in range(4, len(w), 10):
        exchanged[i] = "other"
    dressed = "\n".join("> " + " ".join(w[i : i + 8]).upper() + "<br/>" for i in range(0, len(w), 8))
    docs = [(1, f"{OTHER} {ITEM} {OTHER}"), (2, f"{OTHER}\n{dressed}\n{OTHER}"), (3, " ".join(exchanged)), (4, f"{OTHER} {' '.join(w[10:40])} {OTHER}"), (5, "文" * 30 + ZH[5:45] + "字" * 30), (6, "\n".join(f"{k}. " + " ".join(w[i : i + 9]) for k, i in enumerate(range(0, len(w), 9))))]
    assert leaks(spark, docs) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 1)}


def test_exchanged_signs_and_mixed_scripts(spark):
    w = ITEM.split()
    zh = [c if i % 10 != 9 else "某" for i, c in enumerate(ZH[5:37])]
    run = WORDS[5:17]
    run[6] = "other"
    docs = [(1, "文" * 30 + "".join(zh) + "字" * 30), (2, f"{OTHER} {ZH[5:45]} {OTHER}"), (3, "文" * 200 + " " + " ".join(w[10:40]) + " " + "字" * 200), (4, f"{OTHER} {' '.join(run)} {OTHER}")]
    assert leaks(spark, docs, [(1, ITEM), (2, ZH), (3, " ".join(WORDS[:30]))]) == {(1, 2), (2, 2), (3, 1), (4, 3)}


def test_fewest_windows_of_a_leaked_run():
    # 12 words: a run of 5 whole ones; 25: 10 with one exchanged; 80: 32 with three
    assert [L.least_hits(n) for n in (12, 25, 80)] == [1, 1, 13] and L.least_hits(80, 20) == 1


def test_what_is_no_leak(spark):
    w = ITEM.split()
    half = [x if i % 2 else "new" for i, x in enumerate(w)]
    docs = [(1, OTHER), (2, f"{OTHER} {' '.join(w[:15])} {OTHER}"), (3, " ".join(half)), (4, ZH[:20]), (5, None), (6, ""), (7, " \n ")]
    assert leaks(spark, docs) == set()


def test_repeated_rows_and_empty_tables(spark):
    assert leaks(spark, [(1, ITEM), (1, ITEM)], [(1, ITEM), (1, ITEM), (3, None), (4, "")]) == {(1, 1)}
    assert leaks(spark, [(1, ITEM)], []) == set() and leaks(spark, []) == set()


def test_renamed_slots_are_told_from_copies(spark):
    sentence = "when {a} reads {n} parts the {b} step waits until {a} has closed the file and {b} reports that all {n} parts of the batch were kept in order by {a} before {b}"
    item = sentence.format(a="load_file", b="send_row", n=12)
    renamed = sentence.format(a="open_page", b="keep_line", n=77)
    d = spark.createDataFrame([(1, renamed, None, 7), (2, item, None, 7)], DOCS)
    i = spark.createDataFrame([(1, item, "q", None)], ITEMS)
    assert {(r.doc_id, r.kind) for r in L.leaks(d, i).collect()} == {(1, "renamed"), (2, "copy")}


def test_longest_run_against_brute_force():
    rng = random.Random(2)
    for _ in range(20):
        item = L._CODES.of([rng.choice(WORDS) + str(k) for k in range(50)], False)
        doc = item.copy()
        changed = sorted(rng.sample(range(50), 12))
        doc[changed] = 7
        best = max((b - a for a in range(51) for b in range(a, 51) if sum(a <= c < b for c in changed) <= L.EXCHANGED * (b - a) + 1e-9), default=0)
        share = L.aligned_run(L.Text(doc), L.Text(item))[0]
        assert abs(share * 50 - best) < 1e-6 if best >= L.LEAKED * 50 else share <= best / 50 + 1e-9


def test_short_and_repetitive_items(spark):
    docs = [(1, "before " + "alpha bravo carrier delta engine filter gamma" + " after"), (2, "la " * 40 + OTHER), (3, "alpha bravo carrier delta"), (4, "alpha bravo carrier delta engine")]
    items = [(1, "Alpha bravo carrier, delta engine filter gamma!"), (2, "la " * 30), (3, "alpha bravo carrier delta")]
    assert leaks(spark, docs, items) == {(1, 1), (2, 2), (4, 1)}


def test_renamed_items_say_how(spark):
    sentence = "when {a} reads {n} parts the {b} step waits until {a} has closed the file and {b} reports that all {n} parts of the batch were kept in order by {a} before {b}"
    d = spark.createDataFrame([(1, sentence.format(a="open_page", b="keep_line", n=77), None, 7), (1, sentence.format(a="open_page", b="keep_line", n=77), None, 7)], DOCS)
    i = spark.createDataFrame([(1, sentence.format(a="load_file", b="send_row", n=12), "q", None)], ITEMS)
    assert [(r.doc_id, r.item_id, r.slots) for r in L.renamed(d, i).collect()] == [(1, 1, "load_file -> open_page, 12 -> 77, send_row -> keep_line")]


def test_both_joins_give_the_same(spark, monkeypatch):
    docs, items = [(1, f"{OTHER} {ITEM}"), (2, OTHER), (3, ZH)], ((1, ITEM), (2, ZH))
    wanted = leaks(spark, docs, items)
    monkeypatch.setattr(L, "broadcast_if_small", lambda df, *_: df)
    assert leaks(spark, docs, items) == wanted == {(1, 1), (3, 2)}
