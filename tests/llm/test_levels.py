import random

from sparkseek.llm import levels as R

DOCS, RATINGS = "doc_id long, text string, level int, lang string", "doc_id long, level int, rater string, rated_at timestamp"
STYLE = {
    1: ["The {n} is {a}.", "We open the {n}.", "You can see the {n}.", "It is a {a} {n}."],
    2: ["When the {n} stops, check the {a} page and run the import again.", "The {n} shows how many files were read and how long it took.", "You will find the {n} next to the {a} list in the same folder."],
    3: ["Because the {n} runs before {a} validation, any change should be reviewed against the latency budget that operations agreed on.", "Teams that maintain several repositories benefit from enabling the {n}, provided that the {a} permissions are consistent."],
    4: ["Notwithstanding the methodological limitations inherent in {a} {n} estimation, our investigation demonstrates dependable characterisations of epistemological configurations.", "Whereas antecedent investigations operationalised the {n}, the present contribution foregrounds its {a} constitutive indeterminacy."],
}
NOUNS, ADJECTIVES = "cache window ledger planner router session".split(), "small open late cold slow big".split()


def document(rng, level):
    own = [rng.choice(STYLE[level]) for _ in range(14)] + [rng.choice(STYLE[rng.choice([1, 2, 3, 4])]) for _ in range(4)]
    rng.shuffle(own)
    return "# Title\n\n" + " ".join(s.format(n=rng.choice(NOUNS), a=rng.choice(ADJECTIVES)) for s in own) + "\n\n```\nint x = 1;\n```\n"


def test_held_out_accuracy_and_dirty_rows(spark):
    rng = random.Random(4)
    truth = {i: 1 + i % 4 for i in range(160)}
    docs = [(i, document(rng, lv), 9, None) for i, lv in truth.items()]
    docs += [(900, None, None, None), (901, "", None, None), (902, " \n\t ", None, None), (903, "```\nint f() { return 1; }\n```", None, None), (904, document(rng, 1) * 60, None, None)]
    noisy = [(i, min(4, max(1, truth[i] + (1 if i % 13 == 0 else 0))), "r1", None) for i in range(100)]
    ratings = noisy + noisy[:20] + [(i, truth[i], "r2", None) for i in range(0, 100, 3)] + [(5, None, "r3", None), (None, 2, "r1", None), (7777, 3, "r1", None)]
    d, r = spark.createDataFrame(docs, DOCS), spark.createDataFrame(ratings, RATINGS)
    got = {x.doc_id: x.level for x in R.levels(d, r).collect()}
    held = [i for i in truth if i >= 100]
    assert sum(got[i] == truth[i] for i in held) >= 0.93 * len(held)
    assert not {900, 901, 902, 903} & set(got) and got[904] == 1 and len(got) == 161
    assert R.levels(d, r.limit(0)).count() == 0 and R.levels(d.limit(0), r).count() == 0


def test_only_prose_counts():
    text = "# Heading here\n\nThis is one sentence. And `code` is two!\n\n    indented code here\n\n| a | b |\n\n```py\ndef f(): pass\n```\n- a point of a list\n    at Foo.bar(Baz:12)\n"
    assert R.sentences(text) == [("this", "is", "one", "sentence"), ("and", "⟦i⟧", "is", "two"), ("a", "point", "of", "a", "list")]
    assert R.sentences("这个表格不慢。名字在哪里？") == [tuple("这个表格不慢"), tuple("名字在哪里")]
    assert R.sentences(None) == [] and R.sentences("```\nx = 1\n```") == []


def test_surprisal_is_lowest_under_the_own_model():
    counts = {}
    for level, own in STYLE.items():
        for s in own:
            for g in R.ngrams(R.sentences(s)[0], "en"):
                counts.setdefault(g, [0.0] * 4)[level - 1] += 1
    models = R.LevelModels([(g, tuple(c)) for g, c in counts.items()])
    for level, own in STYLE.items():
        assert models.position(R.sentences(own[0].format(n="page", a="new"))[0])[1] == level


def test_no_ngram_is_dropped(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["".join(letters[i // 26**k % 26] for k in range(4)) for i in range(60_000)]
    zh = "".join(chr(0x4E00 + i) for i in range(3_000)) + "。"
    rated = spark.createDataFrame([(1, " ".join(names) + ".", 1), (2, zh, 2)], "doc_id long, text string, label int")
    table = dict(R.train(rated)[1].value)
    wanted = {g for text in (" ".join(names), zh) for s in R.sentences(text) for g in R.ngrams(s, R.language_of(s))}
    assert len(wanted) > 180_000 and set(table) == wanted


def test_every_rated_document_is_used(spark):
    """only 4,000 were."""
    docs = spark.range(4_600).selectExpr("id as doc_id", "concat('The page ', repeat('x', int(id)), ' is open.') as text", "1 as level", "'en' as lang")
    ratings = spark.range(4_600).selectExpr("id as doc_id", "int(id % 4) + 1 as level", "'r' as rater", "timestamp'2026-01-01' as rated_at")
    assert R._rated(docs, ratings).count() == 4_600


def test_what_recurs_is_worked_out_once(monkeypatch):
    """The words of every sentence were looked up and its place reckoned again, however often it stood in the texts."""
    R._PARTS.clear()
    looked = []
    monkeypatch.setattr(R, "_SIGNS", type("S", (dict,), {"__missing__": lambda self, w: looked.append(w) or w.lower()})())
    found = [R.sentences("The page is open. 这个表格不慢。Read it!\n\n\nGo on now.") for _ in range(50)]
    assert found[0] == [("the", "page", "is", "open"), tuple("这个表格不慢"), ("read", "it"), ("go", "on", "now")] and all(x == found[0] for x in found)
    assert len(looked) == 15
    models = R.LevelModels([(g, (1.0, 0.0, 0.0, 2.0)) for g in R.ngrams(("the", "page"), "en")])
    placed = []
    monkeypatch.setattr(models, "position", lambda s, f=models.position: placed.append(s) or f(s))
    assert len({models.place(("the", "page")) for _ in range(50)}) == 1 and len(placed) == 1
    R._PARTS.clear()
