import pytest
import tiktoken

from sparkseek.llm import tokens as E

PATH = f"{E.VOCABULARIES}/byte_bpe_50k.tiktoken"
TEXTS = ["", " ", "Hello world", "a" * 3_000, "aaa aa a", "\n\n  \t x\r\n", "naïve café — “quotes” 中文文本没有空格 العربية हिन्दी 👩‍💻", "<|endoftext|> x", "def f(x):\n    return x+1  # don't", "\x00\x1c\x85\u2028\ufeff", "e\u0301" * 50, "1234567 ½ ²", "'s 'LL it's we'll", "中" * 4_000]


@pytest.fixture(scope="module")
def index():
    return E.PairIndex(PATH)


def test_equals_the_reference_encoder(index):
    reference = tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=index.ranks, special_tokens={})
    import regex

    pieces = sorted({p for t in TEXTS for p in regex.findall(E.PATTERN, t)})
    for piece, ids in zip(pieces, index.encode([p.encode() for p in pieces]), strict=True):
        assert ids == reference.encode_ordinary(piece), piece


def test_documents_round_trip(spark, index):
    reference = tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=index.ranks, special_tokens={})
    rows = [(i, t, ["clash"], "en") for i, t in enumerate(TEXTS)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<string>, lang string")
    got = {r.doc_id: list(r.ids) for r in E.encode_once(df).collect()}
    assert got.pop(99) == [] and got == {i: reference.encode_ordinary(t) for i, t in enumerate(TEXTS)}
    words = {v: k for k, v in index.ranks.items()}
    assert all(b"".join(words[i] for i in ids).decode() == TEXTS[k] for k, ids in got.items())


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (2, ""), (3, None), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.ids)) for r in E.encode_once(df).collect()) == [(1, 2), (2, 0), (3, 0)]
    assert E.encode_once(df.limit(0)).count() == 0
    assert E.encode(df).count() == 5
