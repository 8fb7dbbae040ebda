"""p8: the reading level of each document, from the surprisal of its whole prose under trained n-gram models.

For every level an interpolated trigram model (words; characters for Han script) is trained on rated documents. As a rated
document holds sentences of other levels too, the models are refined: sentences are scored by the first models and counted again
for the level that explains them best. Every sentence of a document then gets its surprisal under each level's model and from
these a position between 1 and 4; the document's distribution of positions gives one number, and an isotonic regression over
the rated documents maps it monotonically to graded difficulty. Everything in a document is scored, never a prefix.

How the work is laid out
    Ratings are joined to documents by id (a small shuffle of ratings; texts of rated documents only). All rated documents are used;
    their sentences are taken once and equal ones of a level are counted together, so a round of training reads different sentences
    only. N-grams are counted by Spark, and the tasks get all of them, whatever their language and count. All documents are scored in
    the scan stage, without a shuffle.

Defined cases
    null, empty, blank and code-only texts have no row; null levels are left out; repeated ratings count once; raters who disagree
    are averaged; a document rated at two levels equally often trains the lower one; without any usable rating no document has a
    row; ids that occur twice are scored once (the smallest text); other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.session import cut

#: Held-out rated documents that the regression needs; with fewer it is fitted on the trained ones.
HELD_OUT = 40
LEVELS = (1, 2, 3, 4)
#: Interpolation of trigram, bigram, unigram and uniform estimates.
LAMBDA = (0.5, 0.3, 0.19, 0.01)
#: Refinement rounds, and what a document's own level is worth to its sentences then, in nats.
ROUNDS, LOYALTY = 2, 1.0

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", re.S | re.M)
_TAG = re.compile(r"<(?:br|p|div|li|h\d|tr|td|ul|ol)\b[^<>]{0,200}>|</(?:p|div|li|h\d|tr|td|ul|ol)>", re.I)
_INLINE = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--.*?-->", re.S)
_CODE = re.compile(r"`[^`\n]+`")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)|https?://\S+")
_DROPPED_LINE = re.compile(r"^(?:(?: {4}|\t).*|\s*at \S+\(.*|\s*(?:query>|hits:|\$ |>>> ).*|\s*\|.*\|\s*|\s{0,3}#{1,6}\s.*|\s*[-=*_]{3,}\s*|\s*[^\s.!?。！？]*[{}();]+\s*|\s*(?:import|package|def|func|return|class|public|const|let|var|if|for)\b[^.!?。！？]*[{;:)(]\s*)$")
_PREFIX = re.compile(r"^[ \t]*(?:(?:[>*+-]|//|#|\d{1,3}[.)])[ \t]+)*")
_END = re.compile(r"[.!?。！？\n](?:(?<=[.!?])[\"”»')*_]*\s+(?=[^\sa-zäöüßñáéíóú])|(?<=[。！？])|(?<=\n)\n+)")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W㐀-鿿]+")
#: What a code span becomes: read as a name.
_SPAN = " code_span "
_HAN = re.compile(r"[㐀-鿿]")
_ZERO = re.compile("[\ufeff\u200b\u200c\u200d\u2060\u00ad]")
#: Function words that tell the languages apart (fixed vocabulary).
_FUNCTION = {
    "de": frozenset("der die das und ist nicht ein eine den dem des mit von zu auf für sich wird werden nach wenn bei du wir sie es als auch oder aus im ins".split()),
    "es": frozenset("el la los las de que y es no una un en se por con para del al lo como más está hay esta este cuando o su".split()),
    "en": frozenset("the of and is not a an in to that it with for on as are be this by or at from you we which has have when".split()),
}


def sentences(text: str | None) -> list[tuple[str, ...]]:
    """The sentences of a text's prose as tokens; names in code style, code spans and numbers are one sign each."""
    if not text or not text.strip():
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _ZERO.sub("", text))
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "<" in text:
        text = _INLINE.sub(" ", _TAG.sub("\n", text))
    kept = []
    for line in text.split("\n"):
        if _DROPPED_LINE.match(line):
            kept.append("")
        else:
            listed = re.match(r"\s*(?:[-*+]|\d{1,3}[.)])\s", line)
            kept.append(("\n" if listed else "") + _PREFIX.sub("", line))
    text = "\n".join(kept)
    if "](" in text or "://" in text:
        text = _LINK.sub(r"\1", text)
    text = _CODE.sub(_SPAN, text)
    out = []
    for part in _END.split(text):
        tokens = _PARTS[part]
        if tokens:
            out.append(tokens)
    return out


class _Signs(dict):
    """Word -> token, remembered: names in code style and numbers are one sign each, other words are folded."""

    def __missing__(self, word: str) -> str:
        if word.isdigit():
            sign = "⟦n⟧"
        elif "_" in word or any(c.isdigit() for c in word) or _INNER_CAPITAL.search(word):
            sign = "⟦i⟧"
        else:
            sign = word.lower()
        if len(self) > 500_000:
            self.clear()
        self[word] = sign
        return sign


class _Parts(dict):
    """Part of a text -> its tokens, none for less than two words; remembered, as sentences recur."""

    def __missing__(self, part: str) -> tuple[str, ...]:
        tokens = tuple(map(_SIGNS.__getitem__, _TOKEN.findall(part)))
        if len(tokens) - tokens.count("⟦i⟧") - tokens.count("⟦n⟧") < 2:
            tokens = ()
        if len(self) > 200_000:
            self.clear()
        if len(part) < 1_000:
            self[part] = tokens
        return tokens


_INNER_CAPITAL = re.compile("[a-zäöüß][A-ZÄÖÜ]")
_SIGNS = _Signs()
_PARTS = _Parts()


def language_of(tokens: tuple[str, ...]) -> str:
    """Han script, or the language with most function words."""
    if max(tokens, default="") >= "㐀" and sum(1 for t in tokens if _HAN.match(t)) * 2 > len(tokens):
        return "zh"
    counts = {k: sum(map(v.__contains__, tokens)) for k, v in _FUNCTION.items()}
    best = max(counts, key=lambda k: (counts[k], k))
    return best if counts[best] else "en"


def ngrams(tokens: tuple[str, ...], language: str) -> list[str]:
    """Uni-, bi- and trigrams with the sentence's end, and the language's total."""
    head, one, words = f"{language}\t", ("<", *tokens), (*tokens, ">")
    pairs = [f"{a} {b}" for a, b in zip(one, words, strict=True)]
    return [f"{head}1"] * len(words) + [head + w for w in words] + [head + p for p in pairs] + [f"{head}{a} {p}" for a, p in zip(("<", *one), pairs, strict=False)]


class LevelModels:
    """The four interpolated models over one table of counts."""

    def __init__(self, rows: list[tuple[str, tuple[float, ...]]]) -> None:
        self.counts = dict(rows)
        self.known: dict[tuple[str, ...], tuple[float, ...]] = {}
        self.places: dict[tuple[str, ...], float] = {}
        self.grams: dict[str, dict[tuple[str, str, str], tuple[float, ...]]] = {}
        before: dict[str, list[float]] = {}
        for gram, c in rows:
            head, _, _ = gram.rpartition(" ")
            if head:
                own = before.setdefault(head, [0.0] * 4)
                for k in range(4):
                    own[k] += c[k]
        self.before = before
        self.vocabulary = max(1_000, sum(1 for g in self.counts if " " not in g))

    def _gram(self, language: str, w2: str, w1: str, w: str) -> tuple[float, ...]:
        """Surprisal of one word after two others under each level's model."""
        none, get, head = (0.0,) * 4, self.counts.get, f"{language}\t"
        total, one = get(f"{head}1", none), get(head + w, none)
        h2 = self.before.get(head + w1, none)
        h3 = self.before.get(f"{head}{w2} {w1}", none) if h2 is not none else none
        two = get(f"{head}{w1} {w}", none) if h2 is not none else none
        three = get(f"{head}{w2} {w1} {w}", none) if two is not none and h3 is not none else none
        out = []
        for k in range(4):
            p = LAMBDA[3] / self.vocabulary + LAMBDA[2] * one[k] / (total[k] + 1)
            if h2[k]:
                p += LAMBDA[1] * two[k] / h2[k]
            if h3[k]:
                p += LAMBDA[0] * three[k] / h3[k]
            out.append(-math.log(p))
        return tuple(out)

    def surprisals(self, tokens: tuple[str, ...]) -> tuple[float, ...]:
        """Total surprisal of a sentence under each level's model, in nats."""
        found = self.known.get(tokens)
        if found is not None:
            return found
        language = language_of(tokens)
        memo = self.grams.setdefault(language, {})
        w2, w1 = "<", "<"
        one = two = three = four = 0.0
        for w in (*tokens, ">"):
            bits = memo.get((w2, w1, w))
            if bits is None:
                bits = memo[w2, w1, w] = self._gram(language, w2, w1, w)
            one, two, three, four = one + bits[0], two + bits[1], three + bits[2], four + bits[3]
            w2, w1 = w1, w
        if len(memo) > 1_000_000:
            memo.clear()
        out = (one, two, three, four)
        found = out
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[tokens] = found
        return found

    def position(self, tokens: tuple[str, ...], own: int | None = None) -> tuple[float, int]:
        """A sentence's expected level, and its likeliest one; ``own`` is the level its document was rated at."""
        s = [x - (LOYALTY if own == k + 1 else 0.0) for k, x in enumerate(self.surprisals(tokens))]
        low = min(s)
        weights = [math.exp(low - x) for x in s]
        return sum((k + 1) * w for k, w in enumerate(weights)) / sum(weights), s.index(low) + 1


    def place(self, tokens: tuple[str, ...]) -> float:
        """``position`` of a sentence of any document, remembered."""
        found = self.places.get(tokens)
        if found is None:
            if len(self.places) > 300_000:
                self.places.clear()
            found = self.places[tokens] = self.position(tokens)[0]
        return found


def summary(positions: list[float]) -> float:
    """One number for a document's distribution: the level of most of its sentences, shifted towards their mean."""
    nearest = Counter(min(4, max(1, round(p))) for p in positions)
    most = max(nearest, key=lambda k: (nearest[k], -k))
    mean = sum(positions) / len(positions)
    return most + 0.3 * max(-1.0, min(1.0, mean - most))


def _rated(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """``(doc_id, text, label, graded)`` of all rated documents."""
    usable = ratings.filter(F.col("doc_id").isNotNull() & F.col("level").between(1, 4)).select("doc_id", "level", "rater", "rated_at").distinct()
    votes = usable.groupBy("doc_id", "level").count()
    order = Window.partitionBy("doc_id").orderBy(F.desc("count"), "level")
    label = votes.withColumn("n", F.row_number().over(order)).groupBy("doc_id").agg(F.max(F.when(F.col("n") == 1, F.col("level"))).cast("int").alias("label"), (F.sum(F.col("level") * F.col("count")) / F.sum("count")).alias("graded"))
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    return texts.join(label, "doc_id").groupBy("doc_id", "label", "graded").agg(F.min("text").alias("text"))


_LOADED: dict[str, LevelModels] = {}


def _worker_models(shared) -> LevelModels:
    """The models of a (key, broadcast table of counts), built once per worker."""
    key, table = shared
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = LevelModels(table.value)
    return _LOADED[key]


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The different sentences of each batch by level, their tokens parted by spaces, and how often each occurs."""
    for pdf in batches:
        whole: Counter = Counter()
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            whole.update((" ".join(s), int(label)) for s in sentences(text))
        yield pd.DataFrame([(s, lv, n) for (s, lv), n in whole.items()], columns=["sentence", "label", "n"])


def _count(shared):
    """N-gram counts of each batch of sentences by level: the document's own at first, the sentence's likeliest afterwards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = _worker_models(shared) if shared else None
        for pdf in batches:
            counts: dict[int, Counter] = {k: Counter() for k in LEVELS}
            for sentence, label, n in zip(pdf["sentence"].tolist(), pdf["label"].tolist(), pdf["n"].tolist(), strict=True):
                s = tuple(sentence.split(" "))
                own = counts[models.position(s, label)[1] if models else label]
                if n == 1:
                    own.update(ngrams(s, language_of(s)))
                else:
                    for gram in ngrams(s, language_of(s)):
                        own[gram] += n
            yield pd.DataFrame([(g, lv, n) for lv, own in counts.items() for g, n in own.items()], columns=["gram", "level", "n"])

    return run


def train(rated: DataFrame):
    """The n-gram counts after ROUNDS refinements, as (key, broadcast of every n-gram's counts by level). Counting is a Spark job each time."""
    shared = None
    taken = rated.select("text", "label").mapInPandas(_sentences, "sentence string, label int, n long")
    taken = cut(taken.groupBy("sentence", "label").agg(F.sum("n").alias("n")))  # read in every round
    for _ in range(ROUNDS + 1):
        counted = taken.mapInPandas(_count(shared), "gram string, level int, n long")
        table = counted.groupBy("gram").agg(*[F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).cast("double").alias(f"c{k}") for k in LEVELS])
        rows = [(r[0], (r[1], r[2], r[3], r[4])) for r in table.toPandas().itertuples(index=False)]
        shared = uuid.uuid4().hex, rated.sparkSession.sparkContext.broadcast(rows)
    return shared


def _score(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = _worker_models(shared)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                positions = list(map(models.place, sentences(text)))
                if positions:
                    q = sorted(positions)
                    rows.append((doc_id, summary(positions), sum(q) / len(q), q[len(q) // 4], q[len(q) // 2], q[3 * len(q) // 4], len(q)))
            yield pd.DataFrame(rows, columns=["doc_id", "x", "mean", "q25", "median", "q75", "sentences"])

    return run


_SCORES = "doc_id long, x double, mean double, q25 double, median double, q75 double, sentences long"


def document_levels(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """``(doc_id, graded, level, mean, q25, median, q75, sentences)`` of every document that has prose."""
    spark = documents.sparkSession
    rated = cut(_rated(documents, ratings))
    if rated.isEmpty():
        return spark.createDataFrame([], "doc_id long, graded double, level long, mean double, q25 double, median double, q75 double, sentences long")
    # the n-grams are trained on three documents of four, the regression on the others; on all where there are too few
    other = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(4)) == 0
    held_out = rated.filter(other)
    enough = held_out.count() >= HELD_OUT
    shared = train(rated.filter(~other) if enough else rated)
    vector = VectorAssembler(inputCols=["x"], outputCol="features")
    scored = (held_out if enough else rated).select("doc_id", "text").mapInPandas(_score(shared), _SCORES).join(rated.select("doc_id", "graded"), "doc_id")
    points = vector.transform(scored.select("x", F.col("graded").alias("label")))
    fitted = IsotonicRegression(featuresCol="features", labelCol="label", predictionCol="graded").fit(points)
    # the fitted step function as an expression, so that scoring stays one narrow stage
    xs, ys = fitted.boundaries.toArray().tolist(), fitted.predictions.toArray().tolist()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    out = rows.mapInPandas(_score_graded(shared, xs, ys), _SCORES + ", graded double")
    level = F.greatest(F.lit(1), F.least(F.lit(4), F.floor(F.col("graded") + 0.5))).cast("long")
    again = rows.groupBy("doc_id").count().filter("count > 1")
    if not again.isEmpty():
        out = rows.groupBy("doc_id").agg(F.min("text").alias("text")).mapInPandas(_score_graded(shared, xs, ys), _SCORES + ", graded double")
    return out.select("doc_id", "graded", level.alias("level"), "mean", "q25", "median", "q75", "sentences")


def _score_graded(shared, xs: list[float], ys: list[float]):
    score = _score(shared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in score(batches):
            yield pdf.assign(graded=np.interp(pdf["x"], xs, ys) if len(pdf) else pd.Series(dtype="float64"))

    return run


def levels(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """``(doc_id, level)`` of every document that has prose."""
    return document_levels(documents, ratings).select("doc_id", "level")
