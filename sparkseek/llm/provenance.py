"""p5: generated, minified, vendored and data files among source code, by models of how names are written.

A character trigram model of the identifiers of each language is counted over the whole corpus. Every file is then measured:
    mangled     its names' cross-entropy under its own language's model stands MANGLED_BITS above that of the language's median file:
                minified or bundled code;
    template    its names have low diversity (the perplexity of their trigrams, numbers taken as one, is under TEMPLATE of the
                language's median file) and many share one frame (first word and number of words): generated code;
    data        almost all characters stand on lines of literals, and few names stand in so large a file: data stored as code;
    foreign     its naming style (camel against snake case) is another than its repository's in that language, although its own
                language's model still explains its names best: a vendored copy.
What a file says of itself only adds to that: a generator's notice in its leading comment (not denied), another project's licence or
origin notice, and directories or names that package managers, bundlers and generators use for their output.

How the work is laid out
    Chunks are measured where they are scanned, in two passes (counting, then measuring); only trigram counts and one small row of
    measures per chunk are shuffled, never code, and the measures of the files are written once before they are compared. The model
    sent to the tasks is bounded by the folded alphabet: at most 40^3 trigrams for each of the languages. A file's size is the
    newest one in the table of files that is near the number of its characters, and that number otherwise.

Defined cases
    null, empty and blank code measures nothing; files of other extensions than LANGUAGES are no cases; repeated rows count once (in the model of names they weigh as often as they occur);
    a null start line counts as 1; null paths are left out; a path that occurs twice is one file; a file without a row, or with a
    null or wrong size, counts with its characters; no names are
    mangled in a language of which the corpus holds too few (MODEL_GRAMS); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.operators.corpus import latest_fingerprints
from sparkseek.session import cut

#: Extension -> language of the files that are measured.
LANGUAGES = {"py": "python", "java": "java", "go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "c": "c", "h": "c"}
#: Lines longer than this are very long (for banners and styles); shares from which data and foreign styles hold (parameters).
LONG_LINE, DATA, FOREIGN = 500, 0.6, 0.6
#: Bits per sign above the language's median file from which names count as mangled; share of the median diversity under which, and
#: share of names in one frame above which, they count as template-like; fewest names for either verdict.
MANGLED_BITS, TEMPLATE, FRAME, MANGLED_NAMES, TEMPLATE_NAMES = 3.0, 0.69, 0.12, 5, 10
#: Bounds of the medians, for a language of which most files are minified or generated.
MOST_BITS, LEAST_DIVERSITY = 3.5, 9.0
#: Trigrams that a language's model needs before its cross-entropies say anything.
MODEL_GRAMS = 2_000
#: Names that a kilobyte of data stored as code has at most.
DATA_NAMES = 8

#: Literals and comments match without a group, names with one.
_NAME = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|//[^\n]*|#[^\n]*|/\*.*?\*/|\d[\w$]*|([A-Za-z_$][\w$]*)", re.S)
_DATA_LINE = re.compile(r"[\s\"'0-9a-fA-Fx.,+/=\[\](){}<>;:bru_-]*|[\s\"'`]*(?:b|r)?[\"'`]?[A-Za-z0-9+/=]{40,}[\"'`]?[\s,;+\\)]*")
_DIGITS, _WORDS = re.compile(r"\d+"), re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_CAMEL, _SNAKE = re.compile("[a-z][A-Z]"), re.compile("[a-z]_[a-z]")

#: How generators mark their output, in the first comment lines (fixed vocabulary, several languages).
_GENERATED = re.compile(
    r"^\W*(?:@generated\b|<auto-?generated>|(?:this (?:file|code) (?:is|was|has been) )?(?:auto(?:matically)?[- ]?)?generated (?:by|from|with|using|code|file)\b|auto-?generated\b|(?:this (?:file|code) (?:is|was|has been) )?(?:produced|created|written) (?:automatically|by a tool|by the)\b"
    r"|code generated\b|output of:?\s|.*\bdo not (?:edit|modify)\b|automatisch (?:erzeugt|generiert)|.*自动生成|.*自動生成|généré automatiquement|generado automáticamente|.*changes (?:are|will be) lost on the next)",
    re.I,
)
_DENIED = re.compile(r"used to be|no longer|not generated|formerly|once generated|by hand since|maintained by hand|handgeschrieben", re.I)
_NOTICE = re.compile(r"(?:copyright\s*)?(?:\(c\)|©)\s*(?:\d{4}(?:\s*-\s*\d{4})?,?\s*)?(?:the\s+)?([\w.-]+)\s+(?:authors|contributors|developers|project|team)|copyright\s+(?:the\s+)?([\w.-]+)\s+(?:authors|contributors|project)", re.I)
_ORIGIN = re.compile(r"copied (?:unchanged |verbatim )?from|^\W*upstream:|vendored from|original licen[cs]e|original source:|report bugs upstream|imported from https?:", re.I | re.M)
_BANNER = re.compile(r"^/\*!\s*[\w.-]+ v?\d")
_PATH_VENDORED = re.compile(r"(?:^|/)(?:third[_-]?party|3rdparty|node_modules|vendor|external|extern|deps|bower_components|site-packages|Godeps)/", re.I)
_PATH_GENERATED = re.compile(r"(?:^|/)(?:generated|gen|generated-sources|autogen|__generated__)/|(?:^|/)zz_generated[._][^/]*$|\.(?:generated|g)\.\w+$", re.I)
_PATH_BUNDLED = re.compile(r"[.-](?:min|bundle|chunk)\.(?:js|mjs|cjs|jsx)$", re.I)


def folded(name: str) -> str:
    """A name over the model's alphabet of at most 40 signs: lower case, one sign each for digits, capitals' starts and others."""
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "^", name)
    return re.sub(r"[^a-z_^0]", "?", re.sub(r"\d", "0", name.lower()))


def trigrams(name: str) -> list[str]:
    padded = f"<<{folded(name)}>"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def _language(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None


def names(code: str) -> set[str]:
    """The different names of a piece of code, without those in strings and comments."""
    found = set(_NAME.findall(code))
    found.discard("")
    return found


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts of each batch; names of one or two letters teach nothing about how a language's names are written."""
    for pdf in batches:
        by: dict[str, Counter] = {}
        for path, code in zip(pdf["file_path"], pdf["code"], strict=True):
            own = by.setdefault(_language(path), Counter())
            own.update(n for n in names(code) if len(n) > 2)
        rows = []
        for language, counted in by.items():
            grams: Counter = Counter()
            for name, n in counted.items():
                for gram in trigrams(name):
                    grams[gram] += n
            rows += [(language, g, n) for g, n in grams.items()]
        yield pd.DataFrame(rows, columns=["language", "gram", "n"])


class NameModel:
    """Interpolated character trigram models, one per language."""

    def __init__(self, rows: list[tuple[str, str, int]]) -> None:
        self.three: dict[str, dict[str, float]] = {}
        counts: dict[str, Counter] = {}
        for language, gram, n in rows:
            counts.setdefault(language, Counter())[gram] += n
        for language, three in counts.items():
            two, one, after, total = Counter(), Counter(), Counter(), sum(three.values())
            for g, n in three.items():
                two[g[:2]] += n
                after[g[1:]] += n
                one[g[2]] += n
            mid: Counter = Counter()
            for g, n in after.items():
                mid[g[0]] += n
            uniform = 1 / 40
            self.three[language] = {g: -math.log2(0.7 * n / two[g[:2]] + 0.2 * after[g[1:]] / mid[g[1]] + 0.09 * one[g[2]] / total + 0.01 * uniform) for g, n in three.items()}
        self.unseen = -math.log2(0.01 / 40)

    def bits(self, language: str, name: str) -> float:
        """Cross-entropy of a name, bits per sign."""
        own = self.three.get(language, {})
        grams = trigrams(name)
        return sum(own.get(g, self.unseen) for g in grams) / len(grams)


def top_notes(code: str) -> tuple[bool, str, bool]:
    """(generator's notice, whose licence notice, origin notice) of a file's leading comments, however long: up to its fourth line
    of code."""
    generated, owner, origin = False, "", False
    block = False
    seen = 0
    for line in code.split("\n"):
        text = line.strip()
        if not text:
            continue
        comment = block or text.startswith(("//", "#", "/*", "*", "--", '"""', "'''", ";", "<!--"))
        if text.startswith(("/*", '"""', "'''", "<!--")) and not re.search(r".(?:\*/|\"\"\"|'''|-->)", text[1:]):
            block = True
        elif block and re.search(r"\*/|\"\"\"|'''|-->", text):
            block = False
        if not comment or text.startswith(("#include", "#define", "#pragma", "#if", "#end")):
            seen += 1
            if seen > 3:
                break
            continue
        if _GENERATED.search(text) and not _DENIED.search(text):
            generated = True
        found = _NOTICE.search(text)
        if found and not owner:
            owner = (found.group(1) or found.group(2)).lower()
        origin |= bool(_ORIGIN.search(text)) and not _DENIED.search(text)
    return generated, owner, origin


class Measured:
    """What is measured of one name, remembered by the worker."""

    __slots__ = ("bits", "camel", "frame", "grams", "snake")

    def __init__(self, model: NameModel, language: str, name: str) -> None:
        self.bits = model.bits(language, name)
        self.camel, self.snake = bool(_CAMEL.search(name)), bool(_SNAKE.search(name))
        words = _WORDS.findall(name) if len(name) > 2 else ()
        self.frame = (words[0].lower(), len(words)) if len(words) > 1 else None
        self.grams = np.array([sum(_SIGN[c] * 40**i for i, c in enumerate(g)) for g in trigrams(_DIGITS.sub("0", name))], dtype=np.int32) if len(name) > 2 else None


#: The folded alphabet and the padding, numbered.
_SIGN = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz_^0?<>")}


def diversity(own: list[Measured]) -> tuple[int, float, float]:
    """(names, perplexity of their trigrams against the root of their number, share of the commonest frame), of names that are not
    short. Names made from a template repeat their trigrams and their frame."""
    grams = [m.grams for m in own if m.grams is not None]
    if len(grams) < 4:
        return 0, 0.0, 0.0
    counts = np.unique(np.concatenate(grams), return_counts=True)[1]
    total = int(counts.sum())
    bits = math.log2(total) - float((counts * np.log2(counts)).sum()) / total
    frames = Counter(m.frame for m in own if m.frame)
    return len(grams), 2**bits / math.sqrt(total), max(frames.values(), default=0) / len(grams)


def _measure(model_rows: list[tuple[str, str, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = NameModel(model_rows)
        languages = sorted(model.three)
        known: dict[str, dict[str, Measured]] = {x: {} for x in languages}

        def measured(language: str, n: str) -> Measured:
            own = known.setdefault(language, {})
            found = own.get(n)
            if found is None:
                if len(own) > 100_000:
                    own.clear()
                found = own[n] = Measured(model, language, n)
            return found

        for pdf in batches:
            out = []
            for path, start, code in zip(pdf["file_path"], pdf["start_line"], pdf["code"], strict=True):
                language = _language(path)
                own = names(code)
                all_of = [measured(language, n) for n in own]
                camel, snake = sum(m.camel for m in all_of), sum(m.snake for m in all_of)
                long_names, spread, frame = diversity(all_of)
                lines = code.split("\n")
                longest = max(map(len, lines))
                data = sum(len(x) for x in lines if len(x) > 20 and (x.count(",") > 4 or (len(x) > 40 and " " not in x.strip())) and _DATA_LINE.fullmatch(x))
                # whether another language's model explains the names better is only asked where the style is unusual
                unusual = camel + snake >= 4 and longest < LONG_LINE and (camel > 2 * snake if language in ("python", "c") else snake > 2 * camel)
                best = min(languages, key=lambda x: sum(measured(x, n).bits for n in own)) if unusual else language
                generated, owner, origin = top_notes(code) if start <= 1 else (False, "", False)
                code_hash = int.from_bytes(hashlib.blake2b(code.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big")
                out.append((path, start, code_hash, len(code), data, longest, len(own), sum(m.bits for m in all_of), long_names, spread * long_names, frame * long_names, camel, snake, best == language, generated, owner, origin, start <= 1 and bool(_BANNER.match(code))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _MEASURES.split(", ")])

    return run


_MEASURES = "file_path string, start int, code_hash long, chars long, data long, longest long, names long, bits double, long_names long, spread double, frame double, camel long, snake long, own_language boolean, generated boolean, owner string, origin boolean, banner boolean"


def _pieces(chunks: DataFrame) -> DataFrame:
    rows = chunks.select("file_path", F.coalesce(F.col("start_line"), F.lit(1)).cast("int").alias("start_line"), "code")
    extension = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    return rows.filter(F.col("code").isNotNull() & (F.trim("code") != "") & extension.isin(*LANGUAGES))


def name_counts(chunks: DataFrame) -> DataFrame:
    """``(language, gram, n)`` over all names of all code."""
    counted = _pieces(chunks).select("file_path", "code").mapInPandas(_count, "language string, gram string, n long")
    return counted.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def file_measures(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row of measures per file, with the verdicts of the name models (``mangled``, ``template``, ``is_data``, ``foreign``), those of
    ``notice`` and ``path``, and ``reasons``: the names of all that hold."""
    # bounded: at most 40^3 trigrams per language of LANGUAGES
    model = [tuple(r) for r in name_counts(chunks).collect()]
    per_chunk = _pieces(chunks).mapInPandas(_measure(model), _MEASURES).distinct()
    total = [F.sum(c).alias(c) for c in ("chars", "data", "names", "bits", "long_names", "spread", "frame", "camel", "snake")]
    most = [F.max(c).alias(c) for c in ("longest", "generated", "owner", "origin", "banner")]
    rows = per_chunk.groupBy("file_path").agg(*total, *most, F.avg(F.col("own_language").cast("double")).alias("own_share"))
    if files is None:
        rows = rows.withColumn("size", F.col("chars"))
    else:
        sizes = latest_fingerprints(files).select("file_path", F.col("size").alias("told"))
        near = F.col("told").between(F.col("chars") / 2, F.col("chars") * 2)
        rows = rows.join(sizes, "file_path", "left").withColumn("size", F.when(near, F.col("told")).otherwise(F.col("chars"))).drop("told")
    extension = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension]
    share = lambda c, of: F.col(c) / F.greatest(F.col(of), F.lit(1))
    # written once: one row of numbers per file, compared with its language's and its repository's other files
    rows = cut(
        rows.withColumns(
            {
                "language": language, "repo": F.split("file_path", "/")[0], "cross_entropy": share("bits", "names"), "diversity": share("spread", "long_names"), "frame": share("frame", "long_names"),
                "style": (F.col("camel") - F.col("snake")) / F.greatest(F.col("camel") + F.col("snake"), F.lit(1)),
            }
        )
    )
    median = lambda c, names, least: F.percentile_approx(F.when(F.col(names) >= least, F.col(c)), 0.5, 1000)
    bits, spread = median("cross_entropy", "names", MANGLED_NAMES), median("diversity", "long_names", TEMPLATE_NAMES)
    norm = rows.groupBy("language").agg(F.least(bits, F.lit(MOST_BITS)).alias("usual_bits"), F.greatest(spread, F.lit(LEAST_DIVERSITY)).alias("usual_diversity"))
    styles = rows.groupBy("repo", "language").agg(F.percentile_approx("style", 0.5, 1000).alias("usual_style"))
    # a row per language, and a row per repository and language: far smaller than the files, joined without a forced broadcast
    rows = rows.join(norm, "language").join(styles, ["repo", "language"])
    other_owner = (F.col("owner") != "") & (F.col("owner") != F.lower("repo"))
    holds = lambda c: F.coalesce(c, F.lit(False))
    known = Counter()
    for of, _, n in model:
        known[of] += n
    modelled = F.col("language").isin([of for of, n in known.items() if n >= MODEL_GRAMS])
    path = lambda p: F.col("file_path").rlike(f"(?i){p.pattern}")
    rows = rows.withColumns(
        {
            "mangled": holds((F.col("cross_entropy") > F.col("usual_bits") + MANGLED_BITS) & (F.col("names") >= MANGLED_NAMES) & modelled),
            "template": holds((F.col("diversity") < TEMPLATE * F.col("usual_diversity")) & (F.col("frame") > FRAME) & (F.col("long_names") >= TEMPLATE_NAMES)),
            "is_data": (F.col("data") > DATA * F.col("chars")) & (F.col("chars") > 400) & (F.col("names") * 1024 < DATA_NAMES * F.col("size")),
            "foreign": (F.abs(F.col("style") - F.col("usual_style")) > 2 * FOREIGN) & (F.col("camel") + F.col("snake") >= 20) & (F.col("own_share") > 0.9),
            "notice": F.col("generated") | F.col("origin") | other_owner | (F.col("banner") & (F.col("longest") > LONG_LINE)),
            "path": path(_PATH_GENERATED) | path(_PATH_BUNDLED) | path(_PATH_VENDORED),
        }
    )
    names_of = {"mangled": "mangled names", "template": "names of a template", "is_data": "data", "foreign": "foreign style", "notice": "notice", "path": "path"}
    return rows.withColumn("reasons", F.filter(F.array(*[F.when(F.col(c), F.lit(r)) for c, r in names_of.items()]), lambda r: r.isNotNull()))


def reasons(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``(file_path, reasons, cross_entropy, diversity)`` of the files that are not handwritten."""
    found = file_measures(chunks, files).filter(F.size("reasons") > 0)
    return found.select("file_path", F.array_join("reasons", ", ").alias("reasons"), F.round("cross_entropy", 4).alias("cross_entropy"), F.round("diversity", 4).alias("diversity"))


def not_handwritten(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``(file_path)`` of the files that a tool wrote, that are minified, that are copies of other projects, or that are data."""
    return file_measures(chunks, files).filter(F.size("reasons") > 0).select("file_path")
