"""Cutting texts into chunks: overlapping line windows, and definitions found by declaration lines and indentation or braces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions import columns as C
from sparkseek.functions import vocabulary as V


def line_windows(rows: DataFrame, id_col: str, text_col: str, window: int = V.LINE_WINDOW, overlap: int = V.LINE_OVERLAP) -> DataFrame:
    """``(id, symbol, start_line, end_line, code)``: windows of ``window`` lines that overlap by ``overlap``; blank windows are left
    out, and no window begins where the one before it already reached the last line."""
    step = window - overlap
    lines = rows.select(id_col, F.split(text_col, "\n", -1).alias("lines")).filter(F.col("lines").isNotNull())
    last = F.greatest(F.lit(0), F.ceil((F.size("lines") - window) / step).cast("int") * step)
    starts = lines.select(id_col, "lines", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("i"))
    code = F.array_join(F.slice("lines", F.col("i") + 1, window), "\n")
    out = starts.select(
        id_col, F.concat(F.lit("lines_"), (F.col("i") + 1).cast("string")).alias("symbol"), (F.col("i") + 1).alias("start_line"),
        F.least(F.col("i") + window, F.size("lines")).alias("end_line"), code.alias("code"),
    )
    return out.filter(F.col("code").rlike(r"\S"))


def is_meaningful(code: Column) -> Column:
    """At least three lines, or forty signs without the space around them."""
    trimmed = F.regexp_replace(code, r"^\s+|\s+$", "")
    return (F.size(F.split(code, "\n", -1)) >= V.MIN_CHUNK_LINES) | (F.length(trimmed) >= V.MIN_CHUNK_CHARS)


#: Lines that begin a definition, by language.
_BRACED = r"^\s*(?:(?:public|protected|private|static|final|abstract|export|default|async|synchronized|inline|extern|const|unsafe|pub)\s+)*"
DEFINITION = {
    "python": re.compile(r"^\s*(?:@\w|(?:async\s+)?def\s+\w|class\s+\w)"),
    "go": re.compile(r"^(?:func\b|type\s+\w)"),
    "java": re.compile(_BRACED + r"(?:(?:class|interface|enum|record)\s+\w|[\w<>\[\],.?]+\s+\w+\s*\([^;=]*\)?[^;=]*\{)"),
    "javascript": re.compile(_BRACED + r"(?:function\b|class\s+\w|\w+\s*\([^;]*\)\s*\{)"),
    "typescript": re.compile(_BRACED + r"(?:function\b|class\s+\w|interface\s+\w|enum\s+\w|\w+\s*\([^;]*\)\s*(?::[^;{]+)?\{)"),
    "rust": re.compile(r"^\s*(?:pub(?:\([\w\s:]+\))?\s+)?(?:(?:async|const|unsafe|default|extern(?:\s+\"\w+\")?)\s+)*(?:fn|impl|struct|trait|enum)\b"),
    "cpp": re.compile(r"^\s*(?:template\s*<[^;{]*>\s*)?(?:class|struct)\s+\w[^;]*$|^\s*(?:(?:virtual|static|inline|constexpr|explicit|friend)\s+)*[A-Za-z_][\w\s:<>,*&~]*\([^;]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;]*)?\{?\s*(?:\}\s*)?$"),
    "csharp": re.compile(r"^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|protected|private|internal|static|sealed|abstract|virtual|override|async|partial|readonly|new)\s+)*(?:(?:class|interface|struct|record)\s+\w|[\w<>\[\],.?]+\s+\w+\s*(?:<[^;={]*>)?\s*\([^;=]*\)\s*(?:where\b[^;{]*)?(?:\{|=>|$))"),
    "ruby": re.compile(r"^\s*(?:def|class|module)\s+\w"),
    "php": re.compile(r"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*(?:function\s+&?\w|(?:class|interface)\s+\w)"),
    "kotlin": re.compile(r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|internal|open|abstract|override|suspend|inline|data|sealed|enum|companion|operator)\s+)*(?:fun|class|object|interface)\b"),
    "scala": re.compile(r"^\s*(?:(?:private|protected|override|implicit|final|sealed|abstract|case|lazy)(?:\[\w+\])?\s+)*(?:def|class|object|trait)\s+\w"),
    "swift": re.compile(r"^\s*(?:@\w+\s+)*(?:(?:public|private|internal|open|fileprivate|static|final|override|mutating|class)\s+)*(?:func|class|struct|enum|protocol|extension)\s+\w"),
    "lua": re.compile(r"^\s*(?:local\s+)?function\b|^\s*(?:local\s+)?[\w.:]+\s*=\s*function\b"),
    "c": re.compile(r"^(?:typedef\s+)?struct\s+\w*\s*\{|^[A-Za-z_][\w\s*]*\([^;]*\)\s*\{?\s*$"),
}
_CONTROL = re.compile(r"^\s*(?:if|for|while|switch|catch|return|else|do|try|throw|new|with|case)\b")
_SYMBOL = re.compile(r"(?:def|class|interface|enum|record|function\*?|struct|type|fn|fun|trait|impl(?:<[^>]*>)?|module|object|protocol|extension)\s+&?((?:self\.)?[\w.:]+)|func\s+(?:\([^)]*\)\s*)?(\w+)|(\w+)\s*(?:<[^(){};]*>)?\s*\(|([\w.:]+)\s*=\s*function")
#: Languages whose definitions end where the indentation comes back, with the words that close them.
_INDENTED = {"python": (), "ruby": ("end",), "lua": ("end",)}


def _end_of(lines: list[str], i: int, language: str) -> int:
    """The last line of the definition that begins at line ``i``: by indentation in Python, Ruby and Lua, by braces elsewhere."""
    if language in _INDENTED:
        while i < len(lines) and lines[i].lstrip().startswith("@"):
            i += 1
        indent = len(lines[i]) - len(lines[i].lstrip()) if i < len(lines) else 0
        end = i
        for j in range(i + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                    closes = lines[j].split()[0].rstrip(",;)") in _INDENTED[language]
                    return j if closes and not re.search(r"\bend\b\s*[,;)]*$", lines[i]) else end
                end = j
        return end
    depth, opened = 0, False
    for j in range(i, len(lines)):
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|//.*", "", lines[j])
        depth += bare.count("{") - bare.count("}")
        opened |= "{" in bare
        if (opened and depth <= 0) or (not opened and bare.rstrip().endswith(";")):
            return j
        if not opened and j > i and language in ("kotlin", "scala", "swift", "csharp") and not bare.strip():
            return j - 1  # a body of one expression
    return len(lines) - 1


def definitions(code: str, language: str) -> list[tuple[str, int, int, str]]:
    """``(symbol, start, end, code)`` of the definitions: one of up to 200 lines, or without any inside, is kept whole, and a
    longer one gives way to those inside it."""
    pattern = DEFINITION.get("typescript" if language == "tsx" else language)
    lines = code.split("\n")
    if pattern is None:
        return []
    out: list[tuple[str, int, int, str]] = []

    def walk(first: int, last: int) -> None:
        i = first
        while i <= last:
            if not pattern.match(lines[i]) or _CONTROL.match(lines[i]):
                i += 1
                continue
            end = min(_end_of(lines, i, language), last)
            head = next((x for x in range(i, end + 1) if not lines[x].lstrip().startswith("@")), i)
            inside = any(pattern.match(lines[x]) and not _CONTROL.match(lines[x]) for x in range(head + 1, end + 1))
            if end - i + 1 <= V.MAX_CHUNK_LINES or not inside:
                name = _SYMBOL.search(lines[head])
                out.append((next((g for g in name.groups() if g), "") if name else "", i + 1, end + 1, "\n".join(lines[i : end + 1])))
            else:
                walk(head + 1, end)
            i = end + 1

    walk(0, len(lines) - 1)
    return out


def chunk_files(files: DataFrame) -> DataFrame:
    """``(file_path, language, symbol, start_line, end_line, code, blob_hash)`` of ``(file_path, code)`` rows.

    Files with meaningful definitions give those, all others (unknown languages, nothing found) their line windows.
    """
    rows = files.select("file_path", C.language_of(F.col("file_path")).alias("language"), "code").filter(C.text(F.col("code")).rlike(r"\S"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(r.file_path, *d) for r in pdf.itertuples() for d in definitions(r.code, r.language)]
            yield pd.DataFrame(found, columns=["file_path", "symbol", "start_line", "end_line", "code"])

    parsed = rows.filter(F.col("language").isin(*DEFINITION, "tsx")).mapInPandas(run, "file_path string, symbol string, start_line int, end_line int, code string").filter(is_meaningful(F.col("code")))
    windows = line_windows(rows.join(parsed.select("file_path").distinct(), "file_path", "left_anti"), "file_path", "code")
    out = parsed.unionByName(windows.select(*parsed.columns))
    return out.select("file_path", C.language_of(F.col("file_path")).alias("language"), "symbol", "start_line", "end_line", "code", C.blob_hash(F.col("file_path"), F.col("code")).alias("blob_hash"))


def call_edges(chunks: DataFrame) -> DataFrame:
    """``(caller_id, callee_name)``: callees, constructed types and receivers (see ``called_names``), once per chunk."""
    return chunks.select(F.col("chunk_id").alias("caller_id"), F.explode(C.called_names(F.col("code"), F.col("language"))).alias("callee_name"))


def embedding_batches(rows: DataFrame, id_col: str, text_col: str, texts: int = V.BATCH_TEXTS, chars: int = V.BATCH_CHARS) -> DataFrame:
    """``(id, task, batch)``: the rows of each task packed in order into batches of at most so many texts and characters.
    Packing follows a task's rows, so nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = used = batch = 0
        for pdf in batches:
            numbers = []
            for size in pdf["n_chars"]:
                if n and (n >= texts or used + size > chars):
                    batch, n, used = batch + 1, 0, 0
                n, used = n + 1, used + size
                numbers.append(batch)
            yield pdf.assign(batch=numbers)[["id", "task", "n_chars", "batch"]]

    sized = rows.select(F.col(id_col).alias("id"), F.spark_partition_id().alias("task"), F.least(F.greatest(F.length(C.text(F.col(text_col))), F.lit(1)), F.lit(V.EMBED_CHARS)).alias("n_chars"))
    return sized.mapInPandas(run, "id long, task int, n_chars int, batch int")
