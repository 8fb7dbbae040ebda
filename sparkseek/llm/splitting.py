"""p4: cutting oversized chunks at natural boundaries, by agglomerative merging of atomic segments.

A chunk above the limit is first cut into atomic segments: at every natural boundary (the first line of a declaration, or of
the decorators, annotations and comments directly above it; a heading), at blank lines, and, where a segment is still too
large, at lines and finally inside a line. All adjacent pairs lie in a heap by the strength of the boundary between them,
and the weakest boundary is merged first while the combined size plus the overlap fits. What no longer fits stays a cut, so the
cuts that remain are the strongest. Every piece but the first repeats up to OVERLAP whole lines of what precedes it.

Defined cases
    null, empty and short code is not cut; ``start_line`` null counts as 1; a null end line is computed; lines longer than the
    limit are cut between characters, such pieces share a line and take no overlap; repeated rows count once; a null language or
    path leaves the extension unknown, so only blank lines and lines bound; CRLF stays as it is; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.syntax import language

#: Largest piece in characters, most shared lines, and most characters that they may take.
LIMIT, OVERLAP, OVERLAP_CHARS = 4_000, 10, 800

LANGUAGES = {"py": "python", "java": "java", "go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "c": "c", "h": "c", "md": "markdown", "markdown": "markdown"}

_MODS = r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|sealed|non-sealed)\s+|@\s*a(?:\.a)*(?:\([^()]*\))?\s+)*"
_TYPE = r"(?:void|boolean|byte|char|short|int|long|float|double|a(?:\.a)*(?:\s*<[^;={}()]*>)?)(?:\s*\[\s*\])*"
_JS_MODS = r"(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract|declare)\s+|\*\s*)*"
#: First lines of named declarations, over canonical lines (``a`` is any name).
DECLARATION = {
    "python": re.compile(r"\s*(?:async\s+)?def\s+a|\s*class\s+a"),
    "go": re.compile(r"\s*func\s*(?:\([^)]*\)\s*)?a\s*[\[(]|\s*type\s+a\b|\s+a(?:\[[^\]]*\])?\s+(?:struct|interface)\s*\{"),
    "java": re.compile(rf"\s*{_MODS}(?:(?:class|interface|enum|@\s*interface)\s+a\b|record\s+a\s*[<(]|(?:<[^;={{}}()]*>\s*)?{_TYPE}\s+a\s*\(|(?:public|protected|private)\s+a\s*\(|a\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?\{{)"),
    "javascript": re.compile(rf"\s*(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s*\*?\s*a\b|class\s+a\b|{_JS_MODS}[#]?a\s*\([^;]*\)\s*\{{\s*$)"),
    "typescript": re.compile(rf"\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:(?:async\s+)?function\s*\*?\s*a\b|(?:abstract\s+)?class\s+a\b|interface\s+a\b|(?:const\s+)?enum\s+a\b|type\s+a\s*[=<]|namespace\s+a\b|{_JS_MODS}[#]?a\s*[?]?(?:<[^;={{}}()]*>)?\s*\([^;]*\)\s*(?::\s*[^;{{]+)?\{{\s*$)"),
    "c": re.compile(r"(?:typedef\s+)?(?:static\s+)?(?:struct|union|enum)\s+a?\s*\{|typedef\b|(?!(?:return|else|case|goto|do|if|for|while|switch|sizeof)\b)(?:[a-z_]\w*[\s*]+)+a\s*\((?!.*;\s*$)"),
}
_NAME_OF = re.compile(r"(?:\b(?:def|class|func|function\*?|interface|enum|struct|union|type|record|namespace|trait)\s+(?:\([^)]*\)\s*)?|[\s*])([A-Za-z_$][\w$]*)\s*[\[<(={:]|\b(?:class|interface|enum|struct|type|record)\s+([A-Za-z_$][\w$]*)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|\r?$)")
_CODE_LIKE = re.compile(r"[{};]\s*$|^\s*(?:def|return|func|if|for|import|export|const|let)\b")


def _kind(path: str | None) -> str | None:
    name = (path or "").rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def heading_lines(lines: list[str]) -> list[int]:
    """Lines (from 0) of headings outside code. A chunk may begin inside a fence: the reading with less code outside wins."""

    def read(inside: bool) -> tuple[int, list[int]]:
        odd, found, mark = 0, [], "```" if inside else ""
        for i, line in enumerate(lines):
            fence = _FENCE.match(line)
            if fence and (not mark or (fence.group(1)[0] == mark[0] and len(fence.group(1)) >= len(mark) and not line[fence.end() :].strip())):
                mark = "" if mark else fence.group(1)
            elif not mark:
                odd += bool(_CODE_LIKE.search(line))
                if _HEADING.match(line):
                    found.append(i)
                elif i and re.fullmatch(r" {0,3}(?:=+|-{3,})[ \t]*\r?", line) and lines[i - 1].strip() and not re.match(r" {0,3}(?:[#>|*+-]|\d+[.)])|\s{4}", lines[i - 1]) and (i < 2 or not lines[i - 2].strip()):
                    found.append(i - 1)
        return odd, found

    outside = read(False)
    if not any(_FENCE.match(x) for x in lines):
        return outside[1]
    return min(outside, read(True), key=lambda x: x[0])[1]


def declaration_lines(code: str, kind: str) -> list[tuple[int, int]]:
    """(first line, declaration line), from 0, of each named declaration; the first line takes in what stands directly above."""
    lines = code.split("\n")
    opened = 0
    if kind != "python":
        end, begin = code.find("*/"), code.find("/*")
        if end >= 0 and (begin < 0 or end < begin):
            code, opened = "/*" + code, 2  # the chunk begins inside a block comment
    canonical = language(kind).canonical(code.replace("\r\n", "\n"), fast=False).split("\n")
    found = []
    for i, line in enumerate(canonical):
        if not DECLARATION[kind].match(line):
            continue
        first = i
        while first > 0:
            above, original = canonical[first - 1].strip(), lines[first - 1].strip()
            comment = not above and original and not (kind == "c" and original.startswith("#"))
            decorator = kind in ("python", "java", "typescript", "javascript") and above.startswith("@") and not DECLARATION[kind].match(canonical[first - 1])
            if not (comment or decorator):
                break
            first -= 1
        found.append((first, i))
    return found


def natural_lines(code: str, path: str | None) -> dict[int, tuple[int, str | None]]:
    """Line (from 0) -> (strength, symbol) of each natural boundary."""
    kind = _kind(path)
    lines = code.split("\n")
    if kind == "markdown":
        return {i: (10 - min(6, len(lines[i].strip()) - len(lines[i].strip().lstrip("#")) or 1), lines[i].strip().strip("#").strip() or None) for i in heading_lines(lines)}
    if kind is None:
        return {}
    out: dict[int, tuple[int, str | None]] = {}
    for first, at in declaration_lines(code, kind):
        indent = len(lines[at].expandtabs(4)) - len(lines[at].expandtabs(4).lstrip())
        name = _NAME_OF.search(lines[at])
        out.setdefault(first, (max(4, 9 - indent // 2), (name.group(1) or name.group(2)) if name else None))
    return out


def segments(code: str, path: str | None, limit: int = LIMIT) -> list[dict]:
    """Atomic segments: start and end offset, first line (from 0), strength of the boundary before it, whether it is natural."""
    lines = code.split("\n")
    natural = natural_lines(code, path)
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    out: list[dict] = []
    for i, start in enumerate(starts):
        blank_above = i > 0 and not lines[i - 1].strip() and bool(lines[i].strip())
        if i == 0 or i in natural:
            out.append({"start": start, "line": i, "strength": natural.get(i, (9, None))[0], "symbol": natural.get(i, (9, None))[1], "natural": True})
        elif blank_above:
            out.append({"start": start, "line": i, "strength": 2, "symbol": None, "natural": False})
    ends = [s["start"] for s in out[1:]] + [len(code)]
    room = limit - OVERLAP_CHARS
    atoms: list[dict] = []
    for s, end in zip(out, ends, strict=True):
        if end - s["start"] <= room:
            atoms.append(s | {"end": end})
            continue
        last = s["line"]
        while last + 1 < len(starts) and starts[last + 1] < end:
            last += 1
        for i in range(s["line"], last + 1):  # by lines, and a longer line by characters
            stop = min(end, starts[i] + len(lines[i]) + 1)
            for cut in range(starts[i], max(stop, starts[i] + 1), limit - 1):
                head = s if i == s["line"] and cut == starts[i] else {"line": i, "strength": 1 if cut == starts[i] else 0, "symbol": None, "natural": False}
                atoms.append(head | {"start": cut, "end": min(stop, cut + limit - 1)})
    return atoms


def merge(code: str, path: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[dict], dict[int, int]]:
    """(atomic segments, piece -> first offset with its overlap): the segments with ``end`` of the piece that they begin, and
    ``kept``, whether the boundary before them is still a cut when no pair can be merged any more."""
    atoms = segments(code, path, limit)
    line_starts = [0] + [m.end() for m in re.finditer("\n", code)]
    line_of = {s: i for i, s in enumerate(line_starts)}

    def shared(start: int) -> int:
        """Offset at which the overlap of a piece that begins at ``start`` begins."""
        line = line_of.get(start)
        if not line or overlap <= 0:
            return start
        first = line
        while first > 0 and line - first < overlap and start - line_starts[first - 1] <= min(OVERLAP_CHARS, limit // 4):
            first -= 1
        return line_starts[first]

    alive = list(range(len(atoms)))
    nxt = {i: i + 1 if i + 1 < len(atoms) else None for i in alive}
    prv = {i: i - 1 if i else None for i in alive}
    end = {i: atoms[i]["end"] for i in alive}
    begin = {i: shared(atoms[i]["start"]) for i in alive}
    begin = {i: b if end[i] - b <= limit else atoms[i]["start"] for i, b in begin.items()}
    gone: set[int] = set()
    heap = [(atoms[i]["strength"], end[i] - atoms[i - 1]["start"], i) for i in alive[1:]]
    heapq.heapify(heap)
    while heap:
        strength, size, right = heapq.heappop(heap)
        left = prv.get(right)
        if right in gone or left is None:
            continue
        now = end[right] - atoms[left]["start"]
        if now != size:
            heapq.heappush(heap, (strength, now, right))  # its neighbours have grown since
            continue
        # the line end at the cut belongs to neither piece
        last = nxt[right] is None
        if end[right] - begin[left] - (0 if last else 1) > limit:
            continue
        end[left] = end[right]
        gone.add(right)
        nxt[left] = nxt[right]
        if nxt[right] is not None:
            prv[nxt[right]] = left
    merged = [a | {"end": end[i], "kept": i not in gone} for i, a in enumerate(atoms)]
    return merged, {i: begin[i] for i in alive if i not in gone}


def pieces(code: str, path: str | None, symbol: str | None, start_line: int, limit: int = LIMIT, overlap: int = OVERLAP) -> list[dict]:
    """The pieces of one chunk; a chunk within the limit is its own only piece."""
    n = code.count("\n") + 1
    if len(code) <= limit:
        return [{"piece": 0, "start_line": start_line, "end_line": start_line + n - 1, "symbol": symbol, "shared_lines": 0, "natural": True, "code": code}]
    atoms, begin = merge(code, path, limit, overlap)
    out: list[dict] = []
    current = symbol
    for i, atom in enumerate(atoms):
        if atom["symbol"]:
            current = atom["symbol"]
        if i not in begin:
            continue
        stop = atom["end"] - 1 if atom["end"] < len(code) and code[atom["end"] - 1] == "\n" else atom["end"]
        text = code[begin[i] : stop]
        first = atom["line"] - code.count("\n", begin[i], atom["start"])
        out.append({"piece": len(out), "start_line": start_line + first, "end_line": start_line + first + text.count("\n"), "symbol": current, "shared_lines": atom["line"] - first, "natural": atom["natural"], "code": text})
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            symbol = r.symbol if isinstance(r.symbol, str) and r.symbol else None
            rows += [{"chunk_id": r.chunk_id} | p for p in pieces(r.code, r.file_path, symbol, int(r.start_line))]
        yield pd.DataFrame(rows, columns=["chunk_id", "piece", "start_line", "end_line", "symbol", "shared_lines", "natural", "code"])


def _bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(r.chunk_id, s["line"] + 1, s["strength"], s["natural"], s["kept"]) for r in pdf.itertuples() for s in merge(r.code, r.file_path)[0]]
        yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "strength", "natural", "kept"])


def _oversized(chunks: DataFrame, limit: int) -> DataFrame:
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "file_path", "symbol", F.coalesce(F.col("start_line"), F.lit(1)).cast("int").alias("start_line"), "code")
    return rows.filter(F.col("chunk_id").isNotNull() & (F.length("code") > limit))


def split_oversized(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, piece, start_line, end_line, symbol, shared_lines, natural, code)`` of the chunks above the limit; ``natural``
    says whether a piece begins at a natural boundary. No shuffle of what is within the limit: the length is tested in the scan stage."""
    cut = _oversized(chunks, LIMIT).distinct().mapInPandas(_cut, "chunk_id long, piece int, start_line int, end_line int, symbol string, shared_lines int, natural boolean, code string")
    return cut


def boundaries(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, line_no, strength, natural, kept)``: the boundaries between the atomic segments of the chunks above the limit, as they
    come out of the merging: ``kept`` ones are still cuts at its end."""
    found = _oversized(chunks, LIMIT).mapInPandas(_bounds, "chunk_id long, line_no long, strength int, natural boolean, kept boolean")
    return found.distinct()


def natural_boundaries(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, line_no)``: where the atomic segments of the chunks above the limit begin naturally; line 1 always."""
    return boundaries(chunks).filter("natural").select("chunk_id", "line_no").distinct()


def cut_report(chunks: DataFrame) -> DataFrame:
    """``(language, strength, natural, boundaries, cuts)``: how many boundaries of each strength there are, and how many of them are
    still cuts when the weaker ones have been merged."""
    kind = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    languages = chunks.groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.min(F.coalesce(known[kind], F.lit("other"))).alias("language"))
    rows = boundaries(chunks).join(languages, "chunk_id")
    return rows.groupBy("language", "strength", "natural").agg(F.count("*").alias("boundaries"), F.sum(F.col("kept").cast("long")).alias("cuts"))
