"""Word lists, patterns and constants that define the engine's results."""

from __future__ import annotations

import unicodedata

# Extension -> language.
EXTENSION_LANGUAGE = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "tsx", "java": "java",
    "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby",
    "php": "php", "kt": "kotlin", "scala": "scala", "swift": "swift", "sql": "sql", "sh": "bash", "lua": "lua", "md": "markdown",
    "markdown": "markdown", "yml": "yaml", "yaml": "yaml", "json": "json", "toml": "toml", "properties": "properties", "proto": "proto",
}
# Directories never scanned, dot-directories that are, files never and always taken, largest file.
IGNORED_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", "target", "out", ".next", ".nuxt", "vendor", ".idea", ".vscode", ".gradle", "bin", "obj", "coverage", ".pytest_cache")
ALLOWED_DOT_DIRS = (".github", ".gitlab", ".windsurf", ".devin", ".claude", ".cursor", ".codex", ".agent")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "poetry.lock", "uv.lock", "Cargo.lock", "composer.lock", "Gemfile.lock")
FORCED_FILES = ("AGENTS.md", "CLAUDE.md", "GEMINI.md", "AGENT.md", ".windsurfrules", ".cursorrules")
MAX_FILE_SIZE = 1_000_000
# Chunking.
LINE_WINDOW, LINE_OVERLAP, MAX_CHUNK_LINES, MIN_CHUNK_LINES, MIN_CHUNK_CHARS = 60, 10, 200, 3, 40
# File name classes.
TEST_MARKS = ("_test.", "test_", "Test.", ".test.", ".spec.", "_spec.")
BARREL_FILES = ("index.ts", "index.js", "index.tsx", "index.jsx", "index.mjs", "__init__.py", "mod.rs")
# Languages that hold text or settings.
NON_CODE = ("markdown", "yaml", "json", "toml", "properties", "text")
CONFIG_LANGUAGES = ("yaml", "toml", "properties", "json")
# Accessor and builtin names that say nothing in a call graph.
BOILERPLATE = ("toString", "equals", "hashCode", "clone", "compareTo", "builder", "build", "valueOf", "readObject", "writeObject")
BOILERPLATE_PATTERN = "^(get|set|is)[A-Z][A-Za-z0-9_]*$"
CALL_STOP = (
    "print", "len", "range", "enumerate", "zip", "map", "filter", "sorted", "list", "dict", "set", "tuple", "str", "int", "float", "bool",
    "bytes", "open", "isinstance", "type", "super", "getattr", "setattr", "hasattr", "min", "max", "sum", "any", "all", "abs", "repr",
    "format", "iter", "next", "append", "extend", "insert", "remove", "pop", "get", "items", "keys", "values", "update", "add", "join",
    "split", "strip", "replace", "decode", "encode", "startswith", "endswith", "lower", "upper", "find", "index", "getenv", "setdefault",
    "copy", "clear", "sort", "reverse", "count", "this", "self", "log", "logger", "console", "System",
)
CALL_KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "new", "super", "else", "throw", "function", "def", "func", "class", "elif", "except", "with", "not", "and", "or", "in", "sizeof", "typeof", "await", "async", "import", "struct", "case", "do", "try", "yield", "raise", "lambda", "assert")
DECLARED_STOP = ("if", "for", "while", "switch", "catch", "return", "new", "super", "else", "throw")
# Patterns of declared method names, of contracts and of data carriers, which decide scores and callers.
DECLARED = {
    "java": (
        r"(?m)^[ \t]*(?:public|protected|private)\s+(?:(?:static|final|synchronized|abstract|default|native)\s+)*[\w<>\[\],.\s?]+?\s+(\w+)\s*\(",
        r"(?m)^[ \t]*[\w<>\[\],.?]+\s+(\w+)\s*\([^;{}]*\)\s*;",
    ),
    "python": (r"(?m)^[ \t]*def\s+(\w+)\s*\(",),
    "go": (r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(",),
    "typescript": (r"(?m)^[ \t]*(?:public\s+|private\s+|protected\s+|export\s+|async\s+)*(\w+)\s*\([^)]*\)\s*[:{]",),
}
CONTRACT_MARK, CARRIER_MARKS = "@FeignClient", ("@TableName", "@Data")
JAVA_INTERFACE = r"(?m)^\s*(?:public\s+)?(?:@\w+(?:\([^)]*\))?\s+)*interface\s+\w"
SCRIPT_INTERFACE = r"^\s*(?:export\s+)?interface\s"
CONTROL_FLOW = r"\b(if|for|while|switch|return)\b"
DECLARED_MIN, DECLARED_MOST = 4, 12
# Patterns of a query's intent (case-insensitive).
INTENTS = {
    "caller": r"(谁调用|被哪些|哪些[^\s]{0,8}调用|调用了?它|被写入|写入|谁在用|被使用|被引用|callers?\s+of|who\s+calls|call\s*sites?|writes?\s+to|who\s+writes|where\s+.{0,20}\bused)",
    "test": r"(\btests?\b|\bspec\b|benchmark|单测|测试|用例|基准)",
    "doc": r"(architect|overview|convention|guideline|readme|documentation|\bdocs?\b|规范|架构|职责|约定|文档|说明)",
    "config": r"(config|configuration|settings|\byaml\b|\btoml\b|配置)",
    "decl": r"(接口定义|契约|declaration|signature|\binterface\b|feign)",
    "impl": r"(怎么|如何|怎样|流程|逻辑|实现|\bhow\b|implement)",
}
COMPOUND = r"[+＋]|(?<=[一-鿿])(?:以及|并且|同时|和|与|并|及)(?=[一-鿿])"
COMPOUND_MIN = 2
CJK = r"[一-鿿぀-ヿ가-힯]"
# Score factors.
FACTORS = {"test": 0.5, "test_wanted": 1.2, "barrel": 0.85, "non_code": 0.7, "doc_wanted": 1.5, "config_wanted": 1.4, "declaration": 0.75, "impl_extra": 0.75, "entity": 0.85, "tiny": 0.85, "exact_name": 1.5, "name_part": 0.1, "pair": 1.01, "sub_mix": 0.95}
TINY_LINES, NAME_PARTS_MOST, INTENT_SCORE = 2, 3, 9.99
# Fusion, graph and diversity.
RRF_K, MAX_PER_FILE, HOT_CALLERS, MAX_FANOUT, CALLERS_LIMIT, GRAPH_LIMIT = 60, 2, 20, 5, 20, 8
WEIGHTS = {"base": 1.0, "base_expanded": 2.0, "variant": 1.0, "sub": 0.7}
# First results of a sub-query that are its probes, least sub-query score by reranker.
PROBES, SUB_LEAST = 10, {"voyage": 0.55, "cohere": 0.2, "default": 0.2}
# BM25.
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
# Rendering budgets.
RENDER = {"file_lines": 120, "file_lines_tail": 40, "full_files": 3, "chunk_lines": 80, "entity_lines": 30, "line_chars": 200, "file_chars": 8_000, "related_lines": 20}
# Embedding batches and texts, rerank texts.
BATCH_TEXTS, BATCH_CHARS, EMBED_CHARS, RERANK_CHARS = 128, 200_000, 16_000, 4_000
# Change stream.
DEBOUNCE_SECONDS, FLUSH_COUNT = 2, 50


def _folding() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by decomposition."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code).lower())[0]
        if base != chr(code).lower() and base.isascii() and base.isalpha() and len(chr(code).lower()) == 1:
            pairs.append((chr(code).lower(), base))
    unique = dict(pairs)
    return "".join(unique), "".join(unique.values())


FOLD_FROM, FOLD_TO = _folding()
