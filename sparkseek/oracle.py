"""The registered queries as SQL over the same tables, for comparison."""

from __future__ import annotations

from sparkseek.functions import columns as C
from sparkseek.functions import vocabulary as V


def _list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _fold(x: str) -> str:
    return f"translate(lower(coalesce({x}, '')), '{V.FOLD_FROM}', '{V.FOLD_TO}')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all({_fold(x)}, '[\\p{{L}}\\p{{N}}]+')"


def _base(p: str) -> str:
    return f"regexp_extract(coalesce({p}, ''), '([^/\\\\]*)$', 1)"


def _lang(p: str) -> str:
    cases = " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in V.EXTENSION_LANGUAGE.items())
    return f"CASE lower(regexp_extract({_base(p)}, '.\\.([^.]+)$', 1)) {cases} ELSE 'text' END"


def _parts(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'), lambda p: length(p) >= 2)"


def _intent(x: str, key: str) -> str:
    pattern = V.INTENTS[key].replace("'", "''")
    found = f"regexp_matches(coalesce({x}, ''), '(?i){pattern}')"
    return f"({found} AND NOT {_intent(x, 'decl')})" if key == "impl" else found


def _declaration(code: str, lang: str) -> str:
    return (
        f"CASE WHEN {lang} = 'java' THEN contains({code}, '{V.CONTRACT_MARK}') OR regexp_matches({code}, '{V.JAVA_INTERFACE}') "
        f"WHEN {lang} IN ('typescript', 'tsx') THEN regexp_matches({code}, '{V.SCRIPT_INTERFACE}') ELSE false END"
    )


def _entity(code: str, lang: str) -> str:
    table, data = V.CARRIER_MARKS
    return f"({lang} = 'java' AND (contains({code}, '{table}') OR (contains({code}, '{data}') AND contains({code}, 'class '))) AND NOT regexp_matches({code}, '{V.CONTROL_FLOW}'))"


def _called(code: str, lang: str) -> str:
    """The list of names that a chunk calls, repeated ones included."""
    q = lambda x: x.replace("'", "''")
    case = " ".join(f"WHEN {lang} IN ({_list(tuple(x for x, s in C.CALLING.items() if s == sign))}) THEN regexp_replace({code}, '{q(p)}', ' ', 'g')" for sign, p in C.NO_CODE.items())
    bare = f"regexp_replace(CASE {case} ELSE {code} END, '{q(C.HEADS)}', '(', 'g')"
    only = lambda languages, p: f"CASE WHEN {lang} IN ({_list(languages)}) THEN regexp_extract_all(bare, '{q(p)}', 1) ELSE [] END"
    names = ", ".join(["regexp_extract_all(bare, '" + q(C.CALLED) + "', 1)", only(C.CONSTRUCTING, C.CONSTRUCTED), only(C.RECEIVING, C.RECEIVED), only(C.MACROS, C.MACRO)])
    return bare, f"list_concat({names})", _list(tuple(C.CALLING))


def _boilerplate(x: str) -> str:
    return f"(regexp_matches({x}, '{V.BOILERPLATE_PATTERN}') OR {x} IN ({_list(V.BOILERPLATE)}))"


_TEST = "(" + " OR ".join(f"contains({_base('file_path')}, '{m}')" for m in V.TEST_MARKS) + ")"

#: Stored chunks, as ``operators.corpus.clean`` makes them.
CORPUS = f"""corpus AS (
  SELECT chunk_id, blob_hash, file_path, {_lang("file_path")} AS language, coalesce(symbol, '') AS symbol, coalesce(start_line, 1) AS start_line,
         coalesce(end_line, coalesce(start_line, 1) + len(string_split(coalesce(code, ''), chr(10))) - 1) AS end_line, coalesce(code, '') AS code
  FROM (SELECT DISTINCT * FROM chunks) QUALIFY row_number() OVER (PARTITION BY blob_hash ORDER BY chunk_id) = 1)"""
VECTORS = """vectors AS (
  SELECT chunk_id, min(embedding) AS embedding FROM vec_chunks
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY chunk_id)"""
CALLS = "calls AS (SELECT DISTINCT caller_id, callee_name FROM edges WHERE caller_id IS NOT NULL AND coalesce(callee_name, '') <> '')"
HOT = f"hot AS (SELECT callee_name, count(*) AS callers FROM calls GROUP BY callee_name HAVING count(*) > {V.HOT_CALLERS})"
USABLE = "usable AS (SELECT DISTINCT change_id, file_path, CASE WHEN lower(trim(op)) = 'deleted' THEN 'deleted' ELSE 'dirty' END AS state, seen_at FROM change_log WHERE file_path IS NOT NULL AND op IS NOT NULL)"
STATES = "states AS (SELECT file_path, arg_max(state, (seen_at, change_id)) AS state, count(*) AS changes FROM usable GROUP BY file_path)"
KEPT = "kept AS (SELECT DISTINCT chunk_id, blob_hash, file_path FROM chunks QUALIFY row_number() OVER (PARTITION BY blob_hash ORDER BY chunk_id) = 1)"


def _fingerprints(which: str, name: str, where: str = "true") -> str:
    fn = "max" if which == "latest" else "min"
    return f"""{name} AS (SELECT file_path, nullif(f.s, -1) AS size, CASE WHEN f.m > '-infinity'::DOUBLE THEN f.m END AS mtime, f.h AS file_hash FROM (
      SELECT file_path, {fn}({{'m': coalesce(mtime, '-infinity'::DOUBLE), 'h': coalesce(file_hash, ''), 's': coalesce(size, -1)}}) AS f FROM files WHERE file_path IS NOT NULL AND {where} GROUP BY file_path))"""


def _bm25(queries: str, k: int = 20, rows: str = "corpus", key: str = "chunk_id", fields: tuple[str, ...] = ("code", "file_path", "symbol"), p: str = "") -> str:
    """CTEs that end in ``bm25(qid, id, score, rank)`` for a CTE ``queries`` (qid, query); ``p`` is put before all their names."""
    union = " UNION ALL ".join(f"SELECT {key} AS id, {i} AS field, {_tokens(f)} AS toks FROM {rows}" for i, f in enumerate(fields))
    return f"""{p}fields AS ({union}),
  {p}post AS (SELECT id, field, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM {p}fields),
  {p}sized AS (SELECT id, sum(len(toks)) AS dl FROM {p}fields GROUP BY id),
  {p}totals AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM {p}sized),
  {p}phrases AS (SELECT qid, unnest(w) AS word, unnest(range(len(w))) AS phrase FROM (SELECT qid, list_filter(regexp_extract_all(coalesce(query, ''), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2) AS w FROM {queries})),
  {p}split AS (SELECT qid, phrase, {_tokens("word")} AS parts FROM {p}phrases),
  {p}terms AS (SELECT qid, phrase, len(parts) AS n_parts, unnest(parts) AS term, unnest(range(len(parts))) AS part FROM {p}split),
  {p}begun AS (SELECT qid, phrase, id, field, pos - part AS at FROM {p}post JOIN {p}terms USING (term) GROUP BY qid, phrase, n_parts, id, field, pos - part HAVING count(*) = n_parts),
  {p}tf AS (SELECT qid, phrase, id, count(*) AS tf FROM {p}begun GROUP BY qid, phrase, id),
  {p}df AS (SELECT qid, phrase, count(*) AS df FROM {p}tf GROUP BY qid, phrase),
  {p}summed AS (SELECT qid, id, round(-sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN {V.IDF_FLOOR:.6f} ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 6) AS score
     FROM {p}tf JOIN {p}df USING (qid, phrase) JOIN {p}sized USING (id), {p}totals GROUP BY qid, id),
  {p}bm25 AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM {p}summed QUALIFY rank <= {k})"""


_SEP = "(?:以及|并且|同时|和|与|并|及)"
_COMPOUND = "regexp_replace(query, '[+＋]', chr(1), 'g')"
for _ in range(2):  # neighbouring matches share a sign, so twice
    _COMPOUND = f"regexp_replace({_COMPOUND}, '([一-鿿]){_SEP}([一-鿿])', '\\1' || chr(1) || '\\2', 'g')"


def _substrings(name: str, queries: str, rows: str, key: str, fields: tuple[str, ...], k: int) -> str:
    """CTEs that end in ``name(qid, id, score, rank)``: BM25 over substrings of the fields."""
    n = name
    count = lambda f: f"(length({f}) - length(replace({f}, term, ''))) // length(term)"
    low = ", ".join(f"lower(coalesce({f}, '')) AS {f}" for f in fields)
    return f"""{n}_rows AS (SELECT {key} AS id, {low} FROM {rows}),
  {n}_terms AS (SELECT qid, unnest(w) AS term, unnest(range(len(w))) AS phrase FROM (SELECT qid, list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 3) AS w FROM {queries})),
  {n}_tf AS (SELECT qid, phrase, id, {" + ".join(count(f) for f in fields)} AS tf FROM {n}_terms, {n}_rows WHERE {" OR ".join(f"contains({f}, term)" for f in fields)}),
  {n}_df AS (SELECT qid, phrase, count(*) AS df FROM {n}_tf GROUP BY qid, phrase), {n}_sized AS (SELECT id, {" + ".join(f"greatest(length({f}) - 2, 0)" for f in fields)} AS dl FROM {n}_rows), {n}_totals AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM {n}_sized),
  {n}_summed AS (SELECT qid, id, round(-sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN {V.IDF_FLOOR:.6f} ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 6) AS score
    FROM {n}_tf JOIN {n}_df USING (qid, phrase) JOIN {n}_sized USING (id), {n}_totals GROUP BY qid, id),
  {n} AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM {n}_summed QUALIFY rank <= {k})"""


def _halves(queries: str) -> str:
    return f"halves AS (SELECT qid, unnest(parts) AS query, unnest(range(len(parts))) AS sub FROM (SELECT qid, list_filter(list_transform(string_split({_COMPOUND}, chr(1)), lambda p: trim(p, ' ')), lambda p: length(p) >= {V.COMPOUND_MIN}) AS parts FROM {queries}) WHERE len(parts) = 2)"


def _half_lists(sub: int) -> str:
    """CTEs that end in ``half<sub>(qid, id, rank)``: substrings for halves with Han signs, words for the others."""
    own, p = f"SELECT qid, query FROM halves WHERE sub = {sub} AND", f"h{sub}_"
    han = f"regexp_matches(query, '{V.CJK}')"
    return f"""{_bm25(f"({own} NOT {han})", 50, p=p)}, {_substrings(p + "tri", f"({own} {han})", "corpus", "chunk_id", ("code", "file_path", "symbol"), 50)},
  half{sub} AS (SELECT qid, id, rank FROM {p}bm25 UNION ALL SELECT qid, id, rank FROM {p}tri)"""


TEXT_QUERIES = "asked AS (SELECT DISTINCT item_id AS qid, query, cat FROM golden_items WHERE query IS NOT NULL AND item_id % 50 = 0)"
SYMBOL_QUERIES = "asked AS (SELECT chunk_id AS qid, symbol AS query FROM corpus WHERE symbol <> '' AND chunk_id % 50 = 0)"


def _knn(k: int, vectors: str = "vectors", where: str = "v.chunk_id % 50 = 0") -> str:
    return f"""pairs AS (SELECT v.chunk_id AS qid, x.chunk_id AS id, round(list_distance(x.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS dist FROM {vectors} v, {vectors} x WHERE {where}),
  knn AS (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM pairs QUALIFY rank <= {k})"""


def _windows(window: int, step: int) -> str:
    return f"""lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
  starts AS (SELECT doc_id, l, unnest(range(0, greatest(0, ceil((len(l) - {window}) / {step}::DOUBLE)::INT * {step}) + 1, {step})) AS i FROM lines),
  cut AS (SELECT doc_id, i, len(l) AS n, array_to_string(l[i + 1 : i + {window}], chr(10)) AS code FROM starts)"""


_NUMBERED = """array_to_string(list_concat(
  list_transform(string_split(code, chr(10))[1:{n}], lambda x, i: format('{{:>6}}', start_line + i - 1) || chr(9) || CASE WHEN length(x) <= 200 THEN x ELSE x[1:200] || ' …' END),
  CASE WHEN len(string_split(code, chr(10))) > {n} THEN ['... (' || (len(string_split(code, chr(10))) - {n}) || ' more lines)'] ELSE [] END), chr(10))"""

_EMBED = """CASE WHEN coalesce(file_path, '') = '' AND symbol = '' AND language = '' THEN code ELSE
  CASE WHEN coalesce(file_path, '') <> '' THEN '# File: ' || file_path || chr(10) ELSE '' END || CASE WHEN symbol <> '' THEN '# Symbol: ' || symbol || chr(10) ELSE '' END
  || CASE WHEN language <> '' THEN '# Language: ' || language || chr(10) ELSE '' END || chr(10) || code END"""


def _declared(code: str, lang: str) -> str:
    cases = " ".join(
        f"WHEN '{key}' THEN list_concat(" + ", ".join([f"regexp_extract_all({code}, '{p}', 1)" for p in patterns] + (["[]::VARCHAR[]"] if len(patterns) == 1 else [])) + ")" for key, patterns in V.DECLARED.items()
    )
    names = f"CASE replace({lang}, 'tsx', 'typescript') {cases} ELSE [] END"
    keep = f"length(n) >= {V.DECLARED_MIN} AND n NOT IN ({_list(V.DECLARED_STOP)}) AND NOT {_boilerplate('n')} AND NOT ({lang} IN ('java', 'typescript', 'tsx') AND regexp_matches(n, '^[A-Z]'))"
    return names, keep


def _ordered_distinct(name: str) -> str:
    """First occurrences of a list column's elements, in order."""
    return f"list_filter({name}, lambda x, i: list_position({name}, x) = i)"


_BARE, _CALLS, _CALLING = _called("code", "language")
_NAMES, _KEEP = _declared("code", "language")
DECLARED = f"declared AS (SELECT chunk_id, list_filter({_NAMES}, lambda n: {_KEEP}) AS all_names FROM corpus)"

_NAMED = "list_filter(regexp_extract_all(coalesce(query, ''), '[A-Za-z_][A-Za-z0-9_]{3,}'), lambda w: contains(w, '_') OR regexp_matches(w, '[a-z][A-Z]'))"
_CLASSES = "list_transform(list_filter(a, lambda w: regexp_matches(lower(w), '^(tb|t)_')), lambda w: array_to_string(list_transform(list_filter(string_split(w, '_')[2:], lambda p: p <> ''), lambda p: upper(p[1:1]) || p[2:]), ''))"
IDENTS = f"""idents AS (SELECT qid, list_distinct(list_concat(b, list_transform(list_filter(b, lambda w: regexp_matches(w, '^[A-Z]')), lambda w: lower(w[1:1]) || w[2:]))) AS names FROM (
  SELECT qid, list_filter(list_concat(a, {_CLASSES}), lambda w: w <> '') AS b FROM (SELECT qid, {_NAMED} AS a FROM named_queries)))"""

_BOOST = f"""CASE WHEN len(asked_tokens) = 0 THEN 1.0::DOUBLE WHEN array_to_string(sp, '') <> '' AND list_contains(asked_tokens, array_to_string(sp, '')) THEN 1.5::DOUBLE
  ELSE 1.0::DOUBLE + 0.1::DOUBLE * least(len(list_intersect(list_distinct(list_concat(sp, stp)), asked_tokens)), 3) END"""
def _scored(source: str = "bm25", score: str = "round(-b.score, 6)") -> str:
    return f"""ready AS (SELECT b.qid, b.id, {score} AS score, b.rank, c.file_path, c.language, c.symbol, c.code, a.query, {_parts("c.symbol")} AS sp, {_parts(f"regexp_extract({_base('c.file_path')}, '^([^.]*)', 1)")} AS stp,
    list_distinct(list_concat(list_transform(regexp_extract_all(a.query, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: lower(w)), flatten(list_transform(regexp_extract_all(a.query, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: {_parts("w")})))) AS asked_tokens
  FROM {source} b JOIN corpus c ON b.id = c.chunk_id JOIN asked a USING (qid)),
  scored AS (SELECT qid, id, rank, file_path, code, query, decl AS decl_mult, score * decl * tst * bar * noncode * ent * tiny * boost AS score FROM (SELECT *,
    CASE WHEN NOT {_intent("query", "decl")} AND {_declaration("code", "language")} THEN CASE WHEN {_intent("query", "impl")} THEN 0.5625::DOUBLE ELSE 0.75::DOUBLE END ELSE 1.0::DOUBLE END AS decl,
    CASE WHEN {_TEST} THEN CASE WHEN {_intent("query", "test")} THEN 1.2::DOUBLE ELSE 0.5::DOUBLE END ELSE 1.0::DOUBLE END AS tst,
    CASE WHEN {_base("file_path")} IN ({_list(V.BARREL_FILES)}) THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS bar,
    CASE WHEN language IN ({_list(V.NON_CODE)}) THEN CASE WHEN {_intent("query", "doc")} THEN 1.5::DOUBLE WHEN {_intent("query", "config")} AND language IN ({_list(V.CONFIG_LANGUAGES)}) THEN 1.4::DOUBLE ELSE 0.7::DOUBLE END ELSE 1.0::DOUBLE END AS noncode,
    CASE WHEN NOT {_intent("query", "decl")} AND NOT {_declaration("code", "language")} AND {_entity("code", "language")} THEN CASE WHEN {_intent("query", "impl")} THEN 0.6375::DOUBLE ELSE 0.85::DOUBLE END ELSE 1.0::DOUBLE END AS ent,
    CASE WHEN len(string_split(code, chr(10))) <= 2 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS tiny, {_BOOST} AS boost FROM ready))"""


SCORED = _scored()


def _symbol_scored() -> str:
    return f"{CORPUS}, {SYMBOL_QUERIES}, {_bm25('asked')}, ss AS (SELECT b.qid, b.id, round(-b.score, 6) AS score, b.rank AS r0, c.file_path FROM bm25 b JOIN corpus c ON b.id = c.chunk_id)"


def _capped(where: str = "true", n: int = 10, source: str = "ss", tie: str = "id") -> str:
    return f"""few AS (SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY qid, file_path ORDER BY score DESC, {tie}) <= {V.MAX_PER_FILE}),
  top AS (SELECT qid, id, file_path, score, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {tie}) AS place FROM few) WHERE place <= {n})"""


#: CTEs that end in ``paired``: ``scored`` with implementations lifted above their interfaces.
_PAIRED = f"""stemmed AS (SELECT *, regexp_extract({_base("file_path")}, '^([^.]*)', 1) AS stem FROM scored), best_of AS (SELECT qid, stem, max(score / decl_mult) AS base, arg_max(id, (score, -rank, -id)) AS best_id FROM stemmed GROUP BY qid, stem),
  lift AS (SELECT i.qid, i.best_id AS id, max(x.base) AS base FROM best_of i JOIN best_of x ON i.qid = x.qid AND i.stem = x.stem || 'Impl' GROUP BY i.qid, i.best_id),
  paired AS (SELECT s.qid, s.id, s.rank, s.file_path, CASE WHEN l.base > s.score THEN l.base * 1.01::DOUBLE ELSE s.score END AS score FROM scored s LEFT JOIN lift l ON l.qid = s.qid AND l.id = s.id)"""


def _related(origins: str) -> str:
    """CTEs that end in ``numbered(qid, id, relation, n)`` for a SELECT of origins (qid, id, symbol)."""
    return f"""origins AS ({origins}),
  fan AS (SELECT symbol FROM corpus WHERE symbol <> '' GROUP BY symbol HAVING count(*) <= {V.MAX_FANOUT}),
  called AS (SELECT DISTINCT o.qid, c.callee_name FROM calls c JOIN origins o ON c.caller_id = o.id WHERE NOT {_boilerplate("c.callee_name")} AND c.callee_name NOT IN (SELECT callee_name FROM hot)),
  callees AS (SELECT DISTINCT k.qid, p.chunk_id AS id, 'callee' AS relation FROM called k JOIN fan ON fan.symbol = k.callee_name JOIN corpus p ON p.symbol = k.callee_name WHERE (k.qid, p.chunk_id) NOT IN (SELECT (qid, id) FROM origins)),
  names AS (SELECT qid, symbol AS callee_name FROM origins UNION SELECT o.qid, unnest({_ordered_distinct("d.all_names")}[1:{V.DECLARED_MOST}]) FROM origins o JOIN declared d ON d.chunk_id = o.id),
  wanted AS (SELECT DISTINCT qid, callee_name FROM names WHERE callee_name <> '' AND NOT {_boilerplate("callee_name")} AND callee_name NOT IN (SELECT callee_name FROM hot)),
  callers AS (SELECT DISTINCT w.qid, c.caller_id AS id, 'caller' AS relation FROM calls c JOIN wanted w USING (callee_name) WHERE (w.qid, c.caller_id) NOT IN (SELECT (qid, id) FROM origins) AND (w.qid, c.caller_id) NOT IN (SELECT (qid, id) FROM callees)),
  found AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relation = 'caller', id) AS n FROM (SELECT * FROM callees UNION ALL SELECT * FROM callers) QUALIFY n <= {V.GRAPH_LIMIT * 9}),
  once AS (SELECT f.* FROM found f JOIN corpus c ON c.chunk_id = f.id QUALIFY row_number() OVER (PARTITION BY f.qid, c.symbol, c.code[1:200] ORDER BY f.n) = 1),
  numbered AS (SELECT qid, id, relation, row_number() OVER (PARTITION BY qid ORDER BY n) AS n FROM once QUALIFY n <= {V.GRAPH_LIMIT * 3})"""

_FORCED = f"{_base('file_path')} IN ({_list(V.FORCED_FILES)})"

SQL: dict[str, str] = {
    "chunk_lines": f"WITH {_windows(60, 50)} SELECT doc_id, 'lines_' || (i + 1) AS symbol, i + 1 AS start_line, least(i + 60, n) AS end_line, sha256(doc_id || chr(0) || code) AS blob_hash FROM cut WHERE regexp_matches(code, '\\S')",
    "chunk_lines_short": f"WITH {_windows(12, 8)} SELECT doc_id, 'lines_' || (i + 1) AS symbol, i + 1 AS start_line, least(i + 12, n) AS end_line, length(code) AS n_chars FROM cut WHERE regexp_matches(code, '\\S')",
    "language_map": f"SELECT DISTINCT chunk_id, {_lang('file_path')} AS lang FROM chunks",
    "blob_dedup": f"WITH {KEPT} SELECT chunk_id, blob_hash, file_path FROM kept",
    "insert_ignore": "WITH a AS (SELECT DISTINCT chunk_id, blob_hash FROM chunks WHERE start_line = 1 QUALIFY row_number() OVER (PARTITION BY blob_hash ORDER BY chunk_id) = 1), b AS (SELECT DISTINCT chunk_id, blob_hash FROM chunks WHERE start_line > 1 QUALIFY row_number() OVER (PARTITION BY blob_hash ORDER BY chunk_id) = 1) SELECT * FROM a UNION ALL SELECT * FROM b WHERE blob_hash NOT IN (SELECT blob_hash FROM a)",
    "cascade_delete": f"""WITH {CORPUS}, {CALLS}, {USABLE}, {STATES}, gone AS (SELECT file_path FROM states WHERE state = 'deleted'), gone_ids AS (SELECT chunk_id FROM corpus WHERE file_path IN (SELECT file_path FROM gone))
      SELECT 'chunks' AS dataset, count(*) AS n FROM corpus WHERE file_path NOT IN (SELECT file_path FROM gone) UNION ALL SELECT 'edges', count(*) FROM calls WHERE caller_id NOT IN (SELECT chunk_id FROM gone_ids)""",
    "replace_files": f"WITH {CORPUS}, {USABLE}, {STATES}, dirty AS (SELECT file_path FROM states WHERE state = 'dirty') SELECT chunk_id, file_path FROM corpus WHERE file_path NOT IN (SELECT file_path FROM dirty) OR start_line = 1",
    "fingerprint_latest": f"WITH {_fingerprints('latest', 'a')} SELECT file_path, file_hash, coalesce(mtime, -1) AS mtime, coalesce(size, -1) AS size FROM a",
    "fingerprint_diff": f"""WITH {_fingerprints("latest", "cur")}, {_fingerprints("oldest", "old")}, listing AS (SELECT p.file_path, c.file_hash, c.mtime, c.size FROM (SELECT DISTINCT file_path FROM chunks) p LEFT JOIN cur c USING (file_path))
      SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN b.file_path IS NULL THEN 'new' WHEN a.file_path IS NULL THEN 'deleted' WHEN a.mtime IS NOT DISTINCT FROM b.mtime AND a.size IS NOT DISTINCT FROM b.size THEN 'same'
        WHEN a.file_hash = b.file_hash AND a.file_hash <> '' THEN 'touched' ELSE 'changed' END AS status FROM listing a FULL OUTER JOIN old b ON a.file_path = b.file_path""",
    "fingerprint_upsert": f"WITH {_fingerprints('oldest', 'old', 'mtime IS NOT NULL')}, {_fingerprints('latest', 'cur', 'size IS NOT NULL')} SELECT file_path, file_hash, coalesce(mtime, -1) AS mtime, coalesce(size, -1) AS size FROM (SELECT file_path, file_hash, mtime, size FROM cur UNION ALL SELECT file_path, file_hash, mtime, size FROM old WHERE file_path NOT IN (SELECT file_path FROM cur))",
    "file_admission": f"""SELECT DISTINCT file_path, coalesce(size, -1) AS size, {_base("file_path")} NOT IN ({_list(V.LOCK_FILES)}) AND ({_FORCED} OR {_lang("file_path")} <> 'text')
      AND len(list_filter(string_split(file_path, '/')[1:-2], lambda x: x IN ({_list(V.IGNORED_DIRS)}) OR (x LIKE '.%' AND x NOT IN ({_list(V.ALLOWED_DOT_DIRS)})))) = 0 AND coalesce(size, 0) <= {V.MAX_FILE_SIZE} AS admitted FROM files WHERE file_path IS NOT NULL""",
    "stats": f"WITH {CORPUS} SELECT count(*) AS chunks, count(DISTINCT file_path) AS files, count(DISTINCT nullif(symbol, '')) AS symbols FROM corpus",
    "meaningful": f"WITH {CORPUS} SELECT chunk_id, len(string_split(code, chr(10))) >= 3 OR length(regexp_replace(code, '^\\s+|\\s+$', '', 'g')) >= 40 AS meaningful FROM corpus",
    "edge_extract": f"WITH {CORPUS}, bared AS (SELECT chunk_id, language, {_BARE} AS bare FROM corpus WHERE language IN ({_CALLING})), named AS (SELECT DISTINCT chunk_id AS caller_id, unnest({_CALLS}) AS callee_name FROM bared) SELECT * FROM named WHERE callee_name NOT IN ({_list(V.CALL_STOP + V.CALL_KEYWORDS)})",
    "whole_files": """WITH pieces AS (SELECT DISTINCT file_path, coalesce(start_line, 1) AS s, string_split(code, chr(10)) AS l FROM chunks WHERE file_path IS NOT NULL AND code IS NOT NULL),
      lines AS (SELECT file_path, s, s + i AS pos, l[i + 1] AS line FROM (SELECT file_path, s, l, unnest(range(len(l))) AS i FROM pieces)),
      once AS (SELECT file_path, pos, arg_min(line, (s, line)) AS line FROM lines GROUP BY file_path, pos), whole AS (SELECT file_path, string_agg(line, chr(10) ORDER BY pos) AS code FROM once GROUP BY file_path)
      SELECT file_path, length(code) AS n_chars, md5(code) AS code_md5 FROM whole""",
    "embed_texts": f"WITH {CORPUS} SELECT chunk_id, md5(({_EMBED})[1:16000]) AS embed_md5, md5((coalesce(file_path, '') || ' :: ' || symbol || chr(10) || code)[1:4000]) AS rerank_md5 FROM corpus",
    "ident_split": f"WITH {CORPUS} SELECT chunk_id, array_to_string({_parts('symbol')}, ' ') AS parts, {_base('file_path')} AS base, regexp_extract({_base('file_path')}, '^([^.]*)', 1) AS stem FROM corpus",
    "fts_tokens": f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, md5(array_to_string({_tokens('text')}, ' ')) AS tokens_md5 FROM documents",
    "declared_names": f"WITH {CORPUS}, {DECLARED} SELECT chunk_id, array_to_string({_ordered_distinct('all_names')}[1:{V.DECLARED_MOST}], ' ') AS names FROM declared",
    "file_classes": f"WITH {CORPUS} SELECT chunk_id, {_TEST} AS test, {_base('file_path')} IN ({_list(V.BARREL_FILES)}) AS barrel, {_declaration('code', 'language')} AS declaration, {_entity('code', 'language')} AS entity, {_boilerplate('symbol')} AS boilerplate FROM corpus",
    "vector_serialise": f"WITH {VECTORS}, q AS (SELECT chunk_id, list_transform(embedding, lambda x: greatest(-128, least(127, round(x::DOUBLE * 127)))::INT) AS v FROM vectors) SELECT chunk_id, list_sum(v)::BIGINT AS total, list_sum(list_transform(v, lambda x: x * x))::BIGINT AS squares FROM q",
    "knn_l2": f"WITH {VECTORS}, {_knn(10)} SELECT * FROM knn",
    "knn_int8": f"WITH {VECTORS}, small AS (SELECT chunk_id, list_transform(embedding, lambda x: greatest(-128, least(127, round(x::DOUBLE * 127)))::INT) AS embedding FROM vectors), {_knn(10, 'small')} SELECT * FROM knn",
    "bm25_topk": f"WITH {CORPUS}, {TEXT_QUERIES}, {_bm25('asked')} SELECT * FROM bm25",
    "bm25_symbols": f"WITH {CORPUS}, {SYMBOL_QUERIES}, {_bm25('asked')} SELECT * FROM bm25",
    "intent_score": f"WITH {CORPUS}, {TEXT_QUERIES}, {_bm25('asked')}, {SCORED} SELECT qid, id, round(decl_mult, 6) AS decl_mult, round(score, 6) AS score FROM scored",
    "per_group_cap": f"WITH {_symbol_scored()}, {_capped()} SELECT qid, id, rank FROM top",
    "path_filter_glob": f"WITH {_symbol_scored()}, {_capped('regexp_full_match(file_path, $$.*/src/.*[.][jt]s$$)')} SELECT qid, id, rank FROM top",
    "path_filter_part": f"WITH {_symbol_scored()}, {_capped('contains(lower(file_path), $$core/$$)')} SELECT qid, id, rank FROM top",
    "hot_symbols": f"WITH {CALLS}, {HOT} SELECT * FROM hot",
    "symbol_fanout": f"WITH {CORPUS} SELECT symbol, count(*) AS definitions, count(*) <= {V.MAX_FANOUT} AS resolvable FROM corpus WHERE symbol <> '' GROUP BY symbol",
    "callers_of": f"WITH {CORPUS}, {CALLS}, {SYMBOL_QUERIES}, names AS (SELECT DISTINCT qid, query AS callee_name FROM asked) SELECT qid, callee_name, caller_id AS id FROM calls JOIN names USING (callee_name) QUALIFY row_number() OVER (PARTITION BY qid, callee_name ORDER BY caller_id) <= {V.CALLERS_LIMIT}",
    "graph_expand": f"WITH {CORPUS}, {CALLS}, {HOT}, {DECLARED}, {_related('SELECT chunk_id AS qid, chunk_id AS id, symbol FROM corpus WHERE chunk_id % 50 = 0')} SELECT qid, id, relation, row_number() OVER (PARTITION BY qid ORDER BY relation = 'caller' DESC, n) AS rank FROM numbered QUALIFY rank <= {V.GRAPH_LIMIT}",
    "intent_inject": f"""WITH {CORPUS}, {CALLS}, {TEXT_QUERIES}, {_bm25("asked")}, named_queries AS (SELECT DISTINCT item_id AS qid, 'who calls ' || query AS query FROM golden_items WHERE query IS NOT NULL), {IDENTS},
      hits AS (SELECT DISTINCT qid, id FROM (SELECT n.qid, n.name, c.caller_id AS id FROM (SELECT qid, unnest(names) AS name FROM idents) n JOIN calls c ON c.callee_name = n.name QUALIFY row_number() OVER (PARTITION BY n.qid, n.name ORDER BY c.caller_id) <= {V.CALLERS_LIMIT}))
      SELECT coalesce(b.qid, h.qid) AS qid, coalesce(b.id, h.id) AS id, CASE WHEN h.qid IS NOT NULL THEN {V.INTENT_SCORE}::DOUBLE ELSE round(-b.score, 6) END AS score FROM bm25 b FULL OUTER JOIN hits h ON b.qid = h.qid AND b.id = h.id""",
    "content_dedup": f"WITH {CORPUS} SELECT min(chunk_id) AS chunk_id, count(*) AS copies FROM corpus GROUP BY symbol, code[1:200]",
    "numbered_lines": f"WITH {CORPUS} SELECT chunk_id, md5({_NUMBERED.format(n=20)}) AS shown_md5 FROM corpus",
    "render_overlap": f"""WITH {CORPUS}, w AS (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM corpus)
      SELECT chunk_id, greatest(coalesce(shown - start_line + 1, 0), 0) AS skipped, start_line + greatest(coalesce(shown - start_line + 1, 0), 0) AS first, coalesce(start_line > shown + 1, false) AS gap FROM w""",
    "last_op_wins": f"WITH {USABLE}, {STATES} SELECT * FROM states",
    "debounce_bursts": f"""WITH {USABLE}, r AS (SELECT string_split(file_path, '/')[1] AS repo, seen_at FROM usable), g AS (SELECT *, CASE WHEN seen_at <= lag(seen_at) OVER (PARTITION BY repo ORDER BY seen_at) + INTERVAL {V.DEBOUNCE_SECONDS} SECOND THEN 0 ELSE 1 END AS fresh FROM r),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY repo ORDER BY seen_at ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT repo, min(seen_at) AS started, max(seen_at) AS ended, count(*) AS changes FROM s GROUP BY repo, burst""",
    "count_flush": f"WITH {USABLE} SELECT string_split(file_path, '/')[1] AS repo, count(*) // {V.FLUSH_COUNT} AS flushes, count(*) % {V.FLUSH_COUNT} AS pending FROM usable GROUP BY repo",
    "topk_agreement": f"""WITH {VECTORS}, small AS (SELECT chunk_id, list_transform(embedding, lambda x: greatest(-128, least(127, round(x::DOUBLE * 127)))::INT) AS embedding FROM vectors), {_knn(5)},
      pairs2 AS (SELECT v.chunk_id AS qid, x.chunk_id AS id, round(list_distance(x.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS dist FROM small v, small x WHERE v.chunk_id % 50 = 0), knn2 AS (SELECT qid, id FROM pairs2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, id) <= 5)
      SELECT qid, count(b.id) AS shared FROM knn a LEFT JOIN knn2 b USING (qid, id) GROUP BY qid""",
    "rrf_fusion": f"""WITH {CORPUS}, {VECTORS}, asked AS (SELECT c.chunk_id AS qid, c.symbol AS query FROM corpus c JOIN vectors v USING (chunk_id) WHERE c.symbol <> '' AND c.chunk_id % 50 = 0), {_bm25("asked")}, {_knn(20, where="v.chunk_id IN (SELECT qid FROM asked)")},
      lists AS (SELECT qid, id, rank, 0 AS path, 1.0::DOUBLE AS w FROM knn UNION ALL SELECT qid, id, rank, 1, {V.WEIGHTS["sub"]}::DOUBLE FROM bm25),
      fused AS (SELECT qid, id, round(sum(w / (60 + rank)), 9) AS score, min({{'path': path, 'rank': rank}}) AS first FROM lists GROUP BY qid, id)
      SELECT qid, id, round(score, 6) AS score, first.path AS path, first.rank AS path_rank FROM fused QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, first.path, first.rank, id) <= 20""",
    "impl_pairing": f"""WITH {CORPUS}, rows AS (SELECT string_split(file_path, '/')[1] AS repo, chunk_id AS id, CASE WHEN chunk_id % 3 = 0 THEN 'Impl' ELSE '' END AS tail, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS base,
        CASE WHEN chunk_id % 2 = 0 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS decl_mult, chunk_id % 97 / 97.0::DOUBLE AS score FROM corpus),
      stems AS (SELECT *, string_split(base || tail, '.')[1] AS stem FROM rows), best AS (SELECT repo, stem, max(score / decl_mult) AS base, arg_max(id, (score, 0)) AS best_id FROM stems GROUP BY repo, stem)
      SELECT s.repo, s.id, round(CASE WHEN b.base > s.score THEN b.base * 1.01::DOUBLE ELSE s.score END, 6) AS score FROM stems s
      LEFT JOIN (SELECT i.repo, i.best_id AS id, x.base FROM best i JOIN best x ON i.repo = x.repo AND i.stem = x.stem || 'Impl') b ON b.repo = s.repo AND b.id = s.id""",
    "query_intents": f"""SELECT item_id, {", ".join(f"{_intent('query', k)} AS {k}" for k in V.INTENTS)}, CASE WHEN len(parts) = 2 THEN array_to_string(parts, '|') ELSE '' END AS halves, array_to_string(list_sort(names), '|') AS named FROM (
      SELECT q.item_id, q.query, list_filter(list_transform(string_split({_COMPOUND}, chr(1)), lambda p: trim(p, ' ')), lambda p: length(p) >= {V.COMPOUND_MIN}) AS parts, i.names FROM (SELECT DISTINCT item_id, query FROM golden_items) q
      JOIN (WITH named_queries AS (SELECT DISTINCT item_id AS qid, query FROM golden_items), {IDENTS} SELECT * FROM idents) i ON i.qid = q.item_id)""",
    "trigram_match": f"""WITH docs AS (SELECT doc_id AS id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id), asked AS (SELECT DISTINCT item_id AS qid, query FROM golden_items WHERE lang = 'zh' AND query IS NOT NULL),
      {_substrings("tri", "asked", "docs", "id", ("text",), 20)} SELECT qid, id, score, rank FROM tri""",
    "hybrid_search_golden": f"""WITH {CORPUS}, {CALLS}, {HOT}, {DECLARED}, asked AS (SELECT DISTINCT item_id AS qid, query FROM golden_items WHERE query IS NOT NULL), {_halves("asked")},
      {_bm25("asked", 50)}, {_substrings("tri", f"(SELECT * FROM asked WHERE regexp_matches(query, '{V.CJK}'))", "corpus", "chunk_id", ("code", "file_path", "symbol"), 50)},
      {_half_lists(0)}, {_half_lists(1)},
      lists AS (SELECT qid, id, rank, 0 AS path, 1.0::DOUBLE AS w FROM bm25 UNION ALL SELECT qid, id, rank, 1, 1.0 FROM tri UNION ALL SELECT qid, id, rank, 2, {V.WEIGHTS["sub"]} FROM half0 UNION ALL SELECT qid, id, rank, 3, {V.WEIGHTS["sub"]} FROM half1),
      summed2 AS (SELECT qid, id, round(sum(w / (60 + rank)), 9) AS score, min({{'path': path, 'rank': rank}}) AS first FROM lists GROUP BY qid, id),
      fused AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first.path, first.rank, id) AS rank FROM summed2),
      named_queries AS (SELECT * FROM asked WHERE {_intent("query", "caller")}), {IDENTS},
      hits AS (SELECT DISTINCT qid, id FROM (SELECT n.qid, n.name, c.caller_id AS id FROM (SELECT qid, unnest(names) AS name FROM idents) n JOIN calls c ON c.callee_name = n.name QUALIFY row_number() OVER (PARTITION BY n.qid, n.name ORDER BY c.caller_id) <= {V.CALLERS_LIMIT})),
      taken AS (SELECT coalesce(f.qid, h.qid) AS qid, coalesce(f.id, h.id) AS id, CASE WHEN h.qid IS NOT NULL THEN {V.INTENT_SCORE}::DOUBLE ELSE f.score END AS score, coalesce(f.rank, 2147483647) AS rank FROM (SELECT * FROM fused WHERE rank <= 50) f FULL OUTER JOIN hits h ON f.qid = h.qid AND f.id = h.id),
      {_scored("taken", "b.score")}, {_PAIRED}, {_capped("true", 10, "paired", "rank, id")},
      {_related("SELECT t.qid, t.id, c.symbol FROM top t JOIN corpus c ON c.chunk_id = t.id")},
      near AS (SELECT * FROM (SELECT n.qid, n.id, n.relation, row_number() OVER (PARTITION BY n.qid ORDER BY coalesce(f.score, 0) DESC, n.relation = 'caller' DESC, n.n) AS rank FROM numbered n LEFT JOIN fused f ON f.qid = n.qid AND f.id = n.id) WHERE rank <= {V.GRAPH_LIMIT})
      SELECT qid, rank, id, file_path, symbol, score, relation FROM (SELECT t.qid, t.rank, t.id, c.file_path, c.symbol, round(t.score, 6) AS score, NULL AS relation FROM top t JOIN corpus c ON c.chunk_id = t.id
        UNION ALL SELECT n.qid, n.rank + 10, n.id, c.file_path, c.symbol, 0.0, n.relation FROM near n JOIN corpus c ON c.chunk_id = n.id)""",
    "sync_incremental": f"""WITH {USABLE}, {STATES}, pieces AS (SELECT DISTINCT file_path, coalesce(start_line, 1) AS s, string_split(code, chr(10)) AS l FROM chunks WHERE file_path IS NOT NULL AND code IS NOT NULL),
      lines0 AS (SELECT file_path, s, s + i AS pos, l[i + 1] AS line FROM (SELECT file_path, s, l, unnest(range(len(l))) AS i FROM pieces)),
      once AS (SELECT file_path, pos, arg_min(line, (s, line)) AS line FROM lines0 GROUP BY file_path, pos), whole AS (SELECT file_path, string_agg(line, chr(10) ORDER BY pos) AS code FROM once GROUP BY file_path),
      lines AS (SELECT w.file_path, string_split(w.code || CASE WHEN s.state = 'dirty' THEN chr(10) || 'last line changed' ELSE '' END, chr(10)) AS l FROM whole w LEFT JOIN states s USING (file_path) WHERE coalesce(s.state, '') <> 'deleted'),
      starts AS (SELECT file_path, l, unnest(range(0, greatest(0, ceil((len(l) - 60) / 50::DOUBLE)::INT * 50) + 1, 50)) AS i FROM lines), cut AS (SELECT file_path, i, len(l) AS n, array_to_string(l[i + 1 : i + 60], chr(10)) AS code FROM starts),
      made AS (SELECT file_path, 'lines_' || (i + 1) AS symbol, i + 1 AS start_line, least(i + 60, n) AS end_line, code FROM cut WHERE regexp_matches(code, '\\S') QUALIFY row_number() OVER (PARTITION BY file_path, code ORDER BY i) = 1)
      SELECT file_path, symbol, start_line, end_line, md5(code) AS code_md5 FROM made""",
    "eval_metrics": f"""WITH {CORPUS}, golden AS (SELECT DISTINCT item_id AS qid, cat, expected, query FROM golden_items WHERE query IS NOT NULL), {_bm25("(SELECT DISTINCT qid, query FROM golden)", 10)},
      found AS (SELECT b.qid, b.rank, c.file_path FROM bm25 b JOIN corpus c ON b.id = c.chunk_id), wanted AS (SELECT qid, cat, unnest(CASE WHEN len(expected) = 0 OR expected IS NULL THEN [NULL] ELSE expected END) AS path FROM golden),
      hits AS (SELECT w.qid, w.cat, min(CASE WHEN contains(f.file_path, w.path) THEN f.rank END) AS r FROM wanted w LEFT JOIN found f USING (qid) GROUP BY w.qid, w.cat)
      SELECT cat, count(*) AS items, round(avg(coalesce(r = 1, false)::INT), 6) AS top1, round(avg(coalesce(r <= 5, false)::INT), 6) AS recall5, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM hits GROUP BY cat""",
    "rescue": f"""WITH {_symbol_scored()}, {_capped("r0 <= 10")}, probes AS (SELECT DISTINCT qid, file_path FROM ss WHERE r0 > 10), held AS (SELECT DISTINCT p.qid FROM probes p JOIN top t USING (qid, file_path)),
      pool AS (SELECT s.* FROM ss s WHERE s.r0 > 10 AND s.qid NOT IN (SELECT qid FROM held) AND 0.5 - s.r0 / 100.0 >= 0.2 AND (s.qid, s.id) NOT IN (SELECT (qid, id) FROM top)),
      best AS (SELECT qid, id, score FROM pool QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r0, id) = 1),
      low AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid ORDER BY score, id DESC) AS k FROM top),
      kept AS (SELECT l.qid, l.id, l.score, false AS rescued FROM low l LEFT JOIN best b ON b.qid = l.qid WHERE NOT (b.qid IS NOT NULL AND l.n >= 10 AND l.k = 1) UNION ALL SELECT qid, id, score, true FROM best)
      SELECT qid, id, rescued, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM kept""",
    "rerank_mix": f"""WITH {CORPUS}, {TEXT_QUERIES}, {_bm25("asked")}, {SCORED}, halves AS (SELECT qid, id, score, code, list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2) AS w FROM scored),
      subs AS (SELECT qid, id, 0 AS sub, code, w[1 : ceil(len(w) / 2.0)::INT] AS part FROM halves UNION ALL SELECT qid, id, 1, code, w[ceil(len(w) / 2.0)::INT + 1 :] FROM halves),
      toks AS (SELECT qid, id, sub, list_distinct({_tokens("array_to_string(part, ' ')")}) AS a, list_distinct({_tokens("code")}) AS b FROM subs),
      s AS (SELECT qid, id, sub, len(list_intersect(a, b)) / greatest(len(a), 1)::DOUBLE AS s FROM toks), best AS (SELECT qid, sub, max(s) AS best FROM s GROUP BY qid, sub), tops AS (SELECT qid, max(score) AS top FROM scored GROUP BY qid),
      raised AS (SELECT qid, id, max(top * s / best * 0.95::DOUBLE) AS raised, max(s) AS sub_score FROM s JOIN best USING (qid, sub) JOIN tops USING (qid) WHERE s >= 0.2 AND best > 0 GROUP BY qid, id)
      SELECT qid, id, round(greatest(score, raised), 6) AS score, round(sub_score, 6) AS sub_score FROM scored LEFT JOIN raised USING (qid, id)""",
    "hybrid_search": f"""WITH {CORPUS}, {VECTORS}, {CALLS}, {HOT}, {DECLARED}, asked AS (SELECT c.chunk_id AS qid, c.symbol AS query FROM corpus c JOIN vectors v USING (chunk_id) WHERE c.symbol <> '' AND c.chunk_id % 50 = 0),
      {_bm25("asked", 50)}, {_knn(50, where="v.chunk_id IN (SELECT qid FROM asked)")},
      lists AS (SELECT qid, id, rank, 0 AS path FROM knn UNION ALL SELECT qid, id, rank, 1 FROM bm25),
      summed2 AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min({{'path': path, 'rank': rank}}) AS first FROM lists GROUP BY qid, id),
      fused AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first.path, first.rank, id) AS rank FROM summed2), taken AS (SELECT * FROM fused WHERE rank <= 50),
      {_scored("taken", "b.score")}, {_PAIRED}, {_capped("true", 10, "paired", "rank, id")},
      {_related("SELECT t.qid, t.id, c.symbol FROM top t JOIN corpus c ON c.chunk_id = t.id")},
      near AS (SELECT * FROM (SELECT n.qid, n.id, n.relation, row_number() OVER (PARTITION BY n.qid ORDER BY coalesce(f.score, 0) DESC, n.relation = 'caller' DESC, n.n) AS rank FROM numbered n LEFT JOIN fused f ON f.qid = n.qid AND f.id = n.id) WHERE rank <= {V.GRAPH_LIMIT})
      SELECT qid, rank, id, file_path, symbol, score, relation FROM (SELECT t.qid, t.rank, t.id, c.file_path, c.symbol, round(t.score, 6) AS score, NULL AS relation FROM top t JOIN corpus c ON c.chunk_id = t.id
        UNION ALL SELECT n.qid, n.rank + 10, n.id, c.file_path, c.symbol, 0.0, n.relation FROM near n JOIN corpus c ON c.chunk_id = n.id)""",
}
