"""Retrieval: exact nearest vectors, BM25 over words and over substrings, rank fusion. A query set runs as one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions import columns as C
from sparkseek.functions import vocabulary as V
from sparkseek.session import broadcast_if_small, cut


#: The indexed columns of a chunk.
FIELDS = ("code", "file_path", "symbol")


def top_per_query(scored: DataFrame, k: int | None, order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each ``qid`` (all for None) with their rank. The window limits each group before the shuffle."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


#: Rounded distances have this step; rows that may round to one value are told apart by their ids.
STEP = 1e-6


def _packed(rows: DataFrame, block: int, copies: int | None = None) -> DataFrame:
    """Rows (id, v) as blocks (ids, matrix, dim) of up to ``block`` vectors, made where the rows are. ``copies``: equal vectors of a
    block keep only so many, those of the smallest ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), block):
                part = pdf.iloc[s : s + block]
                m = np.stack(part["v"].to_numpy()).astype(np.float64)
                ids = part["id"].to_numpy().astype(np.int64)
                if copies is not None:
                    order = np.argsort(ids, kind="stable")
                    ids, m = ids[order], m[order]
                    same = pd.Series([x.tobytes() for x in m])
                    kept = (same.groupby(same).cumcount() < copies).to_numpy()
                    ids, m = ids[kept], m[kept]
                yield pd.DataFrame({"ids": [ids.tobytes()], "matrix": [m.tobytes()], "dim": [m.shape[1]]})

    return rows.mapInPandas(run, "ids binary, matrix binary, dim int")


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """``(qid, id, dist, rank)``: the exact ``k`` nearest by Euclidean distance; ties go to the smaller id.

    ``queries`` (qid, qvec) is a stated set, run against all rows in blocks: every block of vectors meets every block of queries as
    two matrices. Of a block's equal vectors the ``k`` smallest ids take part. Every row whose distance may round to the ``k``-th of
    its block or less, and to that of the blocks before it in its task, is measured again in the reference's order of sums, however
    many tie there, and the window keeps ``k`` of them by (distance, id). Nothing passes through the driver; Spark broadcasts the query blocks if they are small and otherwise pairs the
    blocks by a distributed product.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach: dict[bytes, np.ndarray] = {}  # by block of queries: what the k-th distance is at most
        for batch in batches:
            for row in range(batch.num_rows):
                buffer = lambda name: batch.column(name)[row].as_buffer()  # noqa: B023, E731  # not a copy
                dim = batch.column("dim")[row].as_py()
                all_q = np.frombuffer(buffer("qmatrix")).reshape(-1, dim)
                x = np.frombuffer(buffer("matrix")).reshape(-1, dim)
                qids, ids = np.frombuffer(buffer("qids"), dtype=np.int64), np.frombuffer(buffer("ids"), dtype=np.int64)
                xx = (x**2).sum(1)
                known = reach.setdefault(qids.tobytes(), np.full(len(all_q), np.inf))
                for s in range(0, len(all_q), 128):
                    q = all_q[s : s + 128]
                    qq = (q**2).sum(1)
                    d = q @ (-2 * x.T)
                    d += xx
                    d += qq[:, None]
                    off = 8 * (dim + 8) * np.finfo(np.float64).eps * (qq + xx.max())  # most that the expanded form is off by
                    if len(x) >= k and np.isinf(known[s : s + 128]).any():
                        kth = np.partition(d[:, : max(8 * k, len(x) // 8)], k - 1, axis=1)[:, k - 1]  # a part of the block bounds it already
                        known[s : s + 128] = np.minimum(known[s : s + 128], np.sqrt(np.maximum(kth + off, 0)))
                    within = lambda: (known[s : s + 128] + 2 * STEP) ** 2 + off  # noqa: B023, E731
                    i, j = np.nonzero(d <= within()[:, None])
                    values = d[i, j]
                    order = np.lexsort((values, i))
                    starts = np.searchsorted(i, np.arange(len(q)))
                    full = np.flatnonzero(np.bincount(i, minlength=len(q)) >= k)
                    kth = values[order[starts[full] + k - 1]]
                    known[s + full] = np.minimum(known[s + full], np.sqrt(np.maximum(kth + off[full], 0)))
                    kept = values <= within()[i]
                    i, j = i[kept], j[kept]
                    squares = np.zeros(len(i))
                    for c in range(dim):
                        squares += (x[j, c] - q[i, c]) ** 2
                    yield pa.RecordBatch.from_arrays([pa.array(qids[s + i]), pa.array(ids[j]), pa.array(np.sqrt(squares))], ["qid", "id", "d"])

    rows = _packed(vectors.select(F.col(id_col).alias("id"), F.col("embedding").alias("v")), 8_192, k)
    asked = _packed(queries.select(F.col("qid").alias("id"), F.col("qvec").alias("v")), 1_024).select(F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"))
    measured = rows.crossJoin(asked).mapInArrow(nearest, "qid long, id long, d double").select("qid", "id", F.round("d", 6).alias("dist"))
    return top_per_query(measured, k, [F.col("dist"), F.col("id")])


#: Rows that the nearest vectors of a query set send to their windows, for each vector.
SENT = 4


def gathered(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``vectors`` in as few partitions as keep what ``knn`` sends in proportion to them, as each partition sends ``k`` rows of a
    query. Both are counted, so they should be stored; few queries leave the partitions as they are."""
    return vectors.coalesce(max(1, SENT * vectors.count() // max(1, queries.count() * k)))


def postings(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``(id, field, term, pos)``: every index token with its place."""
    per_field = F.array(*[F.struct(F.lit(i).alias("field"), C.word_tokens(F.col(f)).alias("tokens")) for i, f in enumerate(fields)])
    split = rows.select(F.col(id_col).alias("id"), F.explode(per_field).alias("f"))
    return split.select("id", F.col("f.field").alias("field"), F.posexplode("f.tokens").alias("pos", "term"))


def lengths(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``(id, dl)``: a row's number of tokens over all fields."""
    total = F.lit(0)
    for f in fields:
        total = total + F.size(C.word_tokens(F.col(f)))
    return rows.select(F.col(id_col).alias("id"), total.alias("dl"))


def stored_postings(rows: DataFrame, id_col: str = "chunk_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(term, id, field, positions)``: one row for each different token of a field, to be stored by term. ``rows`` holds each id once,
    so a field's tokens are gathered where its row is, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, tokens = batch.columns
            sizes = np.diff(tokens.offsets.to_numpy())
            coded = tokens.flatten().dictionary_encode()
            codes, row = coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((codes, row))  # stable, so positions ascend
            codes, row, pos = codes[order], row[order], pos[order]
            first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(codes) != 0)]) if len(codes) else np.zeros(0, dtype=np.int64)
            held = pa.ListArray.from_arrays(pa.array(np.r_[first, len(codes)].astype(np.int32)), pa.array(pos.astype(np.int32)))
            term, at = coded.dictionary.take(pa.array(codes[first])), pa.array(row[first])
            yield pa.RecordBatch.from_arrays([term, ids.take(at), places.take(at), held], ["term", "id", "field", "positions"])

    per_field = F.array(*[F.struct(F.lit(i).alias("field"), C.word_tokens(F.col(f)).alias("tokens")) for i, f in enumerate(fields)])
    split = rows.select(F.col(id_col).cast("long").alias("id"), F.explode(per_field).alias("f")).select("id", "f.field", "f.tokens")
    return split.filter(F.size("tokens") > 0).mapInArrow(run, "term string, id long, field int, positions array<int>")


#: Terms up to which a search filters the stored postings by value, so that files and row groups without them are not read.
FEW_TERMS = 500


def _scores(tf: DataFrame, sized: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each query by BM25, from term counts (qid, phrase, id, tf) and lengths (id, dl)."""
    df = tf.groupBy("qid", "phrase").agg(F.count("*").alias("df"))
    totals = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, F.lit(V.IDF_FLOOR)).otherwise(idf)
    norm = F.col("tf") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("dl") / F.col("avg_dl"))
    scored = tf.join(df, ["qid", "phrase"]).join(sized, "id").crossJoin(F.broadcast(totals))
    scored = scored.select("qid", "id", (weight * F.col("tf") * (V.BM25_K1 + 1) / norm).alias("s"))
    return top_per_query(scored.groupBy("qid", "id").agg(F.round(-F.sum("s"), 6).alias("score")), k, [F.col("score"), F.col("id")])


def _phrases(queries: DataFrame, key: str) -> DataFrame:
    """``(key, phrase, n_parts, part, term)`` of rows (key, query): the parts of every phrase of a query."""
    words = queries.select(F.col(key).alias("_key"), F.posexplode(C.query_phrases(F.col("query"))).alias("phrase", "word"))
    terms = words.select("_key", "phrase", C.word_tokens(F.col("word")).alias("parts")).filter(F.size("parts") > 0)
    return terms.select(F.col("_key").alias(key), "phrase", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "term"))


def bm25(rows: DataFrame | None, queries: DataFrame, k: int, id_col: str = "chunk_id", fields: list[str] | None = None, stored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(qid, id, score, rank)``: BM25 of ``queries`` (qid, query) as an OR of phrases over all fields together.

    A word with underscores is a phrase of its parts; repeated words count again; a phrase that more than half of the rows
    hold gets the smallest weight instead of a negative one. Lower is better. ``stored`` gives (postings, lengths) of an index in place
    of ``rows``; there each different text is answered once, for all queries that ask it. Only postings of queried terms are shuffled.
    """
    fields = fields or list(FIELDS)
    if stored is not None:
        asked = cut(queries.select("qid", "query"))  # read several times below
        if asked.groupBy("qid").count().filter("count > 1").isEmpty():
            return _stored_bm25(asked, k, *stored)
        held, sized = stored
        held = held.select("term", "id", "field", F.explode("positions").alias("pos"))
        terms = _phrases(asked, "qid")
    else:
        held, sized = postings(rows, id_col, fields), lengths(rows, id_col, fields)
        terms = _phrases(queries, "qid")
    hits = held.join(broadcast_if_small(terms), "term").select("qid", "phrase", "n_parts", "id", "field", (F.col("pos") - F.col("part")).alias("at"))
    starts = hits.groupBy("qid", "phrase", "n_parts", "id", "field", "at").count().filter(F.col("count") == F.col("n_parts"))
    return _scores(starts.groupBy("qid", "phrase", "id").agg(F.count("*").alias("tf")), sized, k)


#: Rows whose queried tokens are matched together, and tokens that a scan gathers before it packs them.
BUCKET_ROWS, PACKED_TOKENS = 5_000, 2_000_000


def _squeezed(numbers: np.ndarray) -> bytes:
    """Integers as compressed bytes: differences, and of these the lowest bytes first."""
    steps = np.diff(numbers.astype(np.int64), prepend=np.int64(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _numbers(squeezed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(squeezed, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel())


def _neighbours(tokens: DataFrame, buckets: int, most: int) -> DataFrame:
    """``(id, code, second, following)`` of tokens (id, field, code, positions): every token with another right behind it, and up to
    ``most`` - 1 that follow without a gap. The tokens of a row meet in one of ``buckets``, sent there packed by column."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> Iterator[pa.RecordBatch]:
            ids, field, code, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(buckets)
            order = np.lexsort((pos, field, ids, bucket))
            ids, field, code, pos, bucket = (x[order] for x in (ids, field, code, pos, bucket))
            edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            parts = [slice(s, e) for s, e in zip(edges[:-1], edges[1:], strict=True)]
            blobs = [pa.array([_squeezed(x[p]) for p in parts], pa.binary()) for x in (ids, field, code, pos)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(np.diff(edges).astype(np.int32)), *blobs], ["bucket", "n", "ids", "field", "code", "pos"])

        held, n = [], 0
        for batch in batches:
            places = batch.column(3)
            sizes = np.diff(places.offsets.to_numpy())
            held.append((*[np.repeat(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64), sizes) for i in range(3)], places.flatten().to_numpy().astype(np.int64)))
            n += len(held[-1][0])
            if n >= PACKED_TOKENS:
                yield from packed()
                held, n = [], 0
        if n:
            yield from packed()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            ids, field, code, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((pos, field, ids))
            ids, field, code, pos = (x[order] for x in (ids, field, code, pos))
            joined = np.r_[(ids[1:] == ids[:-1]) & (field[1:] == field[:-1]) & (pos[1:] == pos[:-1] + 1), False]
            ends = np.flatnonzero(~joined)  # the last token of each run
            at = np.arange(len(ids))
            behind = np.minimum(ends[np.searchsorted(ends, at)] - at, most - 1)
            heads = np.flatnonzero(behind)
            for s in range(0, len(heads), 50_000):
                h = heads[s : s + 50_000]
                sizes = behind[h]
                offsets = np.r_[0, np.cumsum(sizes)]
                taken = np.repeat(h + 1 - offsets[:-1], sizes) + np.arange(offsets[-1])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(code[taken]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[h]), pa.array(code[h]), pa.array(code[h + 1]), lists], ["id", "code", "second", "following"])

        held, own = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != own and held:
                    yield from found()
                    held = []
                own = r["bucket"]
                held.append([_numbers(r[c], r["n"]) for c in ("ids", "field", "code", "pos")])
        if held:
            yield from found()

    sent = tokens.select("id", "field", "code", "positions").mapInArrow(pack, "bucket int, n int, ids binary, field binary, code binary, pos binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(follow, "id long, code long, second long, following array<long>")


def _stored_bm25(asked: DataFrame, k: int, held: DataFrame, sized: DataFrame) -> DataFrame:
    """``bm25`` over the postings and lengths of an index, for queries (qid, query) of one text each.

    Texts and phrases that recur are counted once, phrases and terms are numbers. The tokens that phrases of several parts ask for are
    sent once, packed, to their row's bucket, in whatever number of phrases they stand; there every token looks at those behind it, so
    only whole phrases are counted. The counts are made once; a partition sends ``k`` rows of each text.
    """
    texts = asked.select("query").distinct()
    split = cut(_phrases(texts, "query"))  # (query, phrase, n_parts, part, term)
    few = [r.term for r in split.select("term").distinct().limit(FEW_TERMS + 1).collect()]  # bounded
    held = held.filter(F.col("term").isin(few)) if len(few) <= FEW_TERMS else held
    small = F.broadcast if broadcast_if_small(split) is not split else lambda rows: rows
    spelled = split.groupBy("query", "phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "term"))), lambda p: p["term"]).alias("parts"))
    asking = cut(spelled.groupBy("query", "parts").agg(F.count("*").alias("times")))  # a repeated word counts again
    number = F.monotonically_increasing_id()
    wanted = cut(asking.select("parts", F.size("parts").alias("n_parts")).distinct().withColumn("pid", number))
    asking = asking.join(wanted, "parts").select("query", "pid", "times")
    most = wanted.agg(F.coalesce(F.max("n_parts"), F.lit(0))).first()[0]
    # single terms are counted where they stand
    counted = held.join(small(wanted.filter("n_parts = 1").select(F.col("parts")[0].alias("term"), "pid")), "term").select("id", "pid", F.size("positions").alias("n"))
    if most > 1:
        parts = wanted.filter("n_parts > 1").select("pid", F.posexplode("parts").alias("part", "term"))
        codes = cut(parts.select("term").distinct().withColumn("code", number))
        coded = parts.join(codes, "term").groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda p: p["code"]).alias("codes"))
        heads = coded.select("pid", F.col("codes")[0].alias("code"), F.col("codes")[1].alias("second"), F.expr("slice(codes, 2, size(codes))").alias("rest"))
        begun = _neighbours(held.join(small(codes), "term"), max(1, sized.count() // BUCKET_ROWS), most)
        whole = begun.join(small(heads), ["code", "second"]).filter("slice(following, 1, size(rest)) = rest")
        counted = counted.unionByName(whole.select("id", "pid", F.lit(1).alias("n")))
    tf = cut(counted.groupBy("id", "pid").agg(F.sum("n").alias("tf")))
    df = tf.groupBy("pid").agg(F.count("*").alias("df"))
    totals = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, F.lit(V.IDF_FLOOR)).otherwise(idf)
    norm = F.col("tf") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("dl") / F.col("avg_dl"))
    scored = tf.join(sized, "id").join(small(df), "pid").join(small(asking), "pid").crossJoin(F.broadcast(totals))
    scored = scored.select("query", "id", (F.col("times") * weight * F.col("tf") * (V.BM25_K1 + 1) / norm).alias("s"))
    scored = scored.groupBy("query", "id").agg(F.round(-F.sum("s"), 6).alias("score"))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))).filter(F.col("rank") <= k)
    return first.join(asked, "query").select("qid", "id", "score", "rank")


def substring_bm25(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", fields: tuple[str, ...] = FIELDS, least: int = 3) -> DataFrame:
    """``(qid, id, score, rank)``: BM25 in which each run of letters, digits and underscores of a query of ``least`` or more signs
    matches as a substring of any field; a run of Han signs is one such phrase. Trigrams of the texts are joined with the phrases' first
    trigrams, and only those candidates are counted, so no text meets every phrase."""
    plain = rows.select(F.col(id_col).alias("id"), *[F.lower(C.text(F.col(f))).alias(f"t{i}") for i, f in enumerate(fields)])
    texts = [F.col(f"t{i}") for i in range(len(fields))]
    words = F.filter(F.regexp_extract_all(F.lower(C.text(F.col("query"))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) >= least)
    terms = queries.select("qid", F.posexplode(words).alias("phrase", "term")).withColumn("gram", F.substring("term", 1, 3))
    # a look-ahead finds every trigram in one pass over the text
    grams = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit("(?s)(?=(...))"), F.lit(1)) for t in texts])))
    candidates = plain.select("id", F.explode(grams).alias("gram")).join(broadcast_if_small(terms), "gram").select("qid", "phrase", "term", "id").join(plain, "id")
    occurrences = sum(((F.length(t) - F.length(F.replace(t, F.col("term")))) / F.length("term") for t in texts), F.lit(0.0))
    tf = candidates.select("qid", "phrase", "id", occurrences.cast("long").alias("tf")).filter("tf > 0")
    sized = plain.select("id", sum((F.greatest(F.length(t) - 2, F.lit(0)) for t in texts), F.lit(0)).alias("dl"))
    return _scores(tf, sized, k)


def fuse(lists: list[tuple[DataFrame, float]], k: int | None = None) -> DataFrame:
    """``(qid, id, score, path, path_rank, rank)``: weighted reciprocal ranks of several ranked lists (qid, id, rank).

    Equal scores keep the order of their first list and the rank in it.
    """
    united = None
    for path, (rows, weight) in enumerate(lists):
        part = rows.select("qid", "id", "rank", F.lit(path).alias("path"), F.lit(float(weight)).alias("weight"))
        united = part if united is None else united.unionByName(part)
    share = F.col("weight") / (V.RRF_K + F.col("rank"))
    fused = united.groupBy("qid", "id").agg(F.round(F.sum(share), 9).alias("score"), F.min(F.struct("path", "rank")).alias("first"))
    fused = fused.select("qid", "id", "score", F.col("first.path").alias("path"), F.col("first.rank").alias("path_rank"))
    return top_per_query(fused, k, [F.desc("score"), F.col("path"), F.col("path_rank"), F.col("id")])
