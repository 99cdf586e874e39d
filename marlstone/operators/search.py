"""The k best chunks of each of many queries, in one map over the chunks and one merge.

Queries come to the driver in blocks of a set size, and each block goes out as numpy matrices with a pass over all chunks. A task turns
Arrow batches of chunks to matrices, multiplies, and keeps the k best of each query by (score, least id); only these
are shuffled, and one window per query merges them. Nothing is paired in a join, and a pass costs the same however frequent a word is:
words that many queries and chunks share are multiplied as dense matrices, others are added posting by posting.

A slice of chunks is skipped for the queries it cannot improve: the greatest weight of each word in the slice bounds what any of its chunks can
score, and a query whose bound is not above its k-th score so far is left out (equal scores are let through, for the ties).
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..sources.state import work_dir

#: Queries that are scored at once, and those a pass over the chunks; chunks a slice, and words a slice that are multiplied as dense matrices.
GROUP, BLOCK, SLICE, DENSE = 2048, 16384, 512, 384
#: From so many queries on the tokens are written once, and so many of the longest chunks are searched before the others.
MANY, FIRST = 256, 1024


class Best:
    """The k best of each query so far, equal scores by least id; rows of -inf are none. What is below ``floor`` is not wanted."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k, self.scores, self.ids = k, np.full((k, queries), -np.inf), None
        self.floor = np.full(queries, -np.inf) if floor is None else floor

    def limit(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[-1])

    def add(self, scores: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> None:
        """Scores (chunks, columns) of the queries ``columns``."""
        if self.ids is None:
            self.ids = np.empty(self.scores.shape, ids.dtype if ids.dtype != object else object)
        least, n = self.limit()[columns], len(scores)
        if n > self.k:
            least = np.maximum(least, np.partition(scores, n - self.k, axis=0)[n - self.k])
        row, col = np.nonzero((scores >= least) & np.isfinite(scores))
        touched, query = np.unique(col, return_inverse=True)
        held = self.scores[:, columns[touched]]
        there, owner = np.nonzero(np.isfinite(held))
        query = np.concatenate((owner, query))
        score, name = np.concatenate((held[there, owner], scores[row, col])), np.concatenate((self.ids[there, columns[touched][owner]], ids[row]))
        order = np.lexsort((np.unique(name, return_inverse=True)[1], -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, place = order[place < self.k], columns[touched][query[place < self.k]], place[place < self.k]
        self.scores[place, query], self.ids[place, query] = score[order], name[order]

    def rows(self, kind: pa.DataType, first: int = 0) -> pa.RecordBatch | None:
        """Rows of the queries, which are numbered from ``first`` on."""
        if self.ids is None:
            return None
        place, query = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(query + first, pa.int32()), pa.array(self.ids[place, query].tolist(), kind), pa.array(self.scores[place, query])], ["q", "chunk_id", "score"])


def _sorted(batch: pa.RecordBatch, at: int, n: int) -> pa.RecordBatch:
    """Rows of a slice whose id is not null, in order of the id."""
    part = batch.slice(at, n)
    part = part.filter(pc.is_valid(part.column(0)))
    return part.take(pc.sort_indices(part.column(0)))


def _merged(passes: list[tuple[DataFrame, list]], query_kind: str, k: int) -> DataFrame:
    """Best rows of all passes with their query's id and rank; a pass has a block of queries at most, which are joined as a small table."""
    out = None
    for best, ids in passes:
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rank") <= k)
        names = best.sparkSession.createDataFrame(list(enumerate(ids)), f"q int, query_id {query_kind}")
        part = ranked.join(F.broadcast(names), "q").select("query_id", "chunk_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(queries: DataFrame, block: int) -> Iterator[list]:
    """Rows of ``queries(query_id, ...)`` in blocks of about that size."""
    n = -(-queries.count() // block)
    for i in range(n):
        yield queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect()


class Terms:
    """Words of a group of queries (numbers of the pass's words): for each, the queries that have it and how often."""

    def __init__(self, asked: list[list[int]]):
        self.queries = len(asked)
        flat = np.array([w * len(asked) + q for q, ws in enumerate(asked) for w in ws], np.int64)
        key, often = np.unique(flat, return_counts=True)
        self.word, self.of = np.unique(key // max(1, len(asked)), return_inverse=True)
        self.query, self.often = key % max(1, len(asked)), often.astype(np.float64)
        self.start = np.searchsorted(self.of, np.arange(len(self.word) + 1))

    def scores(self, chunk: np.ndarray, word: np.ndarray, weight: np.ndarray, chunks: int, columns: np.ndarray) -> np.ndarray:
        """Sums of weight x times over shared words, (chunks, columns)."""
        place = np.full(self.queries, -1)
        place[columns] = np.arange(len(columns))
        fan = np.diff(self.start)
        cost = np.bincount(word, minlength=len(self.word)) * fan
        heavy = np.argsort(-cost, kind="stable")[:DENSE]
        heavy = heavy[cost[heavy] > 64]
        rank = np.full(len(self.word), -1)
        rank[heavy] = np.arange(len(heavy))
        left, right = np.zeros((chunks, len(heavy))), np.zeros((len(heavy), len(columns)))
        much = rank[word] >= 0
        left[chunk[much], rank[word[much]]] = weight[much]
        mine = (rank[self.of] >= 0) & (place[self.query] >= 0)
        right[rank[self.of[mine]], place[self.query[mine]]] = self.often[mine]
        out = left @ right
        chunk, word, weight = chunk[~much], word[~much], weight[~much]
        n = fan[word]
        ends = np.cumsum(n)
        for a in range(0, len(word), step := 1 << 17):
            b = min(len(word), a + step)
            each = n[a:b]
            entry = np.arange(each.sum()) - np.repeat(ends[a:b] - each - (ends[a - 1] if a else 0), each) + np.repeat(self.start[word[a:b]], each)
            to = place[self.query[entry]]
            fine = to >= 0
            cell = np.repeat(chunk[a:b], each)[fine] * len(columns) + to[fine]
            out += np.bincount(cell, (np.repeat(weight[a:b], each) * self.often[entry])[fine], chunks * len(columns)).reshape(out.shape)
        return out

    def bounds(self, top: np.ndarray) -> np.ndarray:
        """What a chunk with the greatest weight ``top`` of every word of the pass would score, a query."""
        return np.bincount(self.query, top[self.word][self.of] * self.often, self.queries)


class Pass:
    """Queries of a pass over the chunks, in groups that are scored at once, and their words."""

    def __init__(self, asked: list[list[str]]):
        self.words = sorted({w for ws in asked for w in ws})
        at = {w: i for i, w in enumerate(self.words)}
        self.queries = len(asked)
        self.groups = [Terms([[at[w] for w in ws] for ws in asked[i : i + GROUP]]) for i in range(0, len(asked), GROUP)]

    def postings(self, lists: pa.ListArray, value_set: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, word, times) of the words of the pass in lists of tokens."""
        word = pc.fill_null(pc.index_in(lists.flatten(), value_set=value_set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        chunk = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        key, times = np.unique((chunk * len(self.words) + word)[word >= 0], return_counts=True)
        return key // len(self.words), key % len(self.words), times


def _counting(asked: Pass):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, total = pa.array(asked.words, pa.string()), np.zeros(len(asked.words), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                total += np.bincount(asked.postings(batch.column(1).slice(at, SLICE), values)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["t", "df"])

    return run


def _searching(asked: Pass, idf: np.ndarray | None, k: int, digits: int | None, floor: np.ndarray | None = None):
    """Raw scores where there is no idf; ``floor``: a score of each query that k chunks are known to reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, kind = pa.array(asked.words, pa.string()), None
        best = [Best(g.queries, k, None if floor is None else floor[i * GROUP :][: g.queries]) for i, g in enumerate(asked.groups)]
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, SLICE):
                part = _sorted(batch, at, SLICE)
                chunk, word, times = asked.postings(part.column(1), values)
                if not len(word):
                    continue
                weight, ids = times + 1.0 if idf is None else (1.0 + np.log(times)) * idf[word], part.column(0).to_numpy(zero_copy_only=False)
                top, place = np.zeros(len(asked.words)), np.full(len(asked.words), -1)
                np.maximum.at(top, word, weight)
                for terms, found in zip(asked.groups, best, strict=True):
                    able = terms.bounds(top)
                    columns = np.flatnonzero((able > 0) & (able + 1e-5 >= found.limit()))
                    if len(columns):
                        place[terms.word] = np.arange(len(terms.word))
                        own = place[word] >= 0
                        scores = terms.scores(chunk[own], place[word[own]], weight[own], part.num_rows, columns)
                        scores = scores if digits is None else np.round(scores, digits)
                        found.add(np.where(scores > 0, scores, -np.inf), ids, columns)
                        place[terms.word] = -1
        for i, found in enumerate(best):
            if (rows := found.rows(kind, i * GROUP)) is not None:
                yield rows

    return run


def lexical_top_k(chunks: DataFrame, queries: DataFrame, k: int, weighted: bool = True, digits: int | None = 6, block: int = BLOCK, chunk_id: str = "chunk_id", text: str = "text", query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the same as ``top_k`` of ``tfidf_scores`` (rounded) or, not weighted, of ``raw_scores``.

    With weights there is a pass before, for the document frequencies of the block's words; where two passes need them or queries are many, the tokens are
    written once, as folding and cutting text is the dearest part. Of many queries the longest chunks are searched first: the k-th score that a query has there
    is a bound below which it wants nothing, and chunks, longest first in each file, soon cannot reach it."""
    spark = chunks.sparkSession
    said = chunks.select(F.col(chunk_id).alias("chunk_id"), tokens(F.col(text)).alias("w"))
    asked = queries.select(F.col(query_id).alias("query_id"), tokens(F.col(query_text)).alias("w"))
    kinds = {f.name: f.dataType.simpleString() for f in (*said.schema, *asked.schema)}
    blocks, many, total, least = _blocks(asked, block), False, 0, None
    if (first := next(blocks, None)) is not None:
        many = len(first) > MANY
        if weighted or many:
            said = said.withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
            path = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
            (said.sortWithinPartitions(F.desc("n")) if many else said).write.parquet(path)
            said = spark.read.schema(said.schema).parquet(path)
            total = max(said.count(), 1) if weighted else 0
            least = said.select("n").orderBy(F.desc("n")).limit(FIRST).agg(F.min("n")).first()[0] if many else None
    words, out, passes = said.select("chunk_id", "w"), f"q int, chunk_id {kinds['chunk_id']}, score double", []
    for rows in [] if first is None else itertools.chain([first], blocks):
        terms, idf = Pass([r["w"] or [] for r in rows]), None
        if weighted:
            df = np.zeros(len(terms.words))
            for r in words.mapInArrow(_counting(terms), "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
                df[r["t"]] = r["df"]
            idf = np.log((total + 1) / (df + 1)) + 1.0
        rounded = digits if weighted else None
        if least is None:
            found = words.mapInArrow(_searching(terms, idf, k, rounded), out)
        else:
            path = f"{work_dir(spark)}/longest-{uuid.uuid4().hex}"
            said.filter(F.col("n") >= least).select("chunk_id", "w").repartition(8).mapInArrow(_searching(terms, idf, k, rounded), out).write.parquet(path)
            long, floor = spark.read.schema(out).parquet(path), np.full(terms.queries, -np.inf)
            order = Window.partitionBy("q").orderBy(F.desc("score"), "chunk_id")
            for r in long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("q", "score").collect():
                floor[r["q"]] = r["score"]
            found = long.union(said.filter(F.col("n") < least).select("chunk_id", "w").mapInArrow(_searching(terms, idf, k, rounded, floor), out))
        passes.append((found, [r["query_id"] for r in rows]))
    return _merged(passes, kinds["query_id"], k) if passes else spark.createDataFrame([], f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, rank int")


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _nearing(vectors: list[list[float]], k: int, digits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    lengths: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        lengths.setdefault(len(v), []).append(i)
    sides = [(n, np.array(at), _unit(np.array([vectors[i] for i in at], np.float64).reshape(len(at), n)).T) for n, at in lengths.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(len(vectors), k), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, SLICE):
                part = _sorted(batch, at, SLICE)
                if not part.num_rows:
                    continue
                size, flat = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False), part.column(1).flatten().to_numpy(zero_copy_only=False)
                start = np.concatenate(([0], np.cumsum(size)))
                for n, columns, side in sides:
                    scores = np.zeros((part.num_rows, len(columns)))  # vectors of another length are at no angle
                    if n and len(same := np.flatnonzero(size == n)):
                        scores[same] = _unit(flat[start[same][:, None] + np.arange(n)]) @ side
                    best.add(scores if digits is None else np.round(scores, digits) + 0.0, part.column(0).to_numpy(zero_copy_only=False), columns)
        if (rows := best.rows(kind)) is not None:
            yield rows

    return run


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int | None = 6, block: int = GROUP, chunk_id: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the same as ``top_k`` of ``cosine_scores``; a null vector is empty, null entries are zero."""
    filled = lambda c: F.transform(F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")), lambda x: F.coalesce(x, F.lit(0.0)))
    held = vectors.select(F.col(chunk_id).alias("chunk_id"), filled(vector).alias("v"))
    asked = queries.select("query_id", filled("vector").alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in (*held.schema, *asked.schema)}
    out = f"q int, chunk_id {kinds['chunk_id']}, score double"
    passes = [(held.mapInArrow(_nearing([r["v"] for r in rows], k, digits), out), [r["query_id"] for r in rows]) for rows in _blocks(asked, block)]
    return _merged(passes, kinds["query_id"], k) if passes else vectors.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, rank int")
