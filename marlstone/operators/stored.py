"""A stored lexical index: posting lists in blocks by impact, each with a bound, and exact top-k searches that stop early.

Chunks are dealt to shards by a hash of their id, so the list of a word, however frequent, is cut to as many pieces as there are shards. A piece is
ordered by times in the chunk (greatest first, then id) and cut to blocks of ``BLOCK`` postings; a block's row holds its place in the list and its greatest count. Rows lie in folders by a hash of
the word, ``PARTS`` of them, in files of ``PACK`` shards ordered by (shard, word, place): a search opens the folders of its words and reads their rows only.

    blocks(part, shard, term, at, top, ids, tfs)     terms(part, term, df)     size(n, shards, parts, block, kind)

``size`` is written last: an index without it can't be opened, so a build that dies leaves nothing that a reader takes for an index.

A search deals the rows of its words to shards. A task takes the blocks of a query's words in rounds, deepest for the words whose next block is bounded
highest, until chunks not met so far can't reach the k-th best partial score: what is left of a list is at most its next block's bound. Chunks
whose partial score and that rest could still be among the k best are scored in full; the others are never completed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .search import _blocks, _merged

#: Postings a block, chunks a shard, folders of words, shards a file, queries a pass.
BLOCK, SHARD, PARTS, PACK, QUERIES = 64, 8192, 16, 64, 2048
#: A query's postings in a shard that are read in one round.
FEW = 1 << 13
#: Sums in another order may differ by so much; chunks this near to a limit are kept, as equal scores go by id.
SLACK = 1e-5


def _counting():
    """(chunk_id, term, tf) of each batch of (chunk_id, words); a chunk is one row, so nothing is left to add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                part = part.filter(pc.is_valid(part.column(0)))
                lists = part.column(1)
                words = lists.flatten().dictionary_encode()
                width = max(1, len(words.dictionary))
                row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                key, times = np.unique(row * width + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(key // width)), words.dictionary.take(pa.array(key % width)), pa.array(times.astype(np.int64))], ["chunk_id", "term", "tf"])

    return run


def _cutting(block: int):
    """Blocks of lists that come in order. A block ends with its batch too, so it may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0  # the list that the batch before ended in, and how much of it is out
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, term = batch.column(1).to_numpy(), batch.column(2)
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = (shard[1:] != shard[:-1]) | pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(fresh)
            place = np.arange(batch.num_rows) - np.repeat(first, np.diff(np.append(first, batch.num_rows)))
            if (shard[0], term[0].as_py()) == last:
                place[: first[1] if len(first) > 1 else batch.num_rows] += done
            cut = np.flatnonzero(fresh | (place % block == 0))
            ends, heads = pa.array(np.append(cut, batch.num_rows).astype(np.int32)), pa.array(cut)
            ids, tfs = (pa.ListArray.from_arrays(ends, batch.column(i)) for i in (3, 4))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(heads) for i in range(3)), pa.array(place[cut]), batch.column(4).take(heads), ids, tfs], ["part", "shard", "term", "at", "top", "ids", "tfs"])
            last, done = (shard[-1], term[-1].as_py()), int(place[-1]) + 1

    return run


def build(chunks: DataFrame, path: str, chunk_id: str = "chunk_id", text: str = "text", shard: int = SHARD, block: int = BLOCK, parts: int = PARTS) -> str:
    """Writes the index of ``chunks`` (ids are unique; rows without an id are not found) to the new folder ``path``: one pass over the texts, one shuffle of postings."""
    spark = chunks.sparkSession
    said = chunks.filter(F.col(chunk_id).isNotNull()).select(F.col(chunk_id).alias("chunk_id"), tokens(F.col(text)).alias("w"))
    n = chunks.count()
    shards = max(-(-n // shard), min(spark.sparkContext.defaultParallelism, -(-n // 64)), 1)
    packs = max(-(-shards // PACK), min(shards, -(-spark.sparkContext.defaultParallelism // parts)))
    kind = said.schema["chunk_id"].dataType.simpleString()
    postings = said.mapInArrow(_counting(), f"chunk_id {kind}, term string, tf long")
    dealt = postings.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int")).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    dealt = dealt.withColumn("pack", F.col("shard") % packs).repartition(packs * parts, "part", "pack")
    ordered = dealt.sortWithinPartitions("part", "shard", "term", F.desc("tf"), "chunk_id").select("part", "shard", "term", "chunk_id", "tf")
    rows = ordered.mapInArrow(_cutting(block), f"part int, shard int, term string, at long, top long, ids array<{kind}>, tfs array<long>")
    rows.write.partitionBy("part").parquet(f"{path}/blocks")
    schema = f"shard int, term string, at long, top long, ids array<{kind}>, tfs array<long>, part int"
    found = spark.read.schema(schema).parquet(f"{path}/blocks").groupBy("part", "term").agg(F.sum(F.size("ids")).alias("df"))
    found.repartition(parts, "part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/terms")
    spark.createDataFrame([(n, shards, parts, block, kind)], "n long, shards int, parts int, block int, kind string").coalesce(1).write.parquet(f"{path}/size")
    return path


class Asked:
    """Words of a block of queries, their weights in the corpus, and each query's words with their times."""

    def __init__(self, words: list[str], idf: np.ndarray | None, queries: list[list[str]]):
        at = {w: i for i, w in enumerate(words)}
        self.words, self.idf, self.queries = words, idf, []
        for ws in queries:
            own, often = np.unique(np.array([at[w] for w in ws if w in at], np.int64), return_counts=True)
            self.queries.append((own, often.astype(np.float64)))


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whole numbers of all the ranges, one after another."""
    n = end - start
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


class Shard:
    """Postings of the asked words in one shard: by word in order of impact, and by chunk."""

    def __init__(self, asked: Asked, rows: pa.Table, block: int, few: int = FEW):
        self.block, self.few, n = block, few, len(asked.words)
        word = pc.index_in(rows["term"], value_set=pa.array(asked.words, pa.string())).to_numpy().astype(np.int64)
        order = np.lexsort((rows["at"].to_numpy(), word))
        rows, word = rows.take(pa.array(order)), word[order]
        word = np.repeat(word, pc.list_value_length(rows["ids"]).to_numpy())
        ids, tfs = pc.list_flatten(rows["ids"]).combine_chunks(), pc.list_flatten(rows["tfs"]).to_numpy().astype(np.float64)
        self.ids = pc.unique(ids)
        self.ids = self.ids.take(pc.sort_indices(self.ids))
        self.chunk = pc.index_in(ids, value_set=self.ids).to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = tfs + 1.0 if asked.idf is None else (1.0 + np.log(tfs)) * asked.idf[word]
        self.start = np.searchsorted(word, np.arange(n + 1))
        by = np.argsort(self.chunk, kind="stable")
        self.of_chunk, self.chunk_word, self.chunk_weight = np.searchsorted(self.chunk[by], np.arange(len(self.ids) + 1)), word[by], self.weight[by]
        self.times = np.zeros(n)
        self.read = self.scored = 0

    def best(self, words: np.ndarray, often: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, scores) of the k best, by (score, id)."""
        here = self.start[words + 1] > self.start[words]
        words, often = words[here], often[here]
        if not len(words):
            return words, often
        at, end = self.start[words].copy(), self.start[words + 1]
        short = (end - at).sum() <= self.few  # read at once, as rounds would cost more than they leave out
        partial, step = np.zeros(len(self.ids)), (end - at if short else np.full(len(words), self.block))
        deep = np.ones(len(words), bool)
        while True:
            to = np.where(deep, np.minimum(at + step, end), at)
            some = _ranges(at, to)
            partial += np.bincount(self.chunk[some], self.weight[some] * np.repeat(often, to - at), len(partial))
            self.read += len(some)
            at, step = to, np.where(deep, step * 2, step)
            bound = np.where(at < end, self.weight[np.minimum(at, len(self.weight) - 1)] * often, 0.0)
            rest = bound.sum()
            limit = np.partition(partial, -k)[-k] if len(partial) >= k else 0.0
            if rest == 0 or rest + SLACK < limit:
                break
            deep = bound * 2 >= bound.max()
        able = np.flatnonzero((partial > 0) & (partial + rest + SLACK >= limit))
        if rest == 0:
            return self._first(able, partial[able], k, digits)
        self.scored += len(able)
        self.times[words] = often
        some = _ranges(self.of_chunk[able], self.of_chunk[able + 1])
        owner = np.repeat(np.arange(len(able)), self.of_chunk[able + 1] - self.of_chunk[able])
        score = np.bincount(owner, self.chunk_weight[some] * self.times[self.chunk_word[some]], len(able))
        self.times[words] = 0.0
        return self._first(able, score, k, digits)

    def _first(self, able: np.ndarray, score: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
        score = score if digits is None else np.round(score, digits)
        able, score = able[score > 0], score[score > 0]
        first = np.argsort(-score, kind="stable")[:k]
        return able[first], score[first]


def _searching(asked: Asked, k: int, digits: int | None, block: int):
    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(asked, rows, block)
        found = [shard.best(words, often, k, digits) for words, often in asked.queries]
        query = np.repeat(np.arange(len(found), dtype=np.int32), [len(c) for c, _ in found])
        return pa.table({"q": query, "chunk_id": shard.ids.take(pa.array(np.concatenate([c for c, _ in found]))), "score": np.concatenate([s for _, s in found])})

    return run


def top_k(spark: SparkSession, path: str, queries: DataFrame, k: int, weighted: bool = True, digits: int | None = 6, queries_a_pass: int = QUERIES, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` from the index at ``path``: the same rows as ``top_k`` of ``tfidf_scores`` or, not weighted, of ``raw_scores``.

    Queries come to the driver in blocks of ``queries_a_pass``, and of the index only the counts of their words."""
    size = spark.read.parquet(f"{path}/size").first()
    asked = queries.select(F.col(query_id).alias("query_id"), tokens(F.col(query_text)).alias("w"))
    query_kind = asked.schema["query_id"].dataType.simpleString()
    stored = spark.read.schema(f"shard int, term string, at long, top long, ids array<{size['kind']}>, tfs array<long>, part int").parquet(f"{path}/blocks")
    counts = spark.read.schema("term string, df long, part int").parquet(f"{path}/terms")
    tasks = min(2 * size["shards"], 16 * spark.sparkContext.defaultParallelism)  # by number: small shuffles would be joined to one task
    passes = []
    for rows in _blocks(asked, queries_a_pass):
        words = sorted({w for r in rows for w in r["w"]})
        if not words:
            continue
        named = spark.createDataFrame(pa.table({"term": pa.array(words, pa.string())})).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(size['parts'])).cast("int"))
        mine = sorted(r["part"] for r in named.select("part").distinct().collect())
        near = lambda t: t.filter(F.col("part").isin(mine)).join(F.broadcast(named.select("term")), "term", "left_semi")
        known = {r["term"]: r["df"] for r in near(counts).select("term", "df").collect()}
        words = sorted(known)
        idf = np.log((max(size["n"], 1) + 1) / (np.array([known[w] for w in words], np.float64) + 1)) + 1.0 if weighted else None
        task = _searching(Asked(words, idf, [r["w"] for r in rows]), k, digits if weighted else None, size["block"])
        found = near(stored).select("shard", "term", "at", "ids", "tfs").repartition(tasks, "shard").groupBy("shard").applyInArrow(task, f"q int, chunk_id {size['kind']}, score double")
        passes.append((found, [r["query_id"] for r in rows]))
    return _merged(passes, query_kind, k) if passes else spark.createDataFrame([], f"query_id {query_kind}, chunk_id {size['kind']}, score double, rank int")
