"""Rank fusion, structural anchors, one-hop expansion and reranking of hits.

Hits are rows ``(query_id, chunk_id, rank, score, ...)``; every operator takes all queries at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import search_text

RRF_K = 60
#: Words that ask for a length of time; candidates a reranker sees.
DURATION_WORDS = ("anos", "years", "year", "yrs")
RERANKED = 8


def reciprocal_rank_fusion(lexical: DataFrame, dense: DataFrame, k: int, lexical_weight: float = 1.0, dense_weight: float = 1.0, rrf_k: int = RRF_K) -> DataFrame:
    """``(query_id, chunk_id, rank, score, lexical_rank, dense_rank, retrieval_source)``.

    A union and one aggregation instead of a full outer join. The inputs carry their rank, from 1.
    """
    if rrf_k <= 0:
        raise ValueError("rrf_k must be positive")
    side = lambda df, name, w: df.select("query_id", "chunk_id", F.lit(name).alias("side"), "rank", (F.lit(float(w)) / (F.lit(rrf_k) + F.col("rank"))).alias("part"))
    both = side(lexical, "lexical", lexical_weight).unionByName(side(dense, "dense", dense_weight))
    rank_in = lambda name: F.max(F.when(F.col("side") == name, F.col("rank")))
    part_in = lambda name: F.sum(F.when(F.col("side") == name, F.col("part")))
    fused = both.groupBy("query_id", "chunk_id").agg(
        rank_in("lexical").alias("lexical_rank"), rank_in("dense").alias("dense_rank"), part_in("lexical").alias("l"), part_in("dense").alias("d")
    )
    source = F.when(F.col("l").isNotNull() & F.col("d").isNotNull(), "hybrid").when(F.col("l").isNotNull(), "lexical").otherwise("dense")
    fused = fused.withColumn("score", F.coalesce("l", F.lit(0.0)) + F.coalesce("d", F.lit(0.0))).withColumn("retrieval_source", source)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score", "lexical_rank", "dense_rank", "retrieval_source")


def max_anchors(k: int) -> int:
    return max(2, min(4, k // 2))


def named_title(query: Column, title: Column) -> Column:
    """Does the folded query contain the folded title (two signs at least)? Plain containment, not by word."""
    t = search_text(title)
    return (F.length(t) >= 2) & F.contains(search_text(query), t)


def _inner(text: Column, ends: bool = False) -> Column:
    """Distinct words of ``text``; with ``ends`` without the first and the last, which may be parts of longer words where it is contained."""
    w = F.split(text, " ")
    return F.array_distinct(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))) if ends else w)


def _automaton(words: list[str]):
    """Aho-Corasick: (next node by sign, node to fall back to, ends) of each node; ends are the words that end there, the node's own first, then by the fall-backs."""
    steps: list[dict[str, int]] = [{}]
    own: list[int] = [-1]
    for i, word in enumerate(words):
        at = 0
        for sign in word:
            if sign not in steps[at]:
                steps[at][sign] = len(steps)
                steps.append({})
                own.append(-1)
            at = steps[at][sign]
        own[at] = i
    back, chain = [0] * len(steps), [0] * len(steps)
    todo = list(steps[0].values())
    for at in todo:  # grows as nodes are reached, breadth first
        for sign, to in steps[at].items():
            f = back[at]
            while f and sign not in steps[f]:
                f = back[f]
            back[to] = steps[f].get(sign, 0)
            todo.append(to)
        chain[at] = back[at] if own[back[at]] >= 0 else chain[back[at]]
    return steps, back, own, chain


def _found(text: str, automaton) -> set[int]:
    """Words of the automaton that the text contains."""
    steps, back, own, chain = automaton
    out: set[int] = set()
    at = 0
    for sign in text:
        while at and sign not in steps[at]:
            at = back[at]
        at = steps[at].get(sign, 0)
        end = at if own[at] >= 0 else chain[at]
        while end and own[end] not in out:
            out.add(own[end])
            end = chain[end]
    return out


def contained(texts: DataFrame, words: DataFrame, key: str, text: str, word: str, block_signs: int = 1 << 20) -> DataFrame:
    """``(key, word)``, distinct a row of ``texts``: the words of ``words(word)`` that its text contains anywhere. Empty and null words are in none.

    Words come to the driver in blocks of about ``block_signs`` signs, told by a hash; each block is an automaton that every task builds once, and a pass of Arrow batches over
    whole texts, linear in their length however many words there are."""
    distinct = words.select(word).filter(F.length(word) > 0).distinct()
    signs = distinct.agg(F.sum(F.length(word))).first()[0] or 0
    blocks = max(1, -(-signs // block_signs))
    rows = texts.select(key, text).filter(F.col(text).isNotNull())
    kind = rows.schema[key].dataType.simpleString()

    def scanning(few: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(few)
            for batch in batches:
                hits = [sorted(_found(t, automaton)) for t in batch.column(1).to_pylist()]
                row = pa.array([i for i, h in enumerate(hits) for _ in h], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array([few[w] for h in hits for w in h], pa.string())], [key, word])

        return run

    out = None
    for i in range(blocks):
        few = sorted(r[0] for r in distinct.filter(F.pmod(F.xxhash64(word), F.lit(blocks)) == i).collect())
        part = rows.mapInArrow(scanning(few), f"`{key}` {kind}, `{word}` string")
        out = part if out is None else out.unionByName(part)
    return out


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(query_id, record_id)`` of ``docs(record_id, body)`` that contain the text of ``items(query_id, text)`` as it is; an empty item is in every text.

    Items of four words or more meet the documents on their rarest inner word, then containment decides; texts are split at
    single spaces on both sides, so whatever contains the text holds each inner word as a word. Shorter items are a vocabulary, found by ``contained``."""
    said = items.withColumn("inner", _inner(F.col("text"), ends=True))
    long, short = said.filter(F.size("inner") > 1), said.filter((F.size("inner") <= 1) & (F.col("text") != ""))
    wanted = long.select("query_id", F.explode("inner").alias("w"))
    words = docs.select("record_id", F.explode(_inner(F.col("body"))).alias("w")).join(wanted.select("w").distinct(), "w", "left_semi")
    often = words.groupBy("w").agg(F.count("*").alias("n"))
    rare = wanted.join(often, "w", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))["w"].alias("w"))
    met = words.join(rare, "w").select("query_id", "record_id").join(items, "query_id").join(docs, "record_id")
    found = met.filter(F.contains("body", "text")).select("query_id", "record_id")
    brief = contained(docs, short.select("text"), "record_id", "body", "text").join(short.select("query_id", "text"), "text").select("query_id", "record_id")
    blank = items.filter("text = ''").select("query_id", F.lit(1).alias("one")).join(docs.filter("body is not null").select("record_id", F.lit(1).alias("one")), "one").select("query_id", "record_id")
    return found.unionByName(brief).unionByName(blank)


def anchors(queries: DataFrame, chunks: DataFrame, limit: int, skill_record: str = "skills", role_prefix: str = "role-") -> DataFrame:
    """``(query_id, chunk_id, pos, reason)``: chunks that a query names, then, for queries about a length of time,
    role chunks with a period, canonical ones first.

    A title may begin or end within a word of the query, so titles are found by ``contained``. Of the role chunks only the first ``limit`` can be used by any
    query; they are taken first and joined to the queries that ask for a length of time."""
    q = queries.select("query_id", search_text(F.col("text")).alias("q"))
    skills = chunks.filter((F.col("record_id") == skill_record) & (F.col("chunk_type") == "skill")).withColumn("title", search_text(F.substring_index("text", "\n", 1)))
    titled = skills.filter(F.length("title") >= 2)
    met = contained(q, titled.select("title"), "query_id", "q", "title").join(titled.select("title", "chunk_id"), "title")
    named = met.select("query_id", "chunk_id", F.lit(0).alias("prio"), F.lit("exact_named_skill").alias("reason"))
    asks = q.filter(F.arrays_overlap(F.split("q", " "), F.array(*[F.lit(w) for w in DURATION_WORDS])))
    body = search_text(F.col("text"))
    roles = chunks.filter(F.col("record_id").startswith(role_prefix) & (F.col("chunk_type") == "role_detail")).filter(F.contains(body, F.lit("period")))
    canonical = F.col("chunk_id").endswith("canonical-employment-record") | F.contains(body, F.lit("overall period"))
    placed = roles.select("chunk_id", F.when(canonical, 1).otherwise(2).alias("prio")).orderBy("prio", "chunk_id").limit(limit)
    few = placed.agg(F.collect_list(F.struct("prio", "chunk_id")).alias("few")).withColumn("one", F.lit(1))
    timed = asks.withColumn("one", F.lit(1)).join(few, "one").select("query_id", F.inline("few"), F.lit("career_chronology").alias("reason"))
    order = Window.partitionBy("query_id").orderBy("prio", "chunk_id")
    first = named.unionByName(timed).groupBy("query_id", "chunk_id").agg(F.min(F.struct("prio", "reason")).alias("x")).select("query_id", "chunk_id", "x.*")
    return first.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit).select("query_id", "chunk_id", "pos", "reason")


def inject(hits: DataFrame, anchored: DataFrame) -> DataFrame:
    """Anchors (score 1) before the hits that are no anchors; ``pos`` from 1 within a query."""
    front = anchored.select("query_id", "chunk_id", F.lit(0).alias("part"), F.col("pos").alias("at"), F.lit(1.0).alias("score"), F.lit("anchor").alias("retrieval_source"))
    rest = hits.join(anchored.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    back = rest.select("query_id", "chunk_id", F.lit(1).alias("part"), F.col("rank").alias("at"), "score", "retrieval_source")
    order = Window.partitionBy("query_id").orderBy("part", "at")
    return front.unionByName(back).withColumn("pos", F.row_number().over(order)).drop("part", "at")


def expand(hits: DataFrame, relations: DataFrame, chunks: DataFrame, limit: int, metric_record: str = "achievement-metrics", per_link: int = 2) -> DataFrame:
    """Hits followed by chunks one relation away, at half the seed's score.

    ``hits(query_id, chunk_id, record_id, pos, score)``, ``relations(source, relation, target, edge_pos)``,
    ``chunks(chunk_id, record_id, chunk_pos)`` being the active ones. Seeds go in the order of ``pos``, edges in theirs;
    a chunk that is a hit or was added is not added again, and at most ``limit`` are added to a query. Links go to
    the first ``per_link`` chunks of their target.
    """
    first = Window.partitionBy("record_id").orderBy("chunk_pos")
    of_record = chunks.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_link).select(F.col("record_id").alias("target"), F.col("chunk_id").alias("candidate"), "n")
    links = relations.filter("relation = 'links_to'").join(of_record, "target")
    metrics = (
        relations.filter("relation = 'references_metric'").withColumn("candidate", F.concat_ws("::", F.lit(metric_record), "target"))
        .join(chunks.select(F.col("chunk_id").alias("candidate")), "candidate", "left_semi").withColumn("n", F.lit(1))
    )
    edges = links.select("source", "relation", "candidate", "edge_pos", "n").unionByName(metrics.select("source", "relation", "candidate", "edge_pos", "n"))
    seeds = hits.select("query_id", F.col("chunk_id").alias("seed"), F.col("record_id").alias("source"), "pos", "score")
    met = seeds.join(edges, "source").join(hits.select("query_id", F.col("chunk_id").alias("candidate")), ["query_id", "candidate"], "left_anti")
    once = met.groupBy("query_id", "candidate").agg(F.min(F.struct("pos", "edge_pos", "n", "seed", "relation", "score")).alias("m"))
    order = Window.partitionBy("query_id").orderBy("m.pos", "m.edge_pos", "m.n")
    added = once.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit)
    last = hits.groupBy("query_id").agg(F.max("pos").alias("last"))
    return added.join(last, "query_id").select(
        "query_id", F.col("candidate").alias("chunk_id"), (F.col("last") + F.col("k")).alias("pos"), (F.col("m.score") * 0.5).alias("score"),
        F.col("m.seed").alias("seed_chunk_id"), F.col("m.relation").alias("relation"),
    )


def apply_rerank(hits: DataFrame, verdicts: DataFrame, k: int, drop_none: bool = True, seen: int = RERANKED) -> DataFrame:
    """Hits that a reranker judged, in the order of its relevance.

    ``hits(query_id, chunk_id, pos, score, ...)``; ``verdicts(query_id, chunk_id, verdict_pos, relevance, support, reason)``.
    Only the first ``seen`` hits count; of several verdicts on a chunk the first counts; unknown chunks are dropped.
    """
    first = Window.partitionBy("query_id", "chunk_id").orderBy("verdict_pos")
    v = verdicts.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "verdict_pos")
    joined = hits.filter(F.col("pos") <= seen).withColumnRenamed("score", "pre_rerank_score").drop("pos").join(v, ["query_id", "chunk_id"])
    if drop_none:
        joined = joined.filter(~F.col("support").eqNullSafe("none"))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id")
    return joined.withColumn("score", F.col("relevance").cast("double")).withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)
