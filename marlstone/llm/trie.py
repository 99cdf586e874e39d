"""Trie of conversation prefixes, built level by level, with what sharing the prefixes saves.

A node of depth d is a distinct sequence of d turns (role, text); its members are the conversations that start with it,
and its name is the least of their ids, which is unique at a depth. Texts are dropped at once: a turn is a digest of
role and text, its bytes and its place.

Way down: conversations alike as a whole are one, with a weight. Per depth the live ones are grouped by (parent node,
next turn); a group is a node, named by its least id. A conversation stays live while its node holds another and it
has turns left; from where it is alone, its nodes are a chain, which one join writes out at whatever depth. So there
are as many rounds as the longest prefix that two different conversations share, plus one. Way up: per depth, what the
nodes below sum to is joined to their parents. Each level is a table in the shared folder.

Skew: a first turn or a conversation shared by a third of all is summed before it is shuffled; the join that names the
new nodes reads two plain tables, so that adaptive execution splits a hot key, and places in a conversation come from
running totals over ranges, so that a conversation with a third of all turns lies in many tasks. The list of ids that
end at a node is hashed in a stream: ranges of ids are packed to texts first, and one task reads a node's texts in turn.

Cases: a null role or text is empty; turns are ordered by turn, null first, and by digest among equals; repeated rows
are repeated turns; rows with a null conv_id belong to no conversation and are left out; a conversation without turns is a member of the root
only; an empty table gives no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_totals, shuffle_partitions, written

#: Turns at most that a conversation takes over from another.
HEAD = 8
#: Characters of ids in a packed row.
PACK_CHARS = 1 << 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def placed(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, pos, digest, nbytes, before, n, bytes)`` for each turn: its place from 0, its text's bytes and those before it, and the conversation's turns and bytes."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 32))
    thin = conversations.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("nbytes"))
    ranked = running_totals(written(thin, "trie-thin"), ["conv_id", "turn", "digest"], {"rank": F.lit(1), "sum": F.col("nbytes")})
    ranked = written(ranked, "trie-ranked")
    whole = written(ranked.groupBy("conv_id").agg(F.min("rank").alias("r"), F.min("sum").alias("s"), F.count("*").alias("n"), F.sum("nbytes").alias("bytes")), "trie-whole")
    at = ranked.join(whole, "conv_id")
    return written(at.select("conv_id", (F.col("rank") - F.col("r")).alias("pos"), "digest", "nbytes", (F.col("sum") - F.col("s")).alias("before"), "n", "bytes"), "trie-placed")


def _by_depth(turns: DataFrame) -> DataFrame:
    """Written in order of depth, so that a level reads its own part of the table."""
    return written(turns.repartitionByRange(shuffle_partitions(turns.sparkSession), "depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "trie-turns")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations of ``placed`` as they are, for ``prefix_trie``."""
    convs = turns.filter("pos = 0").select("conv_id", F.col("n").alias("len"))
    return _by_depth(turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "nbytes", (F.col("bytes") - F.col("before")).alias("rest"))), convs


def spliced(turns: DataFrame, head: Column, source: Column) -> tuple[DataFrame, DataFrame]:
    """As ``plain``, of conversations rebuilt: the first ``head`` (0 to 8) turns of conversation ``source``, then their own after
    as many. Both are expressions over conv_id; a source that a conversation names needs few that name it."""
    firsts = turns.filter(F.col("pos") < HEAD).groupBy("conv_id", "n", "bytes").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "nbytes", "before"))).alias("items"))
    firsts = written(firsts, "trie-firsts")
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["nbytes"])
    own = firsts.select("conv_id", "n", "bytes", "items", head.cast("int").alias("h"), source.alias("_source"))
    theirs = firsts.select(F.col("conv_id").alias("_source"), F.col("items").alias("theirs"))
    convs = own.join(theirs, "_source", "left").withColumn("head", F.when(F.col("theirs").isNotNull(), F.slice("theirs", F.lit(1), F.col("h"))).otherwise(F.slice("items", 1, 0)))
    convs = convs.select("conv_id", "n", "h", "head", F.size("head").cast("long").alias("kept"), total(F.col("head")).alias("led"), total(F.slice("items", F.lit(1), F.col("h"))).alias("cut"), "bytes")
    convs = written(convs.select("*", (F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"), (F.col("led") + F.col("bytes") - F.col("cut")).alias("total")), "trie-convs")
    first = convs.select("conv_id", "total", F.explode("head").alias("x")).select("conv_id", (F.col("x.pos") + 1).alias("depth"), "x.digest", "x.nbytes", (F.col("total") - F.col("x.before")).alias("rest"))
    ruled = convs.filter("n > h").select(F.col("conv_id").alias("_c"), "h", "kept", (F.col("total") - F.col("led") + F.col("cut")).alias("end"))
    after = turns.join(ruled, F.col("conv_id") == F.col("_c")).filter("pos >= h")
    after = after.select("conv_id", (F.col("pos") - F.col("h") + F.col("kept") + 1).alias("depth"), "digest", "nbytes", (F.col("end") - F.col("before")).alias("rest"))
    return _by_depth(first.union(after)), convs.select("conv_id", "len")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined by commas, in texts of about ``PACK_CHARS``; none holds ids of two groups."""
    rep, first, ids, size = None, None, [], 0
    out: list[tuple[int, int, str]] = []
    for batch in batches:
        for r, c in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            if ids and (r != rep or size > PACK_CHARS):
                out.append((rep, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                rep, first = r, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if len(out) >= 256:
            yield _rows(out, "rep", "first", "ids")
            out = []
    if ids:
        out.append((rep, first, ",".join(ids)))
    if out:
        yield _rows(out, "rep", "first", "ids")


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    kinds = [pa.int64() if isinstance(x, int) else pa.string() for x in rows[0]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's texts, joined by commas, as they stream by."""
    rep, state, out = None, None, []
    for batch in batches:
        for r, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if r == rep:
                state.update(b",")
            else:
                if state is not None:
                    out.append((rep, state.hexdigest()))
                rep, state = r, hashlib.sha256()
            state.update(ids.encode())
        if len(out) >= 4096:
            yield _rows(out, "rep", "hash")
            out = []
    if state is not None:
        out.append((rep, state.hexdigest()))
    if out:
        yield _rows(out, "rep", "hash")


def lists_hashed(members: DataFrame) -> DataFrame:
    """``(rep, hash)``: SHA-256 of the ids of each group of ``members(rep, conv_id)``, ascending, in decimal, joined by commas."""
    n = shuffle_partitions(members.sparkSession)
    members = written(members, "trie-members")
    chunks = members.repartitionByRange(n, "rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_packed, "rep long, first long, ids string")
    return written(chunks, "trie-chunks").repartition(n, "rep").sortWithinPartitions("rep", "first").mapInArrow(_hashed, "rep long, hash string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of ``turns(conv_id, depth, digest, nbytes, rest)``, rest being the bytes from that turn to the end, and ``convs(conv_id, len)``; see ``NODE``."""
    spark = turns.sparkSession
    marks = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("depth", "digest")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "digest", "depth")).alias("y"))
    zero = F.lit(0).cast("long")
    signed = written(convs.join(marks, "conv_id", "left").select("conv_id", "len", F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y")), "trie-signed")
    groups = written(signed.groupBy("len", "x", "y").agg(F.min("conv_id").alias("rep"), F.count("*").alias("m")), "trie-groups")
    least, everyone = signed.agg(F.min("conv_id"), F.count("*")).first()
    if not everyone:
        return spark.createDataFrame([], NODE)
    copied = groups.filter("m > 1").select("len", "x", "y", "rep")
    hashes = written(lists_hashed(signed.join(copied, ["len", "x", "y"]).select("rep", "conv_id")), "trie-hashes")

    levels: list[DataFrame] = []
    live = groups.filter("len > 0").select("rep", "m", "len", F.lit(least).alias("node"))
    while True:
        depth = len(levels) + 1
        at = turns.filter(F.col("depth") == depth).select(F.col("conv_id").alias("rep"), "digest", "nbytes", "rest")
        step = written(live.join(at, "rep"), f"trie-step-{depth}")
        ends = F.col("len") == depth
        nodes = step.groupBy("node", "digest").agg(
            F.min("rep").alias("conv_id"), F.sum("m").alias("n_convs"), F.count("*").alias("reps"), F.min("nbytes").alias("nbytes"), F.min("rest").alias("rest"), F.max("len").alias("len"),
            F.max(F.when(ends, F.col("rep"))).alias("end_rep"), F.max(F.when(ends, F.col("m"))).alias("end_m"),
        )
        nodes = written(nodes, f"trie-nodes-{depth}")
        found, longest = nodes.agg(F.count("*"), F.max(F.when(F.col("reps") > 1, F.col("len")))).first()
        if found:
            levels.append(nodes)
        if not found or longest is None or longest <= depth:
            break
        shared = nodes.filter("reps > 1").select("node", "digest", F.col("conv_id").alias("next"))
        live = step.filter(F.col("len") > depth).join(shared, ["node", "digest"]).select("rep", "m", "len", F.col("next").alias("node"))

    out: list[DataFrame] = []
    alone = F.col("reps") == 1
    below = None
    for depth in range(len(levels), 0, -1):
        nodes = levels[depth - 1]
        if below is None:
            nodes = nodes.select("*", *(zero.alias(c) for c in ("children", "leaves", "saved")))
        else:
            nodes = nodes.join(below, nodes["conv_id"] == below["_parent"], "left")
        own = (F.col("n_convs") - 1) * F.col("nbytes")
        rolled = written(nodes.select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), "n_convs",
            F.when(alone, (F.col("len") > depth).cast("long")).otherwise(F.coalesce("children", zero)).alias("n_children"),
            F.when(alone, F.lit(1).cast("long")).otherwise(F.greatest(F.coalesce("leaves", zero), F.lit(1))).alias("n_leaves"),
            F.when(alone, (F.col("n_convs") - 1) * F.col("rest")).otherwise(own + F.coalesce("saved", zero)).alias("saved_tokens"),
            "end_rep", "end_m",
        ), f"trie-rolled-{depth}")
        out.append(rolled)
        below = rolled.groupBy(F.col("parent_conv_id").alias("_parent")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    children, leaves, saved = below.agg(F.sum("children"), F.sum("leaves"), F.sum("saved")).first() if levels else (0, 1, 0)
    silent = groups.filter("len = 0").select("rep", "m").first() or (None, None)
    kind = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, end_m long"
    out.append(spark.createDataFrame([(least, 0, None, everyone, children, leaves, saved, *silent)], kind))
    for depth, nodes in enumerate(levels, 1):
        chain = nodes.filter(alone & (F.col("len") > depth)).select(F.col("conv_id").alias("_c"), F.lit(depth).alias("_d"), F.col("n_convs").alias("m"), F.col("len"))
        settled = chain if depth == 1 else settled.union(chain)
    if levels:
        last = F.col("depth") == F.col("len")
        tail = turns.join(written(settled, "trie-settled"), F.col("conv_id") == F.col("_c")).filter(F.col("depth") > F.col("_d"))
        out.append(tail.select(
            "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.col("m").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            ((F.col("m") - 1) * F.col("rest")).alias("saved_tokens"), F.when(last, F.col("conv_id")).alias("end_rep"), F.when(last, F.col("m")).alias("end_m"),
        ))
    every = out[0]
    for part in out[1:]:
        every = every.union(part)
    names = [x.split()[0] for x in NODE.split(", ")][:-1]
    listed = F.when(F.col("end_m").isNull(), F.sha2(F.lit(""), 256)).otherwise(F.sha2(F.col("end_rep").cast("string"), 256))
    few = every.filter("end_m is null or end_m = 1").select(*names, listed.alias("ends_sha256"))
    many = every.filter("end_m > 1").join(hashes, F.col("end_rep") == F.col("rep")).select(*names, F.col("hash").alias("ends_sha256"))
    return few.union(many)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: conversations rebuilt on those with ids divisible by 5, and the trie of what results."""
    turns = placed(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefix_trie(*spliced(turns, head, F.col("conv_id") - F.col("conv_id") % 5))


OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS n,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM turns, crc GROUP BY conv_id, crc.t),
parts AS (
  SELECT c.conv_id, t.pos AS place, t.role, t.text, 0 AS part FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL SELECT c.conv_id, t.pos, t.role, t.text, 1 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
rebuilt AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, role, text FROM parts),
members AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
         string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS len FROM members GROUP BY conv_id),
nodes AS (
  SELECT m.depth, m.k, min(m.conv_id) AS conv_id, count(*) AS n_convs, max(m.bytes) AS bytes,
         sha256(coalesce(string_agg(CASE WHEN l.len = m.depth THEN CAST(m.conv_id AS VARCHAR) END, ',' ORDER BY m.conv_id), '')) AS ends_sha256
  FROM members m JOIN lengths l ON l.conv_id = m.conv_id GROUP BY m.depth, m.k),
parents AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN nodes p ON p.depth = m.depth AND p.k = m.k),
children AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT p.*, coalesce(c.n_children, 0) AS n_children FROM parents p LEFT JOIN children c ON c.depth = p.depth AND c.conv_id = p.conv_id),
rolled AS (
  SELECT a.depth, a.k, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM counted n JOIN members a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.k)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, c.parent_conv_id, c.n_convs, CAST(c.n_children AS BIGINT) AS n_children,
       CAST(r.n_leaves AS BIGINT) AS n_leaves, CAST(r.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN rolled r ON r.depth = c.depth AND r.k = c.k
"""
