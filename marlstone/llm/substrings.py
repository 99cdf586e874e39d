"""Removal of repeated passages: every word covered by a window of words that also starts elsewhere.

Anchors come from a difference cover: a set of residues modulo a period v such that any difference modulo v is a
difference of two of them. If windows of L words at i and j are equal, some shift d < v puts both i + d and j + d at
cover residues, so the two share an anchor (the w words there, v + w - 1 <= L) although each document samples its
positions on its own. Only anchors, about a quarter of all positions, are exchanged for all text. Around each anchor
that occurs twice the match is extended: the windows containing it are hashed at full length and exchanged, and those
that occur twice are repeated. An anchor's 64-bit collision only adds candidates. A window is told by 128 bits, two
hashes over two independent random hashes of its words: two windows that differ agree in both with a probability below
2**-90, whatever their words.

Physical plan. Documents are dealt once to shards of bounded size by a row number; every step works a shard at a time
and the three uses of the dealt documents share that exchange. What a shard asks about goes out as one packed row for
each bucket of hashes, each distinct hash once a shard, so a passage that a third of all documents share costs a
bucket one entry a shard; a shard's own repeats travel by shard. A shard sends at most as many rows as there are
buckets (one for ``bucket_bytes`` of text) or sampled places, whichever is less. Answers return packed, a row for each bucket and shard. Nothing is collected, broadcast or
paired.

Cases: null and empty texts have no words, remove none and hash the empty string; texts shorter than a window keep
all; a row repeated whole is a copy like any other, so all windows of both go; very long texts are scanned in blocks;
equal or null ids do not matter, as rows are told apart by number; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_bytes
from .textscan import STEP, U, Words, gram_hash, hash_words, mix, pieces, texts, whole, words

#: Perfect difference covers, period to residues.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

#: Step of the second hash of a window.
SECOND = U(0xC2B2AE3D27D4EB4F)

ASK = "bucket bigint, shard bigint, hashes binary, tails binary, places binary, many binary, known binary"
ANSWER = "shard bigint, places binary"


def is_cover(period: int, residues: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in residues for b in residues} == set(range(period))


def period_for(window: int) -> int:
    """The largest tabulated period that leaves anchors of at least a third of the window; 1 (all positions) if none."""
    return max((v for v in COVERS if window - v + 1 >= max(3, window // 3)), default=1)


class _Shard:
    """Documents of a shard in the order of their row numbers, with the hash of every word and a place for each."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("row")
        self.text = texts(table.column("text"))
        self.table = table
        firsts, hashes, starts, ends = [np.zeros(1, np.int64)], [], [], []
        for a, _, part in pieces(self.text):
            w = words(part)
            hashes.append(hash_words(part.data, w))
            starts.append(w.starts + self.text.offsets[a])
            ends.append(w.ends + self.text.offsets[a])
            firsts.append(w.first[1:] + firsts[-1][-1])
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.hashes = join(hashes, U)
        self.words = Words(join(starts, np.int64), join(ends, np.int64), np.concatenate(firsts))

    def second(self, marked: np.ndarray) -> np.ndarray:
        """Hashes of another family for marked words, zero for the others."""
        out = np.zeros(len(self.hashes), U)
        for a in range(0, len(out), 1 << 16):
            at = a + np.flatnonzero(marked[a : a + (1 << 16)])
            if len(at):
                out[at] = hash_words(self.text.data, Words(self.words.starts[at], self.words.ends[at], self.words.first), 1)
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places at which n words of one row begin, and the hash there."""
        at = np.flatnonzero(whole(self.words, n))
        return at, gram_hash(self.hashes, n)[at]


def _ask(shard: int, places: np.ndarray, h: np.ndarray, buckets: int, tail: np.ndarray | None) -> pa.Table:
    """A packed row for each bucket; of hashes met more than once here one is sent, and all their places are known."""
    order = np.lexsort((places, h)) if tail is None else np.lexsort((places, tail, h))
    h, places = h[order], places[order].astype(np.uint32)
    tail = None if tail is None else tail[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if tail is not None:
        new[1:] |= tail[1:] != tail[:-1]
    last = np.ones(len(h), bool)
    last[:-1] = new[1:]
    many = ~(new & last)
    bucket = (mix(h ^ STEP) % U(buckets)).astype(np.int64)
    by = np.lexsort((places, bucket))
    h, places, bucket, new, many = h[by], places[by], bucket[by], new[by], many[by]
    tail = None if tail is None else tail[by]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    cols: dict[str, list] = {k: [] for k in ("bucket", "shard", "hashes", "tails", "places", "many", "known")}
    add = lambda *x: [v.append(y) for v, y in zip(cols.values(), x, strict=True)]
    for a, b in itertools.pairwise([*cuts.tolist(), len(h)]):
        one = new[a:b]
        add(int(bucket[a]), shard, h[a:b][one].tobytes(), b"" if tail is None else tail[a:b][one].tobytes(), places[a:b][one].tobytes(), many[a:b][one].tobytes(), b"")
    if many.any():  # by shard, not by hash: a very common passage would fill one bucket
        add(int(mix(np.array([shard], U))[0] % U(buckets)), shard, b"", b"", b"", b"", np.sort(places[many]).tobytes())
    return pa.table(cols, schema=pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), *((k, pa.binary()) for k in ("hashes", "tails", "places", "many", "known"))]))


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket: the places, by shard, of hashes that two shards sent or one knows to be repeated; and the
    places that shards already knew."""
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
    hashes, places, many, known = read("hashes", U), read("places", np.uint32), read("many", bool), table.column("known").to_pylist()
    tails, shards = read("tails", U), table.column("shard").to_pylist()
    h, here = np.concatenate(hashes), np.concatenate(many)
    t = np.concatenate(tails) if sum(map(len, tails)) else np.zeros(len(h), U)
    order = np.lexsort((t, h))
    h, t = h[order], t[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    group = np.cumsum(first) - 1
    hit = np.zeros(len(h), bool)
    hit[order] = (np.bincount(group) > 1)[group]
    out: dict[str, list] = {"shard": [], "places": []}
    at = 0
    for shard, own, told in zip(shards, places, known, strict=True):
        to = at + len(own)
        got = told or own[hit[at:to] & ~here[at:to]].tobytes()
        at = to
        if got:
            out["shard"].append(shard)
            out["places"].append(got)
    return pa.table(out, schema=pa.schema([("shard", pa.int64()), ("places", pa.binary())]))


def _placed(answers: pa.Table, n: int) -> np.ndarray:
    mask = np.zeros(n, bool)
    for x in answers.column("places"):
        mask[np.frombuffer(x.as_buffer(), np.uint32)] = True
    return mask


def _windows_at(anchors: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Marks of the window beginnings whose window contains a marked anchor."""
    n = len(anchors)
    turn = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(anchors)
    np.add.at(turn, np.maximum(at - (window - anchor), 0), 1)
    np.add.at(turn, at + 1, -1)
    return np.cumsum(turn[:-1]) > 0


def _covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Marks of the words that windows beginning at ``starts`` cover."""
    turn = np.zeros(n + window, np.int64)
    turn[starts] += 1
    turn[starts + window] -= 1
    return np.cumsum(turn)[:n] > 0


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, shard_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20, keep_text: bool = True) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans (word ranges removed, begin and
    end in turn) and, with ``keep_text``, kept (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    period = period_for(window)
    residues = COVERS.get(period, (0,))
    anchor = window - period + 1
    size = text_bytes(docs, text)
    shards = max(size // shard_bytes + 1, shuffle_partitions(spark))
    buckets = max(size // bucket_bytes + 1, shuffle_partitions(spark))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).repartition("shard")

    def anchors_of(table: pa.Table) -> pa.Table:
        s = _Shard(table)
        at, h = s.grams(anchor)
        inside = at - np.repeat(s.words.first[:-1], np.diff(s.words.first))[at]
        on = np.isin(inside % period, residues)
        return _ask(table.column("shard")[0].as_py(), at[on], h[on], buckets, None)

    def windows_of(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _ask(0, np.zeros(0, np.int64), np.zeros(0, U), buckets, None)
        s = _Shard(table)
        at, h = s.grams(window)
        on = _windows_at(_placed(answers, len(s.hashes)), window, anchor)[at]
        tail = gram_hash(s.second(_covered(at[on], len(s.hashes), window)), window, SECOND)[at[on]]
        return _ask(table.column("shard")[0].as_py(), at[on], h[on], buckets, tail)

    id_type = docs.schema[doc_id].dataType.simpleString()
    out_schema = f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<int>" + ", kept string" * keep_text

    def kept_of(table: pa.Table, answers: pa.Table) -> pa.Table:
        s = _Shard(table)
        w = s.words
        gone = _covered(np.flatnonzero(_placed(answers, len(s.hashes))), len(s.hashes), window)
        cols: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "spans", "kept")}
        data = s.text.data
        for d in range(len(w.first) - 1):
            a, b = int(w.first[d]), int(w.first[d + 1])
            raw = data[s.text.offsets[d] : s.text.offsets[d + 1]].tobytes().split()
            mask, spans = gone[a:b], []
            if mask.any():
                edges = np.flatnonzero(np.diff(np.r_[False, mask, False]))
                spans = edges.tolist()
                keep: list[bytes] = []
                at = 0
                for x, y in zip(spans[::2], spans[1::2], strict=True):
                    keep += raw[at:x]
                    at = y
                raw = keep + raw[at:]
            kept = b" ".join(raw)
            cols["n_words"].append(b - a)
            cols["n_removed"].append(int(mask.sum()))
            cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            cols["spans"].append(spans)
            if keep_text:
                cols["kept"].append(kept)
        arrays = [s.table.column("doc_id").combine_chunks(), pa.array(cols["n_words"], pa.int64()), pa.array(cols["n_removed"], pa.int64()), pa.array(cols["kept_sha256"], pa.string()), pa.array(cols["spans"], pa.list_(pa.int32()))]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
        if keep_text:
            arrays.append(pa.array(cols["kept"], pa.binary()).cast(pa.string()))
            names.append("kept")
        return pa.Table.from_arrays(arrays, names=names)

    by_shard = dealt.groupBy("shard")
    repeated_anchors = by_shard.applyInArrow(anchors_of, ASK).groupBy("bucket").applyInArrow(_answer, ANSWER)
    asked = by_shard.cogroup(repeated_anchors.groupBy("shard")).applyInArrow(windows_of, ASK)
    repeated = asked.groupBy("bucket").applyInArrow(_answer, ANSWER)
    return by_shard.cogroup(repeated.groupBy("shard")).applyInArrow(kept_of, out_schema)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: 35-word windows over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_passages(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM dup) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
