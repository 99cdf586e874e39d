"""The trie of conversation prefixes against a brute-force one."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from marlstone.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, m long"


def sequences(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [x[3:] for x in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def roll(k):
        below = [roll(x) for x in kids[k]]
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        return sum(b[0] for b in below) or 1, own + sum(b[1] for b in below)

    out = []
    for k, ms in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ms if len(convs[c]) == len(k)))
        out.append((min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), len(kids[k]), *roll(k), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nullsafe(rows):
    return sorted(rows, key=lambda r: (r[1], r[0]))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def some_rows(seed):
    draw = random.Random(seed)
    texts = ["a", "é", "", None]
    rows = [(c, t, draw.choice(["u", None]), draw.choice(texts)) for c in range(70) for t in range(draw.choice([1, 2, 3, 5, 12]))]
    rows += [(c, t, "u", "same") for c in range(100, 160) for t in range(4)]  # copies
    rows += [(c, t, "u", f"long {t}" if t < 20 else f"{c} {t}") for c in (200, 201) for t in range(25)]  # a long shared prefix
    rows += [(3, None, "u", "first"), (3, None, "u", "first"), (4, 1, "u", "tie"), (4, 1, None, "tie"), (None, 0, "u", "nobody"), (-7, 0, "u", "below"), (-5, 0, "u", "base")]
    return rows


def test_plain_trie(spark):
    rows = some_rows(1)
    got = trie.prefix_trie(*trie.plain(trie.placed(table(spark, rows)))).collect()
    assert nullsafe(map(tuple, got)) == nullsafe(brute(sequences(rows)))


def test_rebuilt_trie(spark, tmp_path):
    rows = some_rows(2)
    table(spark, rows).repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = trie.op11_prefix_trie(spark, str(tmp_path))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == [x.replace("long", "bigint") for x in trie.NODE.split(", ")]
    assert nullsafe(map(tuple, got.collect())) == nullsafe(brute(rebuilt(sequences(rows))))


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, t, "u", f"{t}") for c in range(1, 5) for t in range(1)]  # no conversation 0 to take turns from
    want = brute(rebuilt(sequences(rows)))
    turns = trie.placed(table(spark, rows))
    got = trie.prefix_trie(*trie.spliced(turns, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9, F.col("conv_id") - F.col("conv_id") % 5))
    assert nullsafe(map(tuple, got.collect())) == nullsafe(want)
    assert want[0][3] == 4


def test_empty_tables(spark, tmp_path):
    for i, rows in enumerate(([], [(None, 1, "u", "x")])):
        table(spark, rows).write.parquet(f"{tmp_path}/{i}/conversations.parquet")
        assert trie.op11_prefix_trie(spark, f"{tmp_path}/{i}").collect() == []


def test_long_lists_are_hashed_over_ranges(spark, monkeypatch):
    ids = list(range(-3, 5000)) + [10**12 + i for i in range(500)]
    groups = {1: ids, 2: [5, 40, 300], 9: [-1]}
    members = spark.createDataFrame([(r, c) for r, cs in groups.items() for c in cs], "rep long, conv_id long").repartition(5)
    got = {r["rep"]: r["hash"] for r in trie.lists_hashed(members).collect()}
    assert got == {r: hashlib.sha256(",".join(map(str, cs)).encode()).hexdigest() for r, cs in groups.items()}
