"""Decontamination, substrings and SimHash against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from marlstone.llm import components, decontaminate, simhash, substrings

WORDS = r"[^\x20\x09-\x0D]+"


def corpus(seed=1, n=60):
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    some = [" ".join(draw.choices(vocab, k=draw.randint(1, 160))) for _ in range(n)]
    shared = " ".join(draw.choices(vocab, k=60))
    rows = [(i, t) for i, t in enumerate(some)]
    rows += [(100 + i, some[i]) for i in range(5)] + [(200 + i, some[i] + "\n" + shared + "\t" + some[i + 9]) for i in range(8)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one"), (304, shared + " " + shared), (100, some[0]), (None, some[1]), (305, "x " * 300)]
    rows += [(400 + i, re.sub(r"w\d+", "zz", some[20], count=1)) for i in range(2)]
    return rows


def docs(spark, rows):
    # A column that clashes with names used inside.
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, `row` int")


def words(t):
    return re.findall(WORDS, t or "")


@pytest.mark.parametrize("window", [35, 12])
def test_substrings(spark, window):
    rows = corpus()
    ws = [words(t) for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    want = []
    for (d, _), w in zip(rows, ws, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = substrings.repeated_passages(docs(spark, rows), window=window, shard_bytes=4000, bucket_bytes=4000).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 1000


def test_substrings_tell_thue_morse_words_apart(spark):
    bits = [bin(i).count("1") & 1 for i in range(1 << 11)]
    pair = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    common = [f"w{i}" for i in range(34)]
    rows = [(i, " ".join([*common, x])) for i, x in enumerate(pair)]
    assert [r["n_removed"] for r in substrings.repeated_passages(docs(spark, rows)).collect()] == [0, 0]
    assert [r["n_removed"] for r in substrings.repeated_passages(docs(spark, rows[:1] * 2)).collect()] == [35, 35]


def test_covers():
    assert all(substrings.is_cover(v, r) for v, r in substrings.COVERS.items())
    assert substrings.period_for(35) == 21 and substrings.period_for(3) == 1


def test_substrings_empty(spark):
    assert substrings.repeated_passages(docs(spark, [])).count() == 0


def brute_fingerprint(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = words(low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark):
    rows = corpus(2) + [(500 + i, "Á É Upper lower 漢字  x\ty\nz" + " w" * i) for i in range(4)]
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = sorted((str(d), f, least.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True)))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == want


@pytest.mark.parametrize("pairwise", [0, 64])
def test_links_connect_what_pairs_connect(spark, pairwise):
    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base[:4]:
        x = b
        for _ in range(40):
            x ^= 1 << draw.randrange(64)
            if draw.random() < 0.5:
                x ^= 1 << draw.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), pairwise=pairwise).collect()
    unsigned = {s: f for s, f in zip(signed, fps, strict=True)}
    assert all((unsigned[r["a"]] ^ unsigned[r["b"]]).bit_count() <= 2 for r in edges)

    def groups(pairs):
        parent = {f: f for f in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(a)] = root(b)
        return sorted(sorted(f for f in fps if root(f) == r) for r in {root(f) for f in fps})

    every = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2]
    assert groups((unsigned[r["a"]], unsigned[r["b"]]) for r in edges) == groups(every)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 99), (98, 100), (98, 100)]
    got = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}
    assert len(got) == 44
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives(spark):
    rows = corpus(3)
    df = docs(spark, rows)
    groups = {r["component_id"] for r in simhash.near_duplicates(df).collect()}
    got = simhash.keep_representatives(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(groups)


def shingles(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = words(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def held(x, t):
    """Shingles of item x, and how many of them text t has; an item of fewer than five words is one shingle."""
    n = min(5, len(words(x))) or 5
    cut = lambda y: {tuple(w[i : i + n]) for w in [words("".join(c.lower() if "A" <= c <= "Z" else c for c in y or ""))] for i in range(len(w) - n + 1)}
    return len(cut(x)), len(cut(x) & cut(t))


def test_containment(spark):
    draw = random.Random(4)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(draw.choices(vocab, k=k))) for i, k in enumerate([5, 6, 9, 20, 40, 41, 90, 200, 4, 0])] + [(20, None), (21, ""), (30, "only"), (31, "V1  v2"), (32, "v7 v8 V9 v8"), (None, "Only here"), (3, "Dup " + " ".join(draw.choices(vocab, k=30)))]
    rows = [(i, " ".join(draw.choices(vocab, k=300))) for i in range(10)]
    for i, t in items[:8]:
        w = (t or "").split()
        for cut in (0, 1, len(w) // 10, len(w) // 6, len(w) // 4):
            rows.append((50 + i, rows[0][1] + " \n " + "\t".join(w[cut:]).upper() + " tail"))
            half = len(w) // 2
            rows.append((70 + i, " ".join(w[:half]) + " gap " * cut + " ".join(w[half:])))
    rows += [(None, items[5][1]), (99, None), (98, ""), (96, "v7"), (95, "and v7 v8\tv9 v8"), (94, "ONLY\nhere"), (93, items[8][1] + " x")]
    want = []
    for d, t in rows:
        for i, x in items:
            n, k = held(x, t)
            if n and k / n >= 0.8:
                want.append((str(d), str(i), n, k))
    assert {"30", "31", "32", "None", "8"} <= {w[1] for w in want}
    it = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(docs(spark, rows), it, block_bytes=600).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"]), r["item_shingles"], r["shared_shingles"]) for r in got) == sorted(want) and len(want) > 15
    clean = decontaminate.drop_contaminated(docs(spark, rows), it, block_bytes=600)
    bad = {i for i, (_, t) in enumerate(rows) if any(held(x, t)[0] and held(x, t)[1] / held(x, t)[0] >= 0.8 for _, x in items)}
    assert clean.count() == len(rows) - len(bad) and clean.columns == ["doc_id", "text", "fp", "row"]
    assert decontaminate.contained_items(docs(spark, []), it).count() == 0
    assert decontaminate.contained_items(docs(spark, rows), it.filter("false")).count() == 0


def test_sketch_is_never_too_small():
    import math

    for n in range(1, 400):
        k = decontaminate.sketch_size(n, 0.8)
        assert k > n - math.ceil(0.8 * n) or k == n
