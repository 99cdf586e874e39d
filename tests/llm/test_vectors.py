"""Vector codes against brute force over all entries, and the bounds against exact distances."""

import hashlib
import math

import numpy as np
import pytest

from marlstone.llm import vectors


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    x = np.array([r[1] for r in kept], dtype=np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if len(own := x[code[:, p] == e, p]):
                    books[p, e] = own.sum(axis=0) // len(own)
    code, error = assign()
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    total = {}
    for r, e in zip(kept, error.sum(axis=1), strict=True):
        total[r[2]] = total.get(r[2], 0) + int(e)
    return [(r[0], "".join(f"{c:02x}" for c in cs), int(e), total[r[2]], digest) for r, cs, e in zip(kept, code, error.sum(axis=1), strict=True)]


def order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string")


def some(seed, n, width=16):
    draw = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(v)) for v in draw.normal(size=width)], int(draw.integers(3))) for i in range(n)]
    same = rows[0][1]
    rows += [(1000 + i, same, None) for i in range(n // 3)]  # a very common vector
    rows += [(2000, None, 1), (2001, [None] * width, 1), (2002, [float("nan")] * width, 1), (2003, [*same[1:], float("inf")], 1), (5, same, 1), (5, rows[9][1], 1), (None, rows[3][1], None)]
    return rows


@pytest.mark.parametrize(("n", "width"), [(90, 16), (7, 64), (40, 24), (1, 8)])
def test_codes(spark, tmp_path, n, width):
    rows = some(n, max(n, 10), width)
    if n == 1:
        rows = rows[:1]
    table(spark, rows).repartition(6).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vectors.op13_vector_codes(spark, str(tmp_path))
    assert got.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert order(map(tuple, got.collect())) == order(brute(rows))


def test_odd_vectors_go(spark):
    rows = [(i, [float(i + j) for j in range(8)], 1) for i in range(4)]
    odd = [(90, [1.0] * 16, 1), (91, [], 1), (92, [1e9] * 8, 1)]
    kept = vectors.whole_vectors(table(spark, rows + odd, "double"))
    assert sorted(r["vec_id"] for r in kept.collect()) == [0, 1, 2, 3]
    assert vectors.whole_vectors(table(spark, [(1, [1.0] * 7, 1)])).collect() == []  # parts don't divide the length


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vectors.op13_vector_codes(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("width", [1, 2, 3, 8, 12])
def test_bounds_are_at_most_the_distance_and_ties_go_low(width):
    draw = np.random.default_rng(width)
    for spread in (2, 50, 10**5, 2**27):
        entries = draw.integers(-spread, spread, (16, width))
        entries[9] = entries[4]
        x = np.concatenate([draw.integers(-spread, spread, (400, width)), entries, (entries[:8] + entries[8:]) // 2])
        b = vectors.Bounds(entries)
        exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        for n, level in zip(b.counts, b.levels, strict=True):
            of_x = b.outline(x, n)
            assert (b._lower((of_x[0][:, None], of_x[1][:, None]), (level[0][None], level[1][None])) <= exact).all()
        code, error = b.nearest(x)
        assert (code == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()
