from __future__ import annotations

import math

import numpy as np

from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def _brute(vectors, k=5, every=50):
    out = []
    for i, q in vectors.items():
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in vectors.items() if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def _search(spark, rows, monkeypatch=None):
    vectors = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(vectors, vectors.where("id % 50 = 0")).collect())


def test_results_are_those_of_all_products(spark, monkeypatch):
    """Ties, repeated vectors, zeros, wide and narrow ranges; many blocks."""
    monkeypatch.setattr(topk, "FEW", 3)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 12)).astype(np.float32) * rng.choice([0.01, 1, 20], (700, 1)).astype(np.float32)
    x[100:300] = x[50]
    x[300:330] = 0
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    want = _brute({i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows})
    assert _search(spark, rows) == want


def test_few_rows_give_all(spark):
    assert [(r[1], r[2], r[3]) for r in _search(spark, [(0, [1.0, 0.0]), (1, [1.0, 5.0]), (2, [-1.0, 0.0])])] == [(1, 1, 65536), (2, 2, -65536)]
    assert _search(spark, [(0, [1.0])]) == []
    assert _search(spark, []) == []


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (6, [0.5, 0.5]), (None, [9.0, 9.0]), (7, [2.0])]
    assert [(r[2], r[3]) for r in _search(spark, rows)] == [(7, 131072), (6, 65536)]


def test_large_components_take_part(spark):
    """Ranked exactly at any size; a score beyond a long is null."""
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((200, 6)) * rng.choice([1, 1e6, 1e9, 5e15], (200, 1))).astype(np.float32)
    x[60:70], x[70] = x[50], -x[50]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    want = _brute({i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows})
    want = [(i, rank, j, s if -(1 << 63) <= s < 1 << 63 else None) for i, rank, j, s in want]
    assert _search(spark, rows) == want and any(s is None for *_, s in want)
    assert [(r[2], r[3]) for r in _search(spark, [(0, [1.0, 1.0]), (1, [1e6, 0.0]), (2, [2.0, 0.0]), (3, [-1e6, 0.0])])] == [(1, 65536 * 10**6), (2, 131072), (3, -65536 * 10**6)]


def test_components_of_any_size_take_part(spark):
    """Up to the largest doubles, beside small ones and beside rows of which nothing is left on the scale of the largest."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((160, 5)) * rng.choice([1e-300, 1e-3, 1, 6e5, 1e12, 1e30, 1e200, 1.5e307], (160, 1))
    x[60:64] = x[50]
    x[70], x[71] = 0, -x[50]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    floors = {i: [int(c) * 256 if abs(c) >= 2**53 else math.floor(256 * c) for c in v] for i, v in rows}
    want = [(i, rank, j, s if -(1 << 63) <= s < 1 << 63 else None) for i, rank, j, s in _brute(floors)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert sorted(map(tuple, topk.search(vectors, vectors.where("id % 50 = 0")).collect()), key=lambda r: r[:2]) == want
    found = _search(spark, [(0, [1.0, 1.0]), (5, [1e30, 0.0]), (6, [6e5, 0.0])])
    assert [(r[2], r[3]) for r in found] == [(5, None), (6, 65536 * 600_000)]


def test_repeated_ids_and_clashing_columns(spark):
    """Repeated rows are candidates each; rows that share an id are queries of their own and no candidates of each other."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 2.0]), (1, [3.0, 2.0]), (2, [1.0, 4.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "v", "n", "dims", "lane", "place", "rank", "score", "query_id"):
        frame = frame.selectExpr("*", f"'other' as `{c}`")
    vectors = topk.integer_vectors(frame)
    found = sorted(tuple(r) for r in topk.search(vectors, vectors.where("id % 50 = 0")).collect())
    one, two = [(1, 3), (1, 3), (2, 1)], [(2, 4), (1, 2), (1, 2)]
    assert found == sorted((0, rank, i, s * 65536) for best in (one, two) for rank, (i, s) in enumerate(best, 1))


def test_sql_takes_the_same_rows(spark, tmp_path):
    """Large components, repeated ids, null and non-finite ones."""
    from oracle import connect, same_rows

    from tidemark.llm.oracles import TOPK
    from tidemark.llm.queries import op7_exact_topk

    rng = np.random.default_rng(4)
    rows = [(i % 90, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((120, 4)) * rng.choice([1, 6e5, 1e12], (120, 1)))]
    rows += [(50, None), (3, [None, 1.0]), (4, [float("nan")]), (None, [1.0]), (150, [1e6, 2.0])]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    same_rows(op7_exact_topk(spark, str(tmp_path)), TOPK, connect(str(tmp_path)))


def test_stopping_early_is_proved():
    """A steep query settles on few segments; the members it keeps hold the true best."""
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (3000, 20)).astype(np.int64)
    x[:, 0] = rng.integers(0, 5000, 3000)
    block = topk.Block(3000, 20, np.arange(3000).astype("<i8").tobytes(), x.astype("<i4").tobytes(), np.argsort(x, axis=0, kind="stable").astype("<u2").T.copy().tobytes())
    q = np.ones((1, 20), np.int64)
    ids, scores = block.top(np.array([-1]), q, 5)[0]
    order = np.lexsort((np.arange(3000), -(x @ q[0])))[:5]
    assert ids.tolist() == order.tolist() and scores.tolist() == (x @ q[0])[order].tolist()
