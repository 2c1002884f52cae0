"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import ann, mips

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, seed=1, n=400, d=12, copies=60):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)).astype(np.float32)
    m[: n // 4] = np.round(m[: n // 4])  # ties
    m[n - copies :] = m[3]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(m)]
    bad = [(1000, None, 0), (1050, [float("nan")] * d, 0), (1100, [None] * d, 0), (1150, [float("inf")] * d, 0), (None, [1.0] * d, 0), (rows[5][0], rows[5][1], 0)]
    return spark.createDataFrame(rows + bad, SCHEMA).withColumns({"score": F.lit(1), "rank": F.lit(1), "norm": F.lit(1)}), m


def best(scores, own, ids, k=5):
    order = [j for j in np.lexsort((ids, -scores)) if j != own]
    return order[:k]


def test_inner_products_are_exact_with_ties_and_copies(spark):
    df, m = table(spark)
    ids = np.arange(len(m))
    v = np.floor(m.astype(float) * 256).astype(np.int64)
    got = {}
    for r in mips.top_inner_products(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, len(m), 50))
    for q in got:
        s = v @ v[q]
        assert got[q] == [(k + 1, int(j), int(s[j])) for k, j in enumerate(best(s, q, ids))]


@pytest.mark.parametrize("sparse", [0.0, 2.0])
def test_block_search_finds_the_same_both_ways(sparse, monkeypatch):
    monkeypatch.setattr(mips, "SPARSE", sparse)
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, (900, 16))
    v = v[np.argsort(-np.linalg.norm(v, axis=1), kind="stable")]
    ids, q, q_id = np.arange(900), v[[5, 400, 899]], np.array([5, 400, 899])
    turn, _ = np.linalg.qr(rng.normal(size=(16, 16)))
    i, ident, score = mips.search_block(q, q_id, np.full(3, mips._LEAST), mips.Candidates(v, ids, turn), 4, step=100)
    for k in range(3):
        s = v @ q[k]
        want = best(s, q_id[k], ids, 4)
        assert sorted(zip(-score[i == k], ident[i == k])) == [(-s[j], j) for j in want]


def test_nearest_scores_and_recall(spark):
    df, m = table(spark, n=600, copies=150)
    m = m.astype(float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.arange(len(m))
    hit = total = 0
    rows = ann.nearest(df.unionByName(df.limit(1).withColumns({"vec_id": F.lit(2000).cast("long"), "embedding": F.array_repeat(F.lit(0.0).cast("float"), 12)}))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, len(m), 50))
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        s = u @ u[q]
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and q not in {r["vec_id"] for r in own}
        assert all(r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-12) for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        floor = np.sort(np.delete(s, q))[-5]
        hit += sum(r["score"] >= floor - 1e-12 for r in own)
        total += 5
    assert hit / total >= 0.9


def test_cells_change_nothing(spark, monkeypatch):
    df, m = table(spark)
    want = sorted(map(tuple, ann.nearest(df, probes=16, epsilon=50).collect()))
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    for q in range(0, len(m), 50):  # every list, no early end: exact but for the rounding of ties
        assert [r[3] for r in want if r[0] == q] == pytest.approx(np.sort(np.delete(u @ u[q], q))[-5:][::-1], abs=1e-12)
    monkeypatch.setattr(ann, "CELL", 8)  # lists over many cells
    assert sorted(map(tuple, ann.nearest(df, probes=16, epsilon=50).collect())) == want


def test_recall_over_the_test_table(spark):
    """Queries: rows whose id is divisible by 20, against all rows."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = ann.nearest(df, every=20).toPandas()
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = np.where(ids == ids[q], -np.inf, u @ u[q])
        own = got[got.query_id == ids[q]].score
        assert len(own) == 5
        hit += int((own >= np.sort(s)[-5] - 1e-12).sum())
        total += 5
    assert total >= 500 and hit / total >= 0.9


def test_one_id_with_two_vectors_counts_by_its_least(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [5.0, 0.0], 0), (1, [2.0, 1.0], 0), (2, [3.0, 1.0], 0), (2, [3.0, 1.0], 1)]
    for df in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::-1], SCHEMA)):
        assert [(r["vec_id"], r["score"]) for r in mips.top_inner_products(df).orderBy("rank").collect()] == [(2, 768 * 256), (1, 512 * 256)]
        assert [r["vec_id"] for r in ann.nearest(df).orderBy("rank").collect()] == [2, 1]


def test_products_beyond_64_bits_are_refused(spark):
    with pytest.raises(ValueError):
        mips.top_inner_products(spark.createDataFrame([(0, [1e9, 1.0], 0), (1, [1.0, 1.0], 0)], SCHEMA))


def test_probes_follow_the_data():
    rng = np.random.default_rng(4)
    centres = np.eye(32)[:16]
    clustered = ann.unit(np.repeat(centres, 40, axis=0) + rng.normal(size=(640, 32)) * 0.01)
    assert (ann.measured_probes(clustered, centres, 5, 0.97)[0] == 1).all()
    spread = ann.unit(rng.normal(size=(640, 32)))
    assert (ann.measured_probes(spread, centres, 5, 0.97)[0] > 5).all()
    both = ann.unit(np.concatenate([np.repeat(centres[:1], 600, axis=0) + rng.normal(size=(600, 32)) * 0.01, spread[:40]]))
    probes, _ = ann.measured_probes(both, centres, 5, 0.97)
    assert probes[0, 1] == 1 and probes[1:].max() > 3


def skewed(kind):
    """Tables of vectors whose density differs by place; ids divisible by 50 are of every sort."""
    rng = np.random.default_rng(6)
    n, d = 3000, 24
    m = rng.normal(size=(n, d))
    if kind == "copies":  # spread queries, one vector for all the rest
        m[np.arange(n) % 50 != 0] = m[1]
    elif kind == "one cluster":  # 4 % spread
        own = np.arange(n) % 25 != 0
        m[own] = 3 * np.eye(d)[0] + rng.normal(size=(own.sum(), d)) * 0.05
        m[np.arange(n) % 100 == 0] = 3 * np.eye(d)[0] + rng.normal(size=(n // 100, d)) * 0.05
    elif kind == "clusters":
        m = 4 * np.eye(d)[rng.integers(0, 9, n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.5, 2.0], (n, 1))
    else:  # outlying: long and far from a crowded half
        m[: n // 2] = np.abs(m[: n // 2]) * 0.2 + 1
        m[::200] = -np.abs(rng.normal(size=(n // 200, d))) * 50
    return m


@pytest.mark.parametrize("kind", ["copies", "one cluster", "clusters", "outlying"])
def test_skewed_tables_have_whole_results_and_recall(spark, kind):
    m = skewed(kind)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for sample in (8192, 400):
        by = {}
        for r in ann.nearest(df, sample=sample).collect():
            by.setdefault(r["query_id"], []).append(r)
        assert set(by) == set(range(0, len(m), 50))
        hit = 0
        for q, own in by.items():
            own.sort(key=lambda r: r["rank"])
            s = np.delete(u @ u[q], q)
            assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and len({r["vec_id"] for r in own}) == 5
            assert all(r["score"] == pytest.approx(u[q] @ u[r["vec_id"]], abs=1e-12) for r in own)
            hit += sum(r["score"] >= np.sort(s)[-5] - 1e-12 for r in own)
        assert hit / (5 * len(by)) >= 0.9


def test_empty_and_tiny_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mips.top_inner_products(none).count() == 0 and ann.nearest(none).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 0)], SCHEMA)
    assert mips.top_inner_products(one).count() == 0 and ann.nearest(one).count() == 0
    three = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0], 0), (2, [], 0)], SCHEMA)
    assert [(r["vec_id"], r["score"]) for r in mips.top_inner_products(three).orderBy("rank").collect()] == [(1, 65536), (2, 0)]
    assert [r["vec_id"] for r in ann.nearest(three).collect()] == [1]
