"""Exact duplicates, importance resampling and integer clustering against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import clustering, exact, resampling

from .helpers import DOCS, awkward, empty


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Exact duplicates ---------------------------------------------------------------------------------


def plain_fingerprint(raw):
    out = []
    for b, m in zip(exact.BASES, exact.MODULI):
        h = 0
        for x in raw:
            h = (h * b + x + 1) % m
        out.append(h)
    return out[0] << 31 | out[1]


def test_fingerprints_combine_over_any_cut():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 256, n, dtype=np.uint8) for n in (0, 1, 5, 0, 4095, 4096, 4097, 20_000, 3)]
    data, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    want = [plain_fingerprint(t.tolist()) for t in texts]
    for piece in (1, 7, 4096, 1 << 16):
        assert exact.fingerprints(data, offsets, piece).tolist() == want
    hashed = lambda t: (exact.piece_hashes(t, np.array([0]), np.array([len(t)]))[0], len(t))
    long = texts[7]
    for cut in (0, 1, 9_999, 20_000):
        h, n = exact.combine(hashed(long[:cut]), hashed(long[cut:]))
        assert n == 20_000 and h.tolist() == hashed(long)[0].tolist()


def brute_groups(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lower(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for i in ids:
            kept = i == keep and left == 1
            left -= kept
            out.append((i, keep, len(ids), kept, sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece,huge,bits", [(1 << 16, 8 << 20, 62), (64, 100, 62), (64, 1 << 20, 3), (64, 100, 3)])
def test_groups_are_exact_whatever_the_fingerprints(spark, piece, huge, bits):
    """Huge texts by pieces, and fingerprints so weak that different texts share them."""
    long = "abcdefghij" * 40
    texts = ["Aa", "aA", "aa", "ab", "ba", "", None, "É", "é", "x" * 99, "X" * 99, "x" * 98 + "y", long, long.upper(), long[:-1] + "k", "k" + long[1:], long + "\x00"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "aa"), (2, "aa"), (None, "aa"), (None, "alone"), (12, long), (12, long)]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS).withColumns({c: F.lit(1) for c in ("fp", "sha", "n", "at", "kept", "_m", "x")}).repartition(3)
    got = exact.exact_duplicates(df, piece, huge, reduce=lambda fp: fp & ((1 << bits) - 1))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(rows)


def test_large_groups_are_the_same(spark, monkeypatch):
    rows = [(i, f"text {i % 3 if i % 2 else i}") for i in range(120)] + [(7, "text 1"), (None, "text 1")]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    for large in (1, 5, 1000):
        monkeypatch.setattr(exact, "LARGE", large)
        assert sorted(map(tuple, exact.exact_duplicates(df).collect()), key=str) == brute_groups(rows)


def test_exact_duplicates_of_awkward_and_empty_tables(spark):
    df = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    for huge in (exact.HUGE, 1000):
        assert sorted(map(tuple, exact.exact_duplicates(df, huge=huge).collect()), key=str) == brute_groups(rows)
    assert exact.exact_duplicates(empty(spark)).count() == 0


# Importance resampling ----------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text):
    words = WORD.findall(lower(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_resample(rows, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x in rows for f in runs(x)[1]), Counter(bucket(f) for x in target for f in runs(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000) / ((s[b] + 1.0) * (big_t + 10000))))
    out = []
    for i, x in rows:
        words, fs = runs(x)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        rank.setdefault(r[0], []).append(n)
    drawn = Counter({i: len(v) for i, v in rank.items()})
    res = []
    for i, n, w, sc, words in out:
        if words >= least and drawn[i] > 0:
            drawn[i] -= 1
            res.append((i, n, w, sc, rank[i].pop(0)))
        else:
            res.append((i, n, w, sc, None))
    return sorted(res, key=str)


def test_crc_of_joined_words():
    rng = np.random.default_rng(2)
    a, b = ([bytes(rng.integers(0, 256, int(n), dtype=np.uint8)) for n in rng.integers(0, 300, 200)] for _ in range(2))
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    assert (resampling.joined_crc(crc(a), crc(b), np.array([len(x) for x in b])) == crc([x + y for x, y in zip(a, b)])).all()


def test_resampling_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    goal = spark.createDataFrame([(t,) for t in [*target, None, ""]], "text string")
    for percent in (25, 100, 0):
        got = resampling.resample(docs, goal, percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_resample(rows, target, percent)


def test_resampling_of_awkward_and_empty_tables(spark):
    df = awkward(spark).withColumns({c: F.lit(1) for c in ("key", "weight", "rank", "buckets", "n_words")})
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    none = spark.createDataFrame([], "text string")
    got = resampling.resample(df, none, 50)
    # Texts that end in a word and begin with one: no word goes over from one text to the next.
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(rows, [], 50)
    joined = spark.createDataFrame([(0, "aa"), (1, "bb cc"), (2, ""), (3, "dd"), (4, None), (5, "dd")], "doc_id long, text string")
    assert sorted(map(tuple, resampling.resample(joined, joined, 100).collect()), key=str) == brute_resample([tuple(r) for r in joined.collect()], ["aa", "bb cc", "dd", "dd"], 100)
    assert resampling.resample(empty(spark), none).count() == 0
    assert resampling.resample(empty(spark), joined).count() == 0


# Clustering ---------------------------------------------------------------------------------------


def brute_kmeans(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    c = [v for _, v in sorted(((sha(f"3:{'' if i is None else i}"), v) for i, v in kept))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((gap(v, m), n) for n, m in enumerate(c))
    for _ in range(rounds):
        at = [place(v)[1] for _, v in kept]
        for n in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a == n]
            if own:
                c[n] = [sum(x) // len(own) for x in zip(*own)]
    ends = [(i, *place(v)) for i, v in kept]
    per = Counter()
    for _, d, n in ends:
        per[n] += d
    return sorted(((i, n, d, per[n], sum(per.values()), sha(",".join(map(str, c[n])))) for i, d, n in ends), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_brute_force_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    m = np.round(rng.normal(size=(300, 4)) * 2) / 1024 if seed == 1 else rng.normal(size=(300, 4))  # a grid of few points: ties everywhere
    m[250:] = m[7]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(900, None), (901, [1.0]), (902, [float("nan")] * 4), (903, [None, 1.0, 1.0, 1.0]), (None, [0.5] * 4), rows[3], (904, [float("inf")] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, v int").withColumns({c: F.lit(1) for c in ("cluster", "distance", "block")}).repartition(3)
    got = clustering.cluster_vectors(df, width=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_kmeans(rows, width=4)


def test_fewer_vectors_than_clusters_large_components_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(i, [1e4 * i, -7e3 * i * i]) for i in range(5)]
    assert sorted(map(tuple, clustering.cluster_vectors(spark.createDataFrame(rows, schema), width=2).collect()), key=str) == brute_kmeans(rows, width=2)
    assert clustering.cluster_vectors(spark.createDataFrame([(1, [1.0])], schema), width=2).count() == 0
    assert clustering.cluster_vectors(spark.createDataFrame([(1, [1.0, 2.0])], schema), width=2).count() == 1
    with pytest.raises(ValueError):
        clustering.cluster_vectors(spark.createDataFrame([(1, [1e300, 2.0])], schema), width=2)


def test_balls_hold_few_centroids_and_the_nearest():
    """Many clusters: far fewer distances than all, the same assignments in every round."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-40_000, 40_000, (64, 8))
    v = (centres[rng.integers(0, 64, 4000)] + rng.normal(size=(4000, 8)) * 300).astype(np.int64)
    c = v[rng.choice(4000, 64, replace=False)]
    cluster, upper, lower, computed = np.zeros(4000, np.int64), np.full(4000, np.inf), np.full(4000, -np.inf), 0
    for n in range(8):
        cluster, upper, lower, some = clustering.assign(v, c, clustering.Neighbours(c), cluster, upper, lower)
        assert (cluster == clustering.distances(v, c).argmin(axis=1)).all()
        computed += some
        old, c = c, np.array([v[cluster == k].sum(axis=0) // max(1, (cluster == k).sum()) if (cluster == k).any() else c[k] for k in range(64)])
        upper, lower = clustering.moved_bounds(old, c, cluster, upper, lower)
    assert computed < 0.35 * 8 * 4000 * 64
