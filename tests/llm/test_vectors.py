import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwise.llm import covertree, multiindex
from tickwise.llm.vectors import fewest

NAN, INF = float("nan"), float("inf")
EDGES = [(0, [0.1, 0.2, 0.3]), (20, [0.1, 0.2, 0.3]), (3, [0.1, 0.2, 0.3]), (3, [0.1, 0.2, 0.3]), (40, [-0.5, 0.0, 1.0]), (5, [0.0, 0.0, 0.0]), (6, None), (60, [NAN, 1.0, 1.0]),
         (7, [INF, 0.0, 0.0]), (8, [None, 1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (80, [1.0, 2.0]), (9, [2.0, 1.0]), (100, []), (11, []), (12, [1.0]), (120, [3.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")


def good(v, zero):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def brute(rows, k, scale, zero):
    own = sorted({(i, tuple(v)) for i, v in rows if i is not None and good(v, zero)})
    out = []
    for q, qv in own:
        if q % 20 == 0:
            found = []
            for i, v in own:
                if i != q and len(v) == len(qv):
                    found.append((-(sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(qv, v)) if scale else float((np.array(qv) * np.array(v)).sum())), i))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def asked(df):
    return df.where(F.col("vec_id") % 20 == 0)


def run(df, k=20):
    return sorted(tuple(r) for r in covertree.top_k(df, asked(df), k).collect())


@pytest.mark.parametrize("block,leaf", [(64, 8), (8192, 128)])
def test_cover_tree_is_exact(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", block)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(5, 8))
    rows = [(i, (centers[i % 5] + 0.1 * rng.normal(size=8)).round(2).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(2000 + i, rng.normal(size=8).tolist()) for i in range(100)]
    assert run(frame(spark, rows), 7) == brute(rows, 7, True, True)


def test_cover_tree_edges(spark):
    assert run(frame(spark, EDGES), 3) == brute(EDGES, 3, True, True)
    assert run(frame(spark, []), 3) == []
    huge = [(0, [1e18, 1.0]), (20, [1e300, 1e300]), (1, [1e18, -1.0]), (2, [3.0, 4.0])]
    got = {(q, i): s for q, _, i, s in run(frame(spark, huge))}
    assert got[0, 1] == 2**63 - 1 and got[0, 2] == math.floor(64e18) * 192 + 64 * 256 if math.floor(64e18) * 192 < 2**63 else True


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(200, 4)) * 0.05 + 5 * rng.normal(size=4) for _ in range(8)])
    tree = covertree.Tree(x, leaf=16, fan=4)
    assert sorted(tree.rows.tolist()) == list(range(len(x)))
    for n in range(len(tree.lo)):
        own = x[tree.rows[tree.lo[n]:tree.hi[n]]]
        assert np.sqrt(((own - tree.centers[n]) ** 2).sum(1)).max() <= tree.radii[n] + 1e-9
        kids = tree.children[n]
        if kids:
            c = tree.centers[kids]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))[~np.eye(len(kids), dtype=bool)]
            assert apart.min() >= max(tree.radius[k] for k in kids) - 1e-9
    calls = []
    real = covertree._products
    covertree._products = lambda a, b, e: calls.append(a.shape[0] * b.shape[0]) or real(a, b, e)
    try:
        z = covertree.scaled(x)
        t = covertree.Tree(z, leaf=16)
        ids, _ = covertree.search(t, z, np.arange(len(z)), np.full(len(z), -2**63), t, z, np.arange(len(z)), 5)
    finally:
        covertree._products = real
    assert sum(calls) < 0.5 * len(z) ** 2
    s = z @ z.T
    np.fill_diagonal(s, -np.inf)
    assert all(set(ids[i]) == set(np.lexsort((np.arange(len(z)), -s[i]))[:5]) for i in range(0, len(z), 37))


def test_multi_index_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = multiindex.neighbours(df, asked(df)).collect()
    rows = df.collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    place = {i: n for n, i in enumerate(ids.tolist())}
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        s = x @ x[place[q]]
        s[place[q]] = -np.inf
        best = set(ids[np.argsort(-s)[:20]].tolist())
        own = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in sorted(own, key=lambda r: (-r["score"], r["vec_id"]))] == list(range(1, len(own) + 1)) and len(own) == 20
        hits += len(best & {r["vec_id"] for r in own})
        total += 20
        assert all(abs(r["score"] - s[place[r["vec_id"]]]) < 1e-12 for r in own)
    assert hits / total >= 0.9


def test_multi_index_recall_beside_many_equal_vectors(spark):
    """A third of the rows is one vector; recall of the queries outside that group."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9000, 64))
    x[2::3] = x[2]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    df = frame(spark, list(enumerate(x.tolist())))
    got = {}
    for r in multiindex.neighbours(df, asked(df)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in range(0, 9000, 20):
        if q % 3 != 2:
            s = x @ x[q]
            s[q] = -np.inf
            s[2::3] = s[2]
            recall.append(len(got[q] & set(np.lexsort((np.arange(9000), -s))[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.92, np.mean(recall)


def _recall(df, probe):
    rows = df.collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in multiindex.neighbours(df, asked(df), probe=probe).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        s[at] = -np.inf
        hits.append(len(got[ids[at]] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    return np.mean(hits)


@pytest.mark.parametrize("kind", ["test table", "directions", "clusters"])
def test_recall_is_that_of_the_budget(spark, kind):
    """The share of rows that is walked decides, not the size of the table."""
    if kind == "test table":
        df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    else:
        rng = np.random.default_rng(2)
        x = rng.normal(size=(5000, 64)) if kind == "directions" else rng.normal(size=(50, 64))[rng.integers(0, 50, 5000)] + 0.35 * rng.normal(size=(5000, 64))
        df = frame(spark, list(enumerate((x / np.linalg.norm(x, axis=1)[:, None]).tolist())))
    assert _recall(df, multiindex.PROBE) >= 0.9
    quarter = _recall(df, multiindex.PROBE / 4)
    assert quarter >= 0.9 if kind == "clusters" else quarter < 0.75


def test_multi_index_edges(spark):
    got = sorted(tuple(r) for r in multiindex.neighbours(frame(spark, EDGES), asked(frame(spark, EDGES)), 3).collect())
    want = brute(EDGES, 3, False, False)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-15)
    assert multiindex.neighbours(frame(spark, []), frame(spark, [])).count() == 0


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(7)
    order = multiindex.walk(a, b, [1] * 42, 42)
    total = (a[:, None] + b[None]).ravel()
    assert sorted(order) == list(range(42)) and np.all(np.diff(total[order]) >= 0)
    assert len(multiindex.walk(a, b, [1] * 42, 10)) == 10


def test_equal_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 16)
    rows = [(i, [0.3, 0.1, -0.2, 0.7]) for i in range(200)] + [(300, [0.1, 0.1, 0.1, 0.1])]
    got = sorted(tuple(r) for r in multiindex.neighbours(frame(spark, rows), asked(frame(spark, rows)), 5).collect())
    assert [g[:3] for g in got] == [w[:3] for w in brute(rows, 5, False, False)]
    x = np.array([r[1] for r in rows])
    assert fewest(np.array([r[0] for r in rows]), x, 6).tolist() == [0, 1, 2, 3, 4, 5, 200]
