import numpy as np
import pytest

from seamline.llm import tree_search


def brute(x, ids, queries, k):
    """Per query row its best (score, id) by scoring everything in whole numbers."""
    whole = [[int(v) for v in row] for row in x]
    out = {}
    for r in queries:
        exact = [(sum(a * b for a, b in zip(whole[r], w)), int(ids[n])) for n, w in enumerate(whole) if n != r]
        scored = sorted((-max(min(s, tree_search.MOST_LONG), tree_search.LEAST_LONG), i) for s, i in exact)
        out[int(r)] = [(-s, i) for s, i in scored[:k]]
    return out


def clustered(rng, centres=40, rows=2000, width=16, spread=0.02):
    c = rng.normal(size=(centres, width))
    x = c[rng.integers(0, centres, rows)] + rng.normal(size=(rows, width)) * spread
    return np.floor(x / np.linalg.norm(x, axis=1)[:, None] * 64)


def search(x, ids, queries, k, block=500):
    rows = np.arange(len(x))
    blocks = [tree_search.cover_tree(x[a : a + block], ids[a : a + block], rows[a : a + block]) for a in range(0, len(x), block)]
    tree = tree_search.cover_tree(x[queries], ids[queries], rows[queries], tree_search.QUERY_LEAF, tree_search.QUERY_MEAN_CHILD)
    found, scored = tree_search.dual_tree(tree, blocks, k)
    return dict(zip(tree.rows.tolist(), found)), scored / (len(queries) * len(x))


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "twins", "large"])
def test_dual_tree_against_brute_force(kind):
    rng = np.random.default_rng(7)
    x = clustered(rng, rows=900) if kind == "clustered" else np.floor(rng.normal(size=(900, 8)) * 20)
    ids = rng.permutation(900)
    if kind == "equal":
        x[:] = 3
    if kind == "twins":
        x[200:500], ids = x[0], rng.integers(0, 50, 900)
    if kind == "large":
        x = np.floor(x * 1e5) * 64
    queries = np.arange(0, 900, 20)
    got, _ = search(x, ids, queries, 20)
    assert got == brute(x, ids, queries, 20)


def test_tree_covers_its_rows_and_halves_its_radii():
    rng = np.random.default_rng(8)
    x = clustered(rng)
    tree = tree_search.cover_tree(x, np.arange(len(x)), np.arange(len(x)))
    assert sorted(tree.rows.tolist()) == list(range(len(x))) and (tree.x == x[tree.rows]).all()
    assert tree.count.max() > 1
    for i in range(len(tree.starts)):
        a, b = tree.starts[i], tree.stops[i]
        assert np.linalg.norm(tree.x[a:b] - tree.x[a], axis=1).max() <= tree.radii[i] + 1e-9
        for c in range(tree.first[i], tree.first[i] + tree.count[i]):
            assert a <= tree.starts[c] < tree.stops[c] <= b and tree.radii[c] <= tree.radii[i] / 2 + 1e-4


def test_most_pairs_of_clustered_rows_are_never_scored():
    x = clustered(np.random.default_rng(9), centres=100, rows=8000, width=32)
    ids = np.arange(len(x))
    got, share = search(x, ids, ids[::20], 20, block=2000)
    assert share < 0.25
    some = ids[::400]
    assert {int(r): got[int(r)] for r in some} == brute(x, ids, some, 20)


def answers(df, k=20):
    return [tuple(r) for r in tree_search.top_inner_products(df, df.vec_id % 20 == 0, k=k).orderBy("query_id", "rank", "vec_id").collect()]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (5, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, row string, pivot int")
    assert answers(df) == [(0, 1, 1, 4096), (0, 2, 20, 2048), (20, 1, 0, 2048), (20, 2, 1, 2048)]
    assert answers(df.limit(0)) == [] and answers(df.where("vec_id = 0")) == []


def test_repeated_query_rows_each_answer_whole(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.25, 0.0]), (2, [0.25, 0.0]), (2, [0.25, 0.0]), (3, [0.125, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    mine = [(20, 1, 20, 4096), (20, 2, 1, 1024), (20, 3, 2, 1024), (20, 4, 2, 1024), (20, 5, 3, 512)]
    assert answers(df) == sorted(mine + mine)
    assert answers(df, k=2) == sorted(2 * mine[:2])


def test_unequal_lengths_and_scores_beyond_64_bits(spark):
    rows = [(20, [1.0]), (1, [0.5, 9.0]), (40, [1e200, 1e200]), (2, [1e200]), (3, [-1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(df)
    assert got[:4] == [(20, 1, 2, tree_search.MOST_LONG), (20, 2, 40, tree_search.MOST_LONG), (20, 3, 1, 2048), (20, 4, 3, tree_search.LEAST_LONG)]
    assert [r[2] for r in got[4:]] == [1, 2, 20, 3]


def test_many_blocks_and_groups_agree_with_brute_force(spark, monkeypatch):
    for name, value in {"DATA_BLOCK": 60, "QUERY_GROUP": 7, "GROUPS_AT_ONCE": 2, "PIVOTS": 24}.items():
        monkeypatch.setattr(tree_search, name, value)
    rng = np.random.default_rng(10)
    x = clustered(rng, centres=12, rows=700, width=8) / 64
    x[:250] = x[0]
    ids = rng.integers(0, 400, 700)
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(5)
    queries = np.flatnonzero(ids % 20 == 0)
    want = brute(np.floor(x * 64), ids, queries, 5)
    assert answers(df, k=5) == sorted((int(ids[r]), n + 1, i, s) for r, mine in want.items() for n, (s, i) in enumerate(mine))
