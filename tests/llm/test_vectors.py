"""op 2 against brute force."""

import numpy as np

from kistwerk.llm.vectors import forest, keys, near_vectors, plan, unit


def components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def sample(seed=0, n=600, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 3):  # chains around the threshold
        x[i + 1] = x[i] + rng.normal(size=dim) * rng.uniform(0, 0.6)
    x[50] = x[10]
    x[51] = x[10]
    m = len(x[100:180])
    x[100:180] = x[100] + rng.normal(size=(m, dim)) * 0.05
    return x.astype(np.float32)


def test_against_brute_force(spark):
    x = sample()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()}
    u = unit(x)
    cos = u @ u.T >= 0.9
    np.fill_diagonal(cos, False)
    links = list(zip(*np.nonzero(cos), strict=True))
    want = components(len(x), links)
    found = sum(got[i].n_links for i in range(len(x)))
    assert found >= 0.995 * cos.sum() and all(got[i].n_links <= cos[i].sum() for i in range(len(x)))
    assert sum(got[i].component_id == want[i] for i in range(len(x))) >= 0.99 * len(x)
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n_links string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df, "vec_id", "embedding").collect()), key=str)
    want = [(1, 3, 1, True), (1, 3, 1, True), (8, 3, 1, False), (None, 3, 1, False)] + [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 9)]
    assert got == sorted(want, key=str)
    assert near_vectors(df.limit(0), "vec_id", "embedding").count() == 0


def test_keys_do_not_depend_on_grouping():
    x = unit(sample(1))
    m, tables = plan(len(x), 0.9)
    whole = keys(x, m, tables)
    assert all((keys(x[i : i + 7], m, tables) == whole[i : i + 7]).all() for i in range(0, len(x), 7))


def test_large_bucket_in_blocks(spark, monkeypatch):
    import kistwerk.llm.vectors as V

    monkeypatch.setattr(V, "BLOCK", 16)
    x = sample(2, 150)
    x[:90] = x[0] + np.random.default_rng(3).normal(size=(90, 16)) * 0.03
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()}
    u = unit(x)
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert all(got[i] == want[i] for i in range(90))


def test_forest_joins_what_all_links_join():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (5, 3), (40, 30), (40, 400), (300, 5000)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        u, v = u[u != v], v[u != v]
        kept = forest(n, u, v)
        assert len(kept) == n - len(set(components(n, zip(u, v, strict=True)))) and components(n, zip(u[kept], v[kept], strict=True)) == components(n, zip(u, v, strict=True))


def test_ties_at_the_threshold(spark):
    """(3, 4) and (1, 0) have a cosine of 0.6 exactly: linked at 0.6, not above."""
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [-3.0, 4.0]), (4, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    links = lambda at: {r.vec_id: r.n_links for r in near_vectors(df, "vec_id", "embedding", at).collect()}
    assert links(0.6) == {1: 2, 2: 2, 3: 0, 4: 2} and links(np.nextafter(0.6, 1)) == {1: 0, 2: 1, 3: 0, 4: 1}


def test_recall_on_planted_links(spark):
    """20,000 vectors with pairs and groups planted around the threshold, against all cosines."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20_000, 32))
    for i in range(0, 6000, 2):
        x[i + 1] = x[i] + rng.normal(size=32) * rng.uniform(0.2, 0.5)
    x[7000:7400] = x[7000] + rng.normal(size=(400, 32)) * 0.2
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r.n_links for r in near_vectors(df, "vec_id", "embedding").collect()}
    u = unit(x)
    want = np.concatenate([(u[i : i + 2000] @ u.T >= 0.9).sum(1) for i in range(0, len(u), 2000)]) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() and want.sum() > 5000
