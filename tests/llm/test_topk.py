import numpy as np

from sigmill.llm import topk


def brute(rows, queries, k, scale=1024):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, set()).add(tuple(v))
    out = []
    for q in sorted(queries & set(good)):
        a = np.floor(scale * np.array(min(good[q])))
        scored = []
        for i, vectors in good.items():
            for v in vectors if i != q else ():
                b = np.floor(scale * np.array(v))
                n = min(len(a), len(b))
                scored.append((-int(a[:n] @ b[:n]), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)]) for i in range(700)]
    rows += [(700, None), (701, [1.0, None] * 4), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (None, [1.0] * 8), (3, rows[3][1]), (704, rows[5][1]), (705, [1.0, 2.0]), (706, []), (5, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    got = topk.top_k(df.where("vec_id % 50 = 0 or vec_id in (701, 705, 706)"), df, 10, row_block=100, query_block=4)
    f32 = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute(f32, {*range(0, 750, 50), 701, 705, 706}, 10)


def test_reading_stops_early():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.exponential(size=(2000, 4)) ** 3 * 1024)
    lists = topk.Lists(np.arange(2000), vectors)
    query = np.array([5.0, 3.0, 0.0, -1.0])
    ids, scores, read = lists.top(7, query, 5)
    exact = vectors @ query
    exact[7] = -np.inf
    best = np.lexsort((np.arange(2000), -exact))[:5]
    assert ids.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()
    assert read < 3 * 2000


def test_share_read_of_dense_vectors():
    """Vectors of 64 alike dimensions are the hardest case: about four fifths of the entries are read."""
    rng = np.random.default_rng(2)
    vectors = np.floor(rng.normal(size=(2000, 64)) * 128)
    lists, shares = topk.Lists(np.arange(2000), vectors), []
    for own in range(0, 2000, 100):
        ids, scores, read = lists.top(own, vectors[own], 10)
        exact = vectors @ vectors[own]
        exact[own] = -np.inf
        best = np.lexsort((np.arange(2000), -exact))[:10]
        assert ids.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()
        shares.append(read / vectors.size)
    assert np.mean(shares) < 0.9


def test_ties_and_small_blocks():
    rng = np.random.default_rng(3)
    for n, dims, k in ((1, 3, 2), (9, 2, 4), (50, 3, 10), (300, 5, 7), (300, 1, 3)):
        vectors = np.floor(rng.normal(size=(n, dims)) * 2)
        lists = topk.Lists(np.arange(n), vectors)
        for query in (vectors[0], np.zeros(dims), -vectors[-1]):
            exact = vectors @ query
            exact[0] = -np.inf
            best = np.lexsort((np.arange(n), -exact))[: min(k, n - 1)]
            ids, scores, _ = lists.top(0, query, k)
            assert ids.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, df, 10).collect()] in ([(0, 1, 1, 1024 * 2048), (1, 1, 0, 1024 * 2048)], [(1, 1, 0, 1024 * 2048), (0, 1, 1, 1024 * 2048)])
    assert topk.top_k(df.limit(0), df.limit(0), 10).collect() == []
