import numpy as np
import pytest

from quiltframe.llm.op8_topk import Index, quantised, top_k, top_of_block


def slow(rows, k):
    ok = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for qi, q in ok:
        if qi % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, x)), i) for i, x in ok if i != qi)[:k]
            out += [(qi, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("scale, n, k", [(1, 500, 20), (1e-3, 200, 20), (30, 300, 5), (1e7, 60, 20), (0, 50, 20), (1, 7, 20)])
def test_block(scale, n, k):
    g = np.random.default_rng(n)
    x = np.floor(64 * g.normal(size=(n, 16)) * scale)
    x[n // 2 :: 3] = x[0]  # ties
    ids = g.permutation(n).astype("i8") * 3
    q, qi = x[: n // 3 + 1], ids[: n // 3 + 1]
    i, j, s = top_of_block(q, qi, x, ids, k)
    for a in range(len(q)):
        want = sorted((-sum(int(u) * int(v) for u, v in zip(q[a], x[b])), ids[b]) for b in range(n) if ids[b] != qi[a])[:k]
        assert [(-v, ids[r]) for r, v in zip(j[i == a], s[i == a])] == want


def test_rows(spark):
    g = np.random.default_rng(1)
    rows = [(i, [float(c) for c in g.normal(size=8).astype("f4")]) for i in range(300)]
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan")]), (460, [float("inf"), 1.0]), (480, []), (500, [1.0]), (520, rows[0][1]), (521, rows[0][1]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(5)
    v = quantised(df)
    got = sorted(tuple(r) for r in top_k(v, v.where("vec_id % 20 = 0"), block=37, query_block=4).collect())
    assert got == slow(rows, 20)
    none = v.limit(0)
    assert top_k(none, none).count() == 0


def test_stops_on_proof():
    """Fewer postings than all are added up, few pairs are scored afresh, and the answers are those of a full product."""
    g = np.random.default_rng(4)
    x = g.normal(size=(16_000, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None])
    ids = g.permutation(16_000).astype("i8")
    index = Index(ids, x)
    i, j, s = index.top(x[:100], ids[:100], 20)
    full = (x[:100] @ x.T).astype("i8")
    full[np.arange(100), np.arange(100)] = -(10**9)
    for a in range(100):
        order = np.lexsort((ids, -full[a]))[:20]
        assert j[i == a].tolist() == order.tolist() and s[i == a].tolist() == full[a, order].tolist()
    assert index.added < 0.85 * 64 * index.pairs and index.rescored < 0.2 * index.pairs
    levels = [[abs(v).min() for _, _, v in some] for some in index.segments]
    assert all(min(a) > max(abs(v).max() for _, _, v in some) for a, some in zip(levels[:-1], index.segments[1:]))
