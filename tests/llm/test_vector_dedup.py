import numpy as np
import pytest

from quiltframe.llm import components as comp
from quiltframe.llm.op9_vector_dedup import Tree, near
from quiltframe.llm.registry import QUERIES


def brute(rows, c):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, "f8")
        return v / np.linalg.norm(v)

    u = [unit(v) for _, v, _ in rows]
    n = len(rows)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and rows[i][2] is not None and rows[i][2] == rows[j][2] and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]):
                link[i][j] = u[i] @ u[j] >= c
    root = [r[0] for r in rows]
    while True:
        new = [min([root[i], *(root[j] for j in range(n) if link[i][j])]) for i in range(n)]
        if new == root:
            break
        root = new
    return sorted((rows[i][0], sum(link[i]), root[i], rows[i][0] == root[i]) for i in range(n))


@pytest.mark.parametrize("cell", [8, 4096])
def test_links(spark, cell):
    g = np.random.default_rng(0)
    rows = []
    for k in range(60):
        base = g.normal(size=6)
        for _ in range(int(g.integers(1, 6))):
            rows.append((len(rows), [float(x) for x in (base + g.normal(size=6) * 0.12).astype("f4")], int(k % 3)))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(30)]
    rows += [(1000, None, 0), (1001, [0.0] * 6, 0), (1002, [float("nan")] + [1.0] * 5, 0), (1003, [None] + [1.0] * 5, 0), (1004, rows[0][1], None), (1005, rows[0][1], 7), (1006, [float("inf")] + [1.0] * 5, 0), (1007, [], 0), (1008, rows[0][1][:5], 0), (1009, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(i, v, c, 1) for i, v, c in rows], "vec_id long, embedding array<float>, label int, id int").repartition(3)
    assert sorted(tuple(r) for r in near(df, 0.98, cell=cell).select("vec_id", "n_links", "component_id", "kept").collect()) == brute(rows, 0.98)
    assert near(df.limit(0)).count() == 0


def test_repeated_ids(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [1.0, 0.01], 1), (7, [1.0, 0.02], 1), (5, [1.0, 0.0], 1), (8, [1e200, 1e198], 1), (9, [0.0, 2.0], 2)]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in near(df).collect()), key=str)
    # a component is of vectors; its id is the least vec_id, which here both of two components have
    assert got == sorted([(5, 4, 5, True), (5, 4, 5, True), (5, 0, 5, True), (6, 4, 5, False), (7, 4, 5, False), (8, 4, 5, False), (9, 0, 9, True), (None, 0, None, True)], key=str)


def test_cells_hold_all_that_may_link():
    g = np.random.default_rng(3)
    x = g.normal(size=(3_000, 5))
    x = np.concatenate([x, x[:500] + g.normal(size=(500, 5)) * 0.05])
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, cell, native = Tree(x[:60]).cells(x, 0.2)
    assert np.bincount(i[native], minlength=len(x)).tolist() == [1] * len(x)
    held = set(zip(i.tolist(), cell.tolist()))
    home = dict(zip(i[native].tolist(), cell[native].tolist()))
    a, b = np.nonzero(np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.2)
    assert len(a) > 2 * len(x) and all((q, home[p]) in held for p, q in zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("edges", [0, 10**6])
def test_components(spark, monkeypatch, edges):
    monkeypatch.setattr(comp, "DRIVER_EDGES", edges)
    g = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in g.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)] + [(500, 500 + i) for i in range(30)]
    got = {r.node: r.root for r in comp.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert comp.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op9_vector_dedup"](spark, sf).collect()) == brute(rows, 0.98)
