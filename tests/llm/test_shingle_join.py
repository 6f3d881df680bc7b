import duckdb
import numpy as np
import pytest

from quiltframe.llm import op5_shingle_join as op
from quiltframe.llm.registry import QUERIES


def brute(docs):
    sets = {}
    for i, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({c: " " for c in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    ids = list(sets)
    link = {i: [j for j in ids if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])] for i in ids}
    root = {i: i for i in ids}
    for _ in ids:
        new = {i: min([root[i], *(root[j] for j in link[i])]) for i in ids}
        if new == root:
            break
        root = new
    return sorted((i, len(sets[i]), len(link[i]), root[i]) for i in ids)


def noisy(g, words, base, share):
    return [str(g.choice(words)) if g.random() < share else w for w in base]


def corpus(seed, sizes, n_words):
    g = np.random.default_rng(seed)
    words = [f"W{i}" for i in range(n_words)]
    docs = []
    for size in sizes:
        base = [str(x) for x in g.choice(words, size)]
        for share in (0, 0, 0.05, 0.1, 0.13, 0.16, 0.2, 0.3):
            docs.append((len(docs), " ".join(noisy(g, words, base, share))))
    return docs


@pytest.mark.parametrize("seed, sizes, n_words", [(1, [1, 2, 3, 4, 5, 6, 8, 10, 12, 20, 30, 40, 50, 60, 63, 64, 65, 66, 67, 80, 100], 3000), (2, [150, 200, 255, 256, 257, 258, 300, 400], 3000), (3, [1000, 1024, 1026, 1500], 20_000), (4, [2, 3, 4, 5, 6, 7] * 5, 6), (5, [40, 70] * 5, 15)])
def test_links(spark, seed, sizes, n_words):
    docs = corpus(seed, sizes, n_words)
    docs += [(10_000, None), (10_001, ""), (10_002, " \t\n"), (10_003, "É é x"), (10_004, "é É x"), (10_005, "\x1cA\x85b a"), (10_006, docs[-1][1].upper()), (10_007, "\x0b".join(docs[-1][1].split()))]
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in docs], "doc_id long, text string, cls string, n int").repartition(3)
    assert sorted(tuple(r) for r in op.similar(df).collect()) == brute(docs)


def test_growing_and_shrinking(spark):
    g = np.random.default_rng(9)
    docs = []
    for size in (5, 40, 60, 100, 160, 250, 420, 700, 1030):
        base = [f"x{g.integers(10**6)}" for _ in range(size)]
        docs += [(len(docs) + k, " ".join(base[: max(1, int(size * f))])) for k, f in enumerate((1, 0.99, 0.9, 0.8, 0.7, 0.62, 0.61, 0.6, 0.595, 0.58))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in op.similar(df).collect()) == brute(docs)
    assert op.similar(df.limit(0)).count() == 0


def test_every_linked_pair_is_a_candidate():
    """Without Spark: the pigeonhole against all pairs, with hot shingles and sets of few segments."""
    g = np.random.default_rng(4)
    join = op.Join(3, 5)
    for n in (1, 2, 3, 4, 6, 9, 15, 33, 64, 65, 120, 300):
        sets = []
        for _ in range(40):
            base = op.mix(g.integers(0, 2**62, n).astype("u8"))
            for f in (0, 0.1, 0.2, 0.24, 0.25, 0.3):
                k = int(n * f)
                sets.append(np.unique(np.concatenate([base[k:], op.mix(g.integers(0, 2**62, int(g.integers(0, k + 1))).astype("u8"))])))
        pool = np.concatenate(sets)
        hot = np.unique(g.choice(pool, len(pool) // 5))
        prices = [np.isin(s, hot) * 90 for s in sets]
        pk = op.Packer(3)
        sig, doc, place, bad = op.signatures(sets, join, prices)
        assert not bad
        pk.add(list(range(len(sets))), sets, sig, doc, place)
        found = set()
        for _, b in pk.blobs():
            x, y = op.candidates([op.unpack(b)], join)
            found |= set(zip(x.tolist(), y.tolist()))
        cls = [op.class_of(s) for s in sets]
        for i in range(len(sets)):
            for j in range(max(0, i - 6), i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if cls[i] != cls[j] and 5 * common >= 3 * (len(sets[i]) + len(sets[j]) - common):
                    assert (min(cls[i], cls[j]), max(cls[i], cls[j])) in found, (n, len(sets[i]), len(sets[j]), common)
                assert op.flips(op.long_sketch(sets[i]), op.long_sketch(sets[j])) <= len(sets[i]) + len(sets[j]) - 2 * common


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, n_shingles, n_similar, component_id from ({op.SQL})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["op5_shingle_join"](spark, sf).collect()) == want


def test_documents_without_id(spark):
    docs = [(2, "a b c"), (1, "a b c"), (None, "a b c"), (None, None)]
    got = sorted((tuple(r) for r in op.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1, 1), (2, 2, 1, 1), (None, None, 0, None), (None, None, 0, None)], key=str)


def test_sketches_are_gathered_by_words():
    """Folded sketches agree one by one, and take little memory beside the result."""
    import tracemalloc

    g = np.random.default_rng(4)
    sets = [np.unique(g.integers(0, 1 << 62, int(n)).astype(op.U)) for n in g.integers(1, 2_000, 300)]
    blobs = [op.long_sketch(s) for s in sets]
    offset = np.cumsum([0, *map(len, blobs)]) // 8
    flat, words = np.frombuffer(b"".join(blobs), op.U), np.diff(offset)
    for w in (4, 8):
        which = g.choice(np.flatnonzero(words >= w), 20_000)
        tracemalloc.start()
        got = op.folded(flat, offset, words, which, w)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        for k in range(0, len(which), 97):
            x = flat[offset[which[k]] : offset[which[k] + 1]]
            while len(x) > w:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            assert (x == got[k]).all()
        assert peak < 2 * 8 * int(words[which].sum()) + 3 * got.nbytes
