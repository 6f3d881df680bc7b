import random

import pytest
from pyspark.sql import functions as F

from quiltframe.operators import curation as C
from quiltframe.operators import intervals as I
from quiltframe.operators import keys as K
from quiltframe.operators import layouts as L
from quiltframe.operators import ragged, resolution, search


def test_remap_golden():
    assert ragged.remap([0, 1, 2, 4, 3, 1], [1, 2, 3, 4, 5, 6], [3, 3], [10, -1, 11, 12, -1]) == ([10, 11, 12], [1, 3, 5], [2, 1])


def test_rows_and_diagonal(spark):
    e = spark.createDataFrame([("a", 2, 1.0), ("a", 0, 3.0), ("b", 1, 5.0)], "uid string, column int, value double")
    assert {r.uid: (r.indices, r.values) for r in ragged.rows_as_arrays(e).collect()} == {"a": ([0, 2], [3.0, 1.0]), "b": ([1], [5.0])}
    d = ragged.diagonal([spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("q", 2)], "x string, y int")])
    assert sorted(tuple(r) for r in d.collect()) == [("1", None), ("q", 2)]
    with pytest.raises(ValueError):
        ragged.diagonal([])
    assert ragged.use_feature_copy(10, 3, True) and not ragged.use_feature_copy(3, 10, True) and not ragged.use_feature_copy(9, None, True)


def test_overlaps_against_all_pairs(spark):
    g = random.Random(1)
    mk = lambda n: [(g.choice("xy"), s := g.randrange(200), s + g.choice([0, 1, 3, 50, 120]), i) for i in range(n)]
    a, b = mk(120), mk(80)
    da, db = (spark.createDataFrame(x, "chrom string, start long, end long, id long") for x in (a, b))
    want = sorted((p[3], q[3]) for p in a for q in b if p[0] == q[0] and p[1] < p[2] and q[1] < q[2] and p[1] < q[2] and p[2] > q[1])
    for width in (1, 7, 1000):
        assert sorted((r.id, r.p_id) for r in I.overlaps(da, db, width).select("id", "p_id").collect()) == want


def test_nested_peaks_count_once(spark):
    f = spark.createDataFrame([("c", 50, 10, "b")], "chrom string, start long, length int, barcode string")
    p = spark.createDataFrame([("c", 0, 100), ("c", 10, 20)], "chrom string, start long, end long")
    assert [tuple(r) for r in I.peak_counts(f, p).collect()] == [("b", "c:0-100", 1)]
    assert I.touching(spark.createDataFrame([("c", 5, 9)], "target_chromosome string, target_start long, target_end long"), "c", 9, 20).count() == 1


def test_fragment_lengths(spark):
    ok = spark.createDataFrame([("c", 1, 5, "b")], "chrom string, start long, end long, barcode string")
    assert I.fragments(ok).first().length == 4
    with pytest.raises(Exception, match="length 65536"):
        I.fragments(spark.createDataFrame([("c", 0, 65_536, "b")], ok.schema)).collect()
    names = spark.createDataFrame([(c,) for c in ("chrM", "chr10", "chr2", "chrX", "scaf")], "c string")
    assert [r.c for r in names.orderBy(*I.chromosome_order(F.col("c"))).collect()] == ["chr2", "chr10", "chrX", "chrM", "scaf"]


def test_layout_faults(spark):
    reg = spark.createDataFrame([("a", 0), ("b", None), ("c", 5)], "uid string, global_index long")
    lay = spark.createDataFrame([("a", 0), ("a", 0), ("z", None)], "feature_uid string, global_index long")
    assert len(L.problems(lay, reg, 2)) == 4
    assert [(r.uid, r.global_index) for r in L.reindex(reg).orderBy("uid").collect()] == [("a", 0), ("b", 6), ("c", 5)]
    with pytest.raises(KeyError, match="b"):
        L.resolve(reg, ["a", "b"])
    with pytest.raises(ValueError):
        L.feature_metadata(lay, reg, "feature_uid", ["global_index"])
    assert [r.n for r in L.ranked(spark.range(500).withColumn("k", F.hash("id")), "k", "n").orderBy("k").collect()] == list(range(500))


def test_curation(spark):
    df = spark.createDataFrame([("aaa", "BRCA2", "a; b", None), ("bbb", None, None, 2), ("ccc", "TP53", " ;", 3)], "uid string, gene string, parts string, n int")
    audit = C.Audit()
    t = C.Transaction("obs", [C.ReplaceValue("gene", None, "none"), C.AddColumn("flag", "yes"), C.RenameColumn("n", "m"), C.CastColumn("m", "string"), C.SetColumn("flag", "upper(gene)", True), C.DropColumn("uid")])
    out, status = C.apply(df, t, audit, version=3)
    assert status == "applied" and out.columns == ["gene", "parts", "flag", "m"]
    assert sorted((r.gene, r.flag, r.m) for r in out.collect()) == [("BRCA2", "BRCA2", None), ("TP53", "TP53", "3"), ("none", "NONE", "2")]
    assert audit.list()[0]["status"] == "applied" and audit.version_before(t.uid) == 3 and len(audit.get(t.uid)) == 6
    with pytest.raises(ValueError, match="there already"):
        C.apply(df, C.Transaction("obs", [C.AddColumn("gene")]))
    assert C.apply(df, C.Transaction("obs", [C.DropColumn("n")]), dry_run=True)[1] == "validated"
    out, status = C.apply(df, C.Transaction("obs", [C.SetColumn("gene", "x"), C.SetColumn("gene", "no_such(1)", True)]), audit)
    assert status == "partial" and {r.gene for r in out.collect()} == {"x"}
    with pytest.raises(ValueError, match="may not"):
        C.apply(df, C.Transaction("obs", [C.SetColumn("gene", "x")]), allowed={"n"})
    got = C.ExplodeColumn("parts", ";", "pos").apply(df).select("uid", "parts", "pos").collect()
    assert sorted(((r.uid, r.parts, r.pos) for r in got), key=str) == [("aaa", "a", 0), ("aaa", "b", 1), ("bbb", None, 0), ("ccc", None, None)]
    with pytest.raises(ValueError, match="not unique"):
        C.MergeColumns("uid", ("gene",), df.union(df)).check(dict(df.dtypes))


def test_resolution(spark):
    terms = spark.createDataFrame([("CL:2", "T cell", "T lymphocyte | Tcell", False), ("CL:1", "t CELL", None, False), ("CL:0", "T cell", None, True), ("UB:1", "liver", "hepar", None)], "term_id string, name string, synonyms string, obsolete boolean")
    values = spark.createDataFrame([("t cell",), ("Hepar",), ("tcell",), ("??",), (None,), ("ctrl",)], "value string")
    got = {r.value: (r.resolved, r.confidence) for r in resolution.resolve_terms(values, terms).collect()}
    assert got == {"t cell": ("CL:1", 1.0), "Hepar": ("UB:1", 0.9), "tcell": ("CL:2", 0.9), "??": (None, 0.0), "ctrl": (None, 0.0)}
    cache = spark.createDataFrame([("??", "cached", 0.5, "cache")], "value string, resolved string, confidence double, source string")
    every, new = resolution.resolve(values, [lambda v: resolution.resolve_terms(v, terms)], controls=True, cache=cache)
    assert {r.value: r.resolved for r in every.collect()} == {"t cell": "CL:1", "Hepar": "UB:1", "tcell": "CL:2", "??": "cached", "ctrl": "control"}
    assert {r.value for r in new.collect()} == {"t cell", "Hepar", "tcell"}
    assert tuple(resolution.report(every).first()) == (5, 5, 0, 0)
    cyc = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    start = spark.createDataFrame([("a",)], "start string")
    assert sorted((r.node, r.depth) for r in resolution.reachable(cyc, start).collect()) == [("b", 1), ("c", 2)]
    assert [r.node for r in resolution.reachable(cyc, start, max_depth=1).collect()] == ["b"]
    pre = spark.createDataFrame([("ENS", "x"), ("ENSMUS", "mouse")], "prefix string, organism string")
    assert {r.id: r.organism for r in resolution.organism(spark.createDataFrame([("ENSMUSG1",), ("ENSG1",), ("q",)], "id string"), pre).collect()} == {"ENSMUSG1": "mouse", "ENSG1": "x", "q": "unknown"}


def test_keys(spark):
    target = spark.createDataFrame([("k1", "u1"), ("k2", "u2")], "k string, uid string")
    df = spark.createDataFrame([(1, "k1"), (2, None)], "row int, k string")
    assert sorted((r.row, r.u) for r in K.fill(df, "k", "u", target, "k").collect()) == [(1, "u1"), (2, None)]
    with pytest.raises(Exception, match="no row has the key zz"):
        K.fill(spark.createDataFrame([(1, "zz")], df.schema), "k", "u", target, "k").collect()
    with pytest.raises(Exception, match="two rows have the key"):
        K.key_map(target.union(spark.createDataFrame([("k1", "u9")], target.schema)), "k").collect()
    with pytest.raises(Exception, match="differs"):
        K.full_outer([df, spark.createDataFrame([(1, "other")], df.schema)], "row").collect()
    assert K.order({"a": {"b"}, "b": {"c"}, "c": set(), "0": {"a"}}) == ["c", "b", "a", "0"]
    with pytest.raises(ValueError, match="depend"):
        K.order({"a": {"b"}, "b": {"a"}})
    one = spark.createDataFrame([("AC-1",), ("GT-1",)], "b string")
    two = spark.createDataFrame([("x#AC-2",), ("x#GT-9",)], "b string")
    assert K.barcodes([one, two], "b") == ("strip_both", [2])
    l = spark.createDataFrame([([1], [1, 2], None), ([1], [2], "x")], "a array<int>, b array<int>, c string")
    assert len(K.check_rows(l, require_any=[["c"]], equal_length=[["a", "b"]])) == 2


def test_search(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], "red fox"), (2, [1.0, 0.0], "red red dog"), (3, None, "blue"), (4, [0.0, 2.0], "fox fox")], "id int, v array<float>, t string")
    assert [r.id for r in search.vector_top(df, "v", [0.0, 1.0], 2, "id").collect()] == [1, 4]
    assert [r.id for r in search.vector_top(df, "v", [0.0, 1.0], 3, "id", "cosine").collect()] == [1, 4, 2]
    assert [r.id for r in search.text_top(df, "t", ["fox"], 5, "id").collect()] == [4, 1]
    assert [r.id for r in search.text_match(df, "t", ["red", "dog"]).collect()] == [2]
    assert {r.id for r in search.text_match(df, "t", ["dog", "blue"], every=False).collect()} == {2, 3}
    h = search.hybrid_top(search.vector_top(df, "v", [0.0, 1.0], 3, "id"), search.text_top(df, "t", ["fox"], 3, "id"), "id", 2)
    assert [r.id for r in h.collect()] == [1, 4]
