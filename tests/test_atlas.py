import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe import schema as S
from quiltframe.sources import readers
from quiltframe.sources.atlas import Atlas
from quiltframe.sources.store import Conflict, Store
from quiltframe.streaming import ingest

OBS = T.StructType([T.StructField("uid", T.StringType()), T.StructField("dataset_uid", T.StringType()), S.pointer("gene_expression", "gene_expression"), S.pointer("image_features", "image_features"), T.StructField("tissue", T.StringType()), T.StructField("parts", T.ArrayType(T.StringType()))])
REG = T.StructType([T.StructField("gene_name", T.StringType())])


@pytest.fixture()
def atlas(spark, tmp_path):
    a = Atlas.create(spark, f"{tmp_path}/atlas", {"cells": OBS}, {"gene_expression": REG, "image_features": REG})
    genes = spark.createDataFrame([(f"g{i}", f"gene {i}") for i in range(5)], "uid string, gene_name string")
    assert a.register_features("gene_expression", genes) == 5
    assert a.register_features("gene_expression", genes.union(spark.createDataFrame([("g0", "other")], genes.schema))) == 0
    a.register_features("image_features", spark.createDataFrame([("c0", "x"), ("c1", "y")], genes.schema))
    lay = lambda *u: spark.createDataFrame([(x, i) for i, x in enumerate(u)], "feature_uid string, local_index int")
    one = a.register_dataset("d1", "z1", "gene_expression", lay("g0", "g1", "g2"))
    assert a.register_dataset("d2", "z2", "gene_expression", lay("g2", "g4")) != one
    assert a.register_dataset("d3", "z3", "gene_expression", lay("g0", "g1", "g2")) == one
    a.register_dataset("d1", "i1", "image_features", lay("c1"))
    with pytest.raises(KeyError, match="zz"):
        a.register_dataset("d4", "z4", "gene_expression", lay("zz"))
    obs = [("a", "d1", ("z1", 0, 2, 0), ("i1", 0), "liver", ["p"]), ("b", "d1", ("z1", 2, 3, 1), None, "lung", ["q"]), ("c", "d2", ("z2", 0, 2, 0), None, "liver", ["p", "q"]), ("d", "d2", None, None, None, None)]
    a.add_obs(spark.createDataFrame(obs, OBS))
    with pytest.raises(ValueError, match="unique"):
        a.add_obs(spark.createDataFrame([obs[0], obs[0]], OBS))
    a.add_values("gene_expression", spark.createDataFrame([("z1", 0, 0, "counts", 1.0), ("z1", 0, 2, "counts", 2.0), ("z1", 1, 1, "counts", 3.0), ("z2", 0, 0, "counts", 4.0), ("z2", 0, 1, "counts", 5.0), ("z2", 0, 1, "counts", 1.0), ("z1", 0, 0, "tpm", 9.0)], "zarr_group string, zarr_row long, local_index long, layer string, value double"))
    a.add_values("image_features", spark.createDataFrame([("i1", 0, "ctrl_standardized", [7.0])], "zarr_group string, position long, layer string, values array<double>"))
    a.optimize()
    return a


def entries(m):
    return sorted(tuple(r) for r in m.x.collect())


def test_queries(spark, atlas):
    with pytest.raises(RuntimeError):
        atlas.query()
    assert atlas.validate() == [] and atlas.snapshot() == 0
    q = atlas.checkout().query()
    assert q.count() == 4 and q.where("tissue = 'liver'").where("tissue = 'lung'").count() == 1
    assert [tuple(r) for r in q.count(["tissue"]).collect()] == [(None, 1), ("liver", 2), ("lung", 1)]
    g = q.feature_spaces("gene_expression")
    assert entries(g.matrix()) == [("a", 0, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), ("c", 2, 4.0), ("c", 3, 6.0)]
    assert [r.uid for r in g.matrix().var.collect()] == ["g0", "g1", "g2", "g4"]
    assert entries(g.feature_join("intersection").matrix()) == [("a", 0, 2.0), ("c", 0, 4.0)]
    # the column space follows from the rows that are left
    assert [r.uid for r in g.where("dataset_uid = 'd2'").matrix().var.collect()] == ["g2", "g4"]
    f = q.features(["g4", "g0", "g4"], "gene_expression")
    assert entries(f.matrix()) == [("a", 0, 1.0), ("c", 1, 6.0)]
    assert entries(f.feature_join("intersection").matrix()) == [("a", 0, 1.0), ("c", 1, 6.0)]
    with pytest.raises(KeyError):
        q.features(["nope"], "gene_expression").matrix()
    assert entries(g.layers("gene_expression", ["tpm"]).matrix()) == [("a", 0, 9.0)]
    with pytest.raises(KeyError):
        g.layers("gene_expression", ["nope"])
    with pytest.raises(ValueError):
        q.matrix()
    assert entries(q.select_fields("image_features").matrix()) == [("a", 0, 7.0)]
    obs, parts = q.multimodal()
    assert sorted((r.uid, r.has_gene_expression, r.has_image_features) for r in obs.collect()) == [("a", True, True), ("b", True, False), ("c", True, False), ("d", False, False)]
    assert set(parts) == set(q.modalities()) == {"gene_expression", "image_features"}
    assert q.limit(3).offset(1).obs().columns == ["uid", "dataset_uid", "tissue", "parts"] and q.limit(2).count() == 2
    assert [r.uid for r in q.balanced_limit(3, "tissue").obs().collect()].__len__() == 2
    with pytest.raises(ValueError):
        q.limit(1).balanced_limit(3, "tissue")
    s = lambda *u: spark.createDataFrame([(x,) for x in u], "uid string")
    assert {r.uid for r in q.by_members("parts", s("p")).obs().collect()} == {"a", "c"}
    assert {r.uid for r in q.by_members("parts", s("p"), s("q")).where("true").obs().collect()} == {"c"}
    assert q.by_members("parts", s("none")).where("uid is not null").count() == 0
    assert q.by_dataset(spark.createDataFrame([("d2",)], "dataset_uid string")).count() == 2
    assert q.by_dataset(spark.createDataFrame([], "dataset_uid string")).count() == 0
    assert [r.uid for r in q.search("liver", "tissue").obs().collect()] == ["a", "c"]
    assert sorted((r.batch, r.position) for r in q.batches(3).collect()) == [(0, 0), (0, 1), (0, 2), (1, 0)]
    for bad in (lambda: q.select("uid"), lambda: q.feature_join("left"), lambda: q.feature_spaces("nope"), lambda: q.select_fields("nope")):
        with pytest.raises((TypeError, ValueError)):
            bad()


def test_versions(spark, atlas):
    assert atlas.snapshot() == 0
    other = Atlas.open(spark, atlas.store.root)
    other.add_obs(spark.createDataFrame([("e", "d2", None, None, None, None)], OBS))
    with pytest.raises(RuntimeError, match="stale"):
        atlas.snapshot()
    atlas.refresh()
    assert atlas.snapshot() == 1
    assert [r.total_rows for r in atlas.list_versions().collect()] == [4, 5]
    assert atlas.checkout(0).query().count() == 4 and atlas.checkout().query().count() == 5
    atlas.restore(0)
    assert atlas.obs().count() == 4 and atlas.checkout(1).query().count() == 5
    with pytest.raises(ValueError, match="no snapshot 7"):
        atlas.checkout(7)
    with pytest.raises(FileNotFoundError):
        Atlas.open(spark, f"{atlas.store.root}/nothing")
    with pytest.raises(ValueError, match="already"):
        Atlas.create(spark, atlas.store.root, {"cells": OBS}, {})


def test_faults(spark, atlas):
    atlas.add_obs(spark.createDataFrame([("x", "d9", ("lost", 0, 1, 0), None, None, None)], OBS))
    atlas.refresh()
    assert any("of no dataset" in f for f in atlas.validate())
    with pytest.raises(ValueError, match="of no dataset"):
        atlas.snapshot()
    with pytest.raises(KeyError):
        atlas.obs_name("nope")


def test_store(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.create("t", T.StructType([T.StructField("uid", T.StringType())]))
    rows = lambda *u: spark.createDataFrame([(x,) for x in u], "uid string")
    assert s.read("t").count() == 0 and s.append("t", rows("a")) == 1
    s.rewrite("t", rows("b", "c"), 1)
    with pytest.raises(Conflict):
        s.rewrite("t", rows("z"), 1)
    assert s.restore("t", 1) == 3 and [r.uid for r in s.read("t").collect()] == ["a"] and s.read("t", 2).count() == 2
    with pytest.raises(KeyError):
        s.read("t", 99)


def test_stream(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.create("t", T.StructType([T.StructField("uid", T.StringType())]))
    src = f"{tmp_path}/in"
    for k, rows in enumerate([("a", "b"), ("b", "c")]):
        spark.createDataFrame([(x,) for x in rows], "uid string").coalesce(1).write.mode("append").parquet(src)
        ingest.append(spark.readStream.schema("uid string").parquet(src), s, "t", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.uid for r in s.read("t").collect()) == ["a", "b", "c"]


def test_schema():
    assert S.pointers(OBS) == {"gene_expression": "gene_expression", "image_features": "image_features"}
    bare = T.StructType([T.StructField("gene_expression", S.SPARSE)])
    assert S.pointers(bare) == {"gene_expression": "gene_expression"}
    with pytest.raises(ValueError, match="has a dense pointer"):
        S.pointers(T.StructType([T.StructField("gene_expression", S.DENSE)]))
    for bad in (T.StructType([]), T.StructType([T.StructField("uid", T.StringType()), T.StructField("dataset_uid", T.StringType())])):
        with pytest.raises(ValueError):
            S.check_obs(bad)
    with pytest.raises(ValueError, match="registered"):
        S.register_space(S.SPACES["image_tiles"])
    assert S.SPACES["image_tiles"].endpoints == ("spatial",)
    assert S.least_type(["float", "smallint"]) == "float" and S.least_type(["float", "bigint"]) == "double"
    with pytest.raises(ValueError):
        S.FeatureSpace("x", "nope", {}, ())


def test_readers(spark, tmp_path):
    (tmp_path / "f.bed").write_text("#c\nchr1\t10\t15\tb0\t1\nchr2\t20\t26\tb1\t2\n")
    assert [(r.chrom, r.length) for r in readers.bed(spark, f"{tmp_path}/f.bed", ["chr2"]).collect()] == [("chr2", 6)]
    (tmp_path / "m.csv").write_text("".join(f"{r},{c},{v}\n" for r, c, v in [(0, 2, 9), (0, 0, 5), (1, 1, 3), (5, 3, 2)]))
    got = {r.row: [(e["column"], e.value) for e in r.entries] for r in readers.triplets(spark, f"{tmp_path}/m.csv", 6, 4).collect()}
    assert got == {0: [(0, 5.0), (2, 9.0)], 1: [(1, 3.0)], 2: [], 3: [], 4: [], 5: [(3, 2.0)]}
    with pytest.raises(ValueError, match="range"):
        readers.triplets(spark, f"{tmp_path}/m.csv", 6, 3)
    (tmp_path / "t.csv").write_text("#x\na,b\n1,2\n")
    assert [tuple(r) for r in readers.delimited(spark, f"{tmp_path}/t.csv").collect()] == [("1", "2")]
    c = readers.Collection("n").add("d", "obs", "p").add("d", "obs", "p")
    assert c.only("d", "obs") == "p" and readers.Collection.loads(c.dumps()) == c
    with pytest.raises(ValueError, match="unknown"):
        readers.Collection.loads(json.dumps({"name": "n", "x": 1}))
    with pytest.raises(ValueError, match="0 files"):
        c.only("d", "var")
