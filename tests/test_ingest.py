import numpy as np
import pytest
from pyspark.sql import types as T

from quiltframe import schema as S
from quiltframe.functions import batches as B
from quiltframe.operators import images
from quiltframe.plans import results as R
from quiltframe.sources import ingest as I
from quiltframe.sources.atlas import Atlas

OBS = T.StructType([T.StructField("uid", T.StringType()), T.StructField("dataset_uid", T.StringType()), S.pointer("gene_expression", "gene_expression"), S.pointer("image_features", "image_features"), S.pointer("chromatin_accessibility", "chromatin_accessibility"), S.pointer("discrete_image", "discrete_image"), T.StructField("tissue", T.StringType())])
GENES = T.StructType([T.StructField("gene_name", T.StringType())])
CHROMS = T.StructType([T.StructField("sequence_name", T.StringType())])
X = np.array([[5, 0, 9], [0, 3, 0], [0, 0, 0], [1, 0, 7]])


def var(spark, names, column="gene_name"):
    return spark.createDataFrame([(n, n.upper(), i) for i, n in enumerate(names)], f"uid string, {column} string, local_index long")


def obs(spark, prefix, n):
    return spark.createDataFrame([(f"{prefix}{i}", f"t{i % 2}", i, f"bc{i}") for i in range(n)], "uid string, tissue string, obs long, barcode string")


@pytest.fixture(scope="module")
def atlas(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("atlas") / "a")
    a = Atlas.create_or_open(spark, root, {"cells": OBS}, {"gene_expression": GENES, "image_features": GENES, "chromatin_accessibility": CHROMS})
    assert Atlas.create_or_open(spark, root, {"cells": OBS}, {}).store.root == root and Atlas.exists(spark, root) and not Atlas.exists(spark, root + "x")
    with pytest.raises(ValueError, match="another schema"):
        Atlas.create_or_open(spark, root, {"cells": T.StructType(OBS.fields[:-1])}, {})
    I.ingest_dataset(a, "d1", "gene_expression", "z1", I.MatrixReader(spark, {"counts": X}), var(spark, ["g0", "g1", "g2"]), obs(spark, "a", 4).drop("barcode"))
    csr = I.Csr(np.array([0, 1, 3]), np.array([1, 0, 1]), np.array([2.0, 4.0, 6.0]), (2, 2))
    parts = {
        "gene_expression": ("z2", I.MatrixReader(spark, {"counts": csr}), var(spark, ["g2", "g3"]), None),
        "image_features": ("i2", I.MatrixReader(spark, {"ctrl_standardized": np.array([[1.5, 2.5]])}), var(spark, ["c0", "c1"]), spark.createDataFrame([(0, 1)], "row long, obs long")),
    }
    I.ingest_multimodal(a, "d2", parts, obs(spark, "b", 2).drop("barcode"))
    frags = [("chr2", 20, 6, "bc0"), ("chr1", 10, 5, "bc0"), ("chr1", 30, 7, "bc1"), ("chr2", 40, 8, "bc2"), ("chr1", 50, 9, "bc2"), ("chrUn", 1, 2, "bc0")]
    a.register_features("chromatin_accessibility", var(spark, ["s1", "s2"], "sequence_name").selectExpr("uid", "concat('chr', substr(uid, 2)) as sequence_name"))
    f = spark.createDataFrame(frags, "chrom string, start long, length int, barcode string")
    I.ingest_fragments(a, "d3", "chromatin_accessibility", "f3", f, obs(spark, "c", 3))
    with pytest.raises(ValueError, match="without fragments"):
        I.ingest_fragments(a, "d4", "chromatin_accessibility", "f4", f, obs(spark, "e", 4))
    image = np.arange(30 * 20, dtype="u2").reshape(30, 20)
    a.add_values("discrete_image", images.chunks(spark, "p5", "raw", image, (8, 8)))
    i = I.Ingestor(a, "d5", 2)
    a.register_dataset("d5", "p5", "discrete_image", None)
    i.pointers["discrete_image"] = spark.createDataFrame([(0, ("p5", [2, 3], [6, 9])), (1, ("p5", [20, 1], [29, 4]))], T.StructType([T.StructField("obs", T.LongType()), T.StructField("discrete_image", S.SPATIAL)]))
    i.write_obs_records(obs(spark, "p", 2).drop("barcode"))
    a.optimize()
    assert a.snapshot() == 0
    return a


def test_results(spark, atlas):
    q = atlas.checkout().query()
    g = q.feature_spaces("gene_expression")
    got = R.to_anndata(g)
    want = {"a0": {"g0": 5, "g2": 9}, "a1": {"g1": 3}, "a2": {}, "a3": {"g0": 1, "g2": 7}, "b0": {"g3": 2}, "b1": {"g2": 4, "g3": 6}}
    names = list(got.var["uid"])
    assert names == ["g0", "g1", "g2", "g3"]
    dense = got.batch.dense("counts")
    assert {u: {n: v for n, v in zip(names, r) if v} for u, r in zip(got.obs["uid"], dense)} == want
    some = list(R.to_batches(g, 4))
    assert [len(b.batch) for b in some] == [4, 2] and np.array_equal(np.concatenate([b.batch.dense() for b in some]), dense)
    assert set(R.to_mudata(q.select_fields("gene_expression", "image_features"))) == {"gene_expression", "image_features"}
    with pytest.warns(UserWarning, match="no matrix"):
        assert set(R.to_mudata(q)) == {"gene_expression", "image_features"}
    image = R.to_anndata(q, "image_features")
    assert image.obs["uid"].tolist() == ["b1"] and image.x.tolist() == [[1.5, 2.5]]
    m = R.to_multimodal(q, (8, 8))
    assert len(m.obs) == 11 and m.present["image_features"].sum() == 1 and set(m.parts) == set(OBS.fieldNames()[2:6])
    assert R.to_arrow(q).num_rows == 11


def test_fragments(spark, atlas):
    q = atlas.checkout().query()
    f = R.to_fragments(q)
    assert f.obs["uid"].tolist() == ["c0", "c1", "c2"] and f.chromosomes == ["chr1", "chr2"] and f.offsets.tolist() == [0, 2, 3, 5]
    assert list(zip(f.chromosome.tolist(), f.start.tolist(), f.length.tolist())) == [(0, 10, 5), (1, 20, 6), (0, 30, 7), (0, 50, 9), (1, 40, 8)]
    assert f.end_max(2).tolist() == [26, 59, 48]
    assert sorted(tuple(r) for r in q.fragments().collect())[0] == ("c0", "chr1", 10, 5)
    for region, n in ((("chr1", 12, 31), 2), (("chr1", 15, 30), 0), (("chr2", 0, 100), 2), (("chr9", 0, 100), 0)):
        assert q.fragments(region=region).count() == n
    before = atlas.store.version("genome.chromatin_accessibility")
    assert before < 0 and I.add_genome_sorted(atlas) == ["f3"] and I.add_genome_sorted(atlas) == []
    atlas.snapshot()
    q = atlas.checkout().query()
    assert "genome.chromatin" in str(q.fragments(region=("chr1", 12, 31)).inputFiles()) and q.fragments(region=("chr1", 12, 31)).count() == 2


def test_copy_by_feature(spark, atlas):
    before = atlas.checkout().query().features(["g2"], "gene_expression")
    want = sorted(tuple(r) for r in before.matrix().x.collect())
    assert I.add_csc(atlas, "gene_expression", ["z1"]) == ["z1"]
    atlas.snapshot()
    q = atlas.checkout().query().features(["g2"], "gene_expression")
    assert "copy." not in str(q.matrix().x.inputFiles())  # not every group has one
    assert I.add_csc(atlas, "gene_expression") == ["z2"]
    atlas.snapshot()
    q = atlas.checkout().query().features(["g2"], "gene_expression")
    assert "copy.gene_expression" in str(q.matrix().x.inputFiles()) and sorted(tuple(r) for r in q.matrix().x.collect()) == want
    assert sorted(tuple(r) for r in want) == [("a0", 0, 9.0), ("a3", 0, 7.0), ("b1", 0, 4.0)]
    every = atlas.checkout().query().features([f"g{i}" for i in range(4)], "gene_expression").where("uid = 'a0'")
    assert "copy." not in str(every.matrix().x.inputFiles())  # more features than rows


def test_crops(spark, atlas):
    got = R.to_spatial_batch(atlas.checkout().query(), "discrete_image", (8, 8))
    image = np.arange(30 * 20, dtype="u2").reshape(30, 20)
    assert np.array_equal(got.layers["raw"][0], image[2:6, 3:9]) and np.array_equal(got.layers["raw"][1], image[20:29, 1:4])
    assert got[1:2].layers["raw"][0].shape == (9, 3)


def test_training(spark, atlas):
    q = atlas.checkout().query()
    d = R.UnimodalDataset(q.feature_spaces("gene_expression"), "gene_expression", ["tissue"], size=4, seed=3)
    assert len(d) == 6 and d.n_features == 4
    b = d.take([5, 0, 0, 2])
    assert b.metadata["uid"].tolist() == ["b1", "a0", "a0", "a2"] and b.dense().tolist() == [[0, 0, 4, 6], [5, 0, 9, 0], [5, 0, 9, 0], [0, 0, 0, 0]]
    with pytest.raises(IndexError):
        d.take([6])
    one, two = list(d.epoch(0)), list(d.epoch(1))
    assert [len(x) for x in one] == [4, 2] and [x.metadata["uid"].tolist() for x in one] == [x.metadata["uid"].tolist() for x in d.epoch(0)]
    assert sorted(sum((x.metadata["uid"].tolist() for x in one), [])) == sorted(sum((x.metadata["uid"].tolist() for x in two), [])) == ["a0", "a1", "a2", "a3", "b0", "b1"]
    d.drop_last = True
    assert [len(x) for x in R.make_loader(d, 2)] == [4, 4]
    m = R.MultimodalDataset(q.by_dataset(spark.createDataFrame([("d2",)], "dataset_uid string")), ["gene_expression", "image_features"], size=2)
    x = m.take([1, 0])
    assert x.metadata["uid"].tolist() == ["b1", "b0"] and x.present["image_features"].tolist() == [True, False]
    assert x.parts["image_features"].layers["ctrl_standardized"].tolist() == [[1.5, 2.5]] and len(x.parts["gene_expression"]) == 2
    assert x[1:2].parts["image_features"].layers["ctrl_standardized"].shape[0] == 0
    with pytest.warns(UserWarning, match="workers"):
        assert sum(len(x) for x in R.make_loader(m, workers=2)) == 2


def test_refusals(spark, atlas):
    i = I.Ingestor(atlas, "d9", 2)
    rows = I.MatrixReader(spark, {"counts": X}).rows()
    feats = spark.createDataFrame([("g0", 0)], "feature_uid string, local_index long")
    for bad in (
        lambda: i.write_array("nope", "z", rows, 2, feats),
        lambda: i.write_array("gene_expression", "z9", rows, 4, feats),
        lambda: i.write_array("gene_expression", "z9", rows, 4, None, spark.createDataFrame([(r, r) for r in range(4)], "row long, obs long")),
        lambda: i.write_array("gene_expression", "z1", rows, 2, feats),
        lambda: I.convert("gene_expression", I.MatrixReader(spark, {"tpm": X}).rows(), 4),
        lambda: I.convert("gene_expression", I.MatrixReader(spark, {"counts": X, "tpm": X.T @ X if False else np.eye(4, 3)}).rows(), 4),
        lambda: I.convert("gene_expression", rows, 2),
        lambda: I.convert("image_features", I.MatrixReader(spark, {"ctrl_standardized": X}).dense_rows(), 5),
        lambda: I.check_var(atlas, "gene_expression", var(spark, ["g0", "g0"])),
        lambda: I.check_var(atlas, "gene_expression", var(spark, ["g0"], "other")),
        lambda: I.MatrixReader(spark, {"a": X, "b": X[:2]}),
        lambda: i.write_obs_records(obs(spark, "y", 3)),
        lambda: atlas.add_obs(spark.createDataFrame([("a0", "d1", None, None, None, None, None)], OBS)),
    ):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError, match="h5py"):
        I.h5ad(spark, "x")
    assert I.records_per_file(1024) == 40_960
    s = I.synthetic_sparse(spark, 50, 20, 0.25).collect()
    assert len(s) > 150 and min(r.value for r in s) >= 1 and len({(r.row, r.local_index) for r in s}) == len(s)
    assert I.synthetic_dense(spark, 3, 4, "raw").count() == 3


def test_catalogue(spark, atlas):
    assert [r.zarr_group for r in atlas.list_datasets().collect()] == ["z1", "i2", "z2", "f3", "p5"]
    assert atlas.find_datasets("gene_expression", dataset="d2").count() == 1 and atlas.find_datasets(group="none").count() == 0
    assert [r.feature_uid for r in atlas.layout("z2", "gene_expression").collect()] == ["g2", "g3"]
    assert {r.zarr_group for r in atlas.find_datasets_with_features(["g2", "g3"]).collect()} == {"z1", "z2"}
    assert {"obs.cells", "datasets", "layouts"} <= set(atlas.schemas())
    with pytest.raises(KeyError):
        atlas.table("datasets")


def test_batches():
    s = B.SparseBatch(np.array([0, 1, 2, 4, 3, 1]), np.array([0, 3, 6]), {"c": np.arange(1, 7)}, 5)
    r = B.remapped(s, np.array([10, -1, 11, 12, -1]), 13)
    assert (r.indices.tolist(), r.layers["c"].tolist(), np.diff(r.offsets).tolist()) == ([10, 11, 12], [1, 3, 5], [2, 1])
    g0 = B.SparseBatch(np.array([0, 1]), np.array([0, 2]), {"c": np.array([10, 20])}, 2)
    g1 = B.SparseBatch(np.array([0, 1]), np.array([0, 1, 2]), {"c": np.array([30, 40])}, 2)
    c = B.concat([g0, g1], [np.array([2, 0]), np.array([2, 1])], 4)
    assert (c.indices.tolist(), c.offsets.tolist(), c.layers["c"].tolist()) == ([2, 0, 2, 1], [0, 2, 3, 4], [10, 20, 30, 40])
    d = B.concat([B.DenseBatch({"x": np.array([[1, 2], [3, 4]])}, 2), B.DenseBatch({"x": np.array([[5, 6]])}, 2)], [np.array([2, 0]), np.array([1, 3])], 4)
    assert d.layers["x"].tolist() == [[2, 0, 1, 0], [4, 0, 3, 0], [0, 5, 0, 6]]
    assert B.scattered(B.DenseBatch({"x": np.array([[1, 9]])}, 2), np.array([0, -1]), 2).layers["x"].tolist() == [[1, 0]]
    sets = B.concat([B.SetBatch(g0, np.array([0, 1])), B.SetBatch(g1, np.array([0, 0, 2]))], [np.array([2, 0]), np.array([2, -1])], 3)
    assert (sets.rows.indices.tolist(), sets.rows.offsets.tolist(), sets.set_offsets.tolist()) == ([2, 0, 2], [0, 2, 3, 3], [0, 1, 1, 3])
    assert len(sets[1:3].rows) == 2 and sets.take(np.array([2, 0])).set_offsets.tolist() == [0, 2, 3]
    assert B.reordered(c, ["x", "y", "z"], ["z", "x"]).dense().tolist() == [[0, 40, 0, 0], [20, 0, 10, 0]]
    assert c[1:].offsets.tolist() == [0, 1, 2]
    for bad in (lambda: B.concat([]), lambda: c[::2], lambda: B.reordered(c, ["x", "y", "z"], ["q"]), lambda: B.concat([c, d])):
        with pytest.raises((ValueError, KeyError, TypeError)):
            bad()
    assert B.least_dtype(["i4", "f4"]) == np.dtype("f8")
    crops = B.concat([B.SpatialBatch({"r": [np.zeros((2, 3))]}), B.SpatialBatch({"r": [np.ones((1, 1))]})])
    assert [x.shape for x in crops.take(np.array([1, 0])).layers["r"]] == [(1, 1), (2, 3)]
