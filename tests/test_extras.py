import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quiltframe import schema_ir
from quiltframe.functions.packing import TRANSFORMS, pack, unpack
from quiltframe.operators import images
from quiltframe.plans import perturbation, training


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(TRANSFORMS), st.sampled_from([np.uint32, np.uint64]))
def test_packing(values, transform, kind):
    x = np.array(values, kind)
    got = unpack(pack(x, transform))
    assert got.dtype == kind and (got == x).all()


def test_packing_is_small():
    x = np.arange(10_000, dtype=np.uint64) * 3 + 2**40
    assert len(pack(x, "delta")) < 4_000 and (unpack(pack(x, "delta_zigzag")) == x).all()
    with pytest.raises(ValueError):
        pack(x.astype("i8"))


def test_crops(spark):
    g = np.random.default_rng(0)
    one, two = g.integers(0, 1000, (20, 17, 3)).astype("u2"), g.integers(0, 1000, (9, 9, 3)).astype("u2")
    stored = images.chunks(spark, "a", "raw", one, (8, 8, 3)).union(images.chunks(spark, "b", "raw", two, (8, 8, 3)))
    boxes = [(0, "a", [0, 0], [4, 4]), (1, "a", [5, 6], [20, 17]), (2, "b", [7, 0], [9, 9]), (3, "a", [3, 3], [3, 5]), (4, "a", [18, 15], [22, 18])]
    got = {r.box: images.array_of(r) for r in images.crops(spark.createDataFrame(boxes, "box long, zarr_group string, min_corner array<bigint>, max_corner array<bigint>"), stored, (8, 8, 3)).collect()}
    assert got.keys() == {0, 1, 2, 4}
    assert (got[0] == one[:4, :4]).all() and (got[1] == one[5:20, 6:17]).all() and (got[2] == two[7:9]).all()
    assert got[4].shape == (4, 3, 3) and (got[4][:2, :2] == one[18:, 15:]).all() and not got[4][2:].any()


def test_schema_ir():
    ir = {"enums": {"e": ["a"]}, "tables": {"cells": {"fields": {"uid": {"kind": "string", "nullable": False, "stable_uid": True}, "p": {"pointer": "gene_expression"}, "genes": {"kind": "string", "list": True, "registry_key": "genes"}, "k": {"enum": "e"}}, "equal_length": [["genes"]]}, "genes": {"fields": {"uid": {"kind": "string"}}}}}
    tables, constraints = schema_ir.load(ir)
    assert constraints["cells"] == {"equal_length": [["genes"]]} and schema_ir.relationships(tables) == [("cells", "genes", "genes")]
    again, _ = schema_ir.load(schema_ir.dump(tables, constraints))
    assert again["genes"] == tables["genes"] and again["cells"]["p"] == tables["cells"]["p"]
    for bad in ({"tables": {}, "x": 1}, {"tables": {"t": {"fields": {"a": {"kind": "nope"}}}}}, {"tables": {"t": {"fields": {"a": {"kind": "int", "registry_key": "gone"}}}}}, {"tables": {"t": {"fields": {"a": {"kind": "int", "stable_uid": True}, "b": {"kind": "int", "stable_uid": True}}}}}):
        with pytest.raises(ValueError):
            schema_ir.load(bad)


def test_training(spark):
    rows = spark.range(100).selectExpr("id as _rowid", "id % 3 as g", "cast(id as string) as uid")
    d = training.MapDataset(rows)
    assert len(d) == 100 and [r._rowid for r in d.take([5, 99, 5, 0]).collect()] == [5, 99, 5, 0]
    with pytest.raises(IndexError, match="100"):
        d.take([100])
    it = training.IterableDataset(rows, "_rowid", 32, seed=1, drop_last=False)
    a, b, c = ([[r._rowid for r in x] for x in it.batches(n)] for n in (0, 0, 1))
    assert a == b != c and sorted(sum(a, [])) == sorted(sum(c, [])) == list(range(100)) and [len(x) for x in a] == [32, 32, 32, 4]
    assert [len(x) for x in training.IterableDataset(rows, "_rowid", 32, drop_last=True).batches(0)] == [32, 32, 32]
    got = training.group_epoch(rows, "g", "_rowid", 10, 3, 0).collect()
    by = {}
    for r in got:
        by.setdefault((r.g, r.batch), []).append(r._rowid)
    assert len(by) == 9 and all(len(v) == 10 for v in by.values())


def test_target_context(spark):
    genes = spark.createDataFrame([("c", "G", 1000, 5000, "+"), ("c", "H", 9000, 9500, "-")], "chrom string, gene string, start long, end long, strand string")
    f = [("c", "transcript", 1500, 5000, "+", "t"), ("c", "exon", 1500, 2000, "+", "t"), ("c", "exon", 3000, 3500, "+", "t"), ("c", "cds", 1800, 2000, "+", "t"), ("c", "exon", 4000, 4100, "+", "n")]
    features = spark.createDataFrame(f, "chrom string, kind string, start long, end long, strand string, parent string")
    spots = {"coding": 1900, "utr5": 1600, "utr3": 3200, "other": 4050, "intron": 2500, "far": 7000, "lead": 1100, "h": 9400}
    guides = spark.createDataFrame([(k, "c", v - 10, v + 10) for k, v in spots.items()], "guide string, chrom string, start long, end long")
    got = {r.guide: r.context for r in perturbation.target_context(guides, genes, features).collect()}
    assert got == {"coding": "exon", "utr5": "5_UTR", "utr3": "3_UTR", "other": "other", "intron": "intron", "far": "intergenic", "lead": "other", "h": "other"}
