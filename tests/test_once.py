"""What is written or numbered is computed once, however often it is read on the way."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe import schema as S
from quiltframe.functions.ids import layout_uid
from quiltframe.operators import layouts as L
from quiltframe.plans import results
from quiltframe.sources.atlas import Atlas

OBS = T.StructType([T.StructField("uid", T.StringType()), T.StructField("dataset_uid", T.StringType()), S.pointer("gene_expression", "gene_expression")])
NAMED = T.StructType([T.StructField("name", T.StringType())])


def counted(df):
    """df, and how many of its rows have been computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_atlas_reads_its_input_once(spark, tmp_path):
    a = Atlas.create(spark, f"{tmp_path}/atlas", {"cells": OBS}, {"gene_expression": NAMED})
    genes, n_genes = counted(spark.range(50).select(F.format_string("g%02d", "id").alias("uid"), F.lit("x").alias("name")))
    assert a.register_features("gene_expression", genes) == 50 and n_genes.value == 50
    features, n_features = counted(spark.range(40).select(F.format_string("g%02d", "id").alias("feature_uid"), F.col("id").alias("local_index")))
    a.register_dataset("d", "z", "gene_expression", features)
    assert n_features.value == 40
    at = F.struct(F.lit("z").alias("zarr_group"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.col("id").alias("zarr_row")).cast(S.SPARSE)
    rows, n_rows = counted(spark.range(300).select(F.col("id").cast("string").alias("uid"), F.lit("d").alias("dataset_uid"), at.alias("gene_expression")))
    a.add_obs(rows)
    assert n_rows.value == 300
    assert [r["_rowid"] for r in a.obs().orderBy("uid").collect()] == list(range(300))
    a.add_values("gene_expression", spark.range(300).select(F.lit("z").alias("zarr_group"), F.col("id").alias("zarr_row"), (F.col("id") % 40).alias("local_index"), F.lit("counts").alias("layer"), F.lit(1.0).alias("value")))
    a.optimize()
    a.snapshot()
    data = results.UnimodalDataset(a.checkout().query(), "gene_expression", [])
    plan = data.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert data.rows.count() == 300 and sum(len(b) for b in data.epoch(0)) == 300


def test_content_uid(spark):
    rows = spark.createDataFrame([("b", 1), ("c", 2), ("a", 0), ("é", 10)], "feature_uid string, local_index int")
    want = rows.agg(layout_uid(F.transform(F.array_sort(F.collect_list(F.struct("local_index", "feature_uid"))), lambda x: x["feature_uid"])).alias("u")).first()["u"]
    assert L.content_uid(rows) == L.content_uid(rows.repartition(3)) == want
    assert L.content_uid(rows.limit(0)) == rows.limit(0).agg(layout_uid(F.collect_list("feature_uid")).alias("u")).first()["u"]


def test_cuts_by_halves(spark):
    for n in (2, 3, 4, 37, 64):
        df = spark.range(1_000).select(F.when(F.col("id") % 10 > 0, F.format_string("k%05d", F.pmod(F.hash("id"), F.lit(500)))).alias("k"))
        got = df.select("k", L.cuts(df, "k", n).alias("p")).collect()
        keys = [r.k for r in sorted(got, key=lambda r: (r.p, r.k or ""))]
        assert [k or "" for k in keys] == sorted(k or "" for k in keys)  # ranges follow one another
        assert all(r.p == 0 for r in got if r.k is None)
        assert len({r.k for r in got}) == len({(r.k, r.p) for r in got}) and len({r.p for r in got}) == n
    plan = df.select(L.cuts(df, "k", 64).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert "filter(" not in plan  # no row is compared with every bound
