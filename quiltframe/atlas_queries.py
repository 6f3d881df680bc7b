"""Queries that run through an atlas: built once a session from the driver's tables, then versioned, checked out and queried.

Orders of a region and suppliers are the observations: lineitem entries their sparse values, ship dates and
quantities their fragments; embeddings are a dense modality of a third table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe import schema as S
from quiltframe.operators import keys as K
from quiltframe.plans import results
from quiltframe.queries import _F, _L, Tables, feature, frags, query, values
from quiltframe.sources import ingest
from quiltframe.sources.atlas import Atlas
from quiltframe.sources.store import holding, scratch

_TEXT = T.StringType()
_UID = [T.StructField("uid", _TEXT), T.StructField("dataset_uid", _TEXT)]
_NAMED = T.StructType([T.StructField("name", _TEXT)])
_BUILT: dict[tuple, Atlas] = {}


def build(t: Tables) -> Atlas:
    """Registries, datasets with layouts, values, obs rows and copies; two snapshots, the second with more orders."""
    key = (t.spark.sparkContext.applicationId, t.d)
    if key in _BUILT:
        return _BUILT[key]
    obs = {
        "orders": T.StructType([*_UID, S.pointer("gene_expression", "gene_expression"), T.StructField("status", _TEXT), T.StructField("total", T.DoubleType())]),
        "cells": T.StructType([*_UID, S.pointer("chromatin_accessibility", "chromatin_accessibility")]),
        "vectors": T.StructType([*_UID, S.pointer("image_features", "image_features"), T.StructField("label", T.IntegerType())]),
    }
    a = Atlas.create(t.spark, f"{scratch(t.spark)}/atlas-{uuid.uuid4().hex}", obs, {"gene_expression": _NAMED, "image_features": _NAMED, "chromatin_accessibility": T.StructType([T.StructField("sequence_name", _TEXT)])})
    a.register_features("gene_expression", t.part.select(feature(F.col("p_partkey")).alias("uid"), F.col("p_name").alias("name")))
    a.register_features("image_features", t.spark.range(64).select(F.format_string("d%02d", "id").alias("uid"), F.col("id").cast("string").alias("name")))
    a.register_features("chromatin_accessibility", t.spark.createDataFrame([(c, c) for c in "ANR"], "uid string, sequence_name string"))
    v = values(t).select(F.concat(F.lit("r"), "dataset").alias("zarr_group"), F.regexp_extract("uid", r"\d+$", 0).cast("long").alias("zarr_row"), "local_index", F.lit("counts").alias("layer"), F.col("value").cast("double").alias("value"))
    a.add_values("gene_expression", v)
    v = a.read("values.gene_expression")  # what follows reads the few columns that it needs
    with holding(v.select("zarr_group", "local_index").distinct()) as measured:
        for r in t.region.collect():  # five rows
            group = f"r{r.r_regionkey}"
            mine = measured.where(F.col("zarr_group") == group)
            a.register_dataset(f"region {r.r_regionkey}", group, "gene_expression", mine.select(feature(F.col("local_index")).alias("feature_uid"), "local_index"))
    a.register_dataset("ships", "ships", "chromatin_accessibility", t.spark.createDataFrame([(c, i) for i, c in enumerate("ANR")], "feature_uid string, local_index long"))
    f = frags(t)
    a.add_values("chromatin_accessibility", f.select(F.lit("ships").alias("zarr_group"), F.col("barcode").cast("long").alias("zarr_row"), F.when(F.col("chrom") == "A", 0).when(F.col("chrom") == "N", 1).otherwise(2).cast("long").alias("local_index"), "start", "length"))
    a.register_dataset("embeddings", "e", "image_features", t.spark.range(64).select(F.format_string("d%02d", "id").alias("feature_uid"), F.col("id").alias("local_index")))
    a.add_values("image_features", t.embeddings.select(F.lit("e").alias("zarr_group"), F.col("vec_id").alias("position"), F.lit("ctrl_standardized").alias("layer"), F.transform("embedding", lambda x: x.cast("double")).alias("values")))

    rows = v.select("zarr_group", "zarr_row").repartition("zarr_row").distinct().join(t.orders, F.col("zarr_row") == F.col("o_orderkey"))  # one shuffle for both
    dataset = F.substring("zarr_group", 2, 20)
    pointer = F.struct("zarr_group", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), "zarr_row").cast(S.SPARSE)
    rows = rows.select(F.concat_ws("-", dataset, "zarr_row").alias("uid"), F.concat(F.lit("region "), dataset).alias("dataset_uid"), pointer.alias("gene_expression"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("total"))
    a.add_obs(rows.where("status <> 'P'"), "orders")
    at = F.struct(F.lit("ships").alias("zarr_group"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.col("barcode").cast("long").alias("zarr_row")).cast(S.SPARSE)
    a.add_obs(f.select("barcode").distinct().select(F.col("barcode").alias("uid"), F.lit("ships").alias("dataset_uid"), at.alias("chromatin_accessibility")), "cells")
    a.add_obs(t.embeddings.where("embedding is not null").select(F.col("vec_id").cast("string").alias("uid"), F.lit("embeddings").alias("dataset_uid"), F.struct(F.lit("e").alias("zarr_group"), F.col("vec_id").alias("position")).cast(S.DENSE).alias("image_features"), "label"), "vectors")
    a.optimize()
    ingest.add_csc(a, "gene_expression")
    ingest.add_genome_sorted(a)
    a.snapshot()
    a.add_obs(rows.where("status = 'P'"), "orders")
    a.refresh()
    a.snapshot()
    _BUILT[key] = a
    return a


def orders(t: Tables, version: int | None = None):
    return build(t).checkout(version).query("orders")


_OBS = f"(select distinct d, uid, o_orderstatus as status, cast(o_totalprice as double) as total from {_L} join orders on o_orderkey = cast(split_part(uid, '-', 2) as bigint))"


@query(f"select uid, g, sum(x) as value from {_L} group by uid, g")
def atlas_matrix(t):
    m = orders(t).matrix()
    return m.x.join(m.var.select("column", F.col("uid").cast("long").alias("g")), "column").select("uid", "g", "value")


@query(f"select uid, g, sum(x) as value from {_L} where g in (1, 7, 9, 50, 111) group by uid, g")
def atlas_features(t):
    m = orders(t).features([f"{k:012d}" for k in (111, 1, 50, 7, 9, 7)], "gene_expression").matrix()
    return m.x.join(m.var.select("column", F.col("uid").cast("long").alias("g")), "column").select("uid", "g", "value")


@query(f"with i as (select g from {_L} where d in (0, 1, 2) group by g having count(distinct d) = 3) select uid, g, sum(x) as value from {_L} join i using (g) where d in (0, 1, 2) group by uid, g")
def atlas_intersection(t):
    some = t.spark.createDataFrame([(f"region {k}",) for k in range(3)], "dataset_uid string")
    m = orders(t).by_dataset(some).feature_join("intersection").matrix()
    return m.x.join(m.var.select("column", F.col("uid").cast("long").alias("g")), "column").select("uid", "g", "value")


@query("select cast(vec_id as varchar) as uid, cast(i - 1 as int) as \"column\", cast(embedding[i] as double) as value from embeddings, unnest(range(1, len(embedding) + 1)) as r(i) where label < 3")
def atlas_dense(t):
    m = build(t).checkout().query("vectors").where("label < 3").matrix()
    return m.x.select("uid", F.col("column").cast("int").alias("column"), "value")


@query(f"select barcode as uid, chrom, s as start, n as length from {_F}")
def atlas_fragments(t):
    return build(t).checkout().query("cells").fragments()


@query(f"select barcode as uid, chrom, s as start, n as length from {_F} where chrom = 'R' and s < 9500 and s + n > 9300")
def atlas_region(t):
    return build(t).checkout().query("cells").fragments(region=("R", 9_300, 9_500))


@query(f"select status, count(*) as count from {_OBS} where total > 1000 group by status")
def atlas_count_by(t):
    return orders(t).where("total > 1000").count(["status"])


@query(f"select uid, total from {_OBS} where status = 'F' and total between 1000 and 100000")
def atlas_where_select(t):
    return orders(t).where("status = 'F' and total between 1000 and 100000").select(["total"]).obs()


@query(f"select 0 as version, count(*) as n from {_OBS} where status <> 'P' union all select 1, count(*) from {_OBS}")
def atlas_versions(t):
    a = build(t)
    counted = [a.checkout(k).obs("orders").agg(F.lit(k).alias("version"), F.count("*").alias("n")) for k in range(2)]
    return counted[0].unionByName(counted[1])


@query(f"with o as (select uid, row_number() over (order by s, uid) - 1 as r from (select *, status = 'P' as s from {_OBS})), v as (select uid, count(*) as n, sum(x) as total from (select uid, g, sum(x) as x from {_L} group by uid, g) group by uid) select r // 100 as batch, r % 100 as position, uid, n, total from o join v using (uid)")
def atlas_batches(t):
    rows, _, _ = results.batch_rows(orders(t), "gene_expression", 100)
    return rows.select("batch", "position", "uid", F.size("indices").cast("long").alias("n"), F.aggregate("counts", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query(f"with v as (select uid, count(*) as n from (select distinct uid, g from {_L}) group by uid) select count(*) as n_rows, max(k) // 64 + 1 as n_batches, cast(sum(n) as bigint) as n_entries from (select n, (row_number() over () - 1) as k from v)")
def atlas_epoch(t):
    data = results.UnimodalDataset(orders(t), "gene_expression", [], size=64, seed=5)
    numbered = K.batches(K.shuffled(data.rows, "ordinal", data.seed, 2), data.size, "order")
    return numbered.agg(F.count("*").alias("n_rows"), (F.max("batch") + 1).alias("n_batches"), F.sum(F.size("indices")).alias("n_entries"))


@query(f"select distinct concat('region ', d) as dataset_uid, lpad(cast(g as varchar), 12, '0') as feature from {_L} where g in (3, 30, 300)")
def atlas_datasets_with(t):
    got = build(t).checkout().find_datasets_with_features([f"{k:012d}" for k in (3, 30, 300)], "gene_expression")
    return got.select("dataset_uid", F.col("global_feature_uid").alias("feature"))


@query(f"select distinct uid, true as has_gene_expression from {_OBS}")
def atlas_multimodal(t):
    obs, _ = orders(t).multimodal()
    return obs.select("uid", "has_gene_expression")


_PARTS = "(select distinct l_suppkey as s, l_partkey as p from lineitem where l_suppkey <= 20)"


@query(f"select s as \"row\", count(*) as n, cast(sum(count(*)) over (order by s) - count(*) as bigint) as start from {_PARTS} group by s")
def sparse_pointers(t):
    """The writer's pointers: a row's place among all entries, by prefix sums over ranges."""
    size = t.lineitem.where("l_suppkey <= 20").select(F.col("l_suppkey").alias("row"), "l_partkey").distinct().groupBy("row").agg(F.count("*").alias("n"))
    return ingest.running(size, "row", "n", "start")
