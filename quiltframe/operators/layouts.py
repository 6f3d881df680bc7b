"""Feature registries and layouts: bridges from a dataset's local columns to global features."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.functions.ids import layout_uid


def insert_absent(target: DataFrame, rows: DataFrame, key: str = "uid") -> DataFrame:
    """The rows to append: the first of each key (by the other columns), less those whose key is there; attributes are never updated."""
    order = [F.col(c).asc_nulls_last() for c in rows.columns if c != key] or [F.col(key)]
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
    return first.join(target.select(key), key, "left_anti")


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least order, null last, of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def reindex(registry: DataFrame, key: str = "uid", index: str = "global_index") -> DataFrame:
    """Numbers rows without an index from the largest on, in order of key; indices once given stay.

    Ranks are counted range by range and shifted by prefix sums, so no single task sorts the table.
    """
    missing = registry.where(F.col(index).isNull())
    top = registry.agg(F.coalesce(F.max(index), F.lit(-1)).alias("__top"))
    return registry.where(F.col(index).isNotNull()).unionByName(ranked(missing, key, "__r").join(F.broadcast(top)).withColumn(index, F.col("__r") + F.col("__top") + 1).select(*registry.columns))


def ranked(df: DataFrame, key: str, name: str, sample: int = 20_000) -> DataFrame:
    """df with a gapless rank from 0 by key, null keys first, without a global sort in one task.

    Ranges are cut at quantiles of about ``sample`` keys; ranks are exact wherever the cuts lie.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    cutup = df.withColumn("__p", cuts(df, key, n, sample))
    size = cutup.groupBy("__p").agg(F.count("*").alias("__c"))  # n rows at most
    before = size.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return cutup.join(F.broadcast(before), "__p").withColumn(name, F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1 + F.col("__b")).drop("__p", "__b")


def cuts(df: DataFrame, key: str, n: int, sample: int = 20_000) -> Column:
    """The range of each row's key, of n at most, from quantiles of about ``sample`` keys; nulls are in the first."""
    keys = df.select(key).where(F.col(key).isNotNull())
    share = min(1.0, sample / max(1, keys.count())) if n > 1 else 0
    some = sorted({r[0] for r in keys.where(F.pmod(F.xxhash64(key, F.lit("range")), F.lit(1_000_000)) < int(share * 1_000_000)).collect()}) if share else []  # about sample keys
    bounds = sorted({some[i * len(some) // n] for i in range(1, n)}) if some else []
    if not bounds:
        return F.lit(0)
    # by halves, so that a row costs the logarithm of the number of ranges; beyond the last bound there is null, which is not less
    every = F.array(*[F.lit(b).cast(df.schema[key].dataType) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(every, at + step - 1) < F.col(key), at + step).otherwise(at))
    return F.when(F.col(key).isNull(), 0).otherwise(below)


def build_layouts(measured: DataFrame, registry: DataFrame) -> DataFrame:
    """(dataset, feature_uid) pairs to layout rows: dataset, layout_uid, feature_uid, local_index, global_index; features in order of uid."""
    order = Window.partitionBy("dataset").orderBy("feature_uid")
    rows = measured.select("dataset", "feature_uid").distinct().withColumn("local_index", F.row_number().over(order) - 1)
    uid = rows.groupBy("dataset").agg(layout_uid(F.transform(F.array_sort(F.collect_list(F.struct("local_index", "feature_uid"))), lambda x: x["feature_uid"])).alias("layout_uid"))
    known = registry.select(F.col("uid").alias("feature_uid"), "global_index")
    return rows.join(uid, "dataset").join(known, "feature_uid", "left").select("dataset", "layout_uid", "feature_uid", "local_index", "global_index")


def content_uid(features: DataFrame) -> str:
    """The layout's uid of (feature_uid, local_index) rows: :func:`layout_uid` of the uids in order, read one batch after another, so no task holds them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha256()
        for b in batches:
            h.update("".join(f"{u}\0" for u in b.column(0).to_pylist()).encode())
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], ["u"])

    order = features.select("feature_uid", "local_index").repartition(1).sortWithinPartitions("local_index", "feature_uid")
    got = order.select("feature_uid").mapInArrow(run, "u string").first()
    return (got["u"] if got else hashlib.sha256().hexdigest())[:16]


def missing_features(measured: DataFrame, registry: DataFrame) -> DataFrame:
    """Measured features that no registry row has."""
    return measured.select("feature_uid").distinct().join(registry.select(F.col("uid").alias("feature_uid")), "feature_uid", "left_anti")


def sync(layouts: DataFrame, registry: DataFrame) -> DataFrame:
    """Layout rows with indices that the registry has got since."""
    known = registry.select(F.col("uid").alias("feature_uid"), F.col("global_index").alias("__g"))
    return layouts.join(known, "feature_uid", "left").withColumn("global_index", F.coalesce("global_index", "__g")).drop("__g").select(*layouts.columns)


def problems(layouts: DataFrame, registry: DataFrame, expected: int | None = None) -> list[str]:
    """What is wrong with a layout: features twice, without index, not in the registry, or of another number."""
    r = layouts.agg(F.count("*").alias("n"), F.countDistinct("feature_uid").alias("d"), F.count_if(F.col("global_index").isNull()).alias("u")).first()
    out = []
    if expected is not None and r.n != expected:
        out.append(f"{r.n} features, expected {expected}")
    if r.d < r.n:
        out.append(f"{r.n - r.d} features are there more than once")
    if r.u:
        out.append(f"{r.u} features have no index")
    if lost := missing_features(layouts, registry).count():
        out.append(f"{lost} features are not in the registry")
    return out


def resolve(registry: DataFrame, uids: list[str]) -> DataFrame:
    """feature_uid, global_index of the wanted uids by index; one that is missing or without index is an error."""
    wanted = registry.sparkSession.createDataFrame([(u,) for u in dict.fromkeys(uids)], "feature_uid string")
    got = wanted.join(registry.select(F.col("uid").alias("feature_uid"), "global_index", F.lit(True).alias("__there")), "feature_uid", "left")
    bad = got.where("__there is null or global_index is null").select("feature_uid").collect()  # of the caller's list
    if bad:
        raise KeyError(f"not in the registry or without index: {sorted(r.feature_uid for r in bad)}")
    return got.drop("__there").orderBy("global_index")


def datasets_with(layouts: DataFrame, datasets: DataFrame, uids: list[str], space: str | None = None) -> DataFrame:
    """The datasets whose layout holds any of the features, one row for each pair."""
    if space is not None:
        datasets = datasets.where(F.col("feature_space") == space)
    wanted = layouts.sparkSession.createDataFrame([(u,) for u in dict.fromkeys(uids)], "feature_uid string")
    hits = layouts.join(wanted, "feature_uid", "left_semi").select("layout_uid", F.col("feature_uid").alias("global_feature_uid")).distinct()
    return hits.join(datasets, "layout_uid").drop("layout_uid")


def feature_metadata(df: DataFrame, registry: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """df with registry columns beside it, by a left join; keys and unknown columns are refused."""
    if bad := [c for c in columns if c in ("uid", "global_index") or c not in registry.columns]:
        raise ValueError(f"cannot join {bad}")
    return df.join(registry.select(F.col("uid").alias("__uid"), *columns), F.col(on) == F.col("__uid"), "left").drop("__uid")
