"""Ragged feature joins: matrices over the union or intersection of what datasets measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feature_space(layouts: DataFrame, datasets: DataFrame | None = None, how: str = "union") -> DataFrame:
    """global_index, column (from 0, by index) of the joined space of the layouts of datasets.

    An intersection counts layouts, not rows, so it needs one grouped pass.
    """
    if how not in ("union", "intersection"):
        raise ValueError(f"no such join: {how!r}")
    own = layouts.join(datasets, "dataset", "left_semi") if datasets is not None else layouts
    if how == "union":
        space = own.select("global_index").distinct()
    else:
        n = own.agg(F.countDistinct("layout_uid").alias("__n"))
        space = own.groupBy("global_index").agg(F.countDistinct("layout_uid").alias("__m")).join(F.broadcast(n)).where("__m = __n").select("global_index")
    # as wide as the registry at most, a dimension table
    return space.where("global_index is not null").withColumn("column", F.row_number().over(Window.orderBy("global_index")) - 1)


def sparse(values: DataFrame, layouts: DataFrame, space: DataFrame, value: str = "value") -> DataFrame:
    """uid, column, value of (dataset, uid, local_index, value): entries outside the space are dropped, repeated ones summed."""
    to = layouts.join(space, "global_index").select("dataset", "local_index", "column")
    return values.join(to, ["dataset", "local_index"]).groupBy("uid", "column").agg(F.sum(value).alias(value))


def dense(values: DataFrame, layouts: DataFrame, space: DataFrame, value: str = "value") -> DataFrame:
    """uid, column, value with 0 wherever a dataset has no such feature: rows of (dataset, uid, values array).

    What a dataset's layout lacks is a list of columns, made once a dataset;
    its zeros are added beside the values, so rows never meet features in a join.
    """
    width = space.count()
    if not width:
        return values.select("uid", F.lit(0).alias("column"), F.lit(0).alias(value)).limit(0)
    every = F.sequence(F.lit(0), F.lit(width - 1)).cast("array<int>")
    own = layouts.join(space, "global_index").groupBy("dataset").agg(F.collect_set(F.col("column").cast("int")).alias("__have"))
    size = layouts.groupBy("dataset").agg((F.max("local_index") + 1).cast("int").alias("__size"))
    of = size.join(own, "dataset", "left").select("dataset", "__size", F.when(F.col("__have").isNull(), every).otherwise(F.array_except(every, "__have")).alias("__lack"))
    rows = values.select("dataset", "uid", value).join(of, "dataset", "left")
    kind = values.schema[value].dataType.elementType
    full = rows.withColumn("__full", F.transform(F.sequence(F.lit(0), F.greatest(F.coalesce("__size", F.lit(1)), F.size(value), F.lit(1)) - 1), lambda i: F.coalesce(F.get(F.col(value), i), F.lit(0).cast(kind))))
    long = full.select("dataset", "uid", F.posexplode("__full").alias("local_index", value))
    at = sparse(long, layouts, space, value)
    zeros = rows.select("uid", F.explode(F.coalesce("__lack", every)).alias("column"))
    return at.unionByName(zeros.select("uid", F.col("column").cast(at.schema["column"].dataType), F.lit(0).cast(at.schema[value].dataType).alias(value)))


def rows_as_arrays(entries: DataFrame, value: str = "value") -> DataFrame:
    """One row for each uid: indices in order and their values, as in compressed sparse rows."""
    both = F.array_sort(F.collect_list(F.struct("column", value)))
    return entries.groupBy("uid").agg(both.alias("__e")).select("uid", F.transform("__e", lambda x: x["column"]).alias("indices"), F.transform("__e", lambda x: x[value]).alias("values"))


def by_feature(values: DataFrame) -> DataFrame:
    """The feature-oriented copy: the same entries, ranged and sorted by feature so that a scan of few features reads few row groups."""
    return values.repartitionByRange("dataset", "local_index").sortWithinPartitions("dataset", "local_index", "uid")


def use_feature_copy(n_rows: int, n_wanted: int | None, all_have_copy: bool) -> bool:
    """Whether to read the feature-oriented copy: for fewer features than rows, where every group has one."""
    return n_wanted is not None and all_have_copy and n_rows > n_wanted


def remap(indices: list[int], counts: list[int], lengths: list[int], to: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Local to joined columns for one batch in memory; columns that map to -1 are dropped from their rows."""
    out_i, out_c, out_n, at = [], [], [], 0
    for n in lengths:
        kept = [(to[i], c) for i, c in zip(indices[at : at + n], counts[at : at + n], strict=True) if to[i] >= 0]
        out_i += [i for i, _ in kept]
        out_c += [c for _, c in kept]
        out_n.append(len(kept))
        at += n
    return out_i, out_c, out_n


def diagonal(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their columns; a column of numbers here and text there is text."""
    if not frames:
        raise ValueError("nothing to concatenate")
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, set()).add(kind)
    texts = {n for n, k in kinds.items() if len(k) > 1 and "string" in k}
    out = None
    for f in frames:
        f = f.withColumns({n: F.col(n).cast("string") for n in texts & set(f.columns)})
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out
