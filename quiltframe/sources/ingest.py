"""From files and arrays to value tables, pointers and obs rows.

A reader gives rows of one canonical form for its pointer; a converter checks
them against the feature space; the writer appends them to the value table and
gives each row's pointer. Nothing goes through the driver but what the caller
holds in memory already.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe import schema as S
from quiltframe.operators import intervals
from quiltframe.operators import layouts as L
from quiltframe.sources import readers
from quiltframe.sources.atlas import Atlas

#: The canonical columns of what readers give, by kind of value.
SPARSE_ROWS = "row long, local_index long, layer string, value double"
DENSE_ROWS = "row long, layer string, values array<double>"
FRAGMENT_ROWS = "row long, chrom string, start long, length int"


class Reader(Protocol):
    """n_rows, and rows() in the canonical columns of one kind."""

    n_rows: int

    def rows(self) -> DataFrame: ...


@dataclass
class Csr:
    """A matrix in compressed sparse rows in memory."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    shape: tuple[int, int]


class MatrixReader:
    """Layers in memory: two-dimensional arrays or :class:`Csr`, all of one number of rows."""

    def __init__(self, spark: SparkSession, layers: Mapping[str, np.ndarray | Csr]):
        if not layers:
            raise ValueError("no layer")
        shapes = {x.shape for x in layers.values()}
        if len(shapes) != 1:
            raise ValueError(f"layers differ in shape: {sorted(shapes)}")
        self.spark, self.layers = spark, dict(layers)
        self.n_rows, self.n_columns = shapes.pop()

    def rows(self) -> DataFrame:
        """Entries; zeros of arrays are left out."""
        out = []
        for name, x in self.layers.items():
            if isinstance(x, Csr):
                r, c, v = np.repeat(np.arange(self.n_rows), np.diff(x.indptr)), x.indices, x.data
            else:
                r, c = np.nonzero(x)
                v = x[r, c]
            out.append(pd.DataFrame({"row": r.astype("i8"), "local_index": np.asarray(c, "i8"), "layer": name, "value": np.asarray(v, "f8")}))
        return self.spark.createDataFrame(pd.concat(out), SPARSE_ROWS)

    def dense_rows(self) -> DataFrame:
        rows = [(i, name, [float(v) for v in r]) for name, x in self.layers.items() for i, r in enumerate(x)]
        return self.spark.createDataFrame(rows, DENSE_ROWS)


class TripletReader:
    """Coordinate triplets in a file, sorted by row; rows without entries count too."""

    def __init__(self, spark: SparkSession, path: str, n_rows: int, n_columns: int, layer: str = "counts", one_based: bool = False, sep: str = ","):
        self.n_rows, self.n_columns = n_rows, n_columns
        got = readers.triplets(spark, path, n_rows, n_columns, one_based, sep)
        self._rows = got.select("row", F.explode("entries").alias("e")).select("row", F.col("e.column").alias("local_index"), F.lit(layer).alias("layer"), F.col("e.value").alias("value"))

    def rows(self) -> DataFrame:
        return self._rows


class FragmentReader:
    """Fragments (chrom, start, length, barcode) of the cells in barcodes (row, barcode); a cell without any is an error."""

    def __init__(self, frags: DataFrame, barcodes: DataFrame):
        self.n_rows = barcodes.count()
        if lost := [r.barcode for r in barcodes.join(frags.select("barcode").distinct(), "barcode", "left_anti").take(5)]:
            raise ValueError(f"cells without fragments: {lost}")
        self._rows = frags.join(barcodes, "barcode").select("row", "chrom", "start", "length")

    def rows(self) -> DataFrame:
        return self._rows


def h5ad(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, MatrixReader]:
    """obs, var and the matrix of an h5ad file, which must be stored by rows if sparse. Needs h5py."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("h5ad files need h5py") from e
    with h5py.File(path, "r") as f:
        x = f["X"]
        if isinstance(x, h5py.Group):
            if x.attrs.get("encoding-type") != "csr_matrix":
                raise TypeError("a sparse matrix must be stored by rows")
            matrix = Csr(x["indptr"][:], x["indices"][:], x["data"][:], tuple(x.attrs["shape"]))
        else:
            matrix = x[:]
        frames = []
        for part in ("obs", "var"):
            g = f[part]
            text = lambda v: [s.decode() if isinstance(s, bytes) else s for s in v.tolist()]
            frames.append(spark.createDataFrame(pd.DataFrame({k: text(g[k][:]) for k in g if isinstance(g[k], h5py.Dataset)})))
    return frames[0], frames[1], MatrixReader(spark, {"counts": matrix})


# converters

CONVERTERS: dict[str, Callable[[S.FeatureSpace, DataFrame, int], DataFrame]] = {}


def converter(kind: str) -> Callable:
    """Registers how rows of a kind of pointer (or of a named feature space) become value rows."""
    def add(f: Callable) -> Callable:
        CONVERTERS[kind] = f
        return f

    return add


def check_layers(space: S.FeatureSpace, names: set[str]) -> None:
    """Layers must be declared, and required ones there."""
    if bad := names - set(space.layers):
        raise ValueError(f"{space.name} has no layer {sorted(bad)}")
    if missing := set(space.must) - names:
        raise ValueError(f"{space.name} needs layers {sorted(missing)}")


@converter("sparse")
def sparse_rows(space: S.FeatureSpace, rows: DataFrame, n_rows: int) -> DataFrame:
    """zarr_row, local_index, layer, value: layers share one structure, nothing is outside the rows, nulls are refused."""
    bad = rows.agg(F.min("row").alias("a"), F.max("row").alias("b"), F.count_if(F.col("value").isNull() | F.col("local_index").isNull() | F.col("row").isNull()).alias("nulls"), F.collect_set("layer").alias("layers")).first()
    if bad.nulls or (bad.a is not None and not 0 <= bad.a <= bad.b < n_rows):
        raise ValueError("entries are null or outside the rows")
    if bad.layers:
        check_layers(space, set(bad.layers))
    if len(bad.layers) > 1 and rows.groupBy("row", "local_index").agg(F.countDistinct("layer").alias("n")).where(F.col("n") < len(bad.layers)).take(1):
        raise ValueError("layers differ in their structure")
    return rows.select(F.col("row").alias("zarr_row"), "local_index", "layer", "value")


@converter("dense")
def dense_rows(space: S.FeatureSpace, rows: DataFrame, n_rows: int) -> DataFrame:
    """position, layer, values: each layer has every row once, all of one width."""
    got = rows.groupBy("layer").agg(F.count("*").alias("n"), F.countDistinct("row").alias("d"), F.min(F.size("values")).alias("a"), F.max(F.size("values")).alias("b"), F.min("row").alias("low"), F.max("row").alias("high")).collect()  # a row for each layer
    check_layers(space, {r.layer for r in got})
    if any((r.n, r.d, r.low, r.high) != (n_rows, n_rows, 0, n_rows - 1) for r in got) or len({x for r in got for x in (r.a, r.b)}) > 1:
        raise ValueError("layers differ in rows or width")
    return rows.select(F.col("row").alias("position"), "layer", "values")


@converter("chromatin_accessibility")
def fragment_rows(space: S.FeatureSpace, rows: DataFrame, n_rows: int) -> DataFrame:
    return rows.select(F.col("row").alias("zarr_row"), "local_index", "start", "length")


def convert(space: str, rows: DataFrame, n_rows: int) -> DataFrame:
    spec = S.SPACES[space]
    return (CONVERTERS.get(space) or CONVERTERS[spec.pointer])(spec, rows, n_rows)


# writers

def running(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows of a smaller key; by ranges, so no task adds up the table."""
    cutup = df.withColumn("__p", L.cuts(df, key, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))))
    total = cutup.groupBy("__p").agg(F.sum(value).alias("__s"))  # a row for each range
    before = total.withColumn("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    w = Window.partitionBy("__p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return cutup.join(F.broadcast(before), "__p").withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col("__b")).drop("__p", "__b")


def write_feature_space(atlas: Atlas, space: str, group: str, rows: DataFrame, n_rows: int) -> DataFrame:
    """Appends the rows of a group to its value table; gives row and pointer of every row from 0, empty ones too."""
    spec = S.SPACES[space]
    values = convert(space, rows, n_rows)
    atlas.add_values(space, values.withColumn("zarr_group", F.lit(group)))
    every = atlas.store.spark.range(n_rows).select(F.col("id").alias("row"))
    if spec.pointer == "dense":
        return every.select("row", F.struct(F.lit(group).alias("zarr_group"), F.col("row").alias("position")).cast(S.DENSE).alias("pointer"))
    one = values.where(F.col("layer") == spec.must[0]) if "layer" in values.columns else values
    size = every.join(one.groupBy(F.col("zarr_row").alias("row")).agg(F.count("*").alias("n")), "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    at = running(size, "row", "n", "start")
    return at.select("row", F.struct(F.lit(group).alias("zarr_group"), F.col("start"), (F.col("start") + F.col("n")).alias("end"), F.col("row").alias("zarr_row")).cast(S.SPARSE).alias("pointer"))


def records_per_file(n_columns: int, elements: int = 40_960 * 1_024) -> int:
    """So many rows that a file holds about so many elements."""
    return max(1, elements // max(1, n_columns))


@dataclass
class Ingestor:
    """One dataset: arrays of several modalities, then its obs rows, once."""

    atlas: Atlas
    dataset: str
    n_obs: int
    table: str | None = None
    pointers: dict[str, DataFrame] = field(default_factory=dict)
    done: bool = False

    def write_array(self, pointer: str, group: str, rows: DataFrame, n_rows: int, features: DataFrame | None, obs_index: DataFrame | None = None) -> None:
        """rows in canonical form. features: feature_uid, local_index of the registry. obs_index: row, obs (its obs row's number); without, rows are obs rows."""
        fields = S.pointers(T.StructType([f for f in self.atlas.obs(self.table).schema.fields if f.name != "_rowid"]))
        if pointer not in fields:
            raise ValueError(f"no pointer {pointer!r}")
        if pointer in self.pointers:
            raise ValueError(f"{pointer} is written already")
        if obs_index is None:
            if n_rows != self.n_obs:
                raise ValueError(f"{n_rows} rows for {self.n_obs} obs rows")
            obs_index = self.atlas.store.spark.range(n_rows).select(F.col("id").alias("row"), F.col("id").alias("obs"))
        r = obs_index.agg(F.count("*").alias("n"), F.countDistinct("obs").alias("d"), F.countDistinct("row").alias("e"), F.min("obs").alias("a"), F.max("obs").alias("b")).first()
        if not r.n == r.d == r.e == n_rows or (n_rows and not 0 <= r.a <= r.b < self.n_obs):
            raise ValueError("obs rows are not unique or out of range")
        space = fields[pointer]
        if S.SPACES[space].has_features and features is None:
            raise ValueError(f"{space} needs its features")
        self.atlas.register_dataset(self.dataset, group, space, features)
        got = write_feature_space(self.atlas, space, group, rows, n_rows)
        self.pointers[pointer] = got.join(obs_index, "row").select("obs", F.col("pointer").alias(pointer))

    def write_obs_records(self, obs: DataFrame, index: str = "obs") -> int:
        """obs: a row for each obs row, with its number in the index column; pointers that were not written are null."""
        if self.done:
            raise RuntimeError("the obs rows are written already")
        r = obs.agg(F.count("*").alias("n"), F.countDistinct(index).alias("d")).first()
        if (r.n, r.d) != (self.n_obs, self.n_obs):
            raise ValueError(f"{r.n} obs rows, expected {self.n_obs}")
        if "dataset_uid" in obs.columns and obs.where(~F.col("dataset_uid").eqNullSafe(self.dataset)).take(1):
            raise ValueError(f"obs rows are of other datasets than {self.dataset}")
        if clash := set(self.pointers) & set(obs.columns):
            raise ValueError(f"pointers are given and written: {sorted(clash)}")
        out = obs.withColumn("dataset_uid", F.lit(self.dataset))
        for p in self.pointers.values():
            out = out.join(p.withColumnRenamed("obs", index), index, "left")
        version = self.atlas.add_obs(out.drop(index), self.table)
        self.done = True
        return version


def check_var(atlas: Atlas, space: str, var: DataFrame) -> None:
    """var has exactly the registry's columns but for the number, uids once each."""
    want, have = set(atlas.registry(space).columns) - {"global_index"}, set(var.columns) - {"local_index"}
    if want != have:
        raise ValueError(f"columns of var differ from the registry: {sorted(want ^ have)}")
    if var.groupBy("uid").count().where("count > 1 or uid is null").take(1):
        raise ValueError("uids of var are null or not unique")


def ingest_dataset(atlas: Atlas, dataset: str, pointer: str, group: str, reader: Reader, var: DataFrame, obs: DataFrame, table: str | None = None) -> Ingestor:
    """One feature space end to end. var: local_index and the registry's columns; obs: its row's number in obs."""
    fields = S.pointers(T.StructType([f for f in atlas.obs(table).schema.fields if f.name != "_rowid"]))
    space = fields.get(pointer)
    if space is None:
        raise ValueError(f"no pointer {pointer!r}")
    check_var(atlas, space, var)
    atlas.register_features(space, var.drop("local_index"))
    ingestor = Ingestor(atlas, dataset, obs.count(), table)
    rows = reader.dense_rows() if S.SPACES[space].pointer == "dense" and hasattr(reader, "dense_rows") else reader.rows()
    ingestor.write_array(pointer, group, rows, reader.n_rows, var.select(F.col("uid").alias("feature_uid"), "local_index"))
    ingestor.write_obs_records(obs)
    return ingestor


def add_from_anndata(atlas: Atlas, dataset: str, pointer: str, group: str, adata: object, layers: dict[str, str] | None = None, table: str | None = None) -> Ingestor:
    """Anything with X (an array or compressed rows), obs and var as pandas frames, and layers; layers: its name -> ours, "X" being the first."""
    spark = atlas.store.spark
    names = layers or {"X": S.SPACES[S.pointers(T.StructType([f for f in atlas.obs(table).schema.fields if f.name != "_rowid"]))[pointer]].must[0]}

    def matrix(x: object) -> np.ndarray | Csr:
        return Csr(x.indptr, x.indices, x.data, x.shape) if hasattr(x, "indptr") else np.asarray(x)

    read = MatrixReader(spark, {ours: matrix(adata.X if theirs == "X" else adata.layers[theirs]) for theirs, ours in names.items()})
    var = adata.var.copy()
    var["local_index"] = np.arange(len(var))
    obs = adata.obs.copy()
    obs["obs"] = np.arange(len(obs))
    return ingest_dataset(atlas, dataset, pointer, group, read, spark.createDataFrame(var), spark.createDataFrame(obs), table)


def ingest_fragments(atlas: Atlas, dataset: str, pointer: str, group: str, frags: DataFrame, obs: DataFrame, barcode: str = "barcode", table: str | None = None) -> Ingestor:
    """Fragments of the cells of obs (obs, barcode ...), by chromosome; fragments on chromosomes that the registry lacks, by sequence_name, are dropped."""
    space = "chromatin_accessibility"
    known = atlas.registry(space).select("uid", F.col("sequence_name").alias("chrom"))
    frags = frags.join(known, "chrom", "left_semi")
    chroms = [r.chrom for r in frags.select("chrom").distinct().orderBy(*intervals.chromosome_order(F.col("chrom"))).collect()]  # of an assembly
    if len(chroms) > 256:
        raise ValueError(f"{len(chroms)} chromosomes, 256 at most")
    local = atlas.store.spark.createDataFrame(list(enumerate(chroms)), "local_index long, chrom string")
    read = FragmentReader(frags, obs.select(F.col("obs").alias("row"), F.col(barcode).alias("barcode")))
    ingestor = Ingestor(atlas, dataset, read.n_rows, table)
    rows = read.rows().join(F.broadcast(local), "chrom").select("row", "local_index", "start", "length")
    ingestor.write_array(pointer, group, rows, read.n_rows, local.join(known, "chrom").select(F.col("uid").alias("feature_uid"), "local_index"))
    ingestor.write_obs_records(obs)
    return ingestor


def ingest_multimodal(atlas: Atlas, dataset: str, parts: dict[str, tuple[str, Reader, DataFrame | None, DataFrame | None]], obs: DataFrame, table: str | None = None) -> Ingestor:
    """Several modalities of one dataset. parts: pointer -> (group, reader, var, obs_index); obs has one row for each observation."""
    fields = S.pointers(T.StructType([f for f in atlas.obs(table).schema.fields if f.name != "_rowid"]))
    if unknown := set(parts) - set(fields):
        raise ValueError(f"no pointers {sorted(unknown)}")
    ingestor = Ingestor(atlas, dataset, obs.count(), table)
    for pointer, (group, reader, var, index) in parts.items():
        space = fields[pointer]
        features = None
        if var is not None:
            check_var(atlas, space, var)
            atlas.register_features(space, var.drop("local_index"))
            features = var.select(F.col("uid").alias("feature_uid"), "local_index")
        rows = reader.dense_rows() if S.SPACES[space].pointer == "dense" and hasattr(reader, "dense_rows") else reader.rows()
        ingestor.write_array(pointer, group, rows, reader.n_rows, features, index)
    ingestor.write_obs_records(obs)
    return ingestor


# feature-oriented copies

def add_csc(atlas: Atlas, space: str, groups: list[str] | None = None) -> list[str]:
    """Adds the copy by feature of groups that have none: sorted by feature and row, so few features read few row groups. Gives the groups."""
    return _copy(atlas, "copy", space, groups, ["zarr_group", "local_index", "zarr_row"])


def add_genome_sorted(atlas: Atlas, space: str = "chromatin_accessibility", groups: list[str] | None = None) -> list[str]:
    """Adds the copy by position of groups that have none: sorted by chromosome and start, so a region reads few row groups."""
    return _copy(atlas, "genome", space, groups, ["zarr_group", "local_index", "start"])


def _copy(atlas: Atlas, kind: str, space: str, groups: list[str] | None, order: list[str]) -> list[str]:
    name = f"{kind}.{space}"
    values = atlas.store.read(f"values.{space}")
    if missing := set(order) - set(values.columns):
        raise ValueError(f"{space} has no {sorted(missing)}")
    if atlas.store.version(name) < 0:
        atlas.store.create(name, values.schema)
    spark = atlas.store.spark
    have = atlas.store.read(name).select("zarr_group").distinct()
    want = values.select("zarr_group").distinct() if groups is None else spark.createDataFrame([(g,) for g in groups], "zarr_group string")
    new = want.join(have, "zarr_group", "left_anti")
    names = sorted(r.zarr_group for r in new.collect())  # of groups
    rows = values.join(new, "zarr_group", "left_semi")
    if names:
        if kind == "copy":
            gaps = rows.groupBy("zarr_group").agg(F.min("zarr_row").alias("low"))
            if gaps.where("low < 0").take(1):
                raise ValueError("rows must be numbered from 0")
        atlas.store.append(name, rows.repartitionByRange(*order[:2], order[2]).sortWithinPartitions(*order))
    atlas.refresh()
    return names


def covered(atlas: Atlas, kind: str, space: str, groups: DataFrame) -> bool:
    """Whether all groups (zarr_group) have a copy of the kind."""
    name = f"{kind}.{space}"
    return atlas.has(name) and not groups.join(atlas.read(name).select("zarr_group").distinct(), "zarr_group", "left_anti").take(1)


# generators

def synthetic_sparse(spark: SparkSession, n_rows: int, n_columns: int, density: float, layer: str = "counts", seed: int = 0) -> DataFrame:
    """Entries at about the density, each where a hash of its place says so; values are 1 plus a geometric number."""
    per = max(1, round(n_columns * density))
    slot = spark.range(n_rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("k"))
    column = F.pmod(F.xxhash64(F.lit(seed), "row", "k"), F.lit(n_columns))
    u = (F.pmod(F.xxhash64(F.lit(seed + 1), "row", "k"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    return slot.select("row", column.alias("local_index"), F.lit(layer).alias("layer"), (1 + F.floor(F.log(u) / F.log(F.lit(0.7)))).cast("double").alias("value")).dropDuplicates(["row", "local_index"])


def synthetic_dense(spark: SparkSession, n_rows: int, n_columns: int, layer: str, seed: int = 0) -> DataFrame:
    value = lambda i: F.pmod(F.xxhash64(F.lit(seed), "row", i), F.lit(1 << 20)) / float(1 << 20)
    return spark.range(n_rows).select(F.col("id").alias("row"), F.lit(layer).alias("layer"), F.transform(F.sequence(F.lit(0), F.lit(n_columns - 1)), value).alias("values"))
