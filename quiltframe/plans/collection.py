"""From a collection of files to final tables and into an atlas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe import schema as S
from quiltframe import schema_code as C
from quiltframe.functions import text
from quiltframe.functions.ids import random_uid, stable_uid
from quiltframe.operators import keys as K
from quiltframe.sources import ingest, readers
from quiltframe.sources.atlas import Atlas

COLLECTION_TABLES = ("library", "publication", "publication_section", "dataset")


# staging

def table_name(dataset: str | None, tag: str) -> str:
    return tag if dataset is None else f"{dataset}.{tag}"


def stage(spark: SparkSession, c: readers.Collection, sep: str = ",") -> dict[str, DataFrame]:
    """The obs and var tables of each dataset's tagged files; a tag has one file a dataset."""
    out = {}
    for dataset, tags in c.datasets.items():
        for tag in tags:
            if tag.endswith(("_obs", "_var")) or tag in ("obs", "var"):
                out[table_name(dataset, tag)] = readers.delimited(spark, c.only(dataset, tag), sep)
    return out


def stage_records(spark: SparkSession, kind: str, records: list[dict]) -> DataFrame:
    """A table of the whole collection from a few records, all as text."""
    if kind not in COLLECTION_TABLES:
        raise ValueError(f"no such table: {kind!r}")
    names = list(dict.fromkeys(k for r in records for k in r))
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in records], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def seed_join(datasets: DataFrame, publications: DataFrame, key: str = "publication_key") -> tuple[DataFrame, DataFrame]:
    """Both with a key of 0, for a collection of one publication."""
    if publications.limit(2).count() > 1 and key not in datasets.columns:
        raise ValueError("several publications: the datasets must say which")
    seeded = [t if key in t.columns else t.withColumn(key, F.lit("0")) for t in (datasets, publications)]
    return seeded[0], seeded[1]


def discover(tables: dict[str, DataFrame], schemas: dict[str, T.StructType]) -> dict[str, list[str]]:
    """The staged tables of each schema: those of its name, with or without a dataset before it."""
    return {s: sorted(n for n in tables if n == s or n.rpartition(".")[2] == s) for s in schemas}


# finalisation

def assign_uids(df: DataFrame, schema: T.StructType, uid: str = "uid") -> DataFrame:
    """df with a uid in every row: what is there stays, else the stable uid of the marked source, else a random one."""
    marked = [f.name for f in schema.fields if f.metadata.get("stable_uid") and f.name in df.columns]
    new = F.when(F.col(marked[0]).isNotNull(), stable_uid(F.col(marked[0]))).otherwise(random_uid()) if marked else random_uid()
    have = F.nullif(F.trim(F.col(uid)), F.lit("")) if uid in df.columns else F.lit(None).cast("string")
    return df.withColumn(uid, F.coalesce(have, new))


def assign_groups(datasets: DataFrame, spaces: list[str]) -> DataFrame:
    """A row for each dataset and feature space with its group; what is there stays."""
    each = datasets.withColumn("feature_space", F.explode(F.array(*[F.lit(s) for s in spaces])))
    have = F.nullif(F.col("zarr_group"), F.lit("")) if "zarr_group" in datasets.columns else F.lit(None).cast("string")
    return each.withColumn("zarr_group", F.coalesce(have, F.concat_ws("/", "dataset_uid", "feature_space")))


def stamp_uid(space_obs: DataFrame, obs: DataFrame, key: str = "barcode") -> DataFrame:
    """A modality's rows with the uid of their obs row, by the key; one without is an error."""
    m = obs.select(text.join_key(F.col(key)).alias("__k"), F.col("uid").alias("__uid"))
    out = space_obs.drop("uid").withColumn("__k", text.join_key(F.col(key))).join(m, "__k", "left")
    bad = F.raise_error(F.concat(F.lit("no obs row has the key "), F.coalesce(F.col("__k"), F.lit("null"))))
    return out.withColumn("uid", F.when(F.col("__uid").isNull(), bad).otherwise(F.col("__uid"))).drop("__k", "__uid")


def artifact(obs: DataFrame, order: str) -> DataFrame:
    """The uids of a dataset of one modality in the order of its data."""
    return obs.select(F.col(order).cast("long").alias("row"), "uid")


def reconcile(spaces: list[DataFrame], column: str = "barcode") -> list[DataFrame]:
    """Each modality's rows with multimodal_barcode: barcodes as they agree best with the first's."""
    name, _ = K.barcodes(spaces, column)
    return [s.withColumn("multimodal_barcode", text.BARCODES[name](F.col(column))) for s in spaces]


def join_obs(spaces: dict[str, DataFrame], key: str = "multimodal_barcode") -> DataFrame:
    """One row for each observation of any modality; a single modality is left alone."""
    frames = list(spaces.values())
    return frames[0] if len(frames) == 1 else K.full_outer(frames, key)


def fill_keys(name: str, df: DataFrame, schemas: dict[str, T.StructType], done: dict[str, DataFrame]) -> DataFrame:
    """df with all its foreign keys: of a column c by c_key, a natural key of the target (its marked natural_key); key columns go.

    A list that is polymorphic goes by c_key and c_kind, a kind for each position.
    """
    natural = lambda t: next((f.name for f in schemas[t].fields if f.metadata.get("natural_key") or f.metadata.get("stable_uid")), None)
    for f in schemas[name].fields:
        to, many = f.metadata.get("registry_key"), f.metadata.get("polymorphic_registry_key")
        given = f"{f.name}_key"
        if given not in df.columns or not (to or many):
            continue
        if to:
            if natural(to) is None:
                raise ValueError(f"{to} has no natural key")
            df = K.fill(df.drop(f.name), given, f.name, done[to], natural(to)).drop(given)
        else:
            targets = {kind: (done[t], natural(t), "uid") for kind, t in many.items()}
            df = K.fill_lists(df.drop(f.name), "uid", f"{f.name}_kind", given, f.name, targets).drop(given)
    return df


def missing_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    """Required columns that are neither there nor filled in later."""
    later = C.deferred(schema)
    return [f.name for f in schema.fields if f.name not in df.columns and f.name not in later and not f.nullable]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: nullable ones that are missing are null, leftovers go, nulls where none may be are errors."""
    if bad := missing_columns(df, schema):
        raise ValueError(f"required columns are missing: {bad}")
    out = S.align(df, T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields]))
    for f in schema.fields:
        if not f.nullable and f.name not in C.deferred(schema):
            out = out.withColumn(f.name, F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"{f.name} is null"))).otherwise(F.col(f.name)))
    return out


def finalise(staged: dict[str, DataFrame], schemas: dict[str, T.StructType], auto: dict[str, Callable[[DataFrame], DataFrame]] | None = None, dataset: str | None = None) -> dict[str, DataFrame]:
    """Final tables by schema, those referred to first: uids, foreign keys, derived columns, the dataset's uid, the schema's columns.

    auto: functions that add derived columns, by table.
    """
    depends = {n: {t for t in _targets_of(s) if t in schemas and t != n} for n, s in schemas.items()}
    done: dict[str, DataFrame] = {}
    for name in K.order(depends):
        found = discover(staged, schemas)[name]
        if not found:
            continue
        df = staged[found[0]]
        for other in found[1:]:
            df = df.unionByName(staged[other], allowMissingColumns=True)
        df = assign_uids(df, schemas[name])
        df = fill_keys(name, df, schemas, done)
        if dataset is not None and "dataset_uid" in schemas[name].fieldNames():
            df = df.withColumn("dataset_uid", F.lit(dataset))
        if auto and name in auto:
            df = auto[name](df)
        done[name] = conform(df, schemas[name])
    return done


def _targets_of(schema: T.StructType) -> set[str]:
    from quiltframe.schema_ir import _targets

    return {t for f in schema.fields for t in _targets(f)}


# into an atlas

@dataclass
class LoaderResult:
    """What a loader gives for a modality: its reader, features (var), and optionally which obs rows its rows are."""

    reader: ingest.Reader
    var: DataFrame | None
    uids: DataFrame | None = None
    overrides: dict[str, object] = field(default_factory=dict)


@dataclass
class LoaderContext:
    spark: SparkSession
    dataset: str
    pointer: str
    files: dict[str, list[str]]


Loader = Callable[[LoaderContext], LoaderResult]


def obs_index(rows: DataFrame, obs: DataFrame) -> DataFrame:
    """row, obs of an artifact (row, uid): where each uid stands among the obs rows; one that is not there is an error."""
    out = rows.join(obs.select("uid", F.col("obs").alias("__o")), "uid", "left")
    bad = F.raise_error(F.concat(F.lit("no obs row has the uid "), F.col("uid")))
    return out.select("row", F.when(F.col("__o").isNull(), bad).otherwise(F.col("__o")).alias("obs"))


def check_loaded(r: LoaderResult, pointer: str) -> None:
    if r.reader is None or r.reader.n_rows < 0:
        raise ValueError(f"{pointer}: the loader gives no rows")
    if r.var is not None:
        n = r.var.agg(F.count("*").alias("n"), F.count("uid").alias("u"), F.countDistinct("local_index").alias("d")).first()
        if not n.n or n.n != n.u or n.n != n.d:
            raise ValueError(f"{pointer}: features without uid, or numbers twice")


def ingest_collection(atlas: Atlas, c: readers.Collection, tables: dict[str, DataFrame], obs: dict[str, DataFrame], loaders: dict[str, Loader], table: str | None = None) -> list[str]:
    """Registries first (new uids only), then every dataset that the atlas lacks; gives those ingested.

    tables: final tables of foreign keys by name. obs: obs rows by dataset, numbered in obs, with uid. loaders: by pointer.
    """
    if not loaders:
        raise ValueError("no loader")
    for name, rows in tables.items():
        if atlas.has(name):
            atlas.upsert(name, rows)
    there = {r.dataset_uid for r in atlas.read("datasets").select("dataset_uid").distinct().toLocalIterator()}
    out = []
    for dataset, files in c.datasets.items():
        if dataset in there:
            continue
        parts = {}
        for pointer, load in loaders.items():
            got = load(LoaderContext(atlas.store.spark, dataset, pointer, files))
            check_loaded(got, pointer)
            group = got.overrides.get("zarr_group", f"{dataset}/{pointer}")
            index = obs_index(got.uids, obs[dataset]) if got.uids is not None else None
            parts[pointer] = (group, got.reader, got.var, index)
        ingest.ingest_multimodal(atlas, dataset, parts, obs[dataset], table)
        out.append(dataset)
    return out
