"""The atlas: obs tables, registries, layouts, datasets, values and snapshots in one store."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe import schema as S
from quiltframe.operators import layouts as L
from quiltframe.plans.query import Query
from quiltframe.sources.store import Store, holding

S_, I_, B_ = T.StringType(), T.LongType(), T.BooleanType()


def _t(**f: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in f.items()])


DATASETS = _t(dataset_uid=S_, zarr_group=S_, feature_space=S_, layout_uid=S_, created_at=S_)
LAYOUTS = _t(layout_uid=S_, feature_uid=S_, local_index=I_, global_index=I_)
VERSIONS = _t(version=I_, tables=S_, total_rows=I_, created_at=S_)
SPARSE_VALUES = _t(zarr_group=S_, zarr_row=I_, local_index=I_, layer=S_, value=T.DoubleType())
DENSE_VALUES = _t(zarr_group=S_, position=I_, layer=S_, values=T.ArrayType(T.DoubleType()))
FRAGMENT_VALUES = _t(zarr_group=S_, zarr_row=I_, local_index=I_, start=I_, length=T.IntegerType())
SPATIAL_VALUES = _t(zarr_group=S_, layer=S_, origin=T.ArrayType(I_), shape=T.ArrayType(I_), dtype=S_, data=T.BinaryType())
REGISTRY = _t(uid=S_, global_index=I_)


def value_schema(space: str) -> T.StructType:
    """The columns of a feature space's value table."""
    spec = S.SPACES[space]
    if "fragments" in spec.endpoints:
        return FRAGMENT_VALUES
    return {"sparse": SPARSE_VALUES, "dense": DENSE_VALUES, "spatial": SPATIAL_VALUES}[spec.pointer]


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


class Atlas:
    """One handle; versions pins tables for time travel, and only a pinned atlas can be queried."""

    def __init__(self, store: Store, versions: dict[str, int] | None = None):
        self.store, self.versions = store, versions
        self.seen = {t: store.version(t) for t in store.tables()}

    @classmethod
    def create(cls, spark: SparkSession, root: str, obs: dict[str, T.StructType], registries: dict[str, T.StructType], extra: dict[str, T.StructType] | None = None) -> Atlas:
        """New tables for obs, features (by feature space), datasets, layouts, versions, values and foreign keys."""
        for schema in obs.values():
            S.check_obs(schema)
        named: dict[str, T.StructField] = {}
        for schema in obs.values():
            for f in schema.fields:
                if S.pointer_kind(f.dataType) and named.setdefault(f.name, f) != f:
                    raise ValueError(f"pointer {f.name!r} differs between obs tables")
        store = Store(spark, root)
        if store.tables():
            raise ValueError("an atlas is there already")
        for name, schema in obs.items():
            store.create(f"obs.{name}", T.StructType([*schema.fields, T.StructField("_rowid", I_)]))
        for space, schema in registries.items():
            extra_fields = [f for f in schema.fields if f.name not in ("uid", "global_index")]
            store.create(f"registry.{space}", T.StructType([*REGISTRY.fields, *extra_fields]))
        spaces = {s for schema in obs.values() for s in S.pointers(schema).values()} | set(registries)
        if lacking := [s for s in spaces if S.SPACES[s].has_features and s not in registries]:
            raise ValueError(f"no registry for {sorted(lacking)}")
        for space in sorted(spaces):
            store.create(f"values.{space}", value_schema(space))
        for name, schema in {"datasets": DATASETS, "layouts": LAYOUTS, "versions": VERSIONS, **(extra or {})}.items():
            store.create(name, schema)
        return cls(store)

    @classmethod
    def exists(cls, spark: SparkSession, root: str) -> bool:
        return Store(spark, root).version("datasets") >= 0

    @classmethod
    def create_or_open(cls, spark: SparkSession, root: str, obs: dict[str, T.StructType], registries: dict[str, T.StructType], extra: dict[str, T.StructType] | None = None) -> Atlas:
        """The atlas at root, made if there is none; one whose obs tables differ in columns is refused."""
        if not cls.exists(spark, root):
            return cls.create(spark, root, obs, registries, extra)
        atlas = cls.open(spark, root)
        for name, schema in obs.items():
            have = {f.name: f.dataType for f in atlas.obs(name).schema.fields if f.name != "_rowid"}
            if have != {f.name: f.dataType for f in schema.fields}:
                raise ValueError(f"obs table {name!r} is of another schema")
        return atlas

    def schemas(self) -> dict[str, T.StructType]:
        """Every table's schema."""
        return {t: self.read(t).schema for t in self.store.tables()}

    def has(self, table: str) -> bool:
        return table in self.versions if self.versions is not None else self.store.version(table) >= 0

    def find_datasets(self, space: str | None = None, dataset: str | None = None, group: str | None = None, layout: str | None = None) -> DataFrame:
        """The datasets that match all that is given."""
        out = self.read("datasets")
        for column, value in (("feature_space", space), ("dataset_uid", dataset), ("zarr_group", group), ("layout_uid", layout)):
            if value is not None:
                out = out.where(F.col(column) == value)
        return out

    def find_datasets_with_features(self, uids: list[str], space: str | None = None) -> DataFrame:
        return L.datasets_with(self.read("layouts"), self.read("datasets"), uids, space)

    def list_datasets(self) -> DataFrame:
        return self.read("datasets").orderBy("dataset_uid", "zarr_group")

    def layout(self, group: str, space: str) -> DataFrame:
        """feature_uid, local_index, global_index of a group, by local index; features without number are an error."""
        got = self.find_datasets(space, group=group).select("layout_uid").join(self.read("layouts"), "layout_uid").select("feature_uid", "local_index", "global_index").orderBy("local_index")
        if got.where("global_index is null").take(1):
            raise ValueError(f"features of {group} have no number: optimise the atlas")
        return got

    def table(self, name: str) -> DataFrame:
        """A table of foreign keys, as create's extra names it."""
        if name in ("datasets", "layouts", "versions") or "." in name or not self.has(name):
            raise KeyError(name)
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, key: str = "uid") -> int:
        """Adds rows of a table of foreign keys whose key is new; gives how many."""
        new = L.insert_absent(self.table(name), rows, key)
        n = new.count()
        if n:
            self.store.append(name, S.align(new, self.store.read(name).schema))
        return n

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Atlas:
        store = Store(spark, root)
        if store.version("datasets") < 0:
            raise FileNotFoundError(f"no atlas at {root}")
        return cls(store)

    def read(self, table: str) -> DataFrame:
        if self.versions is not None and table in self.versions:
            return self.store.read(table, self.versions[table])
        return self.store.read(table)

    def obs_name(self, name: str | None = None) -> str:
        names = [t[4:] for t in self.store.tables() if t.startswith("obs.")]
        if name is None and len(names) != 1:
            raise ValueError(f"which of {names}?")
        if name is not None and name not in names:
            raise KeyError(name)
        return name or names[0]

    def obs(self, name: str | None = None) -> DataFrame:
        return self.read(f"obs.{self.obs_name(name)}")

    def registry(self, space: str) -> DataFrame:
        return self.read(f"registry.{space}")

    # writing

    def register_features(self, space: str, features: DataFrame) -> int:
        """Adds features whose uid is new; gives how many."""
        target = self.registry(space)
        with holding(L.insert_absent(target, features.withColumn("global_index", F.lit(None).cast("long")))) as rows:
            n = rows.count()
            if n:
                self.store.append(f"registry.{space}", rows)
        return n

    def register_dataset(self, dataset: str, group: str, space: str, features: DataFrame | None) -> str | None:
        """Adds a dataset and, if new, its layout: features (feature_uid, local_index). Gives the layout's uid."""
        layout = None
        if self.read("datasets").where((F.col("feature_space") == space) & (F.col("zarr_group") == group)).take(1):
            raise ValueError(f"{space} has group {group!r} already")
        if features is not None:
            with holding(features.select("feature_uid", "local_index")) as features:
                if lost := [r.feature_uid for r in L.missing_features(features, self.registry(space)).take(5)]:
                    raise KeyError(f"not in the registry: {lost}")
                if features.groupBy("feature_uid").count().where("count > 1").take(1):
                    raise ValueError("a feature is there twice")
                layout = L.content_uid(features)
                if not self.read("layouts").where(F.col("layout_uid") == layout).take(1):
                    rows = features.join(self.registry(space).select(F.col("uid").alias("feature_uid"), "global_index"), "feature_uid", "left")
                    self.store.append("layouts", rows.withColumn("layout_uid", F.lit(layout)).withColumn("local_index", F.col("local_index").cast("long")))
        row = self.store.spark.createDataFrame([(dataset, group, space, layout, _now())], DATASETS)
        self.store.append("datasets", row)
        return layout

    def add_obs(self, rows: DataFrame, name: str | None = None) -> int:
        """Appends obs rows aligned to the table's schema: uids must be new, set and unique."""
        table = f"obs.{self.obs_name(name)}"
        have = self.store.read(table)
        with holding(S.align(rows, T.StructType([f for f in have.schema.fields if f.name != "_rowid"]))) as rows:
            r = rows.agg(F.count("*").alias("n"), F.countDistinct("uid").alias("d"), F.count("uid").alias("u")).first()
            if r.n != r.d or r.n != r.u:
                raise ValueError("uids are null or not unique")
            if known := [r.uid for r in rows.select("uid").join(have.select("uid"), "uid", "left_semi").take(5)]:
                raise ValueError(f"uids are there already: {known}")
            top = have.agg(F.coalesce(F.max("_rowid"), F.lit(-1)).alias("m")).first()["m"]
            numbered = L.ranked(rows, "uid", "_rowid").withColumn("_rowid", F.col("_rowid") + top + 1)
            return self.store.append(table, S.align(numbered, have.schema))

    def add_values(self, space: str, values: DataFrame) -> int:
        return self.store.append(f"values.{space}", values)

    def optimize(self) -> None:
        """Numbers new features and copies the numbers into layouts; each table becomes one folder."""
        for t in self.store.tables():
            if t.startswith("registry."):
                n = self.store.version(t)
                with holding(L.first_of(self.store.read(t), "uid", "global_index")) as rows:
                    self.store.rewrite(t, L.reindex(rows), n)
        every = None  # the copy of a feature that has a number stays; only copies without one go
        for t in (x for x in self.store.tables() if x.startswith("registry.")):
            r = self.store.read(t).select("uid", "global_index")
            every = r if every is None else every.unionByName(r)
        if every is not None:
            n = self.store.version("layouts")
            self.store.rewrite("layouts", L.sync(self.store.read("layouts"), every.dropDuplicates(["uid"])), n)
        for t in self.store.tables():
            if t.startswith(("obs.", "values.")):  # many small folders become one
                n = self.store.version(t)
                if len(self.store.manifest(t, n)["folders"]) > 1:
                    rows = self.store.read(t)
                    order = [c for c in ("zarr_group", "zarr_row", "position", "_rowid") if c in rows.columns][:2]
                    self.store.rewrite(t, rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows, n)
        self.refresh()

    def refresh(self) -> None:
        self.seen = {t: self.store.version(t) for t in self.store.tables()}

    def validate(self) -> list[str]:
        """What is wrong: features without number, twice or unknown, pointers into groups that no dataset has, rows without values."""
        out = []
        groups = self.read("datasets").select("zarr_group", "feature_space")
        layouts = self.read("layouts")
        for t in self.store.tables():
            if t.startswith("registry."):
                r = self.read(t).agg(F.count("*").alias("n"), F.countDistinct("uid").alias("d"), F.count_if(F.col("global_index").isNull()).alias("u"), F.countDistinct("global_index").alias("g")).first()
                if r.n != r.d or r.n - r.u != r.g:
                    out.append(f"{t}: uids or numbers are not unique")
                if r.u:
                    out.append(f"{t}: {r.u} features have no number")
            if t.startswith("obs."):
                obs = self.read(t)
                for p, space in S.pointers(T.StructType([f for f in obs.schema.fields if f.name != "_rowid"])).items():
                    lost = obs.select(F.col(f"{p}.zarr_group").alias("zarr_group")).where("zarr_group is not null").distinct().join(groups.where(F.col("feature_space") == space), "zarr_group", "left_anti").count()
                    if lost:
                        out.append(f"{t}.{p}: {lost} groups are of no dataset")
        r = layouts.agg(F.count("*").alias("n"), F.countDistinct("layout_uid", "feature_uid").alias("d"), F.count_if(F.col("global_index").isNull()).alias("u")).first()
        if r.n != r.d:
            out.append("layouts: a feature is there twice")
        if r.u:
            out.append(f"layouts: {r.u} features have no number")
        return out

    # versions

    def snapshot(self) -> int:
        """Records the versions of all tables; refused for a stale handle and for an atlas with faults."""
        now = {t: self.store.version(t) for t in self.store.tables()}
        if any(now[t] != v for t, v in self.seen.items() if t != "versions"):
            raise RuntimeError("the handle is stale: refresh it")
        if faults := self.validate():
            raise ValueError("; ".join(faults))
        versions = self.store.read("versions")
        n = versions.agg(F.coalesce(F.max("version"), F.lit(-1)).alias("m")).first()["m"] + 1
        total = sum(self.read(t).count() for t in now if t.startswith("obs."))
        row = self.store.spark.createDataFrame([(n, json.dumps({t: v for t, v in now.items() if t != "versions"}), total, _now())], VERSIONS)
        self.store.append("versions", row)
        return n

    def list_versions(self) -> DataFrame:
        return self.store.read("versions").orderBy("version")

    def _pinned(self, version: int | None) -> dict[str, int]:
        rows = self.store.read("versions").select("version", "tables").collect()  # one for each snapshot
        if not rows:
            raise ValueError("there is no snapshot")
        want = max(r.version for r in rows) if version is None else version
        got = [r.tables for r in rows if r.version == want]
        if not got:
            raise ValueError(f"there is no snapshot {version}")
        return json.loads(got[0])

    def checkout(self, version: int | None = None) -> Atlas:
        """A read-only atlas as of a snapshot, the newest by default."""
        return Atlas(self.store, self._pinned(version))

    def restore(self, version: int) -> None:
        """Makes a snapshot's tables the newest; nothing is lost."""
        for t, v in self._pinned(version).items():
            if self.store.version(t) != v:
                self.store.restore(t, v)
        self.refresh()

    def query(self, name: str | None = None) -> Query:
        if self.versions is None:
            raise RuntimeError("check out a snapshot first")
        return Query(self, self.obs_name(name))
