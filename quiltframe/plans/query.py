"""A lazy query over one obs table; terminal methods give DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe import schema as S
from quiltframe.operators import images, intervals, keys, layouts, limits, ragged, search

if TYPE_CHECKING:
    from quiltframe.sources.atlas import Atlas


class _Ingest:
    """The ingestion module, imported when first used, as it imports the atlas."""

    def __getattr__(self, name: str) -> object:
        from quiltframe.sources import ingest as module

        return getattr(module, name)


ingest = _Ingest()


@dataclass(frozen=True)
class Matrix:
    """A result: obs, var (features by column) and long entries (uid, column, value) of each layer."""

    obs: DataFrame
    var: DataFrame
    layers: dict[str, DataFrame]

    @property
    def x(self) -> DataFrame:
        return next(iter(self.layers.values()))


@dataclass(frozen=True)
class Query:
    """Each method gives a new query. where replaces an earlier where; filters by by_* methods add up and stay."""

    atlas: Atlas
    name: str
    predicate: str | None = None
    semi: tuple = ()
    columns: tuple[str, ...] | None = None
    n: int | None = None
    skip: int = 0
    even: tuple[int, str] | None = None
    spaces: tuple[str, ...] | None = None
    fields: tuple[str, ...] | None = None
    layer_names: dict[str, tuple[str, ...]] = field(default_factory=dict)
    wanted: dict[str, tuple[str, ...]] = field(default_factory=dict)
    join: str = "union"
    look: tuple | None = None

    def where(self, predicate: str) -> Query:
        return replace(self, predicate=predicate)

    def select(self, columns: list[str]) -> Query:
        if not isinstance(columns, (list, tuple)):
            raise TypeError("select takes a list")
        return replace(self, columns=tuple(columns))

    def limit(self, n: int) -> Query:
        if self.even:
            raise ValueError("limit and balanced_limit exclude each other")
        return replace(self, n=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def balanced_limit(self, n: int, column: str) -> Query:
        if self.n is not None:
            raise ValueError("limit and balanced_limit exclude each other")
        return replace(self, even=(n, column))

    def feature_spaces(self, *spaces: str) -> Query:
        if bad := set(spaces) - set(self._pointers().values()):
            raise ValueError(f"no pointer to {sorted(bad)}")
        return replace(self, spaces=spaces)

    def select_fields(self, *fields: str) -> Query:
        if bad := set(fields) - set(self._pointers()):
            raise ValueError(f"no pointer {sorted(bad)}")
        return replace(self, fields=fields)

    def layers(self, space: str, names: list[str]) -> Query:
        if bad := set(names) - set(S.SPACES[space].layers):
            raise KeyError(f"{space} has no layer {sorted(bad)}")
        return replace(self, layer_names={**self.layer_names, space: tuple(names)})

    def features(self, uids: list[str], space: str) -> Query:
        return replace(self, wanted={**self.wanted, space: tuple(dict.fromkeys(uids))})

    def feature_join(self, how: str) -> Query:
        if how not in ("union", "intersection"):
            raise ValueError(f"no such join: {how!r}")
        return replace(self, join=how)

    def search(self, query: object, column: str, kind: str = "auto", metric: str = "l2") -> Query:
        """By vector (a list of numbers), by words, or "hybrid" with a pair (numbers, words) and (vector column, text column)."""
        kind = ("vector" if isinstance(query, (list, tuple)) else "fts") if kind == "auto" else kind
        if kind not in ("vector", "fts", "hybrid"):
            raise ValueError(f"no such search: {kind!r}")
        return replace(self, look=(kind, query, column, metric))

    def by_members(self, column: str, *sets: DataFrame) -> Query:
        """Rows whose uid list meets each of the sets (uid)."""
        return replace(self, semi=(*self.semi, lambda df: keys.having_all(df, column, list(sets))))

    def by_dataset(self, datasets: DataFrame) -> Query:
        """Rows of the datasets (dataset_uid), by a semi-join; none, no rows."""
        return replace(self, semi=(*self.semi, lambda df: df.join(datasets.select("dataset_uid").distinct(), "dataset_uid", "left_semi")))

    def controls_only(self, kind: str | None = None) -> Query:
        test = F.col("is_negative_control") & (F.col("negative_control_type") == kind if kind else F.lit(True))
        return replace(self, semi=(*self.semi, lambda df: df.where(test)))

    # planning

    def _pointers(self) -> dict[str, str]:
        schema = self.atlas.obs(self.name).schema
        return S.pointers(T.StructType([f for f in schema.fields if f.name != "_rowid"]))

    def active(self) -> dict[str, str]:
        """Pointer -> feature space: the fields chosen, else the spaces chosen, else those that features name, else all."""
        every = self._pointers()
        if self.fields is not None:
            return {f: every[f] for f in self.fields}
        spaces = self.spaces or tuple(self.wanted) or tuple(every.values())
        return {f: s for f, s in every.items() if s in spaces}

    def _filtered(self, present: list[str] = ()) -> DataFrame:
        df = self.atlas.obs(self.name)
        for f in self.semi:
            df = f(df)
        if self.predicate:
            df = df.where(F.expr(self.predicate))
        for p in present:
            df = df.where(F.col(f"{p}.zarr_group").isNotNull())
        return df

    def rows(self, present: list[str] = ()) -> DataFrame:
        """The obs rows of the query, pointers and _rowid included."""
        df = self._filtered(present)
        if self.look:
            kind, q, column, metric = self.look
            k = (self.n if self.n is not None else 1_000_000) + self.skip
            if kind == "vector":
                df = search.vector_top(df, column, list(q), k, "_rowid", metric)
            elif kind == "fts":
                df = search.text_top(df, column, str(q).split(), k, "_rowid")
            else:
                v = search.vector_top(df, column[0], list(q[0]), k, "_rowid", metric)
                t = search.text_top(df, column[1], str(q[1]).split(), k, "_rowid")
                df = df.join(search.hybrid_top(v, t, "_rowid", k), "_rowid")
            order: list[Column] = [F.col("_distance")] if kind == "vector" else [F.desc("_score")] if kind == "fts" else [F.desc("_relevance")]
            df = df.orderBy(*order, "_rowid")
            df = df.offset(self.skip) if self.skip else df
            return df.limit(self.n) if self.n is not None else df
        if self.even:
            return limits.balanced(df, *self.even, "_rowid")
        return limits.page(df, "_rowid", self.n, self.skip)

    # terminal methods

    def obs(self) -> DataFrame:
        """Metadata without pointers and scores."""
        df = self.rows()
        hidden = {*self._pointers(), "_rowid", "_score", "_relevance"}
        names = [c for c in df.columns if c not in hidden and (self.columns is None or c in self.columns or c in ("uid", "_distance"))]
        return df.select(*names)

    def count(self, by: list[str] | None = None) -> int | DataFrame:
        """Rows, or rows by group; limits and searches count, a balanced limit does not."""
        df = replace(self, even=None).rows()
        return limits.counted(df, by) if by else df.count()

    def matrix(self, pointer: str | None = None) -> Matrix:
        """One modality: values over the union or intersection of what the datasets of the rows measure, or over the features asked for."""
        able = {f: s for f, s in self.active().items() if S.SPACES[s].has_features and "matrix" in S.SPACES[s].endpoints}
        if pointer is None and len(able) != 1:
            raise ValueError(f"which of {sorted(able)}?")
        f = pointer or next(iter(able))
        space = able[f]
        spec = S.SPACES[space]
        rows = self.rows([f])
        at = rows.select("uid", f"{f}.*")
        groups = at.select("zarr_group").distinct()
        data = self.atlas.read("datasets").where(F.col("feature_space") == space).join(groups, "zarr_group", "left_semi").select(F.col("zarr_group").alias("dataset"), "layout_uid")
        bridge = self.atlas.read("layouts").join(data, "layout_uid")
        registry = self.atlas.registry(space)
        if space in self.wanted:  # whatever the join, the features asked for are the columns
            from pyspark.sql import Window

            got = layouts.resolve(registry, list(self.wanted[space]))
            cols = got.select("global_index", (F.row_number().over(Window.orderBy("global_index")) - 1).alias("column"))
        else:
            cols = ragged.feature_space(bridge, how=self.join)
        var = cols.join(registry, "global_index").orderBy("column")
        by_feature = False
        if spec.pointer == "sparse" and space in self.wanted and self.atlas.has(f"copy.{space}"):
            by_feature = ragged.use_feature_copy(at.count(), len(self.wanted[space]), ingest.covered(self.atlas, "copy", space, groups))
        values = self.atlas.read(f"{'copy' if by_feature else 'values'}.{space}").withColumnRenamed("zarr_group", "dataset")
        if by_feature:  # few features: their groups and numbers come first, so few row groups are read
            wanted = bridge.join(cols.select("global_index"), "global_index").select("dataset", "local_index").distinct()
            values = values.join(F.broadcast(wanted) if len(self.wanted[space]) <= 10_000 else wanted, ["dataset", "local_index"], "left_semi")
        out = {}
        for layer in self.layer_names.get(space, spec.must):
            v = values.where(F.col("layer") == layer)
            if spec.pointer == "sparse":
                own = v.join(at.select("uid", F.col("zarr_group").alias("dataset"), "zarr_row"), ["dataset", "zarr_row"])
                out[layer] = ragged.sparse(own, bridge, cols)
            else:
                own = v.join(at.select("uid", F.col("zarr_group").alias("dataset"), "position"), ["dataset", "position"])
                out[layer] = ragged.dense(own.withColumnRenamed("values", "value"), bridge, cols)
        hidden = {*self._pointers()}
        return Matrix(rows.select(*[c for c in rows.columns if c not in hidden and not c.startswith("_")]), var, out)

    def modalities(self) -> dict[str, Matrix]:
        """Every modality that is a matrix."""
        return {f: self.matrix(f) for f, s in self.active().items() if "matrix" in S.SPACES[s].endpoints}

    def multimodal(self) -> tuple[DataFrame, dict[str, Matrix]]:
        """obs with has_<pointer> for every row, and each modality that any row has."""
        obs = keys.presence(self.rows(), list(self.active()))
        there = obs.agg(*[F.max(f"has_{f}").alias(f) for f in self.active()]).first()
        able = [f for f, s in self.active().items() if "matrix" in S.SPACES[s].endpoints and there[f]]
        return obs, {f: self.matrix(f) for f in able}

    def fragments(self, pointer: str = "chromatin_accessibility", region: tuple[str, int, int] | None = None) -> DataFrame:
        """uid, chrom, start, length of the fragments of the rows, on all chromosomes or those that overlap a half-open region.

        A region reads the copy by position where all groups of the rows have one.
        """
        space = self._pointers()[pointer]
        at = self.rows([pointer]).select("uid", f"{pointer}.*").select("uid", "zarr_group", "zarr_row")
        groups = at.select("zarr_group").distinct()
        genome = region is not None and ingest.covered(self.atlas, "genome", space, groups)
        v = self.atlas.read(f"{'genome' if genome else 'values'}.{space}")
        names = self.atlas.registry(space).select(F.col("uid").alias("feature_uid"), F.col("sequence_name").alias("chrom"))
        local = self.atlas.read("datasets").where(F.col("feature_space") == space).join(self.atlas.read("layouts"), "layout_uid").join(names, "feature_uid").select("zarr_group", "local_index", "chrom")
        if region is not None:
            chrom, start, end = region
            local = local.where(F.col("chrom") == chrom)
            v = v.where((F.col("start") < end) & (F.col("start") + F.col("length") > start))
        return v.join(local, ["zarr_group", "local_index"]).join(at, ["zarr_group", "zarr_row"]).select("uid", "chrom", "start", "length")

    def crops(self, pointer: str, chunk: tuple[int, ...]) -> DataFrame:
        """uid, layer, shape, dtype, data: the crop that each row's pointer names; chunk is the shape of the stored chunks."""
        space = self._pointers()[pointer]
        at = self.rows([pointer]).select("uid", F.xxhash64("uid").alias("box"), f"{pointer}.*")
        got = images.crops(at.select("box", "zarr_group", "min_corner", "max_corner"), self.atlas.read(f"values.{space}"), chunk)
        return at.select("uid", "box").join(got, "box").drop("box")

    def batches(self, size: int) -> DataFrame:
        """Metadata with batch and position."""
        return keys.batches(self.rows(), size, "_rowid")

    def overlapping(self, frags: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
        return intervals.region(frags, chrom, start, end)
