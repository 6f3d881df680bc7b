"""Results in memory and access for training: what a query gives to analysis and to loaders.

A result is as large as the rows that the query asks for, by the caller's
choice; batches are put together in Spark and fetched one after another, so
the driver holds one batch and what is fetched ahead.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltframe import schema as S
from quiltframe.functions.batches import DenseBatch, MultiBatch, SparseBatch, SpatialBatch
from quiltframe.operators import intervals, keys
from quiltframe.operators.images import array_of
from quiltframe.plans.query import Query
from quiltframe.sources.store import kept

ENDPOINTS: dict[str, Callable] = {}


def endpoint(name: str) -> Callable:
    """Registers a terminal method for the feature spaces that list it."""
    def add(f: Callable) -> Callable:
        ENDPOINTS[name] = f
        return f

    return add


@dataclass
class Annotated:
    """obs and var as frames, a batch of rows in the order of obs; x is its first layer."""

    obs: pd.DataFrame
    var: pd.DataFrame
    batch: SparseBatch | DenseBatch

    @property
    def x(self) -> np.ndarray:
        return next(iter(self.batch.layers.values()))


@dataclass
class Fragments:
    """Fragments sorted by cell, chromosome and start, with offsets of cells."""

    obs: pd.DataFrame
    chromosomes: list[str]
    chromosome: np.ndarray
    start: np.ndarray
    length: np.ndarray
    offsets: np.ndarray

    def end_max(self, block: int = 128) -> np.ndarray:
        """The largest end in each block of so many fragments: what a reader skips by."""
        ends = self.start + self.length
        return np.maximum.reduceat(ends, np.arange(0, len(ends), block)) if len(ends) else ends


@dataclass
class Multimodal:
    obs: pd.DataFrame
    present: dict[str, np.ndarray]
    parts: dict[str, Annotated | Fragments | SpatialBatch] = field(default_factory=dict)


def _ordered(obs: DataFrame) -> pd.DataFrame:
    return obs.toPandas().reset_index(drop=True)


def to_arrow(q: Query):
    """Metadata alone."""
    return q.obs().toArrow()


def packed(q: Query, pointer: str) -> tuple[DataFrame, DataFrame, int]:
    """A row for each uid that has the pointer: columns in order and values of each layer; var; and the width."""
    m = q.matrix(pointer)
    names = list(m.layers)
    long = None
    for name, v in m.layers.items():
        v = v.select("uid", "column", F.col("value").alias(name))
        long = v if long is None else long.join(v, ["uid", "column"], "full_outer")
    both = F.array_sort(F.collect_list(F.struct("column", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])))
    rows = long.groupBy("uid").agg(both.alias("__e")).select("uid", F.col("__e.column").alias("indices"), *[F.col(f"__e.{n}").alias(n) for n in names])
    return rows, m.var, m.var.count()


def _sparse(rows: pd.DataFrame, uids: list, names: list[str], width: int, meta: dict[str, np.ndarray]) -> SparseBatch:
    at = {u: i for i, u in enumerate(rows["uid"])}
    order = [at.get(u) for u in uids]
    size = [0 if i is None else len(rows["indices"].iloc[i]) for i in order]
    pick = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.asarray(rows[c].iloc[i], kind) for i in order if i is not None)])
    return SparseBatch(pick("indices", "i8"), np.append(0, np.cumsum(size)).astype("i8"), {n: pick(n, "f8") for n in names}, width, meta)


def batch_of(q: Query, pointer: str, rows: pd.DataFrame, uids: list, width: int, meta: dict[str, np.ndarray]) -> SparseBatch | DenseBatch:
    space = q._pointers()[pointer]
    names = [c for c in rows.columns if c not in ("uid", "indices")]
    b = _sparse(rows, uids, names, width, meta)
    return b if S.SPACES[space].pointer == "sparse" else DenseBatch({n: b.dense(n) for n in names}, width, meta)


@endpoint("matrix")
def to_anndata(q: Query, pointer: str | None = None) -> Annotated:
    """One matrix modality of the rows that have it."""
    able = [f for f, s in q.active().items() if "matrix" in S.SPACES[s].endpoints]
    if pointer is None and len(able) != 1:
        raise ValueError(f"which of {able}?")
    pointer = pointer or able[0]
    rows, var, width = packed(q, pointer)
    obs = _ordered(q.rows([pointer]).select("uid", *[c for c in q.obs().columns if c != "uid"]))
    return Annotated(obs, _ordered(var.orderBy("column")), batch_of(q, pointer, rows.toPandas(), list(obs["uid"]), width, {}))


def to_mudata(q: Query) -> dict[str, Annotated]:
    """Every modality that is a matrix; others are left out with a warning."""
    out = {}
    for f, s in q.active().items():
        if "matrix" in S.SPACES[s].endpoints:
            out[f] = to_anndata(q, f)
        else:
            warnings.warn(f"{f} is no matrix and left out", stacklevel=2)
    return out


@endpoint("fragments")
def to_fragments(q: Query, pointer: str = "chromatin_accessibility", region: tuple[str, int, int] | None = None) -> Fragments:
    """The fragments of the rows, sorted by cell, chromosome and start."""
    obs = _ordered(q.rows([pointer]).select("uid", *[c for c in q.obs().columns if c != "uid"]))
    got = q.fragments(pointer, region)
    names = [r.chrom for r in got.select("chrom").distinct().orderBy(*intervals.chromosome_order(F.col("chrom"))).collect()]  # of an assembly
    t = got.toPandas()
    cell = t["uid"].map({u: i for i, u in enumerate(obs["uid"])}).to_numpy(dtype="i8")
    chrom = t["chrom"].map({c: i for i, c in enumerate(names)}).to_numpy(dtype="i8")
    start, length = t["start"].to_numpy(dtype="i8"), t["length"].to_numpy(dtype="i8")
    o = np.lexsort((length, start, chrom, cell))
    return Fragments(obs, names, chrom[o], start[o], length[o], np.searchsorted(cell[o], np.arange(len(obs) + 1)))


@endpoint("spatial")
def to_spatial_batch(q: Query, pointer: str, chunk: tuple[int, ...]) -> SpatialBatch:
    """The crops of the rows, each of its own shape."""
    obs = _ordered(q.rows([pointer]).select("uid"))
    layers: dict[str, dict[str, np.ndarray]] = {}
    for r in q.crops(pointer, chunk).collect():  # the rows that the caller asks for
        layers.setdefault(r.layer, {})[r.uid] = array_of(r)
    return SpatialBatch({k: [v[u] for u in obs["uid"]] for k, v in layers.items()}, {"uid": obs["uid"].to_numpy()})


def to_multimodal(q: Query, chunk: tuple[int, ...] = (64, 64)) -> Multimodal:
    """All active fields of all rows, with masks of who has what: fragments before crops before matrices, as a space allows."""
    fields = q.active()
    obs = _ordered(keys.presence(q.rows(), list(fields)).drop("_rowid", *[c for c in q._pointers()]))
    out = Multimodal(obs.drop(columns=[f"has_{f}" for f in fields]), {f: obs[f"has_{f}"].to_numpy(dtype=bool) for f in fields})
    for f, s in fields.items():
        if out.present[f].any():
            able = S.SPACES[s].endpoints
            out.parts[f] = to_fragments(q, f) if "fragments" in able else to_spatial_batch(q, f, chunk) if "spatial" in able and S.SPACES[s].pointer == "spatial" else to_anndata(q, f)
    return out


def batch_rows(q: Query, pointer: str, size: int) -> tuple[DataFrame, DataFrame, int]:
    """batch, position, uid, metadata, columns and values of each row, rows without entries too; var; and the width."""
    rows, var, width = packed(q, pointer)
    there = keys.batches(q.rows([pointer]), size, "_rowid")
    meta = [c for c in q.obs().columns if c != "uid"]
    return there.select("batch", "position", "uid", *meta).join(rows, "uid", "left"), var, width


def to_batches(q: Query, size: int, pointer: str | None = None) -> Iterator[Annotated]:
    """Results of so many rows each, one after another; the column space is that of the whole query."""
    able = [f for f, s in q.active().items() if "matrix" in S.SPACES[s].endpoints]
    if pointer is None and len(able) != 1:
        raise ValueError(f"which of {able}?")
    pointer = pointer or able[0]
    rows, var, width = batch_rows(q, pointer, size)
    names, frame = [c for c in rows.columns], _ordered(var.orderBy("column"))
    layers = [c for c in names if c not in {"batch", "position", "uid", "indices", *q.obs().columns}]
    for held in grouped(rows.orderBy("batch", "position"), "batch"):
        t = pd.DataFrame(held, columns=names)
        t["indices"] = [x if isinstance(x, list) else [] for x in t["indices"]]
        for n in layers:
            t[n] = [x if isinstance(x, list) else [] for x in t[n]]
        b = batch_of(q, pointer, t[["uid", "indices", *layers]], list(t["uid"]), width, {})
        yield Annotated(t[["uid", *[c for c in q.obs().columns if c != "uid"]]], frame, b)


def grouped(rows: DataFrame, by: str) -> Iterator[list]:
    """The rows of each value of a column one after another, of rows ordered by it."""
    held: list = []
    for r in rows.toLocalIterator(prefetchPartitions=True):
        if held and r[by] != held[0][by]:
            yield held
            held = []
        held.append(r)
    if held:
        yield held


class UnimodalDataset:
    """Rows of one modality by their number among the query's rows, values and metadata with them.

    take gives the rows asked for, in that order, repeats too; epoch walks
    through all rows in an order that seed and epoch give, in batches.
    """

    def __init__(self, q: Query, pointer: str, metadata: list[str] | None = None, size: int = 64, seed: int = 0, drop_last: bool = False):
        self.q, self.pointer, self.size, self.seed, self.drop_last = q, pointer, size, seed, drop_last
        self.metadata = [c for c in q.obs().columns if c != "uid"] if metadata is None else metadata
        self.rows, var, self.n_features = batch_rows(q, pointer, 1)
        self.rows = kept(self.rows.withColumnRenamed("batch", "ordinal").drop("position"))  # every epoch and take reads them
        self.var = var

    def __len__(self) -> int:
        return self.q.rows([self.pointer]).count()

    def _batch(self, held: list) -> SparseBatch | DenseBatch:
        t = pd.DataFrame(held, columns=self.columns)
        layers = [c for c in self.columns if c not in {"ordinal", "uid", "indices", "turn", "__batch", *self.q.obs().columns}]
        for c in ("indices", *layers):
            t[c] = [x if isinstance(x, list) else [] for x in t[c]]
        t["__key"] = range(len(t))  # rows may repeat
        meta = {c: t[c].to_numpy() for c in ("uid", *self.metadata)}
        rows = t[["__key", "indices", *layers]].rename(columns={"__key": "uid"})
        return batch_of(self.q, self.pointer, rows, list(t["__key"]), self.n_features, meta)

    @property
    def columns(self) -> list[str]:
        return self._columns

    def take(self, ordinals: list[int]) -> SparseBatch | DenseBatch:
        spark = self.rows.sparkSession
        asked = spark.createDataFrame(list(enumerate(ordinals)), "turn int, ordinal long")
        got = asked.join(self.rows, "ordinal", "left").orderBy("turn")
        held = got.collect()  # the rows asked for
        if missing := [r.ordinal for r in held if r.uid is None]:
            raise IndexError(f"no rows {missing[:5]}")
        self._columns = got.columns
        return self._batch(held)

    def epoch(self, n: int) -> Iterator[SparseBatch | DenseBatch]:
        shuffled = keys.shuffled(self.rows, "ordinal", self.seed, n)
        numbered = keys.batches(shuffled, self.size, "order").withColumnRenamed("batch", "__batch").withColumnRenamed("position", "turn").drop("order")
        whole = len(self) // self.size
        for held in grouped(numbered.orderBy("__batch", "turn"), "__batch"):
            if self.drop_last and held[0]["__batch"] >= whole:
                return
            self._columns = numbered.columns
            yield self._batch(held)


class MultimodalDataset:
    """Rows of several modalities; a row may lack some, and nothing is filled in."""

    def __init__(self, q: Query, pointers: list[str], metadata: list[str] | None = None, size: int = 64, seed: int = 0, drop_last: bool = False):
        self.q, self.pointers, self.size, self.seed, self.drop_last = q, pointers, size, seed, drop_last
        self.parts = {p: UnimodalDataset(q, p, []) for p in pointers}
        self.metadata = [c for c in q.obs().columns if c != "uid"] if metadata is None else metadata
        obs = keys.presence(q.rows(), pointers)
        self.obs = keys.batches(obs, 1, "_rowid").withColumnRenamed("batch", "ordinal").select("ordinal", "uid", *self.metadata, *[f"has_{p}" for p in pointers])

    def __len__(self) -> int:
        return self.q.rows().count()

    def _batch(self, held: list) -> MultiBatch:
        present = {p: np.array([r[f"has_{p}"] for r in held], bool) for p in self.pointers}
        spark = self.obs.sparkSession
        parts = {}
        for p, data in self.parts.items():
            uids = [r.uid for r, there in zip(held, present[p], strict=True) if there]
            asked = spark.createDataFrame(list(enumerate(uids)), "turn int, uid string")
            got = asked.join(data.rows, "uid").orderBy("turn")
            data._columns = got.columns
            parts[p] = data._batch(got.collect())  # a batch
        return MultiBatch({c: np.array([r[c] for r in held], object) for c in ("uid", *self.metadata)}, present, parts)

    def take(self, ordinals: list[int]) -> MultiBatch:
        spark = self.obs.sparkSession
        held = spark.createDataFrame(list(enumerate(ordinals)), "turn int, ordinal long").join(self.obs, "ordinal", "left").orderBy("turn").collect()  # the rows asked for
        if missing := [r.ordinal for r in held if r.uid is None]:
            raise IndexError(f"no rows {missing[:5]}")
        return self._batch(held)

    def epoch(self, n: int) -> Iterator[MultiBatch]:
        numbered = keys.batches(keys.shuffled(self.obs, "ordinal", self.seed, n), self.size, "order").drop("order")
        whole = len(self) // self.size
        for held in grouped(numbered.orderBy("batch", "position"), "batch"):
            if self.drop_last and held[0]["batch"] >= whole:
                return
            yield self._batch(held)


def make_loader(data: UnimodalDataset | MultimodalDataset, epochs: int = 1, workers: int = 0, transform: Callable | None = None) -> Iterator:
    """Batches of some epochs one after another; Spark fetches ahead by itself, so workers are not needed."""
    if workers:
        warnings.warn("an iterable dataset takes no workers", stacklevel=2)
    for n in range(epochs):
        for b in data.epoch(n):
            yield transform(b) if transform else b
