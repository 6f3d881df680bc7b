"""N-dimensional arrays in chunks, and crops of them by boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "zarr_group string, layer string, origin array<bigint>, shape array<bigint>, dtype string, data binary"
CROPS = "box long, layer string, shape array<bigint>, dtype string, data binary"


def chunks(spark: SparkSession, group: str, layer: str, array: np.ndarray, size: tuple[int, ...]) -> DataFrame:
    """The chunks of an array in memory."""
    def each() -> Iterator[tuple]:
        for at in np.ndindex(*[-(-n // s) for n, s in zip(array.shape, size, strict=True)]):
            origin = [a * s for a, s in zip(at, size, strict=True)]
            part = np.ascontiguousarray(array[tuple(slice(o, o + s) for o, s in zip(origin, size, strict=True))])
            yield group, layer, origin, list(part.shape), str(part.dtype), part.tobytes()

    return spark.createDataFrame(list(each()), CHUNKS)


def crops(boxes: DataFrame, stored: DataFrame, chunk: tuple[int, ...]) -> DataFrame:
    """The crop of each box (box, zarr_group, min_corner, max_corner): half-open, of the leading axes, trailing ones whole.

    A box meets its chunks by an equi-join on the chunk's place along the
    leading axis, filtered on the others; each crop is put together in one
    group, which holds the chunks of one box and layer. What no chunk covers is 0.
    """
    first = chunk[0]
    lo, hi = F.col("min_corner"), F.col("max_corner")
    some = boxes.where((F.size(lo) == F.size(hi)) & F.forall(F.zip_with(lo, hi, lambda a, b: a < b), lambda x: x))
    placed = some.withColumn("__c", F.explode(F.sequence(F.floor(lo[0] / first), F.floor((hi[0] - 1) / first))))
    own = stored.withColumn("__c", F.floor(F.col("origin")[0] / first))
    inside = F.forall(F.sequence(F.lit(0), F.size(lo) - 1), lambda k: (F.get("origin", k) < F.get(hi, k)) & (F.get("origin", k) + F.get("shape", k) > F.get(lo, k)))
    met = placed.join(own, ["zarr_group", "__c"]).where(inside).select("box", "layer", "min_corner", "max_corner", "origin", "shape", "dtype", "data")

    def stitch(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        a, b = list(parts.min_corner.iloc[0]), list(parts.max_corner.iloc[0])
        rank = len(a)
        tail = [max(o[k] + s[k] for o, s in zip(parts.origin, parts["shape"], strict=True)) for k in range(rank, len(parts.origin.iloc[0]))]
        out = np.zeros([*(y - x for x, y in zip(a, b, strict=True)), *tail], parts.dtype.iloc[0])
        a = [*a, *[0] * len(tail)]
        for o, s, d in zip(parts.origin, parts["shape"], parts.data, strict=True):
            got = np.frombuffer(d, out.dtype).reshape(list(s))
            start = [max(x, y) for x, y in zip(a, o, strict=True)]
            end = [min(x + n, y + m) for x, n, y, m in zip(a, out.shape, o, s, strict=True)]
            out[tuple(slice(p - x, q - x) for p, q, x in zip(start, end, a, strict=True))] = got[tuple(slice(p - y, q - y) for p, q, y in zip(start, end, o, strict=True))]
        return pd.DataFrame({"box": [key[0]], "layer": [key[1]], "shape": [list(out.shape)], "dtype": [str(out.dtype)], "data": [out.tobytes()]})

    return met.groupBy("box", "layer").applyInPandas(stitch, CROPS)


def array_of(row) -> np.ndarray:
    return np.frombuffer(row.data, row.dtype).reshape(list(row["shape"]))
