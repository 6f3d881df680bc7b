"""Near-duplicate vectors by an exact metric range join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.llm.common import cut, parallelism, table, written
from quiltframe.llm.components import components, roots
from quiltframe.llm.op8_topk import _matrix

#: Slack for rounding wherever a bound decides, on distances between unit vectors; cosines decide links alone.
ROUNDING = 1e-6


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows that are already of length one, in doubles."""
    return a @ b.T


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, of very large and very small numbers too."""
    norm = np.linalg.norm(x, axis=1)
    big = ~((norm > 1e-100) & (norm < 1e100))
    if big.any():
        x[big] /= np.abs(x[big]).max(1)[:, None]
        norm[big] = np.linalg.norm(x[big], axis=1)
    return x / norm[:, None]


def _near_cells(unit: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, pivot, whether it is the nearest) for each cell that a vector is in or a vector within the radius may be in.

    The distance to the plane between the nearest pivot and another is half the
    difference of the squared distances over the pivots' own distance, which is
    at most 2: few pairs need that distance.
    """
    squared = np.maximum(0, 2 - 2 * _cosines(unit, pivots))
    home = squared.argmin(1)
    gap = squared - squared[np.arange(len(unit)), home][:, None]
    i, j = np.nonzero(gap <= 4 * radius + ROUNDING)
    apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", pivots[home[i]], pivots[j])))
    keep = (gap[i, j] <= 2 * radius * apart + ROUNDING) | (j == home[i])
    i, j = i[keep], j[keep]
    return i, j, j == home[i]


class Tree:
    """Pivots of unit length in two levels: about the square root of their number as centres, each pivot under its nearest."""

    def __init__(self, pivots: np.ndarray):
        self.centres = pivots[: math.isqrt(len(pivots))]
        under = _cosines(pivots, self.centres).argmax(1)
        self.leaves = [pivots[under == c] for c in range(len(self.centres))]
        self.first = np.cumsum([0, *map(len, self.leaves)])

    def cells(self, unit: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, cell, native): level by level all cells that a vector within the radius may be native to."""
        out = []
        i, c, own = _near_cells(unit, self.centres, radius)
        for k in np.unique(c):
            at = np.flatnonzero(c == k)
            x, leaf, home = _near_cells(unit[i[at]], self.leaves[k], radius)
            out.append((i[at][x], self.first[k] + leaf, own[at][x] & home))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near(vectors: DataFrame, cosine: float = 0.98, cell: int = 4_096, sample: int = 200_000) -> DataFrame:
    """Links between vectors (vec_id, embedding, label) of one label and cosine >= the threshold, below it none.

    Gives vec_id, n_links, component_id, kept for every row. On unit vectors
    cosine c is distance sqrt(2 - 2c) = r. Pivots, drawn for each label from a
    bounded sample (parameter) so that cells hold about ``cell`` vectors, part
    the space by nearest pivot, in a tree of two levels. A vector is copied
    into each other cell that a vector within r of it may be in: by the
    triangle inequality its distance to that cell's pivot exceeds the cell's
    radius by at most r, and the plane between the two pivots is at most r
    away. Each cell then finds the links of its own vectors alone, so no pair
    counts twice. Equal vectors of a label are one class with an id of its own
    and a weight, from the start.

    Null, zero, empty or non-finite vectors and null labels or vec_ids link
    with nothing; neither do vectors of unequal length. Rows that repeat a
    vec_id count one by one, each by its own vector, and each is returned. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + ROUNDING
    x = F.col("embedding")
    fit = F.col("vec_id").isNotNull() & x.isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows_ = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fit, F.col("label").cast("string")).alias("label"), F.when(fit, x).alias("embedding"))
    # -0.0 and 0.0 are equal vectors; grouping by values does not care about where a vector lies
    classes = rows_.where("label is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()))
    of_label = classes.groupBy("label").count()
    total = of_label.agg(F.sum("count").alias("n")).first().n
    if not total:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))

    # pivots: those of least hash, ceil(n / cell) for each label of more vectors than a cell has, all from a bounded sample
    n = {r.label: r["count"] for r in of_label.where(F.col("count") > cell).collect()}
    wanted = {k: min(math.ceil(v / cell), max(1, sample * v // total)) for k, v in n.items()}
    pivots: dict[str, list[np.ndarray]] = {}
    if wanted:
        share = F.broadcast(spark.createDataFrame([(k, min(1.0, 3 * v / n[k] + 30 / n[k])) for k, v in wanted.items()], "label string, share double"))
        drawn = classes.join(share, "label").withColumn("h", F.pmod(F.xxhash64("embedding", F.lit("pivot")), F.lit(1 << 30))).where(F.col("h") < F.col("share") * (1 << 30))
        for r in sorted(drawn.select("label", "h", "embedding").collect(), key=lambda r: (r.label, r.h, r.embedding)):
            if len(pivots.setdefault(r.label, [])) < wanted[r.label]:
                pivots[r.label].append(np.array(r.embedding, "f8"))
    trees = {k: Tree(_unit(np.stack(v))) for k, v in pivots.items() if len({len(p) for p in v}) == 1}
    sent = spark.sparkContext.broadcast(trees) if trees else None  # at most sample vectors, and their centres

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value if sent else {}
        for b in batches:
            labels = np.array(b.column(1).to_pylist(), object)
            names, vectors_ = b.column(1), b.column(2)
            lengths = np.diff(vectors_.offsets.to_numpy())
            matrix = None
            cell_, native, take = [], [], []
            for label in set(labels):
                at = np.flatnonzero(labels == label)
                tree = of.get(label)
                fits = np.zeros(len(at), bool) if tree is None else lengths[at] == tree.centres.shape[1]
                odd = at[~fits]  # no pivots, or another length: a cell of its own kind, cells are by length as well
                take.append(odd)
                cell_.append(np.zeros(len(odd), int))
                native.append(np.ones(len(odd), bool))
                at = at[fits]
                if not len(at):
                    continue
                if matrix is None:
                    matrix = _matrix(vectors_)
                i, j, own = tree.cells(_unit(matrix[at, : tree.centres.shape[1]].astype("f8")), radius)
                take.append(at[i])
                cell_.append(j)
                native.append(own)
            i = np.concatenate(take)
            t = pa.array(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(t), names.take(t), vectors_.take(t), b.column(3).take(t), pa.array(lengths[i].astype("i4")), pa.array(np.concatenate(cell_).astype("i4")), pa.array(np.concatenate(native))], ["id", "label", "embedding", "weight", "dims", "cell", "native"])

    placed = classes.select("id", "label", "embedding", "weight").mapInArrow(place, "id long, label string, embedding array<float>, weight long, dims int, cell int, native boolean".replace("array<float>", classes.schema["embedding"].dataType.simpleString()))
    # a cell is joined in blocks of bounded size: its own vectors by all its vectors
    sized = placed.groupBy("label", "dims", "cell").agg(F.count("*").alias("n"))
    block = 2 * cell
    split = placed.join(sized.where(F.col("n") > block), ["label", "dims", "cell"], "left")
    split = split.withColumn("parts", F.ceil(F.coalesce(F.col("n"), F.lit(1)) / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # block pair (i, j), i for the vectors whose links are counted: as i only natives go, once for each j; as j all go, once for each i
    left = split.where("native").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("label", "dims", "cell", F.col("mine").alias("i"), F.col("other").alias("j"), F.lit(True).alias("own"), "id", "weight", "embedding")
    right = split.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).where("not (native and other = mine)").select("label", "dims", "cell", F.col("other").alias("i"), F.col("mine").alias("j"), F.lit(False).alias("own"), "id", "weight", "embedding")

    def links(key: tuple, t: pa.Table) -> pa.Table:
        own = t["own"].to_numpy()
        ids, weight = t["id"].to_numpy(), t["weight"].to_numpy()
        unit = _unit(_matrix(t["embedding"]).astype("f8"))
        mine = np.flatnonzero(own)
        others = np.arange(len(ids)) if key[3] == key[4] else np.flatnonzero(~own)
        n_links = np.zeros(len(mine), np.int64)
        ea, eb = [], []
        for a in range(0, len(mine), 512):
            m = mine[a : a + 512]
            i, j = np.nonzero(_cosines(unit[m], unit[others]) >= cosine)
            differ = ids[m[i]] != ids[others[j]]
            i, j = i[differ], others[j[differ]]
            np.add.at(n_links, a + i, weight[j])
            if len(i):  # a spanning forest is enough for what is within reach
                nodes, root = roots(ids[m[i]], ids[j])
                ea.append(nodes)
                eb.append(root)
        a = np.concatenate([ids[mine], *ea])
        b = np.concatenate([np.full(len(mine), -1), *eb]).astype("i8")
        count = np.concatenate([n_links, np.zeros(len(a) - len(mine), np.int64)])
        kind = np.arange(len(a)) < len(mine)
        keep = kind | (a != b)
        return pa.table({"a": a[keep], "b": b[keep], "n": count[keep], "node": kind[keep]})

    found = left.unionByName(right).repartition(parallelism(spark), "label", "dims", "cell", "i", "j").groupBy("label", "dims", "cell", "i", "j").applyInArrow(links, "a long, b long, n long, node boolean")
    found = written(found)
    reach = components(found.where("not node").select("a", "b"))
    counted = found.where("node").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    rooted = written(classes.join(counted, "id").join(reach.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = rooted.join(least, "root").select("label", "embedding", F.lit(True).alias("of_class"), (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    return (
        rows_.join(by_class, ["label", "embedding"], "left")
        .select("vec_id", F.when(F.col("of_class"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings"))
