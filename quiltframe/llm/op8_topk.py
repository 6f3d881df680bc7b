"""Exact inner-product top-k over an impact-ordered index."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiltframe.llm.common import parallelism, shared_folder, table, written

#: Levels of quantised impact: each holds about as many postings.
LEVELS = 16
#: Bounds are first tried when so large a share of the postings is added up.
FIRST = 0.4
#: What scoring a pair afresh costs, by adding up one of its postings.
RESCORE = 160


def quantised(vectors: DataFrame, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and impacts: floor(scale * x) of each component. Vectors that are null or hold null or non-finite components are left out, as are rows without key."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & F.col(key).isNotNull() & finite).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("impacts"))


def _matrix(impacts: pa.Array) -> np.ndarray:
    """Rows of impacts; shorter ones end in zeros."""
    impacts = impacts.combine_chunks() if isinstance(impacts, pa.ChunkedArray) else impacts
    lengths = np.diff(impacts.offsets.to_numpy())
    dims = int(lengths.max(initial=0))
    flat = impacts.flatten().to_numpy(zero_copy_only=False)
    if dims and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


class Index:
    """The impact-ordered postings of one block of vectors.

    A posting is a vector's component, its impact the component's magnitude,
    quantised to levels. Segments, one for each level and dimension, go by
    descending level. rest[l] is the length of what each vector has below level l.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.largest = float(np.abs(x).max(initial=0))
        size = np.abs(x)
        cuts = np.unique(np.quantile(size[size > 0], np.arange(LEVELS)[::-1] / LEVELS)) if (size > 0).any() else np.zeros(0)
        self.segments: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        self.rest = []
        upper = np.inf
        for low in cuts[::-1]:
            level = (size >= low) & (size < upper)
            some = []
            for d in np.flatnonzero(level.any(0)):
                at = np.flatnonzero(level[:, d])
                some.append((int(d), at, x[at, d]))
            self.segments.append(some)
            self.rest.append(np.sqrt(np.where(size < low, x * x, 0).sum(1)))
            upper = low
        self.sizes = [sum(len(at) for _, at, _ in some) for some in self.segments]
        self.order = np.argsort(ids, kind="stable")
        self.added = self.rescored = self.pairs = 0  # postings added and pairs scored afresh, of so many pairs

    def top(self, queries: np.ndarray, qids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k highest scores of each query, ties to the smaller id.

        Score at a time: segment by segment all accumulators of its vectors
        grow. What is left of a vector changes its score by at most |query|
        |rest| (Cauchy-Schwarz). The k best so far, scored exactly, give a floor
        that the k-th score can't be below; vectors whose bound is below that
        are out, by proof, and the work stops when scoring the possible members
        afresh costs less than the segments that remain. Ends with exact scores of all possible members.
        """
        x, ids, n, m = self.x, self.ids, len(self.ids), len(qids)
        none = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
        if not n or not m:
            return none
        most = max(self.largest, 1) * max(np.abs(queries).max(initial=0), 1) * max(x.shape[1], 1)
        if most >= 2**53:  # beyond exact doubles: whole numbers of any size, saturated at 64 bits
            xs, qs = ([[int(v) for v in r] for r in y] for y in (x, queries))
            exact = [[max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, r, strict=True)))) for r in xs] for q in qs]
            return _choose(np.array(exact, np.int64).reshape(m, n), qids, ids, k)
        kind = np.float32 if most < 2**24 else np.float64
        q = queries.T.astype(kind)  # a row for each dimension
        acc = np.zeros((n, m), kind)
        first = np.searchsorted(ids[self.order], qids, "left")
        last = np.searchsorted(ids[self.order], qids, "right")
        for i in np.flatnonzero(last > first):
            acc[self.order[first[i] : last[i]], i] = -np.inf  # never its own answer
        length = np.linalg.norm(queries, axis=1)
        total = sum(self.sizes)
        self.pairs += n * m
        floor, done = None, 0
        for level, some in enumerate(self.segments):
            for d, at, value in some:
                acc[at] += value.astype(kind)[:, None] * q[d]
            done += self.sizes[level]
            self.added += self.sizes[level] * m
            if done < FIRST * total or n <= k:
                continue
            if floor is None:
                by_query = np.ascontiguousarray(acc.T)
                best = np.argpartition(by_query, n - k, axis=1)[:, n - k :]
                exact = np.einsum("ikd,id->ik", x[best], queries)
                exact[np.isneginf(np.take_along_axis(by_query, best, 1))] = -np.inf
                floor = exact.min(1)
                self.rescored += best.size
                at_least = (floor - 1e-5 * (1 + np.abs(floor) + length * self.rest[level].max())).astype(kind)
            possible = acc + np.multiply.outer(self.rest[level].astype(kind), length.astype(kind)) >= at_least
            if np.count_nonzero(possible) * RESCORE <= (total - done) * m:
                break
        else:  # all added up: the scores are exact, but for a floor that never was
            possible = acc >= at_least if floor is not None else np.ones(acc.shape, bool)
        possible = (possible & ~np.isneginf(acc)).T
        i, j = np.nonzero(possible)
        if done == total:
            score = acc[j, i].astype(np.int64)
        else:
            score = np.empty(len(i), np.int64)
            for at in range(0, len(i), 50_000):
                some = slice(at, at + 50_000)
                score[some] = np.einsum("ij,ij->i", queries[i[some]], x[j[some]]).astype(np.int64)
            self.rescored += len(i)
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        take = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[take], j[take], score[take]


def top_of_block(queries: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k highest scores of each query in one block of impacts: see :meth:`Index.top`."""
    return Index(ids, x).top(queries, qids, k)


def _choose(score: np.ndarray, qids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out: tuple[list, list, list] = ([], [], [])
    for i in range(len(qids)):
        rows = np.flatnonzero(ids != qids[i])
        rows = rows[np.lexsort((ids[rows], -score[i, rows]))[:k]]
        out[0].extend([i] * len(rows))
        out[1].extend(rows)
        out[2].extend(score[i, rows])
    return np.array(out[0], int), np.array(out[1], int), np.array(out[2], np.int64)


def _blocks(vectors: DataFrame, size: int, folder: str) -> DataFrame:
    """name, n: blocks of at most size vectors, each a file in the shared folder that its readers open by name.

    A retried task writes files of new names; only those whose names come back count.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        ids, held = [], []

        def block(k: int) -> pa.RecordBatch:
            nonlocal ids, held
            i = np.concatenate(ids)
            dims = max(m.shape[1] for m in held)
            x = np.concatenate([np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in held])
            ids, held = ([i[k:]], [x[k:]]) if k < len(i) else ([], [])
            name = uuid.uuid4().hex
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}") as f:
                narrow = np.abs(x[:k]).max(initial=0) <= 32_000
                f.write(np.array([len(i[:k]), dims, narrow], "<i8").tobytes() + i[:k].astype("<i8").tobytes() + x[:k].astype("<i2" if narrow else "<f8").tobytes())
            return pa.RecordBatch.from_pydict({"name": [name], "n": [len(i[:k])]})

        for b in batches:
            ids.append(b.column(0).to_numpy())
            held.append(_matrix(b.column(1)))
            while sum(map(len, ids)) >= size:
                yield block(size)
        if sum(map(len, ids)):
            yield block(size)

    return written(vectors.mapInArrow(pack, "name string, n long"))


def _open(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        raw = f.read()
    n, dims, narrow = np.frombuffer(raw, "<i8", 3).astype(int)
    return np.frombuffer(raw, "<i8", n, 24), np.frombuffer(raw, "<i2" if narrow else "<f8", n * dims, 24 + 8 * n).reshape(n, dims).astype(np.float64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 16_384, query_block: int = 512) -> DataFrame:
    """The k rows of vectors of highest integer inner product for each query, exactly: query_id, rank, vec_id, score.

    Both take (vec_id, impacts) as :func:`quantised` gives. Blocks of bounded
    size are files of the shared folder; only their names are joined, so a task
    holds one block's index and one block of queries at a time. A block gives k
    rows a query, which are merged by query. A row of the query's own vec_id is
    never its answer; a vec_id that is there twice may be answered twice. Fewer
    than k rows: all. Vectors of unequal length count as ending in zeros. No
    vectors: no rows.
    """
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/impacts-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    packed, asked = _blocks(vectors, block, folder), _blocks(queries, query_block, folder)
    # queries come in slices, so that few blocks are many tasks; a task makes the index of its block once
    n = packed.count()
    slices = max(1, min(asked.count(), -(-4 * parallelism(spark) // max(1, n))))
    slice_ = F.pmod(F.xxhash64("name"), F.lit(slices)).cast("int")
    sent = asked.select(F.col("name").alias("asked"), slice_.alias("slice"))
    met = packed.select("name", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")).join(sent, "slice").repartition(min(60_000, max(1, n * slices)), "name", "slice").sortWithinPartitions("name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, index = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["name"] != name:
                    name, index = r["name"], Index(*_open(folder, r["name"]))
                qids, q = _open(folder, r["asked"])
                dims = max(q.shape[1], index.x.shape[1])
                if index.x.shape[1] < dims:
                    index = Index(index.ids, np.pad(index.x, ((0, 0), (0, dims - index.x.shape[1]))))
                q = np.pad(q, ((0, 0), (0, dims - q.shape[1])))
                for at in range(0, len(qids), 128):
                    i, j, score = index.top(q[at : at + 128], qids[at : at + 128], k)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[at + i]), pa.array(index.ids[j]), pa.array(score)], ["query_id", "vec_id", "score"])

    found = met.select("name", "asked").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
      from v a, v b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
