"""Packing of documents into windows by lexical retrieval."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.llm import bpe
from quiltframe.llm.common import chunked, frugal, rows, table, written

VOCAB = 1 << 16
#: Shards are numbered within their task, and sequences within their shard.
TASK_BITS, SHARD_BITS = 44, 20


def counted(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of each document, ascending, one document after another; how often it has them; where each document ends."""
    key = np.repeat(np.arange(len(ids), dtype=np.uint64) << np.uint64(16), [len(x) for x in ids]) | np.concatenate(ids)
    key = key.astype(np.uint32) if len(ids) <= VOCAB else key
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    key = key[first].astype(np.int64)
    return key & (VOCAB - 1), n, np.searchsorted(key >> 16, np.arange(len(ids)), "right")


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n and ids (16-bit, zstd by Parquet) of every text, and for each task the documents and document frequencies of all ids (n < 0)."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, df, n_docs, n_ids = bpe.library_encoder(path, False), np.zeros(VOCAB, np.int64), 0, 0
        for keys, texts in rows(batches, "doc_id", "text"):
            for k, t in chunked(500, keys, texts):
                out = [raw + end for raw in enc.encode(t)]
                df += np.bincount(counted([np.frombuffer(raw, "<u2") for raw in out])[0], minlength=VOCAB)
                n_docs += len(out)
                n_ids += sum(map(len, out)) // 2
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([len(x) // 2 for x in out], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([n_ids], pa.int64()), pa.array([-1 - n_docs], pa.int64()), pa.array([zlib.compress(df.astype("<i8").tobytes(), 1)], pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(frugal(run, True), "doc_id long, n long, ids binary")


def frequencies(tokens: DataFrame) -> tuple[int, int, np.ndarray]:
    """Documents, tokens and the document frequency of each id, over all documents; summed task by task, then by shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, ids = np.zeros(VOCAB, np.int64), 0, 0
        for n_ids, n, raw in rows(batches, "doc_id", "n", "ids"):
            for a, b, c in zip(n_ids, n, raw, strict=True):
                ids += a
                docs += -1 - b
                df += np.frombuffer(zlib.decompress(c), "<i8")
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [docs, ids]))], ["id", "n"])

    got = tokens.where("n < 0").mapInArrow(frugal(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # an id of the vocabulary each
    df, whole = np.zeros(VOCAB, np.int64), {-1: 0, -2: 0}
    for r in got:
        if r.id < 0:
            whole[r.id] = r.n
        else:
            df[r.id] = r.n
    return whole[-1], whole[-2], df


class Shard:
    """An inverted index over some documents with BM25 scores by the statistics of all.

    terms: how many of a seed's terms, those of highest weight, ask for neighbours; None is all.
    Terms that more than one document in 16 has are dense rows, at most ROWS_MB of them, which are summed faster.
    """

    ROWS_MB = 64

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float, terms: int | None = None, k1: float = 1.2, b: float = 0.75):
        self.ids, self.idf, self.terms = ids, idf, terms
        self.length = np.array([len(x) for x in ids], np.int64)
        n = len(ids)
        pair = np.concatenate([x.astype(np.int64) for x in ids]) * n + np.repeat(np.arange(n), self.length) if n else np.zeros(0, np.int64)
        pair.sort()
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(pair)))
        term, self.doc = np.divmod(pair[first], max(n, 1))
        self.start = np.searchsorted(term, np.arange(VOCAB + 1))
        norm = k1 * (1 - b + b * self.length[self.doc] / max(mean, 1.0))
        self.impact = (idf[term] * tf * (k1 + 1) / (tf + norm)).astype(np.float32)
        self.doc = self.doc.astype(np.int32)
        df = np.diff(self.start)
        often = np.flatnonzero(df * 16 > max(n, 1))
        often = often[np.argsort(-df[often], kind="stable")[: self.ROWS_MB * 250_000 // max(n, 1)]]
        self.row = np.full(VOCAB, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.float32)
        for r, k in enumerate(often):
            s = slice(self.start[k], self.start[k + 1])
            self.dense[r, self.doc[s]] = self.impact[s]
        self.used = np.zeros(n, bool)
        self.live = np.arange(n)  # what the index still holds
        self.next = 0

    def shrink(self) -> None:
        """Takes used documents out of the index once they are a quarter of it."""
        keep = ~self.used[self.live]
        if 4 * np.count_nonzero(keep) > 3 * len(keep):
            return
        new = np.cumsum(keep, dtype=np.int32) - 1
        there = keep[self.doc]
        self.start = np.concatenate([[0], np.cumsum(there)])[self.start]
        self.doc, self.impact = new[self.doc[there]], self.impact[there]
        self.dense, self.live = np.compress(keep, self.dense, axis=1), self.live[keep]

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of each document of live for the seed's terms, 0 for used ones."""
        t, tf = np.unique(self.ids[seed].astype(np.int64), return_counts=True)
        if self.terms is not None and len(t) > self.terms:
            weight = self.idf[t] * tf / (tf + 1.2)
            t = t[np.argsort(-weight, kind="stable")[: self.terms]]
        self.shrink()
        row = self.row[t]
        t = t[row < 0]
        n = self.start[t + 1] - self.start[t]
        at = np.arange(n.sum()) + np.repeat(self.start[t] - np.cumsum(n) + n, n)
        score = np.bincount(self.doc[at], self.impact[at], len(self.live)).astype(np.float32)
        for r in row[row >= 0]:
            score += self.dense[r]
        score[self.used[self.live]] = 0
        return score

    def ordered(self, seed: int, head: int = 64) -> Iterator[np.ndarray]:
        """Unused documents that share a query term with the seed, best first, ties by place: the best head of them, then the others."""
        score = self.scores(seed)
        some = np.flatnonzero(score)
        score, some = score[some], self.live[some]
        if len(some) > 4 * head:
            first = score >= np.partition(score, len(some) - head)[len(some) - head]
            yield some[first][np.argsort(-score[first], kind="stable")]
            score, some = score[~first], some[~first]
        yield some[np.argsort(-score, kind="stable")]

    def neighbours(self, seed: int) -> np.ndarray:
        """All that ordered() gives."""
        return np.concatenate(list(self.ordered(seed)))

    def any(self) -> int:
        """The first unused document, -1 if none is left."""
        while self.next < len(self.used) and self.used[self.next]:
            self.next += 1
        return self.next if self.next < len(self.used) else -1

    def pack(self, window: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset) of each piece.

        A seed opens a window and its neighbours fill it greedily. What of a
        document does not fit opens the next window, as its seed. The last,
        partly filled window is cut into sequences of powers of two.
        """
        out: list[tuple[int, int, int, int, int]] = []
        sequence, room, queue = 0, window, iter(())
        pending = (-1, 0)  # a document begun
        while True:
            if pending[0] >= 0:
                doc, start = pending
                if room == window and self.length[doc] - start < window:
                    queue = (int(x) for part in self.ordered(doc) for x in part)
            else:
                near = next((x for x in queue if not self.used[x]), -1) if room < window else -1
                doc, start = (near, 0) if near >= 0 else (self.any(), 0)
                if doc < 0:
                    break
                self.used[doc] = True
                if near < 0 and self.length[doc] < room:
                    queue = (int(x) for part in self.ordered(doc) for x in part)
            take = int(min(room, self.length[doc] - start))
            out.append((doc, start, take, sequence, window - room))
            room -= take
            pending = (doc, start + take) if start + take < self.length[doc] else (-1, 0)
            if not room:
                sequence, room = sequence + 1, window
        yield from (p for p in out if p[3] < sequence)
        left = window - room
        last = [p for p in out if p[3] == sequence]
        offset = 0
        while left:  # powers of two, largest first
            size = 1 << (left.bit_length() - 1)
            need = size
            while need:
                doc, start, take, _, _ = last.pop(0)
                part = min(need, take)
                yield doc, start, part, sequence, size - need
                need -= part
                if part < take:
                    last.insert(0, (doc, start + part, take - part, 0, 0))
            sequence, left, offset = sequence + 1, left - size, offset + size


def _vectors(ids: list[np.ndarray], idf: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Random projections of the documents' weighted terms, of length 1."""
    v = np.zeros((len(ids), base.shape[1]), np.float32)
    for at in range(0, len(ids), 500):
        t, tf, end = counted(ids[at : at + 500])
        weight, lo = (idf[t] * tf / (tf + 1.2)).astype(np.float32), 0
        for k, hi in enumerate(end.tolist(), at):
            v[k] = weight[lo:hi] @ base[t[lo:hi]]
            lo = hi
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _base(dims: int = 64) -> np.ndarray:
    return np.random.default_rng(6).standard_normal((VOCAB, dims), np.float32)


Tree = dict[int, tuple[np.ndarray, float]]


def split(v: np.ndarray, tokens: np.ndarray, most: float) -> tuple[Tree, dict[int, tuple[int, int]]]:
    """Cuts between two means each until no side has more than so many tokens; the place of each leaf among all and its shard.

    Neighbouring leaves share a shard while they fit.
    """
    tree: Tree = {}
    shard: dict[int, tuple[int, int]] = {}
    held, no = 0.0, 0
    todo = [(1, np.arange(len(v)))]
    while todo:
        p, at = todo.pop()
        size = float(tokens[at].sum())
        if size > most and len(at) >= 16:
            x = v[at]
            right = (x - x.mean(0)) @ np.linalg.svd(np.cov(x.T))[0][:, 0] > 0
            for _ in range(20):
                if right.all() or not right.any():
                    break
                a, b = x[~right].mean(0), x[right].mean(0)
                right, before = x @ (b - a) > (a + b) @ (b - a) / 2, right
                if (right == before).all():
                    break
            if right.any() and not right.all():
                a, b = x[~right].mean(0), x[right].mean(0)
                tree[p] = (b - a, float((a + b) @ (b - a) / 2))
                todo += [(2 * p + 1, at[right]), (2 * p, at[~right])]
                continue
        if held and held + size > most:
            held, no = 0.0, no + 1
        held += size
        shard[p] = (len(shard), no)
    return tree, shard


def leaves(v: np.ndarray, tree: Tree) -> list[int]:
    out = [1] * len(v)
    todo = [(1, np.arange(len(v)))]
    while todo:
        p, at = todo.pop()
        if p in tree and len(at):
            right = v[at] @ tree[p][0] > tree[p][1]
            todo += [(2 * p + 1, at[right]), (2 * p, at[~right])]
        else:
            for i in at.tolist():
                out[i] = p
    return out


def routed(tokens: DataFrame, weights, n_docs: int, n_ids: int, shard_tokens: int) -> DataFrame:
    """doc_id, ids and shard, documents of like terms together; a shard lies in one partition, in an order that no file split changes.

    The cuts are learned from a sample, of which the driver gets 64 numbers a document.
    """
    most = 0.875 * shard_tokens  # room for what the sample does not show
    kept = tokens.where("n >= 0").select("doc_id", "n", "ids")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = _base()
        for n, raw in rows(batches, "n", "ids"):
            v = _vectors([np.frombuffer(r, "<u2") for r in raw], weights.value, base)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array([x.tobytes() for x in v], pa.binary())], ["n", "v"])

    tree, shard = {}, {1: (0, 0)}
    if n_ids > shard_tokens:
        share = min(1.0, max(8_000, min(100_000, 32 * n_ids / most)) / n_docs)
        got = kept.where(F.pmod(F.xxhash64("ids"), F.lit(1_000_000)) < share * 1_000_000).select("n", "ids").mapInArrow(frugal(project), "n long, v binary").collect()  # at most about 100,000
        got.sort(key=lambda r: (r.n, r.v))
        if got:
            n = np.array([r.n for r in got], float)
            tree, shard = split(np.stack([np.frombuffer(r.v, np.float32) for r in got]), n * (n_ids / n.sum()), most)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = _base() if tree else None
        for keys, raw in rows(batches, "doc_id", "ids"):
            p = leaves(_vectors([np.frombuffer(r, "<u2") for r in raw], weights.value, base), tree) if tree else [1] * len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(raw, pa.binary()), pa.array([shard[x][0] for x in p], pa.int32()), pa.array([shard[x][1] for x in p], pa.int32())], ["doc_id", "ids", "leaf", "shard"])

    parts = 1 + max(no for _, no in shard.values())
    there = kept.mapInArrow(frugal(route), "doc_id long, ids binary, leaf int, shard int").repartitionById(parts, F.col("shard"))
    return there.sortWithinPartitions("shard", "leaf", "doc_id", F.xxhash64("ids")).select("doc_id", "ids", "shard")


def pack(docs: DataFrame, window: int = 4096, path: str | None = None, end_id: int = 2, shard_tokens: int = 12_000_000) -> DataFrame:
    """Pieces of every document of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents become ids once, which are kept in the shared folder together with
    each task's document frequencies; BM25 weighs terms by the sums over all
    documents, and all terms of a seed ask. The index is sharded, so memory is
    bounded: documents of like terms go to one shard of about shard_tokens ids
    (one that is larger is cut), and a seed's neighbours come from its shard. Every id lies in exactly one piece; windows are full but
    for a shard's last, which is cut into powers of two, so nothing is padded.
    A document longer than a window fills several. Null and empty texts are
    their end id alone; repeated rows are packed one by one; an empty table
    gives no rows.
    """
    path = path or bpe.default_path("word_bpe_49k.json")
    tokens = written(tokenised(docs, path, end_id))
    n_docs, n_ids, df = frequencies(tokens)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = n_ids / max(1, n_docs)
    weights = docs.sparkSession.sparkContext.broadcast(idf)  # a number for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, no, keys, ids, held, last = TaskContext.get().partitionId(), 0, [], [], 0, -1

        def flush() -> Iterator[pa.RecordBatch]:
            base = task << TASK_BITS | no << SHARD_BITS
            pieces = list(Shard(ids, weights.value, mean).pack(window))
            for (part,) in chunked(20_000, pieces):
                doc, start, length, sequence, offset = (np.array(x) for x in zip(*part, strict=True))
                crc = [zlib.crc32(ids[d][s : s + n].astype("<u4")) for d, s, n, _, _ in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[d] for d in doc], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array([len(ids[d]) for d in doc], pa.int64()), pa.array(base + sequence), pa.array(offset)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

        for k, raw, shards in rows(batches, "doc_id", "ids", "shard"):
            for key, r, shard in zip(k, raw, shards, strict=True):
                if ids and (held + len(r) // 2 > shard_tokens or shard != last):
                    yield from flush()
                    no, keys, ids, held = no + 1, [], [], 0
                last = shard
                keys.append(key)
                ids.append(np.frombuffer(r, "<u2"))
                held += len(r) // 2
        if ids:
            yield from flush()

    return routed(tokens, weights, n_docs, n_ids, shard_tokens).mapInArrow(frugal(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
