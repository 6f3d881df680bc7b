"""Token-ID files: flat unsigned integers with 64-bit offsets, memory-mapped."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.llm import bpe
from quiltframe.llm.common import chunked, parallelism, rows, shared_folder, table, u32crc

#: A shard is three flat files: <name>.bin with the ids (little-endian unsigned 16-bit if the vocabulary
#: allows, which .idx tells), <name>.idx with 64-bit offsets (one more than documents), <name>.key with 64-bit keys.
MAGIC = b"QFTOK001"
#: The key of documents without doc_id; no other document may have it.
NO_KEY = -(2**63)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shard(folder: str, name: str, keys: list[int], ids: Iterator[bytes]) -> tuple[int, int]:
    """Writes one shard under its own temporary names and then renames it; gives documents and tokens."""
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    tmp, offsets = f"{root}/.{name}-{uuid.uuid4().hex}", [0]
    with fs.open_output_stream(f"{tmp}.bin") as out:
        for raw in ids:
            out.write(raw)
            offsets.append(offsets[-1] + len(raw) // 2)
    with fs.open_output_stream(f"{tmp}.idx") as out:
        out.write(MAGIC + np.array([2, len(keys)], "<u8").tobytes() + np.array(offsets, "<u8").tobytes())
    with fs.open_output_stream(f"{tmp}.key") as out:
        out.write(np.array(keys, "<i8").tobytes())
    for end in ("bin", "key", "idx"):  # a retried task writes the same shard again
        fs.move(f"{tmp}.{end}", f"{root}/{name}.{end}")
    return len(keys), offsets[-1]


def open_shard(folder: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, offsets and ids of a shard: memory-mapped where its file system is this machine's."""
    from pyarrow import fs as pafs

    fs, root = _filesystem(folder)

    def flat(end: str) -> np.ndarray:
        path = f"{root}/{name}.{end}"
        if isinstance(fs, pafs.LocalFileSystem):
            import os

            return np.memmap(path, "u1", "r") if os.path.getsize(path) else np.zeros(0, "u1")
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), "u1")

    index = flat("idx")
    if index[:8].tobytes() != MAGIC:
        raise ValueError(f"{name}.idx is no index of token ids")
    width = int(index[8:16].view("<u8")[0])
    return flat("key").view("<i8"), index[24:].view("<u8"), flat("bin").view(f"<u{width}")


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, shards: int | None = None) -> list[tuple[str, int, int, int]]:
    """Encodes and writes every text of docs (doc_id, text) in ascending doc_id order.

    Gives (shard, first token, documents, tokens) for each shard: the first
    tokens are prefix sums over the shards. One shard is one range of doc_id,
    so the order needs one range shuffle of the texts. end_id closes each
    document. Null texts are empty; rows without doc_id come first, under
    :data:`NO_KEY`; equal doc_ids lie side by side, ordered by text. A very long
    text is encoded whole. An empty table gives shards without documents.
    """
    path = path or bpe.default_path("byte_bpe_50k.json")
    spark = docs.sparkSession
    shards = shards or parallelism(spark)
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, keys = bpe.library_encoder(path, True), []

        def ids() -> Iterator[bytes]:
            for k, texts in rows(batches, "doc_id", "text"):
                keys.extend(NO_KEY if x is None else x for x in k)
                for (t,) in chunked(500, texts):
                    for raw in enc.encode(t):
                        yield raw + end

        part = TaskContext.get().partitionId()
        docs_n, tokens_n = write_shard(folder, f"shard-{part:06d}", keys, ids())
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [docs_n], "n_tokens": [tokens_n]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    out, first = [], 0
    for r in sorted(ordered.mapInArrow(run, "part long, n_docs long, n_tokens long").collect()):  # a row for each shard
        out.append((f"shard-{r.part:06d}", first, r.n_docs, r.n_tokens))
        first += r.n_tokens
    return out


def read_tokens(spark: SparkSession, folder: str, shards: list[tuple[str, int, int, int]]) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, firsts in rows(batches, "name", "first"):
            for name, first in zip(names, firsts, strict=True):
                keys, offsets, ids = open_shard(folder, name)
                starts = offsets[:-1].astype("i8") + first
                for at in range(0, len(keys), 10_000):
                    to = min(at + 10_000, len(keys))
                    crc = [u32crc(ids[int(offsets[i]) : int(offsets[i + 1])]) for i in range(at, to)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(k := np.array(keys[at:to], "i8"), mask=k == NO_KEY), "start": starts[at:to], "n_tokens": np.diff(offsets[at : to + 1]).astype("i8"), "ids_crc32": np.array(crc, "i8")})

    kept = [(name, first) for name, first, n, _ in shards if n]
    named = spark.createDataFrame(kept, "name string, first long").repartition(max(1, len(kept)), "name")
    return named.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return read_tokens(spark, folder, write_tokens(table(spark, sf_dir, "documents"), folder))
