"""BPE encoding and decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.llm import bpe
from quiltframe.llm.common import chunked, rows, table


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids (array<int>) of every text.

    Merges come off a priority queue of ranks over a doubly linked list of
    symbols; stale entries are skipped. No shuffle: one pass in Arrow batches.
    A null or empty text gives an empty array; repeated keys stay repeated.
    """
    path = path or bpe.default_path("byte_bpe_50k.json")
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        _, enc = bpe.queue_encoder(path)
        for keys, texts in rows(batches, "k", "t"):
            for k, t in chunked(500, keys, texts):
                ids = [np.frombuffer(b, "<u2").astype("i4") for b in enc.encode(t)]
                yield pa.RecordBatch.from_arrays([pa.array(k, _arrow(kind)), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([StructField("k", kind), StructField("ids", ArrayType(IntegerType()))])
    return docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def decode(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """key and text of every id array: its vocabulary strings one after another. Null or empty: an empty text."""
    path = path or bpe.default_path("byte_bpe_50k.json")
    kind = tokens.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, _ = bpe.queue_encoder(path)
        for keys, arrays in rows(batches, "k", "ids"):
            yield pa.RecordBatch.from_arrays([pa.array(keys, _arrow(kind)), pa.array([q.decode(a or []).decode() for a in arrays], pa.string())], ["k", "text"])

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("k", kind), StructField("text", StringType())])
    return tokens.select(F.col(key).alias("k"), F.col(ids).alias("ids")).mapInArrow(run, schema).withColumnRenamed("k", key)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids of every text and of what those ids decode to.

    One row for each row of docs (doc_id, text; other columns are ignored): doc_id,
    n_tokens, ids_sha256, decoded_sha256. A null text counts as empty, with no
    ids. An empty table gives no rows; a null or repeated doc_id stays as it is.
    """
    path = path or bpe.default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        q, enc = bpe.queue_encoder(path)
        decimal = [f",{i}" for i in range(len(q.bytes_of))].__getitem__
        sha = hashlib.sha256
        for keys, texts in rows(batches, "doc_id", "text"):
            n, a, b = [], [], []
            for (t,) in chunked(500, texts):
                for raw in enc.encode(t):
                    ids = np.frombuffer(raw, "<u2").tolist()
                    n.append(len(ids))
                    a.append(sha("".join(map(decimal, ids))[1:].encode()).hexdigest())
                    b.append(sha(q.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
