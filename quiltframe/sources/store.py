"""Versioned tables: immutable Parquet folders listed by numbered manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer took the next version."""


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where that is unset in local mode, a temporary one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="quiltframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, computed once, as a table in the shared folder."""
    path = f"{scratch(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def holding(df: DataFrame) -> Iterator[DataFrame]:
    """Like :func:`kept`, for as long as the block lasts."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/held-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        spark.sparkContext._jvm.System.gc()  # Spark drops shuffle files when the driver's heap is collected, which may be long after


class Store:
    """Tables under a root. A commit creates manifest n + 1 exclusively, so readers see whole versions and writers cannot overwrite one another; object stores without exclusive creation are refused."""

    def __init__(self, spark: SparkSession, root: str):
        from pyarrow import fs

        self.spark, self.root = spark, root.rstrip("/")
        uri = root if "://" in root or root.startswith("file:") else f"file://{root}"
        self.fs, self.path = fs.FileSystem.from_uri(uri)

    def _manifest(self, table: str, n: int) -> str:
        return f"{self.path}/{table}/_manifest/{n:08d}.json"

    def version(self, table: str) -> int:
        """The newest version, -1 if there is none."""
        from pyarrow import fs

        got = self.fs.get_file_info(fs.FileSelector(f"{self.path}/{table}/_manifest", allow_not_found=True))
        return max((int(f.base_name[:-5]) for f in got if f.base_name.endswith(".json")), default=-1)

    def tables(self) -> list[str]:
        from pyarrow import fs

        got = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(f.base_name for f in got if f.type == fs.FileType.Directory)

    def manifest(self, table: str, version: int | None = None) -> dict:
        n = self.version(table) if version is None else version
        try:
            with self.fs.open_input_stream(self._manifest(table, n)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            raise KeyError(f"{table} has no version {n}") from None

    def _commit(self, table: str, n: int, content: dict) -> None:
        import os

        from py4j.protocol import Py4JJavaError
        from pyarrow import fs

        self.fs.create_dir(f"{self.path}/{table}/_manifest", recursive=True)
        name = self._manifest(table, n)
        if isinstance(self.fs, fs.LocalFileSystem):  # exclusive even between processes
            tmp = f"{name}.{uuid.uuid4().hex}"
            with open(tmp, "w") as f:
                json.dump(content, f)
            try:
                os.link(tmp, name)
            except FileExistsError:
                raise Conflict(f"{table} has version {n} already") from None
            finally:
                os.unlink(tmp)
            return
        # through Hadoop, whose create without overwrite is exclusive where the file system can promise it
        scheme = self.root.partition("://")[0]
        if scheme in ("s3", "s3a", "s3n"):
            raise NotImplementedError(f"{scheme} cannot commit exclusively: keep manifests on a file system with exclusive creation")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/_manifest/{n:08d}.json")
        try:
            out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"{table} has version {n} already") from None
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def create(self, table: str, schema: T.StructType) -> None:
        self._commit(table, 0, {"schema": schema.json(), "folders": []})

    def read(self, table: str, version: int | None = None) -> DataFrame:
        m = self.manifest(table, version)
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        if not m["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/{f}" for f in m["folders"]])

    def append(self, table: str, rows: DataFrame, tries: int = 5) -> int:
        """Adds rows; a lost race is tried again, since an append does not depend on what is there."""
        schema = T.StructType.fromJson(json.loads(self.manifest(table)["schema"]))
        folder = uuid.uuid4().hex
        rows.select(*schema.fieldNames()).write.parquet(f"{self.root}/{table}/{folder}")
        for _ in range(tries):
            n = self.version(table)
            m = self.manifest(table, n)
            try:
                self._commit(table, n + 1, m | {"folders": [*m["folders"], folder]})
                return n + 1
            except Conflict:
                continue
        raise Conflict(f"{table} is too busy")

    def rewrite(self, table: str, rows: DataFrame, based_on: int) -> int:
        """Replaces all rows; refused if the table has moved on from the version it is based on."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{table}/{folder}")
        self._commit(table, based_on + 1, {"schema": rows.schema.json(), "folders": [folder]})
        return based_on + 1

    def restore(self, table: str, version: int) -> int:
        """Makes an old version the newest, without touching what came after it."""
        n = self.version(table)
        self._commit(table, n + 1, self.manifest(table, version))
        return n + 1
