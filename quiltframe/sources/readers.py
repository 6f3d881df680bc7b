"""Readers of interval, coordinate and collection files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.operators.intervals import fragments


def bed(spark: SparkSession, path: str, chroms: list[str] | None = None, barcodes: DataFrame | None = None) -> DataFrame:
    """chrom, start, length, barcode of a (gzipped) BED file's first four columns."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, barcode string")
    if chroms is not None:
        raw = raw.where(F.col("chrom").isin(chroms))
    out = fragments(raw)
    return out.join(barcodes.select("barcode"), "barcode", "left_semi").select("chrom", "start", "length", "barcode") if barcodes is not None else out


def triplets(spark: SparkSession, path: str, n_rows: int, n_columns: int, one_based: bool = False, sep: str = ",") -> DataFrame:
    """row, entries (column, value) by column for every row from 0, empty ones too; an index out of range is an error."""
    raw = spark.read.csv(path, sep=sep, schema="row long, column long, value double")
    if one_based:
        raw = raw.select(F.col("row") - 1, F.col("column") - 1, "value").toDF("row", "column", "value")
    if raw.where(~(F.col("row").between(0, n_rows - 1) & F.col("column").between(0, n_columns - 1))).take(1):
        raise ValueError("an index is out of range")
    rows = raw.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("entries"))
    return spark.range(n_rows).select(F.col("id").alias("row")).join(rows, "row", "left").select("row", F.coalesce("entries", F.array().cast("array<struct<column:bigint,value:double>>")).alias("entries"))


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table as text columns; lines that start with # are skipped."""
    return spark.read.csv(path, sep=sep, header=True, comment="#")


def assembly_report(spark: SparkSession, path: str) -> DataFrame:
    """sequence_name, role, genbank, refseq, ucsc_name of an assembly report; "na" is null."""
    parts = F.split("value", "\t")
    text = spark.read.text(path).where(~F.col("value").startswith("#"))
    names = {"sequence_name": 0, "role": 1, "genbank": 4, "refseq": 6, "ucsc_name": 9}
    return text.select(*[F.when(F.get(parts, i) != "na", F.trim(F.get(parts, i))).alias(n) for n, i in names.items()])


@dataclass
class Collection:
    """A manifest: datasets and the tagged files of each."""

    name: str
    datasets: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def add(self, dataset: str, tag: str, path: str) -> Collection:
        files = self.datasets.setdefault(dataset, {}).setdefault(tag, [])
        if path not in files:
            files.append(path)
        return self

    def only(self, dataset: str, tag: str) -> str:
        files = self.datasets.get(dataset, {}).get(tag, [])
        if len(files) != 1:
            raise ValueError(f"{dataset} has {len(files)} files of {tag}")
        return files[0]

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def loads(text: str) -> Collection:
        raw = json.loads(text)
        if unknown := set(raw) - {"name", "datasets"}:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        return Collection(**raw)
