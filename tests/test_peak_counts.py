"""Counts of cells and peaks leave the task of their cell as they are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltframe.operators import intervals as I


def brute(frags, peaks):
    out = {}
    for c, s, n, b in frags:
        for pc, ps, pe, *name in peaks:
            if b is not None and c == pc and n > 0 and pe > ps and s < pe and s + n > ps:
                k = (b, name[0] if name else f"{pc}:{ps}-{pe}")
                out[k] = out.get(k, 0) + 1
    return out


@pytest.mark.parametrize("named", [False, True])
def test_cells_small_and_large(spark, named):
    rng = np.random.default_rng(3)
    frags = [("xyz"[c], int(s), int(n), f"b{int(b * b // 4)}") for c, s, n, b in zip(rng.integers(3, size=600), rng.integers(300, size=600), rng.integers(6, size=600), rng.integers(9, size=600), strict=True)]
    frags += [(None, 5, 5, "b0"), ("x", 5, 5, None)]
    peaks = [("xy"[k % 2], 4 * k, 4 * k + k % 30, *([f"p{k % 40}"] if named else [])) for k in range(80)]
    f = spark.createDataFrame(frags, "chrom string, start long, length int, barcode string")
    p = spark.createDataFrame(peaks, "chrom string, start long, end long" + (", name string" if named else ""))
    want = brute(frags, peaks)
    for large in (1_000_000, 60, 0):  # no cell, some and all are too large for a task
        got = I.peak_counts(f, p, large=large).collect()
        assert {(r.barcode, r.peak): r.n for r in got} == want and len(got) == len(want)


def test_counts_are_not_shuffled(spark):
    f = spark.range(100).select(F.lit("x").alias("chrom"), "id", (F.col("id") % 7).alias("barcode"), F.lit(3).alias("length")).withColumnRenamed("id", "start")
    p = spark.range(50).select(F.lit("x").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"))
    plan = I.peak_counts(f, p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_blocks_end_with_a_cell(spark):
    f = spark.range(1_500_000).select(F.lit("x").alias("chrom"), (F.col("id") % 100).alias("start"), F.lit(1).alias("length"), F.pmod(F.hash("id"), F.lit(37)).alias("barcode"))
    p = spark.createDataFrame([("x", 0, 10), ("x", 5, 60)], "chrom string, start long, end long")
    got = {(r.barcode, r.peak): r.n for r in I.peak_counts(f, p).collect()}
    want = {(r.barcode, n): r[k] for r in f.groupBy("barcode").agg(F.count_if(F.col("start") < 10).alias("a"), F.count_if(F.col("start").between(5, 59)).alias("b")).collect() for k, n in (("a", "x:0-10"), ("b", "x:5-60"))}
    assert got == want
