"""Access by rows for training: by index, by epoch, by group."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltframe.operators import keys


class MapDataset:
    """Rows by ordinal, in the order asked for."""

    def __init__(self, rows: DataFrame, ordinal: str = "_rowid"):
        self.rows, self.ordinal = rows, ordinal

    def __len__(self) -> int:
        return self.rows.count()

    def take(self, ordinals: list[int]) -> DataFrame:
        """position, and the row of each ordinal asked for, which may repeat; one that is not there is an error."""
        spark = self.rows.sparkSession
        asked = spark.createDataFrame(list(enumerate(ordinals)), "position int, __o long")
        got = F.broadcast(asked).join(self.rows.withColumn("__there", F.lit(True)), F.col("__o") == F.col(self.ordinal), "left")
        if missing := [r["__o"] for r in got.where("__there is null").select("__o").collect()]:
            raise IndexError(f"no rows {missing}")
        return got.drop("__o", "__there").orderBy("position")


class IterableDataset:
    """Batches in an order that a seed and the epoch give; the order is by a hash, so no permutation is held anywhere."""

    def __init__(self, rows: DataFrame, key: str, size: int, seed: int = 0, drop_last: bool = False):
        self.rows, self.key, self.size, self.seed, self.drop_last = rows, key, size, seed, drop_last

    def epoch(self, n: int) -> DataFrame:
        """All rows with batch and position of an epoch."""
        out = keys.batches(keys.shuffled(self.rows, self.key, self.seed, n), self.size, "order").drop("order")
        if self.drop_last:
            out = out.where(F.col("batch") < self.rows.count() // self.size)
        return out

    def batches(self, n: int) -> Iterator[list]:
        """The batches of an epoch one after another; partitions are fetched ahead."""
        held: list = []
        for r in self.epoch(n).orderBy("batch", "position").toLocalIterator(prefetchPartitions=True):
            if held and r.batch != held[0].batch:
                yield held
                held = []
            held.append(r)
        if held:
            yield held


def group_epoch(rows: DataFrame, group: str, key: str, size: int, seed: int, epoch: int, drop_last: bool = True) -> DataFrame:
    """Batches of one group each, shuffled within and across groups: rows with batch and turn (the order of batches)."""
    out = keys.group_batches(keys.shuffled(rows, key, seed, epoch), group, size, "order", drop_last).drop("order")
    return out.withColumn("turn", F.xxhash64(F.lit(seed + epoch), group, "batch"))
