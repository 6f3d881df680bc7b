"""Foreign keys, joins of modalities and summaries when a collection is made final."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_map(target: DataFrame, key: str, uid: str = "uid") -> DataFrame:
    """key, uid; a key of two uids is an error."""
    got = target.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(uid).alias("uid"), F.countDistinct(uid).alias("n"))
    return got.select(F.when(F.col("n") == 1, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("two rows have the key "), F.col("key").cast("string")))).alias("key"), "uid")


def fill(df: DataFrame, column: str, to: str, target: DataFrame, key: str, uid: str = "uid") -> DataFrame:
    """df with a foreign key by a natural key; one that is not null and unmatched is an error."""
    m = key_map(target, key, uid).select(F.col("key").alias("__k"), F.col("uid").alias("__u"))
    bad = F.raise_error(F.concat(F.lit("no row has the key "), F.col(column).cast("string")))
    return df.join(m, F.col(column) == F.col("__k"), "left").withColumn(to, F.when(F.col(column).isNull(), F.lit(None)).when(F.col("__u").isNull(), bad).otherwise(F.col("__u"))).drop("__k", "__u")


def fill_lists(df: DataFrame, row: str, kinds: str, keys: str, to: str, targets: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """df with an array of foreign keys; each position's kind says which target its key is of. Unmatched positions are errors."""
    maps = None
    for kind, (target, key, uid) in targets.items():
        m = key_map(target, key, uid).select(F.lit(kind).alias("__kind"), F.col("key").cast("string").alias("__key"), F.col("uid").cast("string").alias("__uid"))
        maps = m if maps is None else maps.unionByName(m)
    zipped = F.when(F.size(kinds) == F.size(keys), F.arrays_zip(F.col(kinds).alias("k"), F.col(keys).alias("v"))).otherwise(F.raise_error(F.lit("lists of unequal length")))
    each = df.where(F.col(keys).isNotNull()).select(row, F.posexplode(zipped).alias("__p", "__z")).select(row, "__p", F.col("__z.k").alias("__kind"), F.col("__z.v").cast("string").alias("__key"))
    met = each.join(maps, ["__kind", "__key"], "left").withColumn("__uid", F.when(F.col("__uid").isNull(), F.raise_error(F.concat(F.lit("no row has the key "), F.col("__key")))).otherwise(F.col("__uid")))
    lists = met.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__uid"))), lambda x: x["__uid"]).alias(to))
    return df.join(lists, row, "left")


def enrich_lists(df: DataFrame, row: str, uids: str, dimension: DataFrame, columns: list[str], prefix: str = "perturbation_") -> DataFrame:
    """df with a list for each attribute, parallel to the list of uids; unknown uids give null elements, null and empty lists null."""
    each = df.select(row, F.posexplode(uids).alias("__p", "__u"))
    dim = dimension.select(F.col("uid").alias("__u"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    met = each.join(dim, "__u", "left").groupBy(row).agg(F.array_sort(F.collect_list(F.struct("__p", *[f"{prefix}{c}" for c in columns]))).alias("__l"))
    out = df.join(met, row, "left")
    return out.select(*df.columns, *[F.col(f"__l.{prefix}{c}").alias(f"{prefix}{c}") for c in columns])


def having_any(df: DataFrame, uids: str, wanted: DataFrame) -> DataFrame:
    """Rows whose list holds a wanted uid, by a semi-join on the list's elements: no literal lists, no limit."""
    hit = df.select("uid", F.explode(uids).alias("__u")).join(wanted.select(F.col("uid").alias("__u")), "__u", "left_semi").select("uid").distinct()
    return df.join(hit, "uid", "left_semi")


def having_all(df: DataFrame, uids: str, wanted: list[DataFrame]) -> DataFrame:
    """Rows whose list meets each of the wanted sets."""
    for w in wanted:
        df = having_any(df, uids, w)
    return df


def full_outer(frames: list[DataFrame], key: str) -> DataFrame:
    """One row for each key of any frame; columns that several have must agree where both are set. Keys are unique in each."""
    out = frames[0]
    for f in frames[1:]:
        both = [c for c in f.columns if c in out.columns and c != key]
        right = f.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__r_{c}") if c in both else F.col(c) for c in f.columns if c != key])
        j = out.join(right, F.col(key) == F.col("__k"), "full")
        merged = []
        for c in out.columns:
            if c == key:
                merged.append(F.coalesce(key, "__k").alias(key))
            elif c in both:
                clash = F.raise_error(F.concat(F.lit(f"{c} differs for "), F.col(key).cast("string")))
                merged.append(F.when(F.col(c) != F.col(f"__r_{c}"), clash).otherwise(F.coalesce(c, f"__r_{c}")).alias(c))
            else:
                merged.append(F.col(c))
        out = j.select(*merged, *[c for c in f.columns if c not in both and c != key])
    return out


def summary(df: DataFrame, group: str, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """group and out: (op, column) summaries; count = rows, unique = sorted distinct non-null values, nunique their number."""
    ops = {"count": lambda c: F.count("*"), "unique": lambda c: F.array_sort(F.collect_set(c)), "nunique": F.countDistinct}
    return df.groupBy(group).agg(*[ops[op](c).alias(out) for out, (op, c) in specs.items()])


def presence(df: DataFrame, pointers: list[str]) -> DataFrame:
    """df with has_<pointer>; a pointer struct of nulls is absent."""
    return df.withColumns({f"has_{p}": F.col(f"{p}.zarr_group").isNotNull() for p in pointers})


def check_rows(df: DataFrame, require_any: list[list[str]] = (), equal_length: list[list[str]] = ()) -> list[str]:
    """What is wrong with a table by its constraints."""
    out = []
    for group in require_any:
        if n := df.where(" and ".join(f"`{c}` is null" for c in group)).count():
            out.append(f"{n} rows have none of {group}")
    for group in equal_length:
        sizes = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.size(c)) for c in group])))
        if n := df.where(F.size(sizes) > 1).count():
            out.append(f"{n} rows have lists of unequal length in {group}")
    return out


def order(depends: dict[str, set[str]]) -> list[str]:
    """Tables so that each comes after what it depends on, by name where free; a cycle is an error."""
    left, out = {k: set(v) & depends.keys() - {k} for k, v in depends.items()}, []
    while left:
        free = sorted(k for k, v in left.items() if not v)
        if not free:
            raise ValueError(f"tables depend on each other: {sorted(left)}")
        out.append(free[0])
        del left[free[0]]
        for v in left.values():
            v.discard(free[0])
    return out


def barcodes(spaces: list[DataFrame], column: str) -> tuple[str, list[int]]:
    """The way of writing barcodes that gives the largest least overlap with the first space, the first way on ties, and its overlaps."""
    from quiltframe.functions.text import BARCODES

    best: tuple[str, list[int]] = ("exact", [])
    for name, f in BARCODES.items():
        first = spaces[0].select(f(F.col(column)).alias("b")).distinct()
        n = [s.select(f(F.col(column)).alias("b")).distinct().join(first, "b", "left_semi").count() for s in spaces[1:]]
        if not best[1] or min(n) > min(best[1]):
            best = name, n
    return best


def batches(df: DataFrame, size: int, key: str) -> DataFrame:
    """df with batch, position: consecutive batches in order of key."""
    from quiltframe.operators.layouts import ranked

    return ranked(df, key, "__r").withColumn("batch", F.floor(F.col("__r") / size)).withColumn("position", F.col("__r") % size).drop("__r")


def shuffled(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """df with an order that depends on the seed, the epoch and the key alone."""
    return df.withColumn("order", F.xxhash64(F.lit(seed + epoch), key))


def group_batches(df: DataFrame, group: str, size: int, key: str, drop_last: bool = True, ranges: int = 64) -> DataFrame:
    """df with batch (within its group): each batch is of one group.

    Rows are numbered range by range of key and shifted by the sizes of the
    ranges before, so that a group that holds most rows is many tasks.
    """
    from quiltframe.operators.layouts import cuts

    part = cuts(df, key, ranges)
    cutup = df.withColumn("__p", part)
    sizes = cutup.groupBy(group, "__p").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(group)
    before = sizes.withColumn("__b", F.coalesce(F.sum("__c").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", F.sum("__c").over(w)).drop("__c").withColumnRenamed(group, "__g")
    out = cutup.join(before.withColumnRenamed("__p", "__q"), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    out = out.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group, "__p").orderBy(key)) - 1 + F.col("__b")) / size))
    if drop_last:
        out = out.where((F.col("batch") + 1) * size <= F.col("__n"))
    return out.select(*df.columns, "batch")
