"""Vector, full-text and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(vector: Column, query: list[float], metric: str = "l2") -> Column:
    """Squared Euclidean distance, or one less the cosine, in doubles; JVM-side."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    if metric == "l2":
        return F.aggregate(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    if metric != "cosine":
        raise ValueError(f"no such metric: {metric!r}")
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return 1 - dot / (norm * F.lit(sum(x * x for x in query) ** 0.5))


def vector_top(df: DataFrame, column: str, query: list[float], k: int, key: str, metric: str = "l2") -> DataFrame:
    """The k nearest rows with _distance; ties by key. Each task keeps k rows, so nothing is sorted as a whole."""
    return df.where(F.col(column).isNotNull()).withColumn("_distance", distance(F.col(column), query, metric)).orderBy("_distance", key).limit(k)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits and of what is beyond ASCII, in lower case."""
    return F.filter(F.split(F.lower(text), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"), lambda x: x != "")


def text_match(df: DataFrame, column: str, words: list[str], every: bool = True) -> DataFrame:
    """Rows that hold all (or any) of the words as tokens."""
    have, want = tokens(F.col(column)), F.array(*[F.lit(w.lower()) for w in words])
    return df.where(F.size(F.array_intersect(have, want)) == len({w.lower() for w in words}) if every else F.arrays_overlap(have, want))


def _is(word: str):
    return lambda x: x == word


def text_top(df: DataFrame, column: str, words: list[str], k: int, key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k rows of highest BM25 score for the words, with _score; ties by key. Only rows that hold a word leave the scan."""
    want = sorted({w.lower() for w in words})
    if not want:
        return df.where(F.lit(False)).withColumn("_score", F.lit(0.0))
    t = df.withColumn("__t", tokens(F.col(column))).withColumn("__n", F.size("__t"))
    tf = [F.size(F.filter("__t", _is(w))).alias(f"__f{i}") for i, w in enumerate(want)]
    t = t.select(*df.columns, "__n", *tf)
    stats = t.agg(F.count("*").alias("__docs"), F.avg("__n").alias("__mean"), *[F.count_if(F.col(f"__f{i}") > 0).alias(f"__d{i}") for i in range(len(want))])
    hit = t.where(" or ".join(f"__f{i} > 0" for i in range(len(want)))).join(F.broadcast(stats))  # one row
    score = sum((F.log(1 + (F.col("__docs") - F.col(f"__d{i}") + 0.5) / (F.col(f"__d{i}") + 0.5)) * F.col(f"__f{i}") * (k1 + 1) / (F.col(f"__f{i}") + k1 * (1 - b + b * F.col("__n") / F.col("__mean"))) for i in range(len(want))), F.lit(0.0))
    return hit.withColumn("_score", score).select(*df.columns, "_score").orderBy(F.desc("_score"), key).limit(k)


def hybrid_top(vectors: DataFrame, texts: DataFrame, key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two result lists: key, _relevance."""
    a = vectors.withColumn("__r", F.row_number().over(Window.orderBy("_distance", key)))  # k rows each
    b = texts.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("_score"), key)))
    both = a.select(key, "__r").unionByName(b.select(key, "__r"))
    return both.groupBy(key).agg(F.sum(1.0 / (constant + F.col("__r"))).alias("_relevance")).orderBy(F.desc("_relevance"), key).limit(k)
