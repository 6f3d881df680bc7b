"""Language identification by rank-order profiles of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.llm.common import frugal, rows, table

UNDETERMINED = "und"
SPACE = np.uint64(32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    flags = np.zeros(0x110000, bool)
    for block in range(0, 0x110000, 0x1000):
        text = "".join(map(chr, range(block, block + 0x1000)))
        if any(map(str.isalpha, text)):
            flags[block : block + 0x1000] = list(map(str.isalpha, text))
    return flags


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of one to three characters within the words of a text, and how often each is there.

    Words are runs of letters in lower case with a blank on either side. A gram
    is one number: 21 bits for each character. No letter: no gram.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    kept = np.where(letter, codes, 32)[keep]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = np.empty(len(kept) + 2, np.uint64)
    c[0] = c[-1] = SPACE
    c[1:-1] = kept
    if c[-2] == SPACE:
        c = c[:-1]
    full = c != SPACE
    one = c[full]
    two = (c[:-1] << np.uint64(21) | c[1:])[full[:-1] | full[1:]]
    three = (c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])[full[1:-1]]
    every = np.concatenate([one, two, three])
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.diff(np.append(first, len(every)))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent grams, most frequent first, ties in the order of the grams."""
    if len(keys) > size:  # only what can be among them is sorted
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """The rank of each gram in each language; a gram that a profile lacks has the rank of its size."""

    langs: tuple[str, ...]
    keys: np.ndarray
    ranks: np.ndarray
    size: int

    @staticmethod
    def of(profiles: dict[str, list[int]], size: int) -> Profiles:
        langs = tuple(sorted(profiles))
        keys = np.unique(np.array([k for ks in profiles.values() for k in ks], np.uint64))
        ranks = np.full((len(keys) + 1, len(langs)), size, np.int32)
        for j, lang in enumerate(langs):
            ranks[np.searchsorted(keys, np.array(profiles[lang], np.uint64)), j] = np.arange(len(profiles[lang]))
        return Profiles(langs, keys, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance, ties to the first by name, and 1 less its share of the largest possible."""
        if not text or not self.langs:
            return UNDETERMINED, 0.0
        found = ranked(*grams(text), self.size)
        n = len(found)
        if not n:
            return UNDETERMINED, 0.0
        if len(self.keys):
            at = np.searchsorted(self.keys, found)
            at[at == len(self.keys)] = 0
            at[self.keys[at] != found] = len(self.keys)
        else:
            at = np.zeros(n, int)
        place = np.arange(n)[:, None]
        rank = self.ranks[at]
        off = np.where(rank == self.size, self.size, np.abs(rank - place)).sum(0)
        best = int(off.argmin())
        return self.langs[best], float(max(0.0, 1.0 - off[best] / (n * self.size)))


def train(labelled: DataFrame, size: int = 400, sample: int = 20_000) -> Profiles:
    """Profiles of the languages in labelled (doc_id, text, lang).

    sample: about so many rows of each language are read, those of least hash
    of doc_id; it is the documented bound of what training takes. Rows without
    lang or text, and languages whose texts hold no letter, teach nothing.
    Grams are counted in each task and summed by a shuffle; the driver gets
    size grams for each language.
    """
    labelled = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    n = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not n:
        return Profiles((), np.zeros(0, np.uint64), np.zeros((1, 0), np.int32), size)
    spark = labelled.sparkSession
    share = F.broadcast(spark.createDataFrame([(k, min(1.0, sample / v)) for k, v in n.items()], "lang string, share double"))
    chosen = labelled.join(share, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        waiting: dict[str, int] = {}

        def merge(lang: str) -> None:
            k, c = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            keys, inverse = np.unique(k, return_inverse=True)
            held[lang], waiting[lang] = [(keys, np.bincount(inverse, c, len(keys)).astype("i8"))], 0

        for langs, texts in rows(batches, "lang", "text"):
            for lang, text in zip(langs, texts, strict=True):
                k, c = grams(text)
                if len(k):
                    held.setdefault(lang, []).append((k, c))
                    waiting[lang] = waiting.get(lang, 0) + len(k)
                    if waiting[lang] > 1_000_000:
                        merge(lang)
        for lang in list(held):
            merge(lang)
            k, c = held[lang][0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype("i8")), pa.array(c)], ["lang", "gram", "n"])

    from pyspark.sql import Window

    counted = chosen.mapInArrow(frugal(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).collect()  # size rows for each language
    profiles: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r.lang, r.place)):
        profiles.setdefault(r.lang, []).append(r.gram)
    return Profiles.of(profiles, size)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs with lang_pred and score (0 to 1) beside all their columns; columns of those names are replaced.

    Null, empty and letter-free texts get "und" and 0. Very long texts are read
    whole. One pass in Arrow batches; the profiles (languages x size ranks) go
    along with the tasks.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [profiles.predict(t) for t in b.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(frugal(run), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 0 when divided by 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
