"""Interval operators: overlap joins by bins, nearest points, contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fragments(lines: DataFrame) -> DataFrame:
    """chrom, start, length, barcode of (chrom, start, end, barcode); a length that 16 bits cannot hold is an error."""
    n = F.col("end").cast("long") - F.col("start").cast("long")
    return lines.select("chrom", F.col("start").cast("long").alias("start"), F.when(n.between(0, 65_535), n).otherwise(F.raise_error(F.concat(F.lit("length "), n.cast("string")))).cast("int").alias("length"), "barcode")


def chromosome_order(c: Column) -> list[Column]:
    """Sort keys: numbered chromosomes, then X, Y, M, then the rest by name."""
    name = F.regexp_replace(c, "(?i)^chr", "")
    rank = F.when(name.rlike(r"^\d+$"), name.cast("int")).when(name == "X", 1_000_001).when(name == "Y", 1_000_002).when(name.isin("M", "MT"), 1_000_003).otherwise(1_000_004)
    return [rank, c]


def region(frags: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Fragments that overlap a half-open region; the bounds reach the scan."""
    return frags.where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("start") + F.col("length") > start))


def overlaps(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of (chrom, start, end) rows of left and right that overlap, half-open; right's columns carry the prefix p_.

    Both sides go to bins of the given width and meet in the first bin that
    they share, so each pair is found once, by an equi-join. Empty intervals overlap nothing.
    """
    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.where(F.col(e) > F.col(s)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))

    a = binned(left, "start", "end")
    b = binned(right.select(*[F.col(c).alias(f"p_{c}") for c in right.columns]), "p_start", "p_end").withColumnRenamed("__bin", "__pbin")
    met = (F.col("chrom") == F.col("p_chrom")) & (F.col("__bin") == F.col("__pbin")) & (F.col("start") < F.col("p_end")) & (F.col("end") > F.col("p_start"))
    once = F.col("__bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("p_start") / width))
    return a.join(b, met & once).drop("__bin", "__pbin")


def named_peaks(peaks: DataFrame) -> DataFrame:
    """chrom, start, end, name: a peak without name is chrom:start-end."""
    plain = F.concat_ws("", F.col("chrom"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))
    return peaks.select("chrom", "start", "end", (F.coalesce("name", plain) if "name" in peaks.columns else plain).alias("name"))


def peak_counts(frags: DataFrame, peaks: DataFrame, width: int = 1_000, most: int = 4_000_000, large: int = 1_000_000) -> DataFrame:
    """barcode, peak, n: how many fragments of a cell overlap each peak, half-open; empty intervals overlap nothing.

    Peaks are a dimension: up to ``most`` go to all tasks. Fragments, which are
    fewer than counts, are shuffled, so that a cell is whole in one task and its
    counts leave it as they are; only cells of more than ``large`` fragments are counted block by block where
    they lie, and their sums meet by cell and peak. In a block
    those that start before a peak's end, less those that end before its start,
    are the overlaps, by two sorted lists for each cell; where a cell has few
    fragments, its pairs are fewer and are made instead. More peaks than that
    are joined by bins.
    """
    named = named_peaks(peaks).where("end > start")
    if named.limit(most + 1).count() > most:
        met = overlaps(frags.withColumn("end", F.col("start") + F.col("length")), named, width)
        return met.groupBy("barcode", F.col("p_name").alias("peak")).agg(F.count("*").alias("n"))
    by_chrom: dict[str, list] = {}
    for r in named.collect():  # at most so many
        by_chrom.setdefault(r.chrom, []).append((r.start, r.end, r.name))
    sets, names = {}, []
    for chrom, some in by_chrom.items():
        some.sort()
        start, end = (np.array([r[k] for r in some]) for k in range(2))
        sets[chrom] = (start, end, np.maximum.accumulate(end), len(names))
        names += [r[2] for r in some]
    sent = frags.sparkSession.sparkContext.broadcast((sets, pa.array(names, pa.string())))

    def of_cell(start: np.ndarray, end: np.ndarray, peaks_: tuple) -> tuple[np.ndarray, np.ndarray]:
        p_start, p_end, furthest, _ = peaks_
        lo, hi = np.searchsorted(furthest, start, "right"), np.searchsorted(p_start, end, "left")
        a, b = int(lo.min()), int(hi.max())
        pairs = np.maximum(hi - lo, 0)
        if pairs.sum() <= b - a:
            at = np.repeat(lo, pairs) + np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            at, n = np.unique(at[p_end[at] > np.repeat(start, pairs)], return_counts=True)
            return at, n
        n = np.searchsorted(np.sort(start), p_end[a:b], "left") - np.searchsorted(np.sort(end), p_start[a:b], "right")
        at = np.flatnonzero(n > 0)
        return a + at, n[at]

    def counts(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.sort_by([("chrom", "ascending"), ("barcode", "ascending")])
        start = t["start"].to_numpy()
        end = start + t["length"].to_numpy()
        chroms, cells = (pa.concat_arrays(t[c].chunks) for c in ("chrom", "barcode"))
        chrom, cell = chroms.dictionary_encode(), cells.dictionary_encode()
        code = np.stack([x.indices.to_numpy() for x in (chrom, cell)])
        first = np.flatnonzero(np.append(True, (code[:, 1:] != code[:, :-1]).any(0)))
        out: list[tuple] = []
        for x, y in zip(first, np.append(first[1:], len(start)), strict=True):
            known = sent.value[0].get(chroms[x].as_py())
            if known is not None:
                at, n = of_cell(start[x:y], end[x:y], known)
                out.append((np.full(len(at), x), known[3] + at, n))
            if out and (y == len(start) or sum(len(o[0]) for o in out) > 50_000):
                which, peak, n = (np.concatenate(c) for c in zip(*out, strict=True))
                out.clear()
                for lo in range(0, len(which), 50_000):
                    s = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays([cells.take(pa.array(which[s])), pa.array(peak[s]), pa.array(n[s].astype("i8"))], ["barcode", "peak", "n"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 500_000:
                yield from counts(pa.Table.from_batches(held))
                held.clear()
        if held:
            yield from counts(pa.Table.from_batches(held))

    def called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), sent.value[1].take(b.column(1)), b.column(2)], ["barcode", "peak", "n"])

    def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of batches in which the fragments of a cell follow one another; a block ends with a cell."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            if sum(x.num_rows for x in held) >= 200_000:
                last = held[-1].column(held[-1].schema.get_field_index("barcode"))[-1]
                at = b.column(b.schema.get_field_index("barcode"))
                stay = 0 if at[0] != last else b.num_rows if at[-1] == last else int(np.argmin(pc.equal(at, last).to_numpy(zero_copy_only=False)))
                if stay < b.num_rows:
                    yield from called(counts(pa.Table.from_batches([*held, b.slice(0, stay)])))
                    held, b = [], b.slice(stay)
            held.append(b)
        if held:
            yield from called(counts(pa.Table.from_batches(held)))

    cell = frags.schema["barcode"].dataType.simpleString()
    some = frags.where((F.col("length") > 0) & F.col("chrom").isNotNull() & F.col("barcode").isNotNull()).select("chrom", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "barcode")
    kind = f"barcode {cell}, peak string, n long"
    parts = max(1, int(frags.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))  # said, so that they aren't coalesced by their small size
    heavy = some.groupBy("barcode").agg(F.count("*").alias("__n")).where(F.col("__n") > large).select("barcode").collect()  # at most fragments / large
    if not heavy:
        got = some.repartition(parts, "barcode").sortWithinPartitions("barcode").mapInArrow(whole_cells, kind)
    else:
        these = F.broadcast(frags.sparkSession.createDataFrame(heavy, f"barcode {cell}"))
        got = some.join(these, "barcode", "left_anti").repartition(parts, "barcode").sortWithinPartitions("barcode").select(*some.columns).mapInArrow(whole_cells, kind)
        sums = some.join(these, "barcode", "left_semi").select(*some.columns).mapInArrow(blocks, f"barcode {cell}, peak long, n long")
        got = got.union(sums.groupBy("barcode", "peak").agg(F.sum("n").alias("n")).mapInArrow(called, kind))
    return got.groupBy("barcode", "peak").agg(F.sum("n").alias("n")) if len(set(names)) < len(names) else got


def touching(targets: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Targets (target_start, target_end) that touch a region, both ends inclusive."""
    return targets.where((F.col("target_chromosome") == chrom) & (F.col("target_start") <= end) & (F.col("target_end") >= start))


def nearest_gene(points: DataFrame, genes: DataFrame, bins: int = 256) -> DataFrame:
    """point, gene: the gene of a point's chromosome whose start of transcription is nearest, the first by name on ties.

    Points and starts are one list, cut into ranges of each chromosome. A point
    takes the last start before it and the first after it in its range; the
    ends of the ranges, few rows, hand on what lies beyond them. No pairs, and
    no chromosome in one task.
    """
    tss = genes.select("chrom", F.when(F.col("strand").cast("string").isin("1", "+"), F.col("start")).otherwise(F.col("end")).alias("at"), "gene").groupBy("chrom", "at").agg(F.min("gene").alias("gene"))
    both = points.select("chrom", "at", "point", F.lit(None).cast("string").alias("gene")).unionByName(tss.select("chrom", "at", F.lit(None).cast(dict(points.dtypes)["point"]).alias("point"), "gene"))
    from quiltframe.operators.layouts import cuts

    both = both.withColumn("bin", cuts(both, "at", bins))
    here = F.when(F.col("gene").isNotNull(), F.struct("at", "gene"))
    ends = both.groupBy("chrom", "bin").agg(F.max(here).alias("last"), F.min(here).alias("first"))  # a row for each range
    w = Window.partitionBy("chrom").orderBy("bin")
    ends = ends.select("chrom", "bin", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    own = Window.partitionBy("chrom", "bin").orderBy("at")
    found = both.withColumn("l", F.last(here, True).over(own.rangeBetween(Window.unboundedPreceding, 0))).withColumn("r", F.first(here, True).over(own.rangeBetween(0, Window.unboundedFollowing))).where("gene is null")
    found = found.join(ends, ["chrom", "bin"]).withColumn("l", F.coalesce("l", "before")).withColumn("r", F.coalesce("r", "after"))
    dl, dr = F.col("at") - F.col("l.at"), F.col("r.at") - F.col("at")
    pick = F.when(F.col("l").isNull(), F.col("r.gene")).when(F.col("r").isNull() | (dl < dr), F.col("l.gene")).when(dr < dl, F.col("r.gene")).otherwise(F.least("l.gene", "r.gene"))
    return found.select("point", pick.alias("gene"))


def sequence_names(names: DataFrame, assembly: DataFrame) -> DataFrame:
    """name, sequence for each distinct name: by UCSC name, then name, GenBank and RefSeq accession, else "other"."""
    keys = ["ucsc_name", "sequence_name", "genbank", "refseq"]
    known = assembly.select("sequence_name", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.col(k).alias("name")) for i, k in enumerate(keys)])).alias("k")).select("sequence_name", "k.*").where("name is not null")
    best = known.groupBy("name").agg(F.min_by("sequence_name", F.struct("rank", "sequence_name")).alias("sequence"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.coalesce("sequence", F.lit("other")).alias("sequence"))


def best_hit(hits: DataFrame) -> DataFrame:
    """The alignment of highest share matched on a primary chromosome for each query."""
    order = Window.partitionBy("query").orderBy(F.desc("matched"), "chrom", "start")
    return hits.where(F.col("chrom").rlike(r"^chr([0-9]+|X|Y|M)$")).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
