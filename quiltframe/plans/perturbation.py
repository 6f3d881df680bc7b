"""Queries about perturbations: by gene, compound, biologic, publication and accession."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe.operators import intervals, keys
from quiltframe.plans.query import Query


def _pick(table: DataFrame, **equal: object) -> DataFrame:
    for column, value in equal.items():
        if value is not None:
            wanted = list(value) if isinstance(value, (list, tuple, set)) else [value]
            names = table.sparkSession.createDataFrame([(v,) for v in wanted], T.StructType([T.StructField(column, table.schema[column].dataType)]))
            table = table.join(names, column, "left_semi")
    return table.select("uid")


@dataclass(frozen=True)
class Perturbations:
    """Dimension tables of an atlas; each method narrows a query by semi-joins, so repeated calls add up and no match means no rows."""

    genetic: DataFrame
    molecules: DataFrame
    biologics: DataFrame
    publications: DataFrame
    datasets: DataFrame
    column: str = "perturbation_uids"

    def _by(self, q: Query, table: DataFrame, column: str, names: list[str], every: bool, **more: object) -> Query:
        sets = [_pick(table, **{column: n}, **more) for n in names] if every else [_pick(table, **{column: names}, **more)]
        return q.by_members(self.column, *sets)

    def by_gene(self, q: Query, names: list[str], every: bool = False, method: str | None = None) -> Query:
        return self._by(q, self.genetic, "intended_gene_name", names, every, perturbation_type=method)

    def by_compound(self, q: Query, values: list, by: str = "name", every: bool = False) -> Query:
        if by not in ("name", "smiles", "pubchem_cid"):
            raise ValueError(f"compounds have no {by!r}")
        return self._by(q, self.molecules, by, values, every)

    def by_biologic(self, q: Query, names: list[str], kind: str | None = None, every: bool = False) -> Query:
        return self._by(q, self.biologics, "biologic_name", names, every, biologic_type=kind)

    def by_publication(self, q: Query, doi: str | None = None, pmid: object = None, title: str | None = None) -> Query:
        p = _pick(self.publications, doi=doi, pmid=pmid, title=title)
        return q.by_dataset(self.datasets.join(p.withColumnRenamed("uid", "publication_uid"), "publication_uid", "left_semi"))

    def by_accession(self, q: Query, accession: str, database: str | None = None) -> Query:
        d = self.datasets.where(F.col("accession_id") == accession)
        return q.by_dataset(d.where(F.col("accession_database") == database) if database else d)

    def by_region(self, q: Query, chrom: str, start: int, end: int) -> Query:
        """Cells whose guides touch a region, both ends inclusive."""
        return q.by_members(self.column, intervals.touching(self.genetic, chrom, start, end).select("uid"))

    def with_metadata(self, obs: DataFrame, columns: list[str], table: DataFrame) -> DataFrame:
        """Attribute lists parallel to the perturbations; without the column of uids nothing is added."""
        return keys.enrich_lists(obs, "uid", self.column, table, columns) if self.column in obs.columns else obs


def target_context(guides: DataFrame, genes: DataFrame, features: DataFrame, promoter: int = 2_000) -> DataFrame:
    """guide, context of (guide, chrom, start, end): the first that holds its middle of coding exon, untranslated exon, transcript and promoter.

    genes: chrom, gene, start, end, strand ("+" or "-"); features: chrom, kind (cds, exon, transcript), start, end, strand, parent.
    Guides that no gene overlaps are intergenic. Overlaps are found by bins.
    """
    g = guides.withColumn("mid", F.floor((F.col("start") + F.col("end")) / 2))
    spots = g.select("guide", "chrom", F.col("mid").alias("start"), (F.col("mid") + 1).alias("end"), "mid")
    closed = features.withColumn("end", F.col("end") + 1)
    hit = intervals.overlaps(spots, closed, 1_000)
    coding = features.where("kind = 'cds'").groupBy(F.col("parent").alias("p_parent")).agg(F.min("start").alias("cds"))
    hit = hit.join(coding, "p_parent", "left")
    before = F.col("mid") < F.col("cds")
    utr = F.when(F.col("cds").isNull(), "other").when(before == (F.col("p_strand") == "+"), "5_UTR").otherwise("3_UTR")
    rank = F.when(F.col("p_kind") == "cds", 0).when(F.col("p_kind") == "exon", 1).when(F.col("p_kind") == "transcript", 2)
    label = F.when(F.col("p_kind") == "cds", "exon").when(F.col("p_kind") == "exon", utr).when(F.col("p_kind") == "transcript", "intron")
    best = hit.where(rank.isNotNull()).groupBy("guide").agg(F.min(F.struct(rank.alias("r"), F.col("p_start"), F.col("p_parent"), label.alias("c"))).alias("b"))
    near = intervals.overlaps(g.select("guide", "chrom", "start", "end", "mid"), genes, 1_000)
    tss = F.when(F.col("p_strand") == "+", F.col("p_start")).otherwise(F.col("p_end"))
    nearest = near.groupBy("guide").agg(F.min(F.struct(F.abs(F.col("mid") - tss).alias("d"), F.col("p_gene"), tss.alias("tss"), F.col("p_strand").alias("strand"), "mid")).alias("n"))
    ahead = F.when(F.col("n.strand") == "+", (F.col("n.mid") >= F.col("n.tss") - promoter) & (F.col("n.mid") < F.col("n.tss"))).otherwise((F.col("n.mid") > F.col("n.tss")) & (F.col("n.mid") <= F.col("n.tss") + promoter))
    out = guides.select("guide").join(nearest, "guide", "left").join(best, "guide", "left")
    return out.select("guide", F.when(F.col("n").isNull(), "intergenic").when(F.col("b").isNotNull(), F.col("b.c")).when(ahead, "promoter").otherwise("other").alias("context"))
