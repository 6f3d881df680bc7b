"""Resolvers of kinds of entities, the passes that apply them to tables, and their registry.

A resolver is a function of distinct values (value) that gives value, resolved,
confidence, source and alternatives; joins alone decide, and what joins can't
know comes from callables that the caller injects.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe.functions import text
from quiltframe.operators import curation, intervals, resolution, search

Resolver = Callable[[DataFrame], DataFrame]
COLUMNS = ["value", "resolved", "confidence", "source", "alternatives"]

#: How keys of a kind are made comparable before they are looked up.
KEYS: dict[str, Callable[[Column], Column]] = {
    "lower": F.lower,
    "stripped": lambda c: F.lower(F.trim(c)),
    "upper": F.upper,
    "compound": lambda c: F.lower(text.compound(c)),
}
#: Ontologies by what they name.
ONTOLOGIES = {"cell_type": "CL", "tissue": "UBERON", "disease": "MONDO", "organism": "NCBITaxon", "assay": "EFO", "cell_line": "CLO", "development_stage": "HsapDv", "ethnicity": "HANCESTRO", "sex": "PATO"}


def result(df: DataFrame) -> DataFrame:
    """df in the columns of a result; what is missing is empty."""
    have = df.columns
    lists = "alternatives" in have
    return df.select("value", "resolved", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("source", F.lit("none")).alias("source"), (F.coalesce("alternatives", F.array().cast("array<string>")) if lists else F.array().cast("array<string>")).alias("alternatives"))


def unresolved(values: DataFrame) -> DataFrame:
    """A stub for each value: confidence 0 from no source."""
    return result(values.select("value", F.lit(None).cast("string").alias("resolved"), F.lit(0.0).alias("confidence"), F.lit("none").alias("source")))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()


def ranked_lookup(values: DataFrame, table: DataFrame, source: str, key: Callable[[Column], Column] = KEYS["stripped"]) -> DataFrame:
    """By table (key, id, rank, confidence): of the rows of a value's key that of least rank, then id; the others are alternatives."""
    keyed = values.select("value", key(F.col("value")).alias("__k"))
    hits = table.groupBy(F.lower("key").alias("__k"), "id").agg(F.min(F.struct("rank", "confidence")).alias("b")).groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("b.rank", "id", "b.confidence"))).alias("c"))
    first = F.get("c", F.lit(0))
    out = keyed.join(hits, "__k", "left").select("value", first["id"].alias("resolved"), first["confidence"].alias("confidence"), F.when(F.col("c").isNotNull(), source).alias("source"), F.transform(F.slice("c", 2, 1_000_000), lambda x: x["id"]).alias("alternatives"))
    return result(out)


# kinds

def genes(values: DataFrame, symbols: DataFrame, organism: str | None = None) -> DataFrame:
    """By symbol or, for what looks like one, by gene id without its version. symbols: alias, id, canonical, and organism."""
    table = symbols.where(F.col("organism") == organism) if organism else symbols
    ids = values.where(text.is_gene_id(F.col("value")))
    by_id = ids.select("value", text.gene_base(F.col("value")).alias("id")).join(table.select("id").distinct().withColumn("__there", F.lit(True)), "id", "left")
    by_id = result(by_id.select("value", F.when(F.col("__there"), F.col("id")).alias("resolved"), F.when(F.col("__there"), 1.0).otherwise(0.0).alias("confidence"), F.when(F.col("__there"), "id").otherwise("none").alias("source")))
    names = values.join(ids, "value", "left_anti").where(~text.placeholder_symbol(F.col("value")))
    stubs = unresolved(values.join(ids, "value", "left_anti").where(text.placeholder_symbol(F.col("value"))))
    return by_id.unionByName(result(resolution.resolve_aliases(names, table))).unionByName(stubs)


def proteins(values: DataFrame, aliases: DataFrame, records: DataFrame, columns: Iterable[str] = (), organism: str | None = None) -> DataFrame:
    """By alias (alias, id, canonical), then one lookup of the records (id and columns) for all results."""
    table = aliases.where(F.col("organism") == organism) if organism else aliases
    return enriched(result(resolution.resolve_aliases(values, table)), records, columns)


def compounds(values: DataFrame, synonyms: DataFrame, structures: DataFrame | None = None) -> DataFrame:
    """Controls first; then by name without salt and form. synonyms: name, id, is_title: a title is sure (1.0), another name nearly (0.9).

    structures (id, smiles) adds the structure.
    """
    control = values.where(text.is_control(F.col("value")))
    known = result(control.select("value", text.control_type(F.col("value")).alias("resolved"), F.lit(1.0).alias("confidence"), F.lit("control").alias("source")))
    title = F.col("is_title").cast("boolean")
    table = synonyms.select(F.col("name").alias("key"), "id", F.when(title, 0).otherwise(1).alias("rank"), F.when(title, 1.0).otherwise(0.9).alias("confidence"))
    left = values.join(control, "value", "left_anti")
    plain = ranked_lookup(left, table, "synonym")
    found, rest = plain.where("resolved is not null"), plain.where("resolved is null").select("value")
    out = known.unionByName(found).unionByName(ranked_lookup(rest, table, "synonym", KEYS["compound"]))
    return enriched(out, structures, ["smiles"]) if structures is not None else out


def canonical_smiles(smiles: str) -> str | None:
    """The canonical form by a chemistry toolkit; None without one, and for what it cannot read."""
    try:
        from rdkit import Chem
    except ImportError:
        return None
    mol = Chem.MolFromSmiles(smiles)
    return Chem.MolToSmiles(mol) if mol is not None else None


def structures(values: DataFrame, table: DataFrame, column: str, fallback: Resolver | None = None) -> DataFrame:
    """By a structure or a number in a column of table (id, column), exactly, else by the fallback."""
    got = values.join(table.select(F.col(column).cast("string").alias("value"), "id").groupBy("value").agg(F.min("id").alias("id")), "value", "left")
    found = result(got.where("id is not null").select("value", F.col("id").alias("resolved"), F.lit(1.0).alias("confidence"), F.lit(column).alias("source")))
    left = got.where("id is null").select("value")
    return found.unionByName(result(fallback(left)) if fallback else unresolved(left))


def guides(values: DataFrame, cache: DataFrame, align: Resolver, genes_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Guide sequences: from the cache (value, gene, chrom, start, end), else aligned by the caller's function (query, chrom, start, end, matched), best hit, nearest gene.

    Gives all, and what is new for the cache.
    """
    columns = ["value", "gene", "chrom", "start", "end"]
    have = values.join(cache.select(*columns), "value")
    hits = intervals.best_hit(align(values.join(cache.select("value"), "value", "left_anti")))
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    near = intervals.nearest_gene(hits.select("chrom", middle.alias("at"), F.col("query").alias("point")), genes_)
    fresh = hits.join(near.withColumnRenamed("point", "query"), "query", "left").select(F.col("query").alias("value"), "gene", "chrom", "start", "end")
    return have.unionByName(fresh), fresh


def terms(values: DataFrame, ontology: DataFrame, kind: str) -> DataFrame:
    """Terms of the ontology that a kind of thing has."""
    return result(resolution.resolve_terms(values, ontology, ONTOLOGIES[kind]))


cell_types, tissues, diseases, organisms, assays = (partial(terms, kind=k) for k in ("cell_type", "tissue", "disease", "organism", "assay"))


def cell_lines(values: DataFrame, lines: DataFrame, text_search: bool = True) -> DataFrame:
    """By name (1.0), by synonym (0.9), else the first by words (0.7). lines: id, name, synonyms (array)."""
    names = lines.select(F.col("name").alias("key"), "id", F.lit(0).alias("rank"), F.lit(1.0).alias("confidence"))
    others = lines.select(F.explode("synonyms").alias("key"), "id", "name").where("key <> name").select("key", "id", F.lit(1).alias("rank"), F.lit(0.9).alias("confidence"))
    first = ranked_lookup(values, names.unionByName(others), "name")
    if not text_search:
        return first
    left = first.where("resolved is null").select("value")
    word = left.select("value", F.explode(F.array_distinct(search.tokens(F.col("value")))).alias("word"))
    every = F.array_distinct(search.tokens(F.concat_ws(" ", "name", F.concat_ws(" ", "synonyms"))))
    posting = lines.select("id", F.explode(every).alias("word"), F.size(every).alias("n"))
    w = Window.partitionBy("value").orderBy(F.desc("hits"), "n", "id")
    best = word.join(posting, "word").groupBy("value", "id").agg(F.count("*").alias("hits"), F.first("n").alias("n")).withColumn("r", F.row_number().over(w)).where("r = 1")
    found = left.join(best, "value", "left").select("value", F.col("id").alias("resolved"), F.when(F.col("id").isNotNull(), 0.7).otherwise(0.0).alias("confidence"), F.when(F.col("id").isNotNull(), "words").alias("source"))
    return first.where("resolved is not null").unionByName(result(found))


def organism_records(values: DataFrame, table: DataFrame) -> DataFrame:
    """value and the record of an organism by its common or scientific name. table: common_name, scientific_name and more."""
    both = table.select(F.explode(F.array(F.lower("common_name"), F.lower("scientific_name"))).alias("__k"), "*").where("__k is not null").dropDuplicates(["__k"])
    return values.withColumn("__k", F.lower(F.trim("value"))).join(both, "__k", "left").drop("__k")


def live_terms(table: DataFrame, prefix: str) -> DataFrame:
    return table.where(F.col("term_id").startswith(f"{prefix}:") & ~F.coalesce("obsolete", F.lit(False)))


def enriched(results: DataFrame, records: DataFrame, columns: Iterable[str], key: str = "id") -> DataFrame:
    """Results with columns of their records, by one join for all."""
    columns = list(columns)
    return results.join(records.select(F.col(key).alias("resolved"), *columns), "resolved", "left").select(*results.columns, *columns)


# chains, caches, limits

def chain(*steps: Resolver) -> Resolver:
    """Each step on what those before left; the first that knows a value wins."""
    def run(values: DataFrame) -> DataFrame:
        left, out = values, None
        for step in steps:
            got = result(step(left))
            found = got.where("resolved is not null")
            out = found if out is None else out.unionByName(found)
            left = left.join(found.select("value"), "value", "left_anti")
        return out.unionByName(unresolved(left)) if out is not None else unresolved(left)

    return run


def cached(step: Resolver, read: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Resolver:
    """What a cache (the columns of a result) holds is not asked again; only what is resolved anew is written."""
    def run(values: DataFrame) -> DataFrame:
        known = values.join(read().select(*COLUMNS), "value")
        fresh = result(step(values.join(known.select("value"), "value", "left_anti")))
        write(fresh.where("resolved is not null"))
        return known.select(*COLUMNS).unionByName(fresh)

    return run


class Bucket:
    """So many calls a second, and a burst at most; take waits for its turn."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.left, self.at, self.lock = float(burst), clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.left = min(self.burst, self.left + (now - self.at) * self.rate)
            self.at = now
            if self.left < 1:
                wait = (1 - self.left) / self.rate
                self.sleep(wait)
                self.left, self.at = 1.0, now + wait
            self.left -= 1


def remote(ask: Callable[[str], str | None], source: str, confidence: float = 0.8, bucket: Bucket | None = None) -> Resolver:
    """A step that asks a service value by value, from the driver, at the pace of the bucket: for the few values that tables don't know."""
    def run(values: DataFrame) -> DataFrame:
        out = []
        for r in values.toLocalIterator():
            if bucket:
                bucket.take()
            got = ask(r.value)
            out.append((r.value, got, confidence if got is not None else 0.0, source if got is not None else "none"))
        return result(values.sparkSession.createDataFrame(out, "value string, resolved string, confidence double, source string"))

    return run


# reports and passes

def report_table(results: DataFrame) -> DataFrame:
    """A row for each input, its alternatives in one text."""
    return results.select("value", "resolved", "confidence", "source", F.array_join("alternatives", "; ").alias("alternatives"))


def keyed_merge(results: DataFrame, column: str, to: dict[str, str]) -> DataFrame:
    """A table to merge by the column: each result's columns under the names of the table's. Values without result stay out."""
    return results.where("resolved is not null").groupBy(F.col("value").alias(column)).agg(*[F.max_by(theirs, F.struct("confidence", theirs)).alias(ours) for theirs, ours in to.items()])


def apply_pass(df: DataFrame, column: str, resolver: Resolver, to: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """df with a column's distinct values resolved, in place or into other columns (result's column -> table's), and the results.

    Rows whose value has no result keep what they have.
    """
    results = resolver(distinct_values(df, column))
    names = to or {"resolved": column}
    merged = keyed_merge(results, "__key", {theirs: f"__new_{ours}" for theirs, ours in names.items()})
    out = df.join(merged, F.col(column).cast("string") == F.col("__key"), "left").drop("__key")
    for ours in names.values():
        new = F.col(f"__new_{ours}")
        out = out.withColumn(ours, F.coalesce(new.cast(df.schema[ours].dataType), F.col(ours)) if ours in df.columns else new)
    return out.select(*df.columns, *[c for c in names.values() if c not in df.columns]), results


#: Resolver kinds by marker: what a field's ontology_aligned or cross_reference names.
BINDINGS: dict[str, Callable[..., Resolver]] = {}


def bind(kind: str) -> Callable:
    """Registers how a resolver of a kind is made from reference tables."""
    def add(make: Callable[..., Resolver]) -> Callable:
        if kind in BINDINGS:
            raise ValueError(f"{kind!r} is bound already")
        BINDINGS[kind] = make
        return make

    return add


def parse_kind(kind: str) -> str:
    if kind not in BINDINGS:
        raise ValueError(f"no resolver for {kind!r}; there are {sorted(BINDINGS)}")
    return kind


for _kind in ONTOLOGIES:
    bind(_kind)(lambda tables, k=_kind: cell_lines_of(tables) if k == "cell_line" else partial(terms, ontology=tables["ontology"], kind=k))
bind("gene")(lambda tables: partial(genes, symbols=tables["gene_aliases"]))
bind("protein")(lambda tables: partial(proteins, aliases=tables["protein_aliases"], records=tables["proteins"]))
bind("compound")(lambda tables: partial(compounds, synonyms=tables["compound_synonyms"]))


def cell_lines_of(tables: dict[str, DataFrame]) -> Resolver:
    return partial(cell_lines, lines=tables["cell_lines"])


@dataclass(frozen=True)
class Pass:
    column: str
    kind: str
    to: dict[str, str] = field(default_factory=dict)


def plan(schema: T.StructType) -> list[Pass]:
    """The passes that a schema's markers ask for, in order of its fields."""
    out = []
    for f in schema.fields:
        kind = f.metadata.get("ontology_aligned") or f.metadata.get("cross_reference")
        if kind:
            out.append(Pass(f.name, parse_kind(kind)))
    return out


def run_plan(df: DataFrame, schema: T.StructType, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """df after all passes of its schema, and the results by column; columns that df lacks are left out."""
    results = {}
    for p in plan(schema):
        if p.column in df.columns:
            df, results[p.column] = apply_pass(df, p.column, BINDINGS[p.kind](tables), p.to or None)
    return df, results


def edits(results: DataFrame, column: str) -> list[curation.Op]:
    """One replacement for each value that changes, for a transaction; results are of distinct values."""
    return [curation.ReplaceValue(column, r.old, r.new) for r in resolution.proposals(results, column).orderBy("old").toLocalIterator()]


def coerced(value: object, kind: T.DataType) -> object:
    """A value as a column's type takes it: texts of numbers and truths are read, whole numbers stay whole; anything else is an error."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(kind, T.StringType):
        return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    if isinstance(kind, T.BooleanType):
        truth = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}
        if isinstance(value, bool):
            return value
        if (t := str(value).strip().lower()) in truth:
            return truth[t]
        raise ValueError(f"{value!r} is no truth value")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        number = float(value)
        if not number.is_integer():
            raise ValueError(f"{value!r} is no whole number")
        return int(value) if isinstance(value, (int, str)) and str(value).strip().lstrip("+-").isdigit() else int(number)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(value)
    if isinstance(kind, T.ArrayType):
        return [coerced(v, kind.elementType) for v in (value if isinstance(value, (list, tuple)) else [value])]
    return value
