"""Entity resolution: aliases, ontology terms, hierarchies, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.functions import text as T


def resolve_aliases(values: DataFrame, aliases: DataFrame, value: str = "value") -> DataFrame:
    """value, resolved, confidence, source, alternatives for each distinct value.

    aliases: alias, id, canonical (boolean). One canonical id is sure (1.0), one
    id alone nearly (0.9); of several the first by name, canonical ones before others, is taken (0.7) and the rest are alternatives.
    """
    keys = values.select(F.col(value).alias("value")).where("value is not null").distinct().withColumn("__k", F.lower(F.trim("value")))
    per_id = aliases.select(F.lower("alias").alias("__k"), "id", "canonical").groupBy("__k", "id").agg(F.max("canonical").alias("canonical"))
    hits = per_id.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct((~F.col("canonical")).alias("other"), "id"))).alias("c"))
    n_canonical = F.size(F.filter("c", lambda x: ~x["other"]))
    found = keys.join(hits, "__k", "left")
    return found.select(
        "value",
        F.col("c")[0]["id"].alias("resolved"),
        F.when(F.col("c").isNull(), 0.0).when(n_canonical == 1, 1.0).when(F.size("c") == 1, 0.9).otherwise(0.7).alias("confidence"),
        F.when(F.col("c").isNull(), "none").otherwise("alias").alias("source"),
        F.coalesce(F.transform(F.slice("c", 2, 1_000_000), lambda x: x["id"]), F.array().cast("array<string>")).alias("alternatives"),
    )


def resolve_terms(values: DataFrame, terms: DataFrame, prefix: str | None = None, value: str = "value") -> DataFrame:
    """Ontology terms (term_id, name, synonyms " | "-separated, obsolete) by name (1.0), then synonym (0.9); the first by id wins."""
    live = terms.where(~F.coalesce("obsolete", F.lit(False)))
    if prefix:
        live = live.where(F.col("term_id").startswith(f"{prefix}:"))
    names = live.select(F.lower("name").alias("__k"), "term_id", F.lit(0).alias("rank"))
    synonyms = live.select(F.explode(F.split("synonyms", r" \| ")).alias("__s"), "term_id").select(F.lower(F.trim("__s")).alias("__k"), "term_id", F.lit(1).alias("rank"))
    best = names.union(synonyms).groupBy("__k").agg(F.min(F.struct("rank", "term_id")).alias("b"))
    keys = values.select(F.col(value).alias("value")).where("value is not null").distinct().withColumn("__k", F.lower(F.trim("value")))
    conf = F.when(F.col("b.rank") == 0, 1.0).when(F.col("b.rank") == 1, 0.9).otherwise(0.0)
    return keys.join(best, "__k", "left").select("value", F.col("b.term_id").alias("resolved"), conf.alias("confidence"), F.when(F.col("b").isNull(), "none").when(F.col("b.rank") == 0, "name").otherwise("synonym").alias("source"))


def resolve(values: DataFrame, lookups: list[Callable[[DataFrame], DataFrame]], controls: bool = False, cache: DataFrame | None = None, fallback: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Each value's resolution, and what was resolved anew: cache, control labels, lookups and the fallback in turn, each on what is left."""
    left = values.select("value").where("value is not null").distinct()
    columns = ["value", "resolved", "confidence", "source"]
    parts, fresh = [], []
    if cache is not None:
        parts.append(left.join(cache.select(*columns), "value"))
        left = left.join(cache.select("value"), "value", "left_anti")
    if controls:
        parts.append(left.where(T.is_control(F.col("value"))).select("value", T.control_type(F.col("value")).alias("resolved"), F.lit(1.0).alias("confidence"), F.lit("control").alias("source")))
        left = left.where(~T.is_control(F.col("value")))
    for step in [*lookups, *([fallback] if fallback else [])]:
        got = step(left).select(*columns)
        fresh.append(got.where("resolved is not null"))
        left = got.where("resolved is null").select("value")
    parts += fresh
    parts.append(left.select("value", F.lit(None).cast("string").alias("resolved"), F.lit(0.0).alias("confidence"), F.lit("none").alias("source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    new = fresh[0] if fresh else out.limit(0)
    for p in fresh[1:]:
        new = new.unionByName(p)
    return out, new


def report(resolved: DataFrame) -> DataFrame:
    """total, resolved, unresolved and ambiguous values."""
    ambiguous = F.count_if(F.size("alternatives") > 0) if "alternatives" in resolved.columns else F.lit(0)
    return resolved.agg(F.count("*").alias("total"), F.count_if(F.col("resolved").isNotNull()).alias("resolved"), F.count_if(F.col("resolved").isNull()).alias("unresolved"), ambiguous.cast("long").alias("ambiguous"))


def proposals(resolved: DataFrame, column: str) -> DataFrame:
    """column, old, new, confidence: one replacement for each old value, that of highest confidence."""
    changed = resolved.where("resolved is not null and resolved <> value")
    return changed.groupBy(F.col("value").alias("old")).agg(F.max_by(F.struct(F.col("resolved").alias("new"), "confidence"), F.struct("confidence", "resolved")).alias("b")).select(F.lit(column).alias("column"), "old", "b.*")


def organism(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """id, organism by the longest matching prefix (prefix, organism), else "unknown".

    An id goes to its prefixes of the lengths that there are, few numbers, and meets the table by an equi-join.
    """
    sizes = sorted(r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect())
    each = ids.select("id").distinct()
    if sizes:
        each = each.withColumn("prefix", F.explode(F.array(*[F.substring("id", 1, n) for n in sizes])))
        hit = each.join(prefixes, "prefix", "left")
    else:
        hit = each.withColumn("prefix", F.lit("")).withColumn("organism", F.lit(None).cast("string"))
    hit = hit.withColumn("prefix", F.when(F.col("organism").isNotNull(), F.col("prefix")))
    return hit.groupBy("id").agg(F.max_by("organism", F.length("prefix")).alias("organism")).select("id", F.coalesce("organism", F.lit("unknown")).alias("organism"))


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, down: bool = False) -> DataFrame:
    """start, node, depth of all that can be reached from starts (start) over edges (child, parent), nearest first; cycles end.

    A loop of frontier joins: each round joins only the nodes new in the last and is cut from its lineage.
    """
    a, b = ("parent", "child") if down else ("child", "parent")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next"))
    frontier = starts.select(F.col("start").cast("string").alias("start"), F.col("start").cast("string").alias("node"), F.lit(0).alias("depth")).distinct()
    spark = edges.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp()
        spark.sparkContext.setCheckpointDir(folder)
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.join(step, "node").select("start", F.col("next").cast("string").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = new.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", "depth").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def siblings(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node: the other children of each start's parents."""
    mine = starts.join(edges, starts["start"] == edges["child"]).select("start", "parent")
    return mine.join(edges, "parent").where("child <> start").select("start", F.col("child").alias("node")).distinct()
