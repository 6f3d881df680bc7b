"""The engine's operators on the driver's tables, each with its SQL where SQL has it.

region of the supplier (or supplier) = dataset, part = feature registry, distinct
(region, order) = obs, lineitem = sparse values, embeddings = dense values, documents = full text,
ship dates and quantities = intervals, region > nation > customer = hierarchy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe import schema as S
from quiltframe.functions import ids, text
from quiltframe.operators import curation as C
from quiltframe.operators import intervals as I
from quiltframe.operators import keys as K
from quiltframe.operators import layouts as L
from quiltframe.operators import limits, ragged, resolution, resolvers, search
from quiltframe.plans import collection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.d}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, d: f(Tables(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def feature(key: Column) -> Column:
    """Part keys as uids that sort like the keys."""
    return F.lpad(key.cast("string"), 12, "0")


def registry(t: Tables) -> DataFrame:
    return t.part.select(feature(F.col("p_partkey")).alias("uid"), F.col("p_partkey").alias("global_index"), "p_name", "p_brand")


def measured(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("dataset"), feature(F.col("l_partkey")).alias("feature_uid")).distinct()


def values(t: Tables) -> DataFrame:
    where = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("dataset"))
    return t.lineitem.join(where, F.col("l_suppkey") == F.col("s_suppkey")).select("dataset", F.concat_ws("-", "dataset", "l_orderkey").alias("uid"), F.col("l_partkey").alias("local_index"), F.col("l_quantity").alias("value"))


def chosen(t: Tables) -> DataFrame:
    """Layouts of the regions: their local indices are the parts' keys."""
    return values(t).select("dataset", F.col("dataset").alias("layout_uid"), "local_index", F.col("local_index").alias("global_index")).distinct()


_L = "(select n_regionkey as d, concat(n_regionkey, '-', l_orderkey) as uid, l_partkey as g, l_quantity as x from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey)"
_UNION = f"select g, row_number() over (order by g) - 1 as c from (select distinct g from {_L})"
_INTER = f"select g, row_number() over (order by g) - 1 as c from (select g from {_L} group by g having count(distinct d) = (select count(distinct d) from {_L}))"


@query(_UNION.replace("g, row", "g as global_index, row").replace("as c from", 'as "column" from'))
def feature_union(t):
    return ragged.feature_space(chosen(t))


@query(_INTER.replace("g, row", "g as global_index, row", 1).replace("as c from", 'as "column" from', 1))
def feature_intersection(t):
    return ragged.feature_space(chosen(t), how="intersection")


def _sparse_sql(space: str) -> str:
    return f'with s as ({space}) select uid, c as "column", sum(x) as value from {_L} join s using (g) group by uid, c'


@query(_sparse_sql(_UNION))
def sparse_matrix_union(t):
    return ragged.sparse(values(t), chosen(t), ragged.feature_space(chosen(t)))


@query(_sparse_sql(_INTER))
def sparse_matrix_intersection(t):
    return ragged.sparse(values(t), chosen(t), ragged.feature_space(chosen(t), how="intersection"))


@query(f"select uid, g, sum(x) as value from {_L} where g in (1, 7, 9, 50, 111) group by uid, g")
def features_filter(t):
    wanted = L.resolve(registry(t), [f"{k:012d}" for k in (111, 1, 50, 7, 9, 7)])
    cols = wanted.select("global_index", (F.rank().over(Window.orderBy("global_index")) - 1).alias("column"))
    got = ragged.sparse(values(t), chosen(t), cols)
    return got.join(F.broadcast(cols), "column").select("uid", F.col("global_index").alias("g"), "value")


@query(f"select d as dataset, g as local_index, count(*) as n, sum(x) as total from {_L} group by d, g")
def feature_copy_scan(t):
    return ragged.by_feature(values(t)).groupBy("dataset", "local_index").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"with s as ({_UNION}), n as (select count(distinct uid) as n from {_L}), v as (select uid, g, sum(x) as x from {_L} group by uid, g) select c as \"column\", n.n as n_rows, count(v.x) as n_set, coalesce(sum(v.x), 0) as total from s cross join n left join v using (g) group by c, n.n")
def zero_fill(t):
    space = ragged.feature_space(chosen(t))
    v = ragged.sparse(values(t), chosen(t), space)
    n = values(t).select("uid").distinct().agg(F.count("*").alias("n_rows"))  # one row
    return space.select("column").join(F.broadcast(n)).join(v, "column", "left").groupBy("column").agg(F.first("n_rows").alias("n_rows"), F.count("value").alias("n_set"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


@query('select vec_id as uid, i - 1 as "column", cast(embedding[i] as double) as value from embeddings, unnest(range(1, len(embedding) + 1)) as r(i)')
def dense_matrix(t):
    e = t.embeddings.select(F.col("label").alias("dataset"), F.col("vec_id").alias("uid"), F.transform("embedding", lambda x: x.cast("double")).alias("value"))
    space = t.spark.range(64).select(F.col("id").alias("global_index"), F.col("id").alias("column"))
    lay = e.select("dataset").distinct().join(F.broadcast(space)).select("dataset", F.col("global_index").cast("int").alias("local_index"), "global_index")
    return ragged.dense(e, lay, space)


@query("select dataset, layout_uid, n from (select l_suppkey as dataset, substr(sha256(string_agg(concat(lpad(cast(l_partkey as varchar), 12, '0'), chr(0)), '' order by l_partkey)), 1, 16) as layout_uid, count(*) as n from (select distinct l_suppkey, l_partkey from lineitem) group by l_suppkey)")
def layout_uids(t):
    return L.build_layouts(measured(t), registry(t)).groupBy("dataset", "layout_uid").agg(F.count("*").alias("n"))


@query("select l_suppkey as dataset, lpad(cast(l_partkey as varchar), 12, '0') as feature_uid, row_number() over (partition by l_suppkey order by l_partkey) - 1 as local_index, l_partkey as global_index from (select distinct l_suppkey, l_partkey from lineitem)")
def layout_rows(t):
    return L.build_layouts(measured(t), registry(t)).drop("layout_uid")


@query("select lpad(cast(p_partkey as varchar), 12, '0') as uid, p_name, case when p_partkey < 100 then p_partkey else (select max(p_partkey) from part where p_partkey < 100) + row_number() over (partition by p_partkey < 100 order by p_partkey) end as global_index from part")
def registry_reindex(t):
    r = t.part.select(feature(F.col("p_partkey")).alias("uid"), "p_name", F.when(F.col("p_partkey") < 100, F.col("p_partkey")).alias("global_index"))
    return L.reindex(r)


@query("select lpad(cast(p_partkey as varchar), 12, '0') as uid, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity = 50)")
def register_if_absent(t):
    have = t.lineitem.where("l_quantity = 50").select(feature(F.col("l_partkey")).alias("uid")).distinct()
    return L.insert_absent(have, t.part.select(feature(F.col("p_partkey")).alias("uid"), "p_name"))


@query("select distinct lpad(cast(l_partkey as varchar), 12, '0') as feature_uid from lineitem where l_partkey not in (select p_partkey from part where p_size > 10)")
def missing_features(t):
    return L.missing_features(measured(t), t.part.where("p_size > 10").select(feature(F.col("p_partkey")).alias("uid")))


@query("select distinct l_suppkey as zarr_group, lpad(cast(l_partkey as varchar), 12, '0') as global_feature_uid, s_name from lineitem join supplier on s_suppkey = l_suppkey where l_partkey in (3, 30, 300)")
def datasets_with_features(t):
    lay = measured(t).withColumnRenamed("dataset", "layout_uid")
    data = t.supplier.select(F.col("s_suppkey").alias("zarr_group"), F.col("s_suppkey").alias("layout_uid"), "s_name")
    return L.datasets_with(lay, data, [f"{k:012d}" for k in (3, 30, 300)])


@query("select l_orderkey, l_linenumber, p_name, p_brand from lineitem left join part on p_partkey = l_partkey")
def feature_metadata(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", feature(F.col("l_partkey")).alias("feature_uid"))
    return L.feature_metadata(df, registry(t), "feature_uid", ["p_name", "p_brand"]).drop("feature_uid")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice between 1000 and 100000")
def obs_where_select(t):
    return t.orders.where(F.expr("o_orderstatus = 'F' and o_totalprice between 1000 and 100000")).select("o_orderkey", "o_totalprice")


@query("select o_orderpriority, count(*) as count from orders group by 1")
def obs_count_by(t):
    return limits.counted(t.orders, ["o_orderpriority"])


@query("select count(*) as n from orders where o_orderstatus = 'O'")
def obs_count(t):
    return t.orders.where("o_orderstatus = 'O'").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey from orders order by o_orderkey limit 500 offset 100")
def obs_offset_limit(t):
    return limits.page(t.orders, "o_orderkey", 500, 100).select("o_orderkey", "o_custkey")


@query("select c_custkey, c_mktsegment from customer qualify row_number() over (partition by c_mktsegment order by c_custkey) <= 203 // (select count(distinct c_mktsegment) from customer)")
def balanced_limit(t):
    return limits.balanced(t.customer, 203, "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment")


@query("select c_custkey, o.k as start from customer join (select o_custkey, min(o_orderkey) as k from orders group by 1) o on o_custkey = c_custkey")
def presence_filter(t):
    o = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    p = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.struct(F.col("o_custkey").cast("string").alias("zarr_group"), F.col("k").alias("start")).alias("p"))
    return K.presence(p, ["p"]).where("has_p").select("c_custkey", "p.start")


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as has_orders, c_acctbal > 0 as has_balance from customer")
def multimodal_presence(t):
    o = t.orders.select(F.col("o_custkey").alias("k")).distinct()
    p = t.customer.join(o, F.col("c_custkey") == F.col("k"), "left")
    s = p.select("c_custkey", F.struct(F.col("k").cast("string").alias("zarr_group")).alias("orders"), F.struct(F.when(F.col("c_acctbal") > 0, "g").alias("zarr_group")).alias("balance"))
    return K.presence(s, ["orders", "balance"]).select("c_custkey", "has_orders", "has_balance")


@query("with h as (select p_partkey, p_name, sha1(unhex('b3e7a9f16c2d4a8b9f013d5e7a2b8c4f') || encode(concat(p_name, '|', p_partkey))) as s from part) select p_partkey, substr(s, 1, 12) || '5' || substr(s, 14, 3) as uid from h")
def stable_uids(t):
    return t.part.select("p_partkey", ids.stable_uid(F.col("p_name"), F.col("p_partkey")).alias("uid"))


_QUERY = [round(0.01 * (i % 7 - 3), 2) for i in range(64)]


@query(f"with q as (select {_QUERY}::double[] as q) select vec_id, round(d, 6) as distance from (select vec_id, list_sum(list_transform(list_zip(embedding, q), lambda z: (cast(z[1] as double) - z[2]) * (cast(z[1] as double) - z[2]))) as d from embeddings, q) order by d, vec_id limit 25")
def vector_topk(t):
    got = search.vector_top(t.embeddings, "embedding", _QUERY, 25, "vec_id")
    return got.select("vec_id", F.round("_distance", 6).alias("distance"))


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '')"


@query(f"select doc_id from documents where list_contains({_TOKENS}, 'und') and list_contains({_TOKENS}, 'die')")
def text_match(t):
    return search.text_match(t.documents, "text", ["und", "die"]).select("doc_id")


@query(f"with t as (select doc_id, {_TOKENS} as w from documents where text is not null), f as (select doc_id, len(w) as n, len(list_filter(w, lambda x: x = 'was')) as a, len(list_filter(w, lambda x: x = 'with')) as b from t), s as (select count(*) as d, avg(n) as m, count(*) filter (where a > 0) as da, count(*) filter (where b > 0) as db from f) select doc_id, round(ln(1 + (d - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (d - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 6) as score from f, s where a + b > 0 order by score desc, doc_id limit 30")
def text_topk(t):
    docs = t.documents.where("text is not null")
    top = search.text_top(docs, "text", ["was", "with"], 60, "doc_id").select("doc_id", F.round("_score", 6).alias("score"))
    return top.orderBy(F.desc("score"), "doc_id").limit(30)


def frags(t: Tables) -> DataFrame:
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01"))
    return t.lineitem.select(F.col("l_returnflag").alias("chrom"), day.cast("long").alias("start"), F.col("l_quantity").cast("int").alias("length"), F.col("l_suppkey").cast("string").alias("barcode"))


_F = "(select l_returnflag as chrom, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as s, cast(l_quantity as int) as n, cast(l_suppkey as varchar) as barcode from lineitem)"


@query(f"select barcode, s as start, n as length from {_F} where chrom = 'R' and s < 9500 and s + n > 9300")
def fragment_region(t):
    return I.region(frags(t), "R", 9_300, 9_500).select("barcode", "start", "length")


_PEAKS = "(select p_partkey, case p_partkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as chrom, 8000 + (p_partkey * 37) % 2500 as a, 8000 + (p_partkey * 37) % 2500 + p_size as b from part)"


@query(f"select barcode, concat(p.chrom, ':', a, '-', b) as peak, count(*) as n from {_F} f join (select distinct chrom, a, b from {_PEAKS}) p on f.chrom = p.chrom and s < b and s + n > a group by 1, 2")
def peak_counts(t):
    k = F.col("p_partkey")
    chrom = F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R")
    peaks = t.part.select(chrom.alias("chrom"), (8_000 + (k * 37) % 2_500).alias("start"), (8_000 + (k * 37) % 2_500 + F.col("p_size")).alias("end")).distinct()
    return I.peak_counts(frags(t), peaks, 64)


@query("with g as (select s_nationkey as chrom, cast(floor(s_acctbal) as bigint) as at, s_name from supplier), q as (select c_custkey as point, c_nationkey as chrom, cast(floor(c_acctbal) as bigint) as at from customer), r as (select point, s_name as gene, row_number() over (partition by point order by abs(g.at - q.at), s_name) as n from q left join g on g.chrom = q.chrom) select point, gene from r where n = 1")
def nearest_gene(t):
    at = F.floor("s_acctbal")
    g = t.supplier.select(F.col("s_nationkey").alias("chrom"), at.alias("start"), at.alias("end"), F.lit("+").alias("strand"), F.col("s_name").alias("gene"))
    return I.nearest_gene(t.customer.select(F.col("c_nationkey").alias("chrom"), F.floor("c_acctbal").alias("at"), F.col("c_custkey").alias("point")), g)


def _orders(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("uid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts"))


_BRAND = "select l_orderkey from lineitem join part on p_partkey = l_partkey where p_brand = "


@query("select distinct l_orderkey as uid from lineitem join part on p_partkey = l_partkey where p_brand in ('Brand#11', 'Brand#12')")
def by_any(t):
    return K.having_any(_orders(t), "parts", t.part.where("p_brand in ('Brand#11', 'Brand#12')").select(F.col("p_partkey").alias("uid"))).select("uid")


@query(f"select distinct l_orderkey as uid from lineitem where l_orderkey in ({_BRAND} 'Brand#11') and l_orderkey in ({_BRAND} 'Brand#12')")
def by_all(t):
    sets = [t.part.where(F.col("p_brand") == b).select(F.col("p_partkey").alias("uid")) for b in ("Brand#11", "Brand#12")]
    return K.having_all(_orders(t), "parts", sets).select("uid")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey in (select r_regionkey from region where r_name = 'ASIA')))")
def semi_join_chain(t):
    n = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    c = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("select uid, pos, p_name as name from (select l_orderkey as uid, l_partkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as pos from lineitem) left join part on p_partkey = k and p_size > 5")
def list_enrichment(t):
    dim = t.part.where("p_size > 5").select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("name"))
    got = K.enrich_lists(_orders(t), "uid", "parts", dim, ["name"])
    return got.select("uid", F.posexplode("perturbation_name").alias("pos", "name"))


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 'HOUSES' else c_mktsegment end as c_mktsegment from customer")
def replace_value(t):
    return C.ReplaceValue("c_mktsegment", "BUILDING", "HOUSES").apply(t.customer).select("c_custkey", "c_mktsegment")


@query("select c_custkey, c_acctbal * 2 as twice, 'x' as tag from customer")
def add_columns(t):
    df = C.AddColumn("twice", "c_acctbal * 2", expr=True).apply(t.customer)
    return C.AddColumn("tag", "x").apply(df).select("c_custkey", "twice", "tag")


@query("select c_custkey, cast(c_nationkey as varchar) as c_nationkey from customer")
def cast_column(t):
    return C.CastColumn("c_nationkey", "string").apply(t.customer).select("c_custkey", "c_nationkey")


@query("select c_custkey, coalesce(n_name, c_name) as c_name from customer left join nation on n_nationkey = c_custkey")
def merge_columns(t):
    src = t.nation.select(F.col("n_nationkey").cast("long").alias("c_custkey"), F.col("n_name").alias("c_name"))
    return C.MergeColumns("c_custkey", ("c_name",), src).apply(t.customer).select("c_custkey", "c_name")


@query("select p_partkey, part as p_name, pos - 1 as pos from (select p_partkey, unnest(string_split(p_name, ' ')) as part, generate_subscripts(string_split(p_name, ' '), 1) as pos from part)")
def explode_column(t):
    return C.ExplodeColumn("p_name", " ", "pos").apply(t.part.select("p_partkey", "p_name"))


@query("select s_suppkey, 'key' as slot, cast(s_nationkey as varchar) as value from supplier union all select s_suppkey, 'name', s_name from supplier")
def wide_to_long(t):
    df = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("string").alias("a"), F.col("s_name").alias("b"))
    return C.WideToLong("slot", {"key": {"value": "a"}, "name": {"value": "b"}}).apply(df)


@query("with a as (select lower(p_name) as k, lpad(cast(p_partkey as varchar), 12, '0') as id, p_size > 45 as c from part), g as (select k, count(*) as n, count(*) filter (where c) as nc, coalesce(min(id) filter (where c), min(id)) as id from a group by k) select distinct p_name as value, g.id as resolved, case when nc = 1 then 1.0 when n = 1 then 0.9 else 0.7 end as confidence, n - 1 as others from part join g on k = lower(p_name)")
def resolve_alias(t):
    aliases = t.part.select(F.col("p_name").alias("alias"), feature(F.col("p_partkey")).alias("id"), (F.col("p_size") > 45).alias("canonical"))
    got = resolution.resolve_aliases(t.part.select(F.col("p_name").alias("value")), aliases)
    return got.select("value", "resolved", F.col("confidence").cast("double").alias("confidence"), F.size("alternatives").alias("others"))


@query("select 'n_name' as col, n_name as old, r_name as new from nation join region on r_regionkey = n_regionkey")
def propose_replacements(t):
    r = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("value"), F.col("r_name").alias("resolved"), F.lit(0.9).alias("confidence"))
    return resolution.proposals(r, "n_name").select(F.col("column").alias("col"), "old", "new")


def hierarchy(t: Tables) -> DataFrame:
    n = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return n.unionByName(c).unionByName(t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent")))


@query("select concat('c', c_custkey) as start, concat('n', c_nationkey) as node, 1 as depth from customer union all select concat('c', c_custkey), concat('r', n_regionkey), 2 from customer join nation on n_nationkey = c_nationkey union all select concat('c', c_custkey), 'world', 3 from customer")
def ontology_ancestors(t):
    starts = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("start"))
    return resolution.reachable(hierarchy(t), starts)


@query("select concat('r', n_regionkey) as start, concat('n', n_nationkey) as node, 1 as depth from nation union all select concat('r', n_regionkey), concat('c', c_custkey), 2 from customer join nation on n_nationkey = c_nationkey")
def ontology_descendants(t):
    return resolution.reachable(hierarchy(t), t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("start")), down=True)


@query("select concat('n', a.n_nationkey) as start, concat('n', b.n_nationkey) as node from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey")
def ontology_siblings(t):
    return resolution.siblings(hierarchy(t), t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("start")))


@query("select c_custkey, n_name as nation_uid from customer join nation on n_nationkey = c_nationkey")
def fk_scalar(t):
    return K.fill(t.customer, "c_nationkey", "nation_uid", t.nation, "n_nationkey", "n_name").select("c_custkey", "nation_uid")


@query("select s_suppkey, 0 as pos, n_name as uid from supplier join nation on n_nationkey = s_nationkey union all select s_suppkey, 1, r_name from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey")
def fk_lists(t):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.array(F.lit("nation"), F.lit("region")).alias("kinds"), F.array("n_nationkey", "n_regionkey").alias("keys"))
    got = K.fill_lists(s, "s_suppkey", "kinds", "keys", "uids", {"nation": (t.nation, "n_nationkey", "n_name"), "region": (t.region, "r_regionkey", "r_name")})
    return got.select("s_suppkey", F.posexplode("uids").alias("pos", "uid"))


@query("select coalesce(l.doc_id, d.doc_id) as doc_id, quality, lang from labels l full join (select doc_id, lang from documents where lang = 'en') d on d.doc_id = l.doc_id")
def obs_full_outer(t):
    return K.full_outer([t.labels.select("doc_id", "quality"), t.documents.where("lang = 'en'").select("doc_id", "lang")], "doc_id")


@query("select o_custkey, count(*) as n_orders, count(distinct o_orderstatus) as n_status, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as statuses from orders group by o_custkey")
def summary_fields(t):
    got = K.summary(t.orders, "o_custkey", {"n_orders": ("count", "o_orderkey"), "n_status": ("nunique", "o_orderstatus"), "statuses": ("unique", "o_orderstatus")})
    return got.withColumn("statuses", F.array_join("statuses", ","))


@query("select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 64 as batch, (row_number() over (order by o_orderkey) - 1) % 64 as position from orders")
def obs_batches(t):
    return K.batches(t.orders.select("o_orderkey"), 64, "o_orderkey")


@query("select o_orderkey, o_custkey, b as batch from (select o_orderkey, o_custkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 4 as b, count(*) over (partition by o_custkey) as n from orders) where (b + 1) * 4 <= n")
def group_batches(t):
    return K.group_batches(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 4, "o_orderkey")


@query("select c_custkey, lower(trim(c_mktsegment)) in ('building', 'machinery') as hit, c_name <> '' as named from customer")
def scalar_labels(t):
    return t.customer.select("c_custkey", F.lower(F.trim("c_mktsegment")).isin("building", "machinery").alias("hit"), text.join_key(F.col("c_name")).isNotNull().alias("named"))


@query("select p_partkey, trim(x) as target from (select p_partkey, unnest(regexp_split_to_array(replace(p_name, ' ', ' + '), '\\s*[+&;|]\\s*|\\s*,\\s+')) as x from part) where trim(x) <> ''")
def combinatorial_split(t):
    return t.part.select("p_partkey", F.explode(text.combination(F.replace("p_name", F.lit(" "), F.lit(" + ")))).alias("target"))


@query("select distinct event_type, case when event_type = 'click' then 'click' else 'other' end as kind, split_part(concat('E:', event_type), ':', 1) as prefix from events")
def curie_prefixes(t):
    return t.events.select("event_type").distinct().select("event_type", F.when(F.col("event_type") == "click", "click").otherwise("other").alias("kind"), text.curie_prefix(F.concat(F.lit("E:"), "event_type")).alias("prefix"))


@query("select o_orderkey, null as c_name, o_totalprice from orders union all select null, c_name, null from customer")
def diagonal_concat(t):
    return ragged.diagonal([t.orders.select("o_orderkey", "o_totalprice"), t.customer.select("c_name")])


_TERMS = "(select concat(p_brand, ':', lpad(cast(p_partkey as varchar), 12, '0')) as id, lower(p_name) as name, concat('syn', p_partkey % 500) as syn from part where p_size < 40)"


@query(f"with v as (select distinct p_name as value from part union select distinct concat('SYN', p_partkey % 700) from part), b as (select k, min((r, id)) as m from (select name as k, 0 as r, id from {_TERMS} union all select syn, 1, id from {_TERMS}) group by k) select value, m[2] as resolved, case m[1] when 0 then 1.0 when 1 then 0.9 else 0.0 end as confidence from v left join b on k = lower(value)")
def resolve_terms(t):
    terms = t.part.select(F.concat("p_brand", F.lit(":"), feature(F.col("p_partkey"))).alias("term_id"), F.col("p_name").alias("name"), F.concat(F.lit("syn"), F.col("p_partkey") % 500).alias("synonyms"), (F.col("p_size") >= 40).alias("obsolete"))
    values = t.part.select(F.col("p_name").alias("value")).union(t.part.select(F.concat(F.lit("SYN"), F.col("p_partkey") % 700)))
    return resolution.resolve_terms(values, terms).select("value", "resolved", F.col("confidence").cast("double").alias("confidence"))


@query("select count(*) as total, count(*) filter (where n_regionkey is not null) as resolved, count(*) filter (where n_regionkey is null) as unresolved from (select distinct p_size from part) left join nation on n_nationkey = p_size")
def resolution_report(t):
    r = t.part.select("p_size").distinct().join(t.nation, F.col("p_size") == F.col("n_nationkey"), "left").select(F.col("n_regionkey").alias("resolved"))
    return resolution.report(r).select("total", "resolved", "unresolved")


@query("with h as (select p_brand as query, concat('chr', p_size) as chrom, p_partkey as start, p_retailprice as matched from part), r as (select *, row_number() over (partition by query order by matched desc, chrom, start) as n from h where regexp_matches(chrom, '^chr([0-9]+|X|Y|M)$')) select query, chrom, start from r where n = 1")
def best_alignment(t):
    hits = t.part.select(F.col("p_brand").alias("query"), F.concat(F.lit("chr"), "p_size").alias("chrom"), F.col("p_partkey").alias("start"), F.col("p_retailprice").alias("matched"))
    return I.best_hit(hits).select("query", "chrom", "start")


@query("select distinct n_name as name, coalesce(n2, 'other') as sequence from nation left join (select n_name as k, concat('s', n_nationkey) as n2 from nation where n_name < 'J') on k = n_name")
def sequence_names(t):
    early = F.col("n_name") < "J"
    assembly = t.nation.select(F.concat(F.lit("s"), "n_nationkey").alias("sequence_name"), F.when(early, F.col("n_name")).alias("ucsc_name"), F.lit(None).cast("string").alias("genbank"), F.lit(None).cast("string").alias("refseq"))
    return I.sequence_names(t.nation.select(F.col("n_name").alias("name")), assembly)


@query("select s_suppkey, case when s_nationkey % 5 = 0 then 'odd' else 'wide' end as organism from supplier")
def organism_by_prefix(t):
    idc = F.concat(F.when(F.col("s_nationkey") % 5 == 0, "ENS").otherwise("ENSW"), "s_suppkey")
    pre = t.spark.createDataFrame([("ENS", "odd"), ("ENSW", "wide")], "prefix string, organism string")
    ids_ = t.supplier.select("s_suppkey", idc.alias("id"))
    return ids_.join(resolution.organism(ids_, pre), "id").select("s_suppkey", "organism")


@query("select c_custkey, c_mktsegment, c_acctbal, 'x' as name from customer")
def set_and_drop(t):
    df = C.AddColumn("tmp", 1, "int").apply(t.customer)
    out, status = C.apply(df, C.Transaction("customer", [C.DropColumn("tmp"), C.RenameColumn("c_name", "name"), C.SetColumn("name", "x")]))
    assert status == "applied"
    return out.select("c_custkey", "c_mktsegment", "c_acctbal", "name")


@query("select user_id, min(event_id) as first_event, count(*) as n from events group by user_id having count(*) >= 40")
def stratified_events(t):
    n = K.summary(t.events, "user_id", {"n": ("count", "event_id")}).where("n >= 40")
    return n.join(t.events.groupBy("user_id").agg(F.min("event_id").alias("first_event")), "user_id")


@query("select value, resolved, confidence, n - 1 as others from (select p_brand as value, cast(p_partkey as varchar) as resolved, cast(case when p_size > 45 then 1.0 else 0.9 end as double) as confidence, count(*) over (partition by p_brand) as n, row_number() over (partition by p_brand order by p_size <= 45, cast(p_partkey as varchar)) as r from part) where r = 1 union all select 'DMSO', 'DMSO', cast(1.0 as double), 0")
def compound_names(t):
    names = t.part.select(F.col("p_brand").alias("name"), F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") > 45).alias("is_title"))
    asked = t.part.select(F.concat("p_brand", F.lit(" sodium salt")).alias("v"), F.col("p_brand").alias("value")).select("value").distinct().union(t.spark.createDataFrame([("DMSO",)], "value string"))
    return resolvers.compounds(asked, names).select("value", "resolved", "confidence", F.size("alternatives").cast("long").alias("others"))


@query("select s_name as value, cast(s_suppkey as varchar) as resolved, cast(1.0 as double) as confidence from supplier union all select concat('x ', replace(s_name, '#', ' ')), cast(s_suppkey as varchar), cast(0.7 as double) from supplier where s_suppkey <= 5")
def cell_line_names(t):
    lines = t.supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.array(F.lower("s_name")).alias("synonyms"))
    asked = t.supplier.select(F.col("s_name").alias("value")).union(t.supplier.where("s_suppkey <= 5").select(F.concat(F.lit("x "), F.replace("s_name", F.lit("#"), F.lit(" ")))))
    return resolvers.cell_lines(asked, lines).select("value", "resolved", "confidence")


@query("select c_custkey, coalesce(k, c_mktsegment) as c_mktsegment, k as segment_id from customer left join (select c_mktsegment as v, concat('EFO:', min(c_custkey)) as k from customer where c_mktsegment < 'H' group by 1) on v = c_mktsegment")
def resolution_pass(t):
    terms_ = t.customer.where("c_mktsegment < 'H'").groupBy(F.initcap(F.col("c_mktsegment")).alias("name")).agg(F.concat(F.lit("EFO:"), F.min("c_custkey")).alias("term_id")).withColumn("synonyms", F.lit("")).withColumn("obsolete", F.lit(False))
    one, _ = resolvers.apply_pass(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", lambda v: resolvers.assays(v, terms_), {"resolved": "segment_id"})
    two, _ = resolvers.apply_pass(one, "c_mktsegment", lambda v: resolvers.assays(v, terms_))
    return two


@query("select cast(o_orderkey as varchar) as uid, cast(c_custkey as varchar) as customer_uid, 'all' as dataset_uid from orders join customer on c_custkey = o_custkey")
def final_tables(t):
    schemas = {
        "order": T.StructType([S.marked("uid", T.StringType()), S.marked("customer_uid", T.StringType(), registry_key="customer"), S.marked("dataset_uid", T.StringType())]),
        "customer": T.StructType([S.marked("uid", T.StringType()), S.marked("name", T.StringType(), natural_key=True)]),
    }
    staged = {
        "x.order": t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("string").alias("uid"), F.col("c_name").alias("customer_uid_key"), "o_orderstatus"),
        "customer": t.customer.select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_name").alias("name"), "c_acctbal"),
    }
    return collection.finalise(staged, schemas, None, "all")["order"]


@query("select x.uid, 'row' as kind from (select distinct s_suppkey as uid from supplier where s_suppkey % 3 = 0) x union all select s_suppkey, 'other' from supplier where s_suppkey % 3 <> 0")
def uids_kept(t):
    rows = t.supplier.select(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string")).otherwise(F.lit(" ")).alias("uid"), F.col("s_suppkey").cast("string").alias("acc"))
    schema = T.StructType([S.marked("acc", T.StringType(), stable_uid=True)])
    got = collection.assign_uids(rows, schema)
    same = F.col("uid") == ids.stable_uid(F.col("acc"))
    return got.select(F.col("acc").cast("long").alias("uid"), F.when(F.col("uid") == F.col("acc"), "row").when(same, "other").otherwise("wrong").alias("kind"))


@query("select count(*) as n_rows, cast(sum(case when n_regionkey = 0 then 1 else 0 end) as bigint) as n_first, max(r_name) as last_name from nation join region on r_regionkey = n_regionkey")
def stamped_rows(t):
    obs = t.region.select(F.col("r_regionkey").cast("string").alias("barcode"), F.col("r_name").alias("uid"))
    got = collection.stamp_uid(t.nation.select(F.concat(F.lit(" "), F.col("n_regionkey").cast("string"), F.lit(" ")).alias("barcode")), obs)
    return got.agg(F.count("*").alias("n_rows"), F.count_if(F.trim("barcode") == "0").alias("n_first"), F.max("uid").alias("last_name"))


from quiltframe import atlas_queries  # noqa: E402, F401  adds its queries, by the helpers above
