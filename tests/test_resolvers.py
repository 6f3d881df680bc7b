import pytest
from pyspark.sql import types as T

from quiltframe import schema as S
from quiltframe.operators import audit, curation
from quiltframe.operators import resolvers as R
from quiltframe.sources.store import Store


def vals(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "value string")


def got(df):
    return {r.value: (r.resolved, r.confidence, r.source, list(r.alternatives)) for r in df.collect()}


def test_kinds(spark):
    syn = spark.createDataFrame([("Aspirin", "2244", True), ("acetylsalicylic acid", "2244", False), ("aspirin", "9", False)], "name string, id string, is_title boolean")
    smi = spark.createDataFrame([("2244", "CC(=O)O")], "id string, smiles string")
    c = R.compounds(vals(spark, "DMSO", "Aspirin", "acetylsalicylic acid sodium", "thing"), syn, smi)
    assert {r.value: (r.resolved, r.confidence, r.source, r.smiles) for r in c.collect()} == {"DMSO": ("DMSO", 1.0, "control", None), "Aspirin": ("2244", 1.0, "synonym", "CC(=O)O"), "acetylsalicylic acid sodium": ("2244", 0.9, "synonym", "CC(=O)O"), "thing": (None, 0.0, "none", None)}
    assert got(c)["Aspirin"][3] == ["9"]
    al = spark.createDataFrame([("p53", "P04637", True, "human"), ("p53", "P02340", True, "mouse")], "alias string, id string, canonical boolean, organism string")
    rec = spark.createDataFrame([("P04637", "TP53")], "id string, gene string")
    assert [(r.resolved, r.gene) for r in R.proteins(vals(spark, "P53"), al, rec, ["gene"], "human").collect()] == [("P04637", "TP53")]
    g = spark.createDataFrame([("TP53", "ENSG00000141510", True)], "alias string, id string, canonical boolean")
    assert {k: v[:3] for k, v in got(R.genes(vals(spark, "tp53", "ENSG00000141510.4", "ENSG00000000009", "what"), g)).items()} == {"tp53": ("ENSG00000141510", 1.0, "alias"), "ENSG00000141510.4": ("ENSG00000141510", 1.0, "id"), "ENSG00000000009": (None, 0.0, "none"), "what": (None, 0.0, "none")}
    lines = spark.createDataFrame([("CVCL_1", "HeLa", ["HeLa", "He-La cells"]), ("CVCL_2", "K-562", ["K562"])], "id string, name string, synonyms array<string>")
    assert {k: v[:3] for k, v in got(R.cell_lines(vals(spark, "hela", "K562", "the cells of K 562", "zz"), lines)).items()} == {"hela": ("CVCL_1", 1.0, "name"), "K562": ("CVCL_2", 0.9, "name"), "the cells of K 562": ("CVCL_2", 0.7, "words"), "zz": (None, 0.0, "none")}
    onto = spark.createDataFrame([("CL:1", "T cell", "T-cell | t lymphocyte", False), ("UBERON:1", "T cell", "", False)], "term_id string, name string, synonyms string, obsolete boolean")
    assert got(R.cell_types(vals(spark, "T lymphocyte"), onto))["T lymphocyte"][:2] == ("CL:1", 0.9) and R.live_terms(onto, "CL").count() == 1
    assert got(R.structures(vals(spark, "CC(=O)O", "x"), smi, "smiles"))["CC(=O)O"][0] == "2244" and R.canonical_smiles("C") is None
    org = spark.createDataFrame([("human", "Homo sapiens", 9606)], "common_name string, scientific_name string, taxon int")
    assert {r.value: r.taxon for r in R.organism_records(vals(spark, "Homo Sapiens", "human ", "cat"), org).collect()} == {"Homo Sapiens": 9606, "human ": 9606, "cat": None}
    cache = spark.createDataFrame([("AAA", "g1", "chr1", 1, 4)], "value string, gene string, chrom string, start long, end long")
    hits = spark.createDataFrame([("CCC", "chr2", 90, 110, 1.0), ("CCC", "chrUn_1", 1, 2, 2.0)], "query string, chrom string, start long, end long, matched double")
    near = spark.createDataFrame([("chr2", 100, 300, "+", "g2"), ("chr2", 500, 600, "+", "g3")], "chrom string, start long, end long, strand string, gene string")
    every, fresh = R.guides(vals(spark, "AAA", "CCC"), cache, lambda v: hits.join(v.withColumnRenamed("value", "query"), "query"), near)
    assert sorted((r.value, r.gene) for r in every.collect()) == [("AAA", "g1"), ("CCC", "g2")] and [r.value for r in fresh.collect()] == ["CCC"]


def test_chains_and_caches(spark):
    one = lambda v: v.selectExpr("value", "if(value = 'a', 'A', null) as resolved", "1.0D as confidence", "'one' as source")
    asked, slept = [], []
    clock = iter([0.0, 0.0, 0.0, 0.0, 0.0])
    bucket = R.Bucket(2, 1, lambda: next(clock), slept.append)
    ask = R.remote(lambda x: asked.append(x) or {"b": "B"}.get(x), "web", bucket=bucket)
    out = got(R.chain(one, ask)(vals(spark, "a", "b", "c")))
    assert {k: v[0] for k, v in out.items()} == {"a": "A", "b": "B", "c": None} and set(asked) == {"b", "c"} and slept[:1] == [0.5]
    kept = []
    have = R.result(vals(spark, "a").selectExpr("value", "'old' as resolved", "1.0D as confidence", "'cache' as source"))
    out = got(R.cached(one, lambda: have, kept.append)(vals(spark, "a", "b")))
    assert out["a"][0] == "old" and out["b"][0] is None and kept[0].count() == 0
    assert [tuple(r) for r in R.report_table(R.ranked_lookup(vals(spark, "x"), spark.createDataFrame([("x", "1", 0, 1.0), ("X", "2", 1, 0.9), ("x", "3", 1, 0.9)], "key string, id string, rank int, confidence double"), "s")).collect()] == [("x", "1", 1.0, "s", "2; 3")]


def test_passes(spark):
    onto = spark.createDataFrame([("UBERON:5", "liver", "", False), ("CL:7", "b cell", "B lymphocyte", False)], "term_id string, name string, synonyms string, obsolete boolean")
    schema = T.StructType([S.marked("tissue", T.StringType(), ontology_aligned="tissue"), S.marked("cell", T.StringType(), ontology_aligned="cell_type"), T.StructField("n", T.LongType())])
    df = spark.createDataFrame([("Liver", "b cell", 1), ("moon", None, 2), ("liver", "B Lymphocyte", 3)], "tissue string, cell string, n long")
    out, results = R.run_plan(df, schema, {"ontology": onto})
    assert sorted((r.n, r.tissue, r.cell) for r in out.collect()) == [(1, "UBERON:5", "CL:7"), (2, "moon", None), (3, "UBERON:5", "CL:7")]
    assert set(results) == {"tissue", "cell"} and [p.kind for p in R.plan(schema)] == ["tissue", "cell_type"]
    two, _ = R.apply_pass(df, "tissue", lambda v: R.tissues(v, onto), {"resolved": "tissue_id", "confidence": "tissue_sure"})
    assert sorted((r.n, r.tissue, r.tissue_id, r.tissue_sure) for r in two.collect()) == [(1, "Liver", "UBERON:5", 1.0), (2, "moon", None, None), (3, "liver", "UBERON:5", 1.0)]
    assert [(e.old, e.new) for e in R.edits(results["tissue"], "tissue")] == [("Liver", "UBERON:5"), ("liver", "UBERON:5")]
    with pytest.raises(ValueError, match="no resolver"):
        R.parse_kind("moons")
    with pytest.raises(ValueError, match="already"):
        R.bind("gene")(None)


def test_coercion():
    for value, kind, want in ((3.0, T.StringType(), "3"), ("7", T.LongType(), 7), ("yes", T.BooleanType(), True), (2.0, T.IntegerType(), 2), ("1.5", T.DoubleType(), 1.5), (["1", 2], T.ArrayType(T.LongType()), [1, 2]), (None, T.LongType(), None), (float("nan"), T.StringType(), None), (2**60 + 1, T.LongType(), 2**60 + 1)):
        assert R.coerced(value, kind) == want
    for value, kind in (("x", T.LongType()), (1.5, T.LongType()), ("maybe", T.BooleanType())):
        with pytest.raises(ValueError):
            R.coerced(value, kind)


def test_audit(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    rows = spark.createDataFrame([("aaa", "BRCA2", "ENS1"), ("bbb", "BRCA2", "ENS2"), ("ccc", "TP53", "ENS3")], "uid string, gene_symbol string, ensembl_id string")
    store.create("genes", rows.schema)
    store.append("genes", rows)
    log = audit.AuditStore(store)
    t = curation.Transaction("genes", [curation.ReplaceValue("gene_symbol", "TP53", "P53"), curation.RenameColumn("ensembl_id", "eid")], "me", "because")
    assert audit.apply(store, "genes", t, log) == "applied"
    assert store.read("genes").where("gene_symbol = 'P53'").count() == 1 and "eid" in store.read("genes").columns
    bad = curation.Transaction("genes", [curation.SetColumn("eid", "x"), curation.CastColumn("eid", "int")])
    assert audit.apply(store, "genes", bad, log) == "partial"
    listed = log.list().collect()
    assert [(r.uid, r.status) for r in listed] == [(bad.uid, "partial"), (t.uid, "applied")] and listed[0].error and log.list("none").count() == 0 and log.list(limit=1).count() == 1
    assert [(r.op, r.status) for r in log.get(bad.uid).collect()] == [("SetColumn", "applied"), ("CastColumn", "pending")]
    assert log.pending(bad.uid) == [bad.ops[1]]
    audit.revert(store, "genes", log, t.uid)
    assert sorted(tuple(r) for r in store.read("genes").collect()) == sorted(tuple(r) for r in rows.collect())
    with pytest.raises(KeyError):
        log.version_before("nope")
    with pytest.raises(ValueError):
        audit.op_from_json("Transaction", "{}")
