import json

import numpy as np
import pytest
from pyspark.sql import types as T

from quiltframe import schema as S
from quiltframe import schema_code as C
from quiltframe import schema_ir as IR
from quiltframe.plans import collection as P
from quiltframe.plans import results as R
from quiltframe.sources import ingest, readers
from quiltframe.sources import reference as X
from quiltframe.sources.atlas import Atlas

YAML = """
# a small atlas
tables:
  study:
    fields:
      uid: {kind: string}
      accession:
        kind: string
        stable_uid: true
  gene_expression:
    fields:
      gene_name: {kind: string, nullable: false}
  cell:
    fields:
      uid: {kind: string}
      dataset_uid: {kind: string}
      study_uid:
        kind: string
        registry_key: study
      tissue:
        kind: string
        ontology_aligned: tissue
      tags: {kind: string, list: true}
      gene_expression:
        pointer: gene_expression
    require_any:
      -
        - tissue
        - tags
"""


def test_yaml():
    got = C.from_yaml(YAML)
    assert got["tables"]["cell"]["fields"]["tags"] == {"kind": "string", "list": True} and got["tables"]["cell"]["require_any"] == [["tissue", "tags"]]
    assert C.from_yaml(C.to_yaml(got)) == got and C.from_yaml("") == {} and C.from_yaml('{"a": [1]}') == {"a": [1]}
    assert C.from_yaml("a: 'it''s'\nb: [x, 2, true]\nc: ~\nd:\n- 1\n- two") == {"a": "it's", "b": ["x", 2, True], "c": None, "d": [1, "two"]}
    for bad in ("a: 1\na: 2", "a:\n  b: 1\n    c: 2", "a: 1\n  b: 2", "\ta: 1", "x", "a: 1\n&b: 2"):
        with pytest.raises(ValueError):
            C.from_yaml(bad)


def test_source():
    tables, constraints = IR.load(C.from_yaml(YAML))
    text = C.source(tables, constraints)
    assert IR.dump(*IR.load(C.from_source(text))) == IR.dump(tables, constraints)
    space = {}
    exec(text, space)  # what is generated runs too
    assert dict([space["study"]])["study"] == C.from_source(text)["tables"]["study"]
    for bad in ("import os\nos.system('x')", "x = other('y')", "x = table('y', 1)", "x = table('y', column('a', kind=open('f')))"):
        with pytest.raises(ValueError):
            C.from_source(bad)
    p = C.parsed(tables, {"cell": "study"})
    assert p.relationships == [{"from": "cell", "column": "study_uid", "to": "study", "many": False}] and p.inherited == {"cell": ["uid"]}
    assert C.markers(tables["cell"], "ontology_aligned") == {"tissue": "tissue"} and C.deferred(tables["cell"]) == {"gene_expression"}


def test_stages(spark, tmp_path):
    assert [s for s, fault in C.validate(YAML, spark, f"{tmp_path}/a") if fault is None] == ["parse", "load", "generate", "obs tables", "atlas"]
    assert C.validate("a: 1\na: 2", spark, f"{tmp_path}/b")[-1][0] == "parse"
    assert C.validate("tables:\n  x:\n    colour: red", spark, f"{tmp_path}/c")[-1][0] == "load"
    assert "no table has a pointer" in C.validate("tables:\n  x:\n    fields:\n      a: {kind: string}", spark, f"{tmp_path}/d")[-1][1]
    assert "already" in C.validate(YAML, spark, f"{tmp_path}/a")[-1][1]


def test_records(spark):
    from pyspark.sql import functions as F

    from quiltframe.functions.ids import stable_uid

    schema = T.StructType([T.StructField("uid", T.StringType()), S.marked("acc", T.StringType(), stable_uid=True), T.StructField("global_index", T.LongType()), S.pointer("image", "discrete_image")])
    rows = spark.createDataFrame([("A", None, ("z", [0], [1])), ("B", 3, ("z", [2], [1])), (None, None, None)], "acc string, global_index long, image struct<zarr_group:string,min_corner:array<bigint>,max_corner:array<bigint>>").withColumn("uid", F.when(F.col("acc") == "A", stable_uid(F.col("acc"))).otherwise(F.lit("other")))
    assert C.check_records(rows, schema) == ["uid is not that of acc: 1 rows", "image: corners: 1 rows", "global_index is given: 1 rows"]
    assert C.check_records(rows.where("acc = 'A'"), schema) == []
    made = spark.createDataFrame([("z", 1), (None, None)], "g string, p int").select(C.pointer_struct("dense", zarr_group="g", position="p").alias("x")).collect()
    assert [None if r.x is None else tuple(r.x) for r in made] == [("z", 1), None]
    with pytest.raises(ValueError):
        C.pointer_struct("dense", zarr_group="g")
    with pytest.raises(ValueError, match="prepare"):
        C.prepared(rows, "missing")


def test_finalise(spark):
    tables, _ = IR.load(C.from_yaml(YAML))
    schemas = {n: tables[n] for n in ("cell", "study")}
    staged = {
        "study": spark.createDataFrame([("ACC1",), ("ACC2",)], "accession string"),
        "d1.cell": spark.createDataFrame([("", "ACC2", "liver", "junk"), ("mine", "ACC1", "lung", "junk")], "uid string, study_uid_key string, tissue string, leftover string"),
    }
    done = P.finalise(staged, schemas, {"cell": lambda df: df.withColumn("tissue", df.tissue.substr(1, 3))}, "d1")
    study = {r.accession: r.uid for r in done["study"].collect()}
    cells = done["cell"].collect()
    assert {(r.dataset_uid, r.study_uid, r.tissue) for r in cells} == {("d1", study["ACC2"], "liv"), ("d1", study["ACC1"], "lun")}
    assert done["cell"].columns == tables["cell"].fieldNames() and "mine" in {r.uid for r in cells} and all(r.uid for r in cells)
    again = {r.accession: r.uid for r in P.finalise(staged, schemas, None, "d1")["study"].collect()}
    assert again == study  # stable
    staged["d1.cell"] = staged["d1.cell"].withColumn("study_uid_key", staged["d1.cell"].leftover)
    with pytest.raises(Exception, match="no row has the key"):
        P.finalise(staged, schemas)["cell"].collect()
    with pytest.raises(ValueError, match="required"):
        P.conform(spark.createDataFrame([(1,)], "x int"), tables["gene_expression"])
    assert P.missing_columns(staged["study"], tables["gene_expression"]) == ["gene_name"]


def test_pieces(spark):
    obs = spark.createDataFrame([("u1", "AA-1"), ("u2", "CC-1")], "uid string, barcode string")
    assert sorted(r.uid for r in P.stamp_uid(spark.createDataFrame([(" AA-1 ",), ("CC-1",)], "barcode string"), obs).collect()) == ["u1", "u2"]
    with pytest.raises(Exception, match="no obs row"):
        P.stamp_uid(spark.createDataFrame([("GG-1",)], "barcode string"), obs).collect()
    a, b = P.seed_join(spark.createDataFrame([("d",)], "dataset_uid string"), spark.createDataFrame([("p",)], "title string"))
    assert a.first().publication_key == b.first().publication_key == "0"
    with pytest.raises(ValueError, match="several"):
        P.seed_join(a.drop("publication_key"), b.union(b))
    assert [r.zarr_group for r in P.assign_groups(spark.createDataFrame([("d", None)], "dataset_uid string, zarr_group string"), ["x", "y"]).collect()] == ["d/x", "d/y"]
    one, two = P.reconcile([obs, spark.createDataFrame([("AA",), ("CC",)], "barcode string")])
    joined = P.join_obs({"a": one.select("multimodal_barcode", "uid"), "b": two.select("multimodal_barcode")})
    assert sorted(r.uid for r in joined.collect()) == ["u1", "u2"] and P.join_obs({"a": one}) is one
    assert P.stage_records(spark, "dataset", [{"a": 1}, {"b": "x"}]).columns == ["a", "b"]
    with pytest.raises(ValueError):
        P.stage_records(spark, "other", [])
    assert P.discover({"d1.cell": 1, "d2.cell": 2, "cellar": 3}, {"cell": None}) == {"cell": ["d1.cell", "d2.cell"]}
    assert P.artifact(spark.createDataFrame([("u", "3")], "uid string, n string"), "n").first().row == 3


def test_ingest(spark, tmp_path):
    tables, _ = IR.load(C.from_yaml(YAML))
    a = Atlas.create(spark, f"{tmp_path}/a", {"cell": tables["cell"]}, {"gene_expression": tables["gene_expression"]}, {"study": tables["study"]})
    c = readers.Collection("c").add("d1", "gene_expression", "x").add("d2", "gene_expression", "y")
    obs = {d: spark.createDataFrame([(f"{d}{i}", i) for i in range(3)], "uid string, obs long") for d in c.datasets}

    def load(ctx):
        x = np.array([[1, 0], [0, 2], [3, 0]]) * (1 if ctx.dataset == "d1" else 10)
        uids = spark.createDataFrame([(i, f"{ctx.dataset}{2 - i}") for i in range(3)], "row long, uid string")  # permuted
        return P.LoaderResult(ingest.MatrixReader(spark, {"counts": x}), spark.createDataFrame([("g0", "a", 0), ("g1", "b", 1)], "uid string, gene_name string, local_index long"), uids)

    studies = spark.createDataFrame([("s1", "ACC")], "uid string, accession string")
    assert P.ingest_collection(a, c, {"study": studies}, obs, {"gene_expression": load}) == ["d1", "d2"]
    assert P.ingest_collection(a, c, {"study": studies}, obs, {"gene_expression": load}) == [] and a.table("study").count() == 1
    a.optimize()
    a.snapshot()
    got = R.to_anndata(a.checkout().query())
    assert dict(zip(got.obs["uid"], got.batch.dense().tolist())) == {"d10": [3, 0], "d11": [0, 2], "d12": [1, 0], "d20": [30, 0], "d21": [0, 20], "d22": [10, 0]}
    with pytest.raises(ValueError, match="no loader"):
        P.ingest_collection(a, c, {}, obs, {})
    with pytest.raises(Exception, match="no obs row has the uid"):
        P.obs_index(spark.createDataFrame([(0, "zz")], "row long, uid string"), obs["d1"]).collect()


def test_reference(spark, tmp_path):
    r = X.Reference(spark, f"{tmp_path}/r")
    assert set(r.tables()) == set(X.RECORDS) and r.load("organisms", iter([[{"common_name": "human", "taxon": 9606}], [{"common_name": "cat"}, {"common_name": "human", "taxon": 9606}]])) == 3
    r.optimise("organisms", "common_name")
    assert r.table("organisms").count() == 2
    with pytest.raises(ValueError):
        r.load("organisms", [[{"colour": 1}]])
    with pytest.raises(KeyError):
        r.table("nope")


def test_services(tmp_path):
    doc = {"obo_id": "CL:0000084", "label": "T cell", "synonyms": ["T lymphocyte"], "description": ["a cell"], "is_obsolete": False}
    asked = []

    def fetch(url):
        asked.append(url)
        if "search" in url:
            return json.dumps({"response": {"docs": [doc]}})
        if "ancestors" in url:
            return json.dumps({"_embedded": {"terms": [{"short_form": "CL_0000000", "label": "cell", "is_obsolete": True}]}})
        if "efetch?db=pubmed" in url:
            return "<S><PubmedArticle><PMID>12</PMID><Journal><Title>J</Title></Journal><PubDate><Year>2020</Year><Month>Mar</Month></PubDate><ArticleTitle>On <i>T</i> cells</ArticleTitle><AbstractText Label='AIM'>why</AbstractText><ArticleId IdType='doi'>10.1/x</ArticleId></PubmedArticle></S>"
        if "biosample" in url:
            return "<S><BioSample accession='SAMN1'><Organism taxonomy_name='Homo sapiens'/><Attribute attribute_name='Tissue' harmonized_name='tissue'>liver</Attribute></BioSample></S>"
        if "geo?" in url:
            return "^SERIES\n!Series_title = A\n!Series_sample_id = 1\n!Series_sample_id = 2\n"
        if "elink" in url:
            return json.dumps({"linksets": [{"linksetdbs": [{"links": ["7"]}]}]})
        return '<a href="../">up</a>\n<a href="GSE1_RAW.tar">GSE1_RAW.tar</a>  2020-01-01 10:00  1.5M\n'

    o = X.OntologyService("http://service", fetch, 1000)
    assert o.exact("t lymphocyte", "CL") == "CL:0000084" and o.exact("other", "CL") is None
    n = len(asked)
    o.exact("t lymphocyte", "CL")
    assert len(asked) == n and o.ancestors("CL:0000084") == [{"term_id": "CL:0000000", "name": "cell", "synonyms": "", "definition": None, "parents": [], "obsolete": True}]
    a = X.Archive("http://archive", fetch, 1000)
    assert a.publications(["12"]) == [{"pmid": "12", "doi": "10.1/x", "title": "On T cells", "journal": "J", "date": "2020-03-01", "sections": [{"label": "AIM", "text": "why"}]}]
    assert a.samples(["1"])[0]["attributes"] == {"tissue": "liver"} and a.series("GSE1")["Series_sample_id"] == ["1", "2"] and a.linked("gds", "pubmed", "1") == ["7"]
    assert a.files("GSE1") == [("GSE1_RAW.tar", 3 << 19)]
    assert X.characteristics(["Tissue: liver", "tissue: other", "x"]) == {"tissue": "liver"} and X.flat({"a": {"b": [1, 2]}, "c": None}) == {"a.b": "1; 2", "c": ""}
    assert [X.id_kind(x) for x in ("10.1038/x", "PMC12", "123", "GSE5", "SAMN01", "PRJNA1", "SRR1")] == ["doi", "pmcid", "pmid", "geo", "biosample", "bioproject", "sra"]
    for bad in (lambda: X.id_kind("what?"), lambda: X.iri("CL")):
        with pytest.raises(ValueError):
            bad()
    got = [list(X.download(["f.txt"], lambda n: n.encode(), f"{tmp_path}/d")) for _ in range(2)]
    assert got[0] == got[1] and open(got[0][0]).read() == "f.txt"
    assert X.listing("-rw-r--r-- 1 u g 77 Jan 1 2020 a b.gz") == [("a b.gz", 77)]
