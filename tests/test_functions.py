import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from quiltframe.functions import ids, text


def one(spark, expr, value=None):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("x")).first()["x"]


def test_uids(spark):
    ns = uuid.UUID(ids.NAMESPACE)
    df = spark.createDataFrame([(i, f"name é {i}", float(i) / 2) for i in range(300)], "i long, s string, f double")
    got = df.select("i", "s", "f", ids.stable_uid(F.col("s"), ids.whole_number(F.col("f"))).alias("u")).collect()
    for r in got:
        f = str(int(r.f)) if r.f == int(r.f) else str(r.f)
        assert r.u == uuid.uuid5(ns, f"{r.s}|{f}").hex[:16]
    assert one(spark, ids.stable_uid(F.col("v"))) is None
    uids = ["b", "a", "cé"]
    h = hashlib.sha256(b"".join(u.encode() + b"\0" for u in uids)).hexdigest()[:16]
    assert one(spark, ids.layout_uid(F.array(*[F.lit(u) for u in uids]))) == h
    assert len(one(spark, ids.random_uid())) == 16


@pytest.mark.parametrize("f, value, want", [
    (text.is_control, " DMSO ", True), (text.is_control, "TP53", False),
    (text.control_type, "Non-Targeting", "nontargeting"), (text.control_type, "etoh", "ethanol"), (text.control_type, "lacZ", "lacz"), (text.control_type, "x", None),
    (text.combination, " A+B & C ; D|E, F,G ", ["A", "B", "C", "D", "E", "F,G"]), (text.combination, "+", []),
    (text.perturbation_method, "CRISPR-i screen", "CRISPRi"), (text.perturbation_method, "a CRISPR screen", "CRISPRko"), (text.perturbation_method, "dCas9-VP64", "CRISPRa"), (text.perturbation_method, "sirna", "siRNA"), (text.perturbation_method, "drug", None),
    (text.BARCODES["strip_suffix"], "s#ACGT-1", "s#ACGT"), (text.BARCODES["strip_prefix"], "s#ACGT-1", "ACGT-1"), (text.BARCODES["strip_both"], "s#ACGT-1", "ACGT"), (text.BARCODES["reverse_complement"], "AACG-1", "CGTT"), (text.BARCODES["exact"], "a", "a"),
    (text.join_key, "  ", None), (text.join_key, " a ", "a"), (text.join_key, "NaN", None),
    (text.curie_prefix, "CL:0001", "CL"), (text.placeholder_symbol, "AC134879.3", True), (text.placeholder_symbol, "1700049J03Rik", True), (text.placeholder_symbol, "TP53", False),
    (text.is_gene_id, "ENSG000001.4", True), (text.is_gene_id, "ENSMUSG01", True), (text.is_gene_id, "ENST1", False), (text.gene_base, "ENSG1.2", "ENSG1"),
    (text.compound, " Imatinib mesylate ", "Imatinib"), (text.compound, "X (free base)", "X"), (text.compound, "aspirin", "aspirin"), (text.sex, "male", "PATO:0000384"), (text.sex, "?", None),
])
def test_text(spark, f, value, want):
    assert one(spark, f(F.col("v")), value) == want


def test_lists(spark):
    df = spark.createDataFrame([(["a", "b"], ["1", "2"], "k: v; x; n: m: o")], "a array<string>, b array<string>, t string")
    r = df.select(text.joined(F.col("a")).alias("j"), text.search_tokens(F.col("a"), F.col("b")).alias("s"), text.key_values(F.col("t")).alias("m"), text.equal_lengths(F.col("a"), F.col("b")).alias("e")).first()
    assert (r.j, r.s, r.m, r.e) == ("a;b", "a:1 b:2", {"k": "v", "n": "m: o"}, True)
    with pytest.raises(Exception, match="no prefix"):
        one(spark, text.curie_prefix(F.col("v")), "plain")
