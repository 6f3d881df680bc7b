
from quiltframe.plans.perturbation import Perturbations
from tests.test_atlas import OBS, atlas  # noqa: F401


def test_filters(spark, atlas):  # noqa: F811
    atlas.snapshot()
    q = atlas.checkout().query()
    genetic = spark.createDataFrame([("p", "TP53", "CRISPRko", "chr1", 10, 20), ("q", "BRCA2", "CRISPRi", "chr1", 100, 120)], "uid string, intended_gene_name string, perturbation_type string, target_chromosome string, target_start long, target_end long")
    molecules = spark.createDataFrame([("q", "aspirin", "CC", 7)], "uid string, name string, smiles string, pubchem_cid long")
    biologics = spark.createDataFrame([("p", "mab", "antibody")], "uid string, biologic_name string, biologic_type string")
    publications = spark.createDataFrame([("u1", "10.1/x", "77", "A title")], "uid string, doi string, pmid string, title string")
    datasets = spark.createDataFrame([("d1", "u1", "GSE1", "GEO"), ("d2", None, "GSE2", "GEO")], "dataset_uid string, publication_uid string, accession_id string, accession_database string")
    p = Perturbations(genetic, molecules, biologics, publications, datasets, column="parts")

    def uids(query):
        return {r.uid for r in query.obs().collect()}

    assert uids(p.by_gene(q, ["TP53", "BRCA2"])) == {"a", "b", "c"}
    assert uids(p.by_gene(q, ["TP53", "BRCA2"], every=True)) == {"c"}
    assert uids(p.by_gene(q, ["TP53", "BRCA2"], method="CRISPRi")) == {"b", "c"}
    assert uids(p.by_gene(p.by_compound(q, [7], "pubchem_cid"), ["TP53"])) == {"c"}
    assert uids(p.by_biologic(q, ["mab"], "antibody")) == {"a", "c"} and uids(p.by_biologic(q, ["mab"], "other")) == set()
    assert uids(p.by_publication(q, doi="10.1/x")) == {"a", "b"} and uids(p.by_publication(q, pmid="1").where("true")) == set()
    assert uids(p.by_accession(q, "GSE2", "GEO")) == {"c", "d"}
    assert uids(p.by_region(q, "chr1", 20, 99)) == {"a", "c"} and uids(p.by_region(q, "chr1", 20, 100)) == {"a", "b", "c"}
    got = p.with_metadata(q.obs(), ["intended_gene_name"], genetic)
    assert {r.uid: r.perturbation_intended_gene_name for r in got.collect()} == {"a": ["TP53"], "b": ["BRCA2"], "c": ["TP53", "BRCA2"], "d": None}
    assert p.with_metadata(q.obs().drop("parts"), ["intended_gene_name"], genetic).columns == ["uid", "dataset_uid", "tissue"]
