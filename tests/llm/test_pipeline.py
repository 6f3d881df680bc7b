import corpus_pipeline as pipe
import pytest

import __spark_entry__ as entry
from quiltframe.llm import op1_line_dedup, op10_pii
from quiltframe.llm.registry import ORACLES, QUERIES
from tests.llm.test_line_dedup import brute as without_lines
from tests.llm.test_packing import verify
from tests.llm.test_pii import brute as patterns
from tests.llm.test_shingle_join import brute as groups

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipe.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns and before
            was, now = {r.doc_id: r for r in before}, {r.doc_id: r for r in after}
            assert now.keys() <= was.keys() and len(now) == len(after)
        if name == "language":
            assert now.keys() == {i for i, r in was.items() if any(map(str.isalpha, r.text or ""))}
            assert all(now[i] == was[i] for i in now)
        elif name == "lines":
            want = without_lines([(i, r.text) for i, r in was.items()])
            assert {i: r.text for i, r in now.items()} == {i: t for i, t in want.items() if t == was[i].text or t.strip()}
        elif name == "near copies":
            assert now.keys() == {i for i, _, _, root in groups([(i, r.text) for i, r in was.items()]) if root == i}
        elif name == "personal data":
            assert now.keys() == was.keys()
            for i, r in was.items():
                if not op10_pii.mentions(r.text):
                    assert now[i].text == r.text
                assert not patterns(now[i].text)
        else:
            verify({r.doc_id: r.text for r in before}, after, 4096)


def test_run(spark):
    assert pipe.run(spark, SF).count() > 0
    assert pipe.ORACLE_SQL is None


def test_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    t = "Some words of a line that is long enough to count for all.\n"
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", "en", "a", 5), (4, t * 3, "en", "a", 1), (5, t, None, None, None), (6, "mail a@b.co " + t.upper(), "en", "a", 3), (7, "word " * 30_000, "en", "a", 3)]
    docs = spark.createDataFrame(odd, schema)
    for name, stage in pipe.STAGES:
        for d in (docs, docs.limit(0)):
            got = stage(spark, d, SF).collect()
            if name == "lines" and d is docs:
                assert {r.doc_id: r.text for r in got}[4] == t.strip() + "\n" and 5 not in {r.doc_id for r in got}
            assert got or d is not docs


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, "你好", None), (4, None, None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in pipe.language(spark, docs, SF).collect()) == [1, 3]
    labelled = docs.union(spark.createDataFrame([(5, "some words of it", "en"), (6, "12", "de")], docs.schema))
    assert sorted(r.doc_id for r in pipe.language(spark, labelled, SF).collect()) == [1, 5]


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and len([n for n in names if n.startswith("op")]) == 10
    assert QUERIES.keys() <= names.keys() and ORACLES.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("clash", ["kind", "key", "h", "gone", "root", "blob", "ids", "n"])
def test_clashing_names(spark, clash):
    docs = spark.createDataFrame([(1, "a b c d e f\na b c d e f", "x"), (2, "a b c d e f", "y")], f"doc_id long, text string, {clash} string")
    assert sorted((r.doc_id, r.n_removed, r[clash]) for r in op1_line_dedup.dedup(docs).collect()) == [(1, 1, "x"), (2, 1, "y")]


def test_memory_is_given_back(spark, monkeypatch):
    """Each stage after the first begins with small heaps, and workers hold few texts of a batch at once."""
    import pyarrow as pa

    from quiltframe.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array([f"t{i}" for i in range(2_500)]), pa.array(range(2_500))], ["text", "id"])
    got = list(common.rows([batch, batch.slice(0, 0)], "id", "text"))
    assert max(len(t) for _, t in got) <= common.ROWS and [x for i, _ in got for x in i] == list(range(2_500))
    heap = spark.sparkContext._jvm.Runtime.getRuntime()
    monkeypatch.setattr(pipe, "trim", lambda s: (calls.append(1), common.trim(s)))
    calls = []
    waste = spark.range(200_000).selectExpr("repeat(cast(id as string), 200) as x").collect()
    del waste
    before = heap.totalMemory() - heap.freeMemory()
    docs = spark.createDataFrame([(1, "one two three", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipe.STAGES[1:]:
        assert stage(spark, docs, "").count() >= 1
    assert len(calls) == 4
    common.trim(spark)
    assert heap.totalMemory() - heap.freeMemory() < before
