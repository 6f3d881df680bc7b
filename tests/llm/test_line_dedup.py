import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltframe.llm import op1_line_dedup as op
from quiltframe.llm.registry import QUERIES
from quiltframe.llm.words import word_hashes


def brute(docs):
    """The text of each distinct document without later matches."""
    def words(line):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
        for c in "\t\x0b\x0c\r\n":
            w = w.replace(c, " ")
        return {x for x in w.split(" ") if x}

    seen, out = [], {}
    for i, t in sorted(docs):
        keep = []
        for line in t.split("\n"):
            s = words(line)
            if len(s) >= 5 and any(5 * len(s & r) >= 4 * len(s | r) for r in seen):
                seen.append(s)
                continue
            if len(s) >= 5:
                seen.append(s)
            keep.append(line)
        out[i] = "\n".join(keep)
    return out


def test_words():
    texts = ["", " ", "a", "Ab ab  AB\tx\x0by\x1cz", "é É", "w" * 3_000_000 + " v", " ".join(["long"] * 600_000), "b\na"]
    h, of = word_hashes(texts)
    by, at = {}, 0
    for i, t in enumerate(texts):
        w = t.encode().lower().split()
        got = h[of == i].tolist()
        assert len(got) == len(w)
        for x, y in zip(w, got):
            assert by.setdefault(x, y) == y
    assert len(set(by.values())) == len(by)
    assert word_hashes([])[0].size == 0


def corpus():
    g = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    base = [[str(x) for x in g.choice(words, int(n))] for n in g.integers(1, 60, 40)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(int(g.integers(1, 8))):
            b = list(base[int(g.integers(40))]) if g.random() < 0.6 else [str(x) for x in g.choice(words, int(g.integers(1, 40)))]
            b = [w if g.random() > 0.08 else str(g.choice(words)) for w in b]
            lines.append(" ".join(b).upper() if g.random() < 0.1 else " ".join(b))
        docs.append((i, "\n".join(lines)))
    return docs


def test_lines(spark):
    docs = corpus() + [(100, ""), (101, "\n\n"), (102, "one two three four"), (103, "one two three four"), (104, "a b c d e\na b c d e\n"), (105, "x " * 50_000 + "y z u v w t"), (106, "é à ü ö ß\nÉ à ü ö ß")]
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in docs] + [(200, None, "k", 0), (None, None, "k", 1)], "doc_id long, text string, key string, h int").repartition(4)
    got = op.dedup(df).collect()
    want = brute(docs)
    assert {r.doc_id: r.text for r in got if r.text is not None} == want
    assert sorted((r.doc_id or -1, r.n_lines, r.n_removed, r.key) for r in got if r.text is None) == [(-1, 0, 0, "k"), (200, 0, 0, "k")]
    for r in got:
        if r.text is not None:
            t = dict(docs)[r.doc_id]
            assert r.n_lines == t.count("\n") + 1
    assert op.dedup(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    t = "one two three four five six\nnothing"
    df = spark.createDataFrame([(1, t), (1, t), (1, t + "\nmore"), (None, t)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in op.dedup(df).collect())[0] == (0, t)
    assert sorted(r.text for r in op.dedup(df).collect() if r.doc_id)[:2] == ["nothing", "nothing"]


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, n_lines, n_removed, text from ({op.SQL})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["op1_line_dedup"](spark, sf).collect()) == want


def test_all_lines_with_words_when_asked(spark):
    docs = [(i, t + "\nAll rights reserved.\n你好世界\nw1") for i, t in corpus()] + [(100, "\n"), (101, "one two three four\none two three\nfour three two one five")]
    seen, want = [], {}
    for i, t in docs:
        keep = []
        for line in t.split("\n"):
            s = set(line.lower().split())
            if not (s and any(5 * len(s & r) >= 4 * len(s | r) for r in seen)):
                keep.append(line)
            if s:
                seen.append(s)
        want[i] = "\n".join(keep)
    got = op.dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_tokens=1).collect()
    assert {r.doc_id: r.text for r in got} == want


@pytest.mark.parametrize("run", [4_096, 16, 7])
def test_tokens_of_many_lines(spark, run):
    """Runs beyond the bound are cut into blocks; no link is lost."""
    g = np.random.default_rng(7)
    docs = corpus()
    for i in range(100, 200):
        lines = []
        for _ in range(3):
            b = [f"b{k}" for k in range(int(g.integers(12, 31)))]
            for _ in range(int(g.integers(0, 5))):
                b[int(g.integers(len(b)))] = f"b{g.integers(60)}"
            lines.append(" ".join(b))
        docs.append((i, "\n".join(lines)))
    keyed = spark.createDataFrame(docs, "key long, text string").select("key", F.xxhash64("text").alias("h"), "text")
    gone = {r.key: set(r.gone) for r in op.removed_lines(keyed, run=run).collect()}
    assert {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in docs} == brute(docs)


def alike(n_docs):
    """Documents of five lines each, nearly all of which are alike."""
    g = np.random.default_rng(3)
    out = []
    for i in range(n_docs):
        lines = []
        for _ in range(5):
            b = [f"s{k}" for k in range(20)]
            for _ in range(int(g.integers(0, 4))):
                b[int(g.integers(20))] = f"v{g.integers(3_000)}"
            lines.append(" ".join(b))
        out.append((i, "\n".join(lines)))
    return out


def test_pairs_of_like_lines_are_not_listed(spark, monkeypatch):
    """What is kept between the steps grows with the lines that are alike, not with their pairs."""
    rows_of, real = [], op.written

    def seen(df):
        out = real(df)
        rows_of.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(op, "written", seen)
    docs = alike(300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in op.dedup(df).collect()} == brute(docs)
    assert sum(n for c, n in rows_of if "key2" in c) < 5 * 5 * len(docs)
