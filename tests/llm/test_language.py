import zlib
from collections import Counter

import numpy as np

from quiltframe.llm import op7_language as op
from quiltframe.llm.registry import QUERIES

EN, DE = "the cat and the dog are in the house of the king ", "der hund und die katze sind in dem haus des königs "


def slow_grams(text):
    c = Counter()
    for w in "".join(x if x.isalpha() else " " for x in text.lower()).split():
        w = f" {w} "
        for n in (1, 2, 3):
            c.update(g for i in range(len(w) - n + 1) if (g := w[i : i + n]).strip())
    return c


def number(g):
    k = 0
    for x in g:
        k = k << 21 | ord(x)
    return k


def test_grams():
    for text in ("", "12 !!", "a", "Ab, äb-c", EN, "x1y", "  lone ", "日本 語", "İ é"):
        k, n = op.grams(text)
        assert dict(zip(k.tolist(), n.tolist())) == {number(g): v for g, v in slow_grams(text).items()}, text


def test_ranks_and_distance():
    k, n = op.grams(EN * 3 + "zebra")
    want = sorted(zip((-n).tolist(), k.tolist()))
    assert op.ranked(k, n, 10).tolist() == [x for _, x in want[:10]]
    p = op.Profiles.of({"en": [1, 2, 3], "de": [3, 9]}, 3)
    assert p.ranks[np.searchsorted(p.keys, np.uint64(3))].tolist() == [0, 2]  # de, en


def test_training_and_prediction(spark):
    rows = [(i, (EN if i % 2 else DE) * (1 + i % 3), "en" if i % 2 else "de", "s") for i in range(40)]
    rows += [(100, None, "en", "s"), (101, "x", None, "s"), (102, "123", "zz", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    p = op.train(docs)
    assert p.langs == ("de", "en")
    tests = spark.createDataFrame([(1, EN, "k"), (2, DE, "k"), (3, None, "k"), (4, "", "k"), (5, "1 2!", "k"), (6, DE * 5000, "k"), (6, DE, None)], "doc_id long, text string, lang_pred string")
    got = sorted((r.doc_id, r.lang_pred) for r in op.predict(tests, p).collect())
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (6, "de")]
    assert all(0 <= r.score <= 1 for r in op.predict(tests, p).collect())
    assert op.predict(tests.limit(0), p).count() == 0
    nothing = op.train(docs.limit(0))
    assert {r.lang_pred for r in op.predict(tests, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_language"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == 1000 and (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    h = got[got.held_out]
    assert (h.lang == h.lang_pred).mean() > 0.97
