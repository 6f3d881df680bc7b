import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quiltframe.llm import bpe
from quiltframe.llm.op6_packing import VOCAB, Shard, pack
from quiltframe.llm.registry import QUERIES

WORD = bpe.default_path("word_bpe_49k.json")


def verify(texts, pieces, window):
    t = Tokenizer.from_file(WORD)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    assert by_doc.keys() == ids.keys()
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[i])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two


@pytest.mark.parametrize("shard", [300, 12_000_000])
def test_pieces(spark, shard):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    g = np.random.default_rng(3)
    texts = {i: " ".join(g.choice(words, int(n))) for i, n in enumerate(g.integers(0, 60, 80))}
    texts |= {90: None, 91: "", 92: "long " * 3000, 93: "same text", 94: "same text"}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, ids string").repartition(3)
    verify(texts, pack(docs, window=64, shard_tokens=shard).collect(), 64)
    assert pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("files", [1, 6])
def test_like_documents_meet_across_files(spark, files):
    """Documents of one topic lie in all files and more than one shard apart."""
    g = np.random.default_rng(8)
    topics = [[f"{w}{k}" for w in ("river", "engine", "violin", "harbor", "pepper", "castle")] for k in range(8)]
    texts = [" ".join(g.choice(topics[i % 8], 30)) for i in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).repartition(files)
    got = pack(docs, window=512, shard_tokens=2_500).collect()
    by = defaultdict(set)
    for r in got:
        by[r.sequence_id >> 20].add(r.doc_id % 8)
    assert len(by) > 3
    assert np.mean([len(x) for x in by.values()]) < 4


def test_neighbours_follow_bm25():
    g = np.random.default_rng(1)
    ids = [g.integers(0, 40, int(n)).astype("u2") for n in g.integers(3, 30, 25)]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=VOCAB)
    idf = np.log1p((25 - df + 0.5) / (df + 0.5)).astype("f4")
    mean = np.mean([len(x) for x in ids])
    s = Shard(ids, idf, mean, terms=100)
    s.used[[0, 5]] = True
    score = []
    for d, x in enumerate(ids):
        v = sum(idf[t] * (f := (x == t).sum()) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in np.unique(ids[0]))
        score.append(0 if s.used[d] else v)
    got = s.neighbours(0)
    assert set(got) == {d for d in range(25) if score[d] > 0}
    assert np.all(np.diff([score[d] for d in got]) <= 1e-4)


def test_neighbours_by_all_terms_as_in_production():
    g = np.random.default_rng(4)
    ids = [np.concatenate([g.integers(0, 60, 80), g.zipf(1.3, 120) % 5000]).astype("u2") for _ in range(600)]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=VOCAB)
    idf = np.log1p((600 - df + 0.5) / (df + 0.5)).astype("f4")
    mean = np.mean([len(x) for x in ids])
    s = Shard(ids, idf, mean)
    assert 0 < len(s.dense) < np.count_nonzero(df)
    s.used[[7, 9]] = True
    tf = np.stack([np.bincount(x, minlength=VOCAB) for x in ids]).astype(float)
    impact = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * np.array([[len(x)] for x in ids]) / mean))
    for seed in (7, 9):
        want = impact[:, np.unique(ids[seed])].sum(1)
        got = s.neighbours(seed)
        assert sorted(got) == [d for d in range(600) if want[d] > 0 and not s.used[d]]
        assert np.all(np.diff(want[got]) <= 1e-3)


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    verify(texts, QUERIES["op6_packing"](spark, sf).collect(), 4096)


def test_terms_of_many_documents_at_once():
    from quiltframe.llm import op6_packing

    g = np.random.default_rng(9)
    ids = [g.integers(0, 65_536, int(n)).astype("<u2") for n in [0, 1, 700, 3, 0]] + [np.array([65_535, 0, 65_535], "<u2")]
    t, tf, end = op6_packing.counted(ids)
    lo = 0
    for x, hi in zip(ids, end, strict=True):
        a, b = np.unique(x.astype(np.int64), return_counts=True)
        assert (t[lo:hi] == a).all() and (tf[lo:hi] == b).all() and len(a) == hi - lo
        lo = hi
