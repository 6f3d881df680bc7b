import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quiltframe.llm import bpe
from quiltframe.llm.op2_token_files import open_shard, read_tokens, write_tokens
from quiltframe.llm.op4_bpe import decode, encode, round_trip

BYTE, WORD = bpe.default_path("byte_bpe_50k.json"), bpe.default_path("word_bpe_49k.json")
ODD = ["", "a  b", " a", "a ", "x\n\ny\n", "\t\tfoo\t bar", "it's we'll  \n z", "<|endoftext|> a <|endoftext|>b", "x\0y z", "ⅷ½²３abc Ⅷ\x1c \x1d", "日本語 テスト　全角", "é é ́x", "🤣🤣 ok z", " ", "\n", "a\xa0b \xa0c\xa0 d", "İSTANBUL ΣΑΣ ΣΑΣ", "H̱ÉLLO <|x|> WORLD\u2126 ½ Ⅷ ǅ K\u212a", "&amp; it'S &c. \x85 x\x1fy", "ÀÉß ẞ ÿŸ", "ab" * 5000, "w " * 3000]


@pytest.mark.parametrize("path, make", [(BYTE, lambda: bpe.library_encoder(BYTE, True)), (BYTE, lambda: bpe.queue_encoder(BYTE)[1]), (WORD, lambda: bpe.library_encoder(WORD, False))])
def test_ids_are_those_of_the_library(path, make):
    t = Tokenizer.from_file(path)
    want = [t.encode(x, add_special_tokens=False).ids for x in ODD]
    assert [np.frombuffer(b, "<u2").tolist() for b in make().encode(ODD)] == want


def test_ids_with_a_small_memory(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    t = Tokenizer.from_file(BYTE)
    enc = bpe.ChunkEncoder(lambda w: [np.array(t.encode(x).ids, "<u2").tobytes() for x in w], lambda x: t.encode(x).ids, True)
    texts = ["one two three four five six seven", "eight nine one two"] * 3
    assert [np.frombuffer(b, "<u2").tolist() for b in enc.encode(texts)] == [t.encode(x).ids for x in texts]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_round_trip_digests(spark):
    texts = [*ODD, None]
    t = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in round_trip(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert round_trip(docs(spark, [])).count() == 0


def test_encode_decode(spark):
    got = {r.doc_id: r.text for r in decode(encode(docs(spark, [*ODD, None]))).collect()}
    assert got == dict(enumerate([*ODD, ""]))
    q = bpe.queue_encoder(BYTE)[0]
    t = Tokenizer.from_file(BYTE)
    for ids in ([255, 256], [162, 50256, 96]):  # broken UTF-8
        assert q.decode(ids).decode() == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("shards", [1, 3])
def test_files(spark, tmp_path, shards):
    texts = [*ODD, None, *ODD]
    t = Tokenizer.from_file(BYTE)
    made = write_tokens(docs(spark, texts).repartition(5), f"file://{tmp_path}/x", shards=shards)
    got = [tuple(r) for r in read_tokens(spark, f"file://{tmp_path}/x", made).orderBy("doc_id").collect()]
    want, start, flat = [], 0, []
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        flat += ids
    assert got == want
    assert np.concatenate([open_shard(f"file://{tmp_path}/x", m[0])[2] for m in made]).tolist() == flat
    with pytest.raises(ValueError, match="no index"):
        (tmp_path / "x" / "bad.idx").write_bytes(b"nothing at all, that is")
        open_shard(f"file://{tmp_path}/x", "bad")


def test_files_of_nothing(spark, tmp_path):
    made = write_tokens(docs(spark, []), f"file://{tmp_path}/y")
    assert read_tokens(spark, f"file://{tmp_path}/y", made).count() == 0


def test_files_of_documents_without_id(spark, tmp_path):
    df = spark.createDataFrame([(3, "c c"), (None, "b"), (None, "a"), (-4, None)], "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in read_tokens(spark, f"file://{tmp_path}/z", write_tokens(df, f"file://{tmp_path}/z", shards=2)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -4, 3]
    t = Tokenizer.from_file(BYTE)
    assert [r[3] for r in got] == [zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()) for x in ("a", "b", "", "c c")]
