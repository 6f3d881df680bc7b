import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quiltframe.llm import op10_pii as op


def brute(text):
    """The patterns as they are written."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.b@-_%+ 0123459()é\n", max_size=60))
def test_patterns_fuzzed(text):
    assert op.base_spans(text) == brute(text)


def test_patterns():
    for text in ("a@b.c.d x..@y.z-é a@b@c.de", "1.2.3.4.5.6.7.8.9 001.02.3.255 1.2.3.256", "4041894974608795 4041-8949 7460-8795 40418949746087951", "+1 (988) 555-2485 +1-2 +123456789012345678", "é" * 9 + "a@b.co"):
        assert op.base_spans(text) == brute(text)
    assert [k for k, _, _ in op.base_spans("x a.b@c.de 4041894974608795 42.1.2.3 +1 (988) 555-2485")] == [0, 1, 2, 3]
    for long in ("a" * 200_000 + "@b", "1" * 200_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000, "@" * 100_000):
        op.mentions(long)


def model():
    g = np.random.default_rng(0)
    return op.Model(g.normal(size=(op.N_FEATURES, 5)) * 0.3, 3.0, g.normal(size=(5, 5)) * 0.2)


def test_messages_are_exact_on_a_tree():
    m = model()
    found = op.mentions("tel 0201 555 7788" + " x" * 40 + " then 020 1555 7788" + " y" * 40 + " 12345678 ok 99-88-77-66")
    found = [op.Mention(x.start, x.end, x.kind, x.keys[-1:], x.features) for x in found]
    assert len(found) == 4
    b = m.beliefs(found, rounds=200)
    want, hub = np.zeros((4, 5)), found[0].keys == found[1].keys
    assert hub
    u = np.stack([x.features for x in found]) @ m.weights
    for l in itertools.product(range(5), repeat=5):  # four mentions and what the first two share
        s = sum(u[i, l[i]] for i in range(4)) + m.agree * ((l[0] == l[4]) + (l[1] == l[4]))
        s += sum(m.follow[l[i], l[i + 1]] for i in range(3) if found[i + 1].start - found[i].end <= 40)
        for i in range(4):
            want[i, l[i]] += np.exp(s)
    assert np.allclose(b, want / want.sum(1, keepdims=True), atol=1e-3)


def test_rows(spark):
    texts = ["call +1 (988) 555-2485 now; later 988 555-2485 again", "mail a.b@mail.example.com or a.b [at] mail [dot] example [dot] com", "clean text of 12 words in 2024", None, "", "nothing"]
    texts += [f"write to u{i}@mail.org or +1 (555) 123-4{i:03d}, card 4041894974608795 at 10.0.0.{i} in 20{i:02d}" for i in range(40)]
    texts += ["+1 (988) 555-2485 " + "z " * 30_000 + "+1 (988) 555-2485 " * 3000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    m = op.train(docs)
    got = {r.doc_id: r for r in op.find(docs, m).collect()}
    for i, t in enumerate(texts):
        base = brute(t or "")
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(op.text_of(base).encode()).hexdigest()
        assert set(op.text_of(base).split(",")) <= set(r.spans.split(","))
    assert "phone:34:46" in got[0].spans
    assert "email:" in got[1].spans and got[1].spans.count("email") == 2
    assert got[2].spans == got[3].spans == got[4].spans == ""
    red = {r.doc_id: r.text for r in op.redact(docs, m).collect()}
    assert red[0] == "call <PHONE> now; later <PHONE> again" and red[3] is None and red[4] == "" and red[2] == texts[2]
    both = "dial +1 (208) 555-1177 4284896609045836 now"  # too many digits for either pattern
    assert op.base_spans(both) == brute(both) == [] and op.text_of(m.spans(both)[1]) == "card:23:39,phone:5:22"
    assert op.find(docs.limit(0), op.train(docs.limit(0))).count() == 0


def test_long_runs_and_spaced_brackets_are_candidates():
    def parts(text):
        return [text[m.start : m.end] for m in op.mentions(text)]

    assert parts("+1 (988) 555-2485; later 988 555-2485 / 204 555-1177") == ["+1 (988) 555-2485", "988 555-2485", "204 555-1177"]
    assert parts("card 4041.8949.7460.8795 now") == ["4041.8949.7460.8795"]
    assert parts("988 555-2485 204 555-1177") == ["988 555-2485", "204 555-1177"]
    assert parts("988 555-2485 204 555-1177 301 555-9999 x") == ["988 555-2485", "204 555-1177", "301 555-9999"]
    assert parts("to john.doe [ at ] example [ dot ] com") == ["john.doe [ at ] example [ dot ] com"]
    assert parts("to john.doe ( AT ) example.com") == ["john.doe ( AT ) example.com"]


def test_recall_of_what_patterns_miss(spark):
    """Held-out people: addresses and numbers written otherwise, alone and beside a match of a pattern, among numbers that are none."""
    g = np.random.default_rng(1)

    def person(i):
        d = g.integers(0, 10, 10)
        digits = "".join(map(str, d))
        card = digits + f"{i:05d}"
        card += next(c for c in "0123456789" if op.luhn(card + c))
        return {"email": f"u{i}.{'abcdef'[i % 6]}@mail{i % 7}.org", "phone": f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}", "card": card, "ip": f"10.{i % 200}.{d[0]}.{d[1]}"}

    noise = ["order 20-{0:04d} of 12 items", "pages 100-{0:03d}", "in 19{0:02d}/20", "1,{0:03d}.50 paid", "room 4{0:02d}", "build 2.{0}.7", "ratio 12:{0}", "at 10:{0:02d} AM (local) 2024-01-{0:02d}"]
    texts, want = [], []
    for i in range(400):
        p = person(i)
        p = p | {"phone": p["phone"]}
        lines, spans = [], []
        text = ""
        for kind, s in p.items():
            k = op.KINDS.index(kind)
            text += str(g.choice(noise)).format(i % 28 + 1) + " and " + s + " so. "
            if i % 4 == 0:
                v = op.variants(k, s)
                v = v[int(g.integers(len(v)))]
                text += "x" * 50 + " then "
                spans.append((k, len(text), len(text) + len(v)))
                text += v + " too. "
        texts.append(text)
        want.append(spans)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    m = op.train(docs.where("doc_id % 4 = 1"))
    hit = total = extra = 0
    for t, w in zip(texts, want):
        base, every = m.spans(t)
        hit += len(set(w) & set(every))
        total += len(w)
        extra += len(set(every) - set(w) - set(base))
    assert total > 300 and hit >= 0.9 * total and extra <= 0.02 * total
    assert m.agree > 0 and np.abs(m.follow).max() < 10


def test_training_counts_every_example(spark):
    """A shape a thousand times is worth a thousand, whatever the table's size."""
    docs = spark.createDataFrame([(i, "see 123 456-7890 here" if i % 10 else "call +1 (988) 555-2485 now") for i in range(3000)], "doc_id long, text string")
    rows_ = [r for r in op.examples("see 123 456-7890 here")]
    assert [r[1:] for r in rows_] == [(-1, -1, -1, 0)]
    m, few = op.train(docs), op.train(docs.where("doc_id < 100"))
    assert np.allclose(m.weights, few.weights, atol=1e-6) and m.spans("see 123 456-7890 here")[1] == []
    for long in ("1 1" + "/1" * 100_000, "a" * 200_000 + "(at)" + "b." * 100_000, "(1" * 100_000, "1(" * 100_000 + "x"):
        op.mentions(long)
    assert op.mentions("x" * 300 + "(at)" + "y" * 300 + ".org")[0].end == 608
