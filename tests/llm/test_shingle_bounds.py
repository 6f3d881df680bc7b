"""Bounds that keep pairs of sets which share little from being made."""

import numpy as np

from quiltframe.llm import op5_shingle_join as op


def some(rng, n):
    return np.unique(op.mix(rng.integers(1 << 62, size=n).astype(np.uint64)))


def met(sets, prices, parts=3, join=op.Join(3, 5)):
    pk = op.Packer(parts)
    sig, doc, place, bad = op.signatures(sets, join, prices)
    assert bad == 0
    pk.add(list(range(len(sets))), sets, sig, doc, place)
    of = {op.class_of(s): i for i, s in enumerate(sets)}
    out = set()
    for _, b in pk.blobs():
        x, y = op.candidates([op.unpack(b)], join)
        out |= {tuple(sorted((of[int(p)], of[int(q)]))) for p, q in zip(x, y, strict=True)}
    return out


def test_lone_elements_before_the_first_shared_one():
    rng = np.random.default_rng(5)
    x = rng.permutation(some(rng, 700))
    sets, prices = [], []
    for k in range(2):  # 140 cheap elements come before the only one that both have
        own = x[1 + 300 * k : 301 + 300 * k]
        s = np.append(own, x[0])
        p = np.append(np.where(np.arange(300) < 140, 0, 100), 50)
        order = np.argsort(s)
        sets.append(s[order])
        prices.append(p[order])
    assert met(sets, prices) == set()


def test_linked_sets_meet_whatever_the_prices():
    rng = np.random.default_rng(7)
    join = op.Join(3, 5)
    for size in (80, 260, 300, 500, 900, 1_100):
        sets = []
        for _ in range(6):
            base = some(rng, size)
            sets.append(base)
            for lost in (0.1, 0.2, 0.24, 0.38):  # some replaced, or some left out
                keep = base[rng.random(len(base)) > lost]
                sets += [np.unique(np.append(keep, some(rng, len(base) - len(keep)))), keep]
        dear = {}
        prices = [np.array([dear.setdefault(int(e), int(rng.integers(200))) for e in s]) for s in sets]
        linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 3 * (len(sets[i]) + len(sets[j]) - c)}
        assert len(linked) > 50 and linked <= met(sets, prices, join=join)


def test_runs_without_probe_are_left_out():
    rng = np.random.default_rng(9)
    join = op.Join(3, 5)
    base = [some(rng, n) for n in rng.integers(1, 40, size=60)]
    sets = base + [np.unique(np.append(b[1:], some(rng, 1))) for b in base]
    prices = [np.zeros(len(s), int) for s in sets]
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 3 * (len(sets[i]) + len(sets[j]) - c) and c}
    assert linked <= met(sets, prices, join=join)
