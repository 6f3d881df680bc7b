"""Exact Jaccard self-join on word n-grams by universe partition and pigeonhole."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.llm.common import cut, frugal, parallelism, rows, table, written
from quiltframe.llm.components import components
from quiltframe.llm.words import U, mix, word_hashes

#: The largest sizes of the bands; each later one is four times the last.
FIRST_BANDS = (64, 256)
SKETCHED = 256  # sets up to this size carry a sketch of 256 bits
INDEX, DELETED, PROBE, PROBE_DELETED = 251, 252, 253, 254  # entries of the smallest band beside its prefixes


class Prices:
    """What orders signatures: an estimate of how many documents hold a shingle, 8 for each power of two.

    By the counts of its words over all documents, as if they came together by
    chance, or by a bounded sample of documents, whichever is more. Linked
    sets do not depend on it.
    """

    def __init__(self, words: np.ndarray, n_words: int, shingles: np.ndarray, docs: np.ndarray):
        self.words, self.all, self.shingles, self.docs = words, int(8 * math.log2(max(1, n_words))), shingles, docs

    def of_words(self, h: np.ndarray) -> np.ndarray:
        return np.maximum(self.words[(h & U(len(self.words) - 1)).astype(np.int64)].astype(np.int64) - 1, 0) * 8 // 7

    def of_sample(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return np.where(self.shingles[at] == s, self.docs[at], 0)


def shingle_sets(texts: list[str], width: int, salt: int, prices: Prices | None = None) -> list:
    """The sorted distinct shingle hashes of each text; a text of fewer words than the width has one of all its words.

    With prices: (sets, prices of their shingles).
    """
    h, of = word_hashes(texts)
    n = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)
    k = np.minimum(width, n)  # words of each shingle
    start = np.cumsum(n) - n
    m = np.maximum(n - k + 1, 0) * (n > 0)
    doc = np.repeat(np.arange(len(texts)), m)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m) + start[doc]
    s = (U(salt) * U(0x9E3779B97F4A7C15)) + k[doc].astype(U) + U(1)
    cost = prices.of_words(h) if prices else None
    price = np.full(len(doc), -(prices.all if prices else 0), np.int64)
    for i in range(width):
        here = k[doc] > i
        x = at + i if here.all() else np.minimum(at + i, max(len(h) - 1, 0))
        s = np.where(here, mix(s * U(31) + h[x]), s) if not here.all() else mix(s * U(31) + h[x])
        if prices:
            price += np.where(here, cost[x], 0)
    edge = np.cumsum(m).tolist()
    sets, costs, a = [], [], 0
    for b in edge:
        if prices:
            order = np.argsort(s[a:b])
            one = s[a:b][order]
        else:
            one = np.sort(s[a:b])
        if len(one) > 1:
            fresh = np.concatenate([[True], one[1:] != one[:-1]])
            one = one[fresh]
        sets.append(one)
        if prices:
            costs.append(price[a:b][order][fresh] if b - a > 1 else price[a:b])
        a = b
    return (sets, costs) if prices else sets


def class_of(s: np.ndarray) -> int:
    """One number for equal sets: 63 bits of a hash of all of the set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def band_of(n: np.ndarray) -> np.ndarray:
    """The largest size of each size's band."""
    u = np.where(n <= FIRST_BANDS[0], FIRST_BANDS[0], FIRST_BANDS[1]).astype(np.int64)
    while (n > u).any():
        u = np.where(n > u, u * 4, u)
    return u


def segments(u: np.ndarray) -> np.ndarray:
    """How many segments the universe has for a band."""
    return np.where(u == FIRST_BANDS[1], u * 5 // 4, u)


class Join:
    """Thresholds as a fraction p / q, and what follows from it.

    Sets r, s with |r & s| >= t |r | s| differ in d <= (|r| + |s|) (1 - t) / (1 + t)
    elements. Cut the universe into segments by hash: at most d segments differ.
    """

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest Hamming distance of linked sets of these sizes."""
        return (a + b) * (self.q - self.p) // (self.q + self.p)

    def partner(self, n: np.ndarray) -> np.ndarray:
        """The largest size that may link with n."""
        return n * self.q // self.p

    def sized(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a, b) * self.q >= np.maximum(a, b) * self.p


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def signatures(sets: list[np.ndarray], join: Join, prices: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(signature, set, place + 256 * alone) of what each set is found by, and how many sets the pigeonhole fails.

    The subset of a set in one segment, if not empty, is one signature. Of q
    of them linked sets have q - d in common, so in a global order of all
    signatures they share one among the first d + 1 of each: the prefix. Cost-based
    allocation is that order: signatures of least estimated frequency first.
    The first signature in that order that linked sets share stands behind
    ``place`` others in each, ``alone`` of them of one element, which the other
    set lacks. A segment where two such meet holds two different elements, any
    other at least one: sets whose counts of ``alone`` add up to more than d
    are not linked.
    A set is cut by the segments of its own band and, if a larger band may hold
    partners, of the next. In the smallest band a set may have too few
    non-empty segments; such a set probes with whole subsets and their one-deletion
    neighbourhoods, which all sets of that band index.
    """
    n = np.array([len(s) for s in sets], np.int64)
    S = np.concatenate(sets) if sets else np.zeros(0, U)
    doc = np.repeat(np.arange(len(sets)), n)
    cost = np.concatenate(prices) if prices else np.zeros(0, np.int64)
    mixed = mix(S ^ U(0xA5A5A5A5))
    u = band_of(n)
    far_partner = join.partner(n)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    failing = 0
    for own in (True, False):
        m = segments(u if own else 4 * u)
        longest = join.far(n, np.minimum(u, far_partner)) if own else join.far(n, far_partner)
        take = n > 0 if own else far_partner > u
        if not take.any():
            continue
        tok = take[doc] if not take.all() else slice(None)
        s, d, c, x = S[tok], doc[tok], cost[tok], mixed[tok]
        seg = ((s >> U(32)) * m[d].astype(U)) >> U(32)  # hash order is segment order
        first = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (d[1:] != d[:-1])]))
        size = np.diff(np.append(first, len(s)))
        dd = d[first]
        base = mix(seg[first] * U(0x9E3779B97F4A7C15) + m[dd].astype(U))
        sig = mix(np.add.reduceat(x, first) + base)
        price = np.clip(np.minimum.reduceat(c, first) - 40 * (size - 1), 0, 255)
        order = np.argsort(dd.astype(U) << U(48) | price.astype(U) << U(40) | sig >> U(24))
        od = dd[order]
        starts = np.searchsorted(od, np.arange(len(sets)))
        place = np.arange(len(od)) - starts[od]
        lone = size[order] == 1
        before = np.append(0, np.cumsum(lone))
        before = before[:-1] - before[starts][od]  # subsets of one element that come first
        keep = place <= longest[od]
        o = order[keep]
        of = np.maximum(n[dd[o]], 1)
        out.append((sig[o], dd[o], (place[keep] * 250 // of | before[keep] * 250 // of << 8).astype(np.uint16)))
        if not own:
            continue
        have = np.bincount(dd, minlength=len(sets))
        need = join.far(n, n) + 1
        small = u == FIRST_BANDS[0]
        failing += int(((have < need) & ~small & (n > 0)).sum())
        if small.any():
            ext = small[dd]
            weak = small & (have < need) & (n > 0)
            # deletion variants: the sum without one element
            per = np.repeat(np.arange(len(first)), size)
            lone = small[d] & (size[per] > 1)
            deleted = mix(mix(np.add.reduceat(x, first)[per[lone]] - x[lone] + base[per[lone]]) ^ U(1))
            whole = mix(sig[ext] ^ U(1))
            out.append((whole, dd[ext], np.full(len(whole), INDEX, np.uint16)))
            out.append((deleted, d[lone], np.full(len(deleted), DELETED, np.uint16)))
            w = weak[dd[ext]]
            out.append((whole[w], dd[ext][w], np.full(int(w.sum()), PROBE, np.uint16)))
            w = weak[d[lone]]
            out.append((deleted[w], d[lone][w], np.full(int(w.sum()), PROBE_DELETED, np.uint16)))
            reach = np.bincount(dd, np.minimum(size, 2), minlength=len(sets))
            failing += int((weak & (reach < need)).sum())
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.uint16), failing
    return *(np.concatenate(x) for x in zip(*out, strict=True)), failing


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """256 parities for each set: every element that two sets don't share flips one at most."""
    out = np.zeros((len(sets), 4), U)
    small = [i for i, s in enumerate(sets) if 0 < len(s) <= SKETCHED]
    if small:
        s = np.concatenate([sets[i] for i in small])
        d = np.repeat(small, [len(sets[i]) for i in small])
        bit = mix(s ^ U(0x51ED27)) >> U(56)
        np.bitwise_xor.at(out.reshape(-1), d * 4 + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return out


def long_sketch(s: np.ndarray) -> bytes:
    """Parities of at least two bits an element, a power of two of them; half as many are those halves, one upon the other."""
    bits = max(256, 1 << int(2 * len(s) - 1).bit_length())
    at = (mix(s ^ U(0x2545F49)) & U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1 == 1, bitorder="little").tobytes()


def flips(a: bytes, b: bytes) -> int:
    """In how many parities two long sketches differ: no more than the sets differ in elements."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def folded(flat: np.ndarray, offset: np.ndarray, words: np.ndarray, which: np.ndarray, w: int) -> np.ndarray:
    """Some of the long sketches that lie in flat, by places and sizes in words, each folded to w words."""
    times = words[which] // w
    out = np.zeros((len(which), w), U)
    for k in np.unique(times).tolist():
        m = np.flatnonzero(times == k)
        y = flat[offset[which[m]][:, None] + np.arange(w * k)]
        while y.shape[1] > w:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        out[m] = y
    return out


class Packer:
    """Signatures on their way to the partitions of the shuffle, as blobs of packed numbers."""

    def __init__(self, parts: int):
        self.parts = parts
        self.clear()

    def clear(self) -> None:
        self.n_docs = self.n_sigs = 0
        self.sig, self.doc, self.place, self.ids, self.cls, self.n, self.sketch = ([] for _ in range(7))
        self.long: list[bytes] = []

    def add(self, ids: list[int], sets: list[np.ndarray], sig: np.ndarray, doc: np.ndarray, place: np.ndarray) -> None:
        self.sig.append(sig)
        self.doc.append((doc + self.n_docs).astype(np.uint32))
        self.place.append(place)
        self.ids.append(np.array(ids, np.int64))
        self.cls.append(np.array([class_of(s) for s in sets], np.int64))
        self.n.append(np.array([len(s) for s in sets], np.uint32))
        self.sketch.append(sketches(sets))
        self.long += [long_sketch(s) if len(s) else b"" for s in sets]
        self.n_docs += len(ids)
        self.n_sigs += len(sig)

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        if not self.n_docs:
            return
        sig, doc, place, ids, cls, n, sketch = (np.concatenate(x) for x in (self.sig, self.doc, self.place, self.ids, self.cls, self.n, self.sketch))
        long = self.long
        self.clear()
        part = ((sig & U(0xFFFF)) % U(self.parts)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(self.parts + 1))
        home = cls % self.parts
        at_home = np.argsort(home, kind="stable")
        home_edge = np.searchsorted(home[at_home], np.arange(self.parts + 1))
        local = np.zeros(len(ids), np.uint32)
        for p in range(self.parts):
            o, h = order[edge[p] : edge[p + 1]], at_home[home_edge[p] : home_edge[p + 1]]
            if not len(o) and not len(h):
                continue
            here = np.zeros(len(ids), bool)
            here[doc[o]] = True
            docs = np.flatnonzero(here)
            local[docs] = np.arange(len(docs))
            short = n[docs] <= SKETCHED
            key = np.ascontiguousarray(sig[o] >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6]
            yield p, b"".join(
                x.tobytes()
                for x in (np.array([len(o), len(docs), int(short.sum()), len(h)], "<u4"), key, local[doc[o]].astype("<u4" if len(docs) > 65_535 else "<u2"), place[o], cls[docs], n[docs], sketch[docs[short]], ids[h], cls[h], n[h])
            ) + b"".join(long[i] for i in h)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """key, place, class, size, sketch of each signature; doc_id, class and size of documents."""
    n_sig, n_docs, n_short, n_home = np.frombuffer(blob, "<u4", 4).astype(int)
    at = 16

    def get(kind: str, n: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(blob, kind, n, at)
        at += x.nbytes
        return x

    key = np.zeros((n_sig, 8), np.uint8)
    key[:, :6] = get("u1", 6 * n_sig).reshape(-1, 6)
    local = get("<u4" if n_docs > 65_535 else "<u2", n_sig)
    place, cls, n = get("<u2", n_sig), get("<i8", n_docs), get("<u4", n_docs)
    sketch = np.zeros((n_docs, 4), U)
    sketch[n <= SKETCHED] = get("<u8", 4 * n_short).reshape(-1, 4)
    home = get("<i8", n_home), get("<i8", n_home), get("<u4", n_home)
    long = []
    for k in home[2].tolist():
        size = max(256, 1 << (2 * k - 1).bit_length()) // 8 if k else 0
        long.append(blob[at : at + size])
        at += size
    return key.view("<u8")[:, 0], place, local, cls, n, sketch, *home, long


def candidates(blobs: list[tuple[np.ndarray, ...]], join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes that share a signature in one partition and pass every bound.

    Runs of one signature are gone through by distance within the run, so no
    list of all its pairs is ever held, and only pairs within all bounds leave.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not blobs:
        return none
    cls, first = np.unique(np.concatenate([b[3] for b in blobs]), return_index=True)
    n = np.concatenate([b[4] for b in blobs])[first].astype(np.int64)
    sketch = np.concatenate([b[5] for b in blobs])[first]
    key = np.concatenate([b[0] for b in blobs])
    place = np.concatenate([b[1] for b in blobs])
    node = np.concatenate([np.searchsorted(cls, b[3]).astype(np.uint32)[b[2]] for b in blobs])
    blobs.clear()
    order = np.argsort(key)
    key = key[order]
    twin = np.zeros(len(key), bool)
    twin[1:] = key[1:] == key[:-1]
    twin[:-1] |= twin[1:]
    order, key = order[twin], key[twin]
    if len(key):  # runs of whole and one-deletion subsets that no set probes, which are most of those, make no pair
        first, kind = _runs(key), place[order] & 255
        used = (np.minimum.reduceat(kind, first) < INDEX) | (np.maximum.reduceat(kind, first) >= PROBE)
        used = np.repeat(used, np.diff(np.append(first, len(key))))
        order, key = order[used], key[used]
    node, place = node[order], place[order].astype(np.int64)
    place, alone = place & 255, place >> 8
    order = np.lexsort((place, node, key))
    key, node, place, alone = key[order], node[order], place[order], alone[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | ((place[1:] >= INDEX) & (place[1:] != place[:-1]))
    key, node, place, alone = key[fresh], node[fresh], place[fresh], alone[fresh]
    starts = _runs(key)
    end = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key)))) if len(key) else starts
    found: list[np.ndarray] = []
    held = 0
    k, at = np.int64(len(cls)), np.arange(len(key))
    step = 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        for lo in range(0, len(at), 2_000_000):
            i = at[lo : lo + 2_000_000]
            j = i + step
            a, b, pa_, pb = node[i], node[j], place[i], place[j]
            na, nb = n[a], n[b]
            far = join.far(na, nb)
            plain = (pa_ < INDEX) & (pb < INDEX) & (pa_ * na <= 250 * (far + 1)) & (pb * nb <= 250 * (far + 1)) & (alone[i] * na + alone[j] * nb <= 250 * far)
            p, q = np.minimum(pa_, pb), np.maximum(pa_, pb)
            extra = ((q == PROBE) & ((p == INDEX) | (p == DELETED))) | ((q == PROBE_DELETED) & (p == INDEX))
            ok = (plain | extra) & (a != b) & join.sized(na, nb)
            i_ok = np.flatnonzero(ok)
            both = (na[i_ok] <= SKETCHED) & (nb[i_ok] <= SKETCHED)
            flips = np.bitwise_count(sketch[a[i_ok]] ^ sketch[b[i_ok]]).sum(1)
            i_ok = i_ok[~both | (flips <= far[i_ok])]
            a, b = a[i_ok].astype(np.int64), b[i_ok].astype(np.int64)
            found.append(np.minimum(a, b) * k + np.maximum(a, b))
            held += len(a)
            if held > 4_000_000:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
        step += 1
    if not found:
        return none
    pair = np.unique(np.concatenate(found))
    return cls[pair // k], cls[pair % k]


STEP = "kind int, group int, x long, y long, n long, w long, blob binary"
DOC, CLASS, PAIRS = 0, 1, 2


def _step(**columns: list) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    kinds = {"kind": pa.int32(), "group": pa.int32(), "x": pa.int64(), "y": pa.int64(), "n": pa.int64(), "w": pa.int64(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in kinds.items()], list(kinds))


def _prices(docs: DataFrame, width: int, sample: int, salt: int) -> Prices:
    """Word counts over all documents, and shingles that two or more of about so many documents hold."""
    from quiltframe.llm.op1_line_dedup import counts

    n = max(1, docs.count())
    share = min(1.0, sample / n)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("shingles")), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in rows(batches, "text"):
            for at in range(0, len(texts), 200):
                k, n = np.unique(np.concatenate(shingle_sets(texts[at : at + 200], width, salt)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], ["k", "n"])

    got = chosen.mapInArrow(frugal(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where("n > 1").toArrow()  # of the sample alone
    k, of = got["k"].to_numpy().astype(U), got["n"].to_numpy()
    order = np.argsort(k)
    words, n_words = counts(docs)
    return Prices(words, n_words, k[order], (8 * np.log2(np.maximum(of[order] / share, 1))).astype(np.int64))


def _found(docs: DataFrame, join: Join, width: int, salt: int, sample: int, grid: int) -> DataFrame | None:
    """Documents, classes and blocks of candidate pairs; None if the pigeonhole fails some set with this salt."""
    spark = docs.sparkSession
    parts = min(60_000, parallelism(spark))
    prices = spark.sparkContext.broadcast(_prices(docs, width, sample, salt))  # 16 MB of counts, and of a bounded sample

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, failing = Packer(parts), 0

        def out() -> pa.RecordBatch:
            part, blob = zip(*packer.blobs(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["part", "blob"])

        for keys, texts in rows(batches, "doc_id", "text"):
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) < 1_500_000) and to - at < 4_000:
                    chars += len(texts[to])
                    to += 1
                sets, costs = shingle_sets(texts[at:to], width, salt, prices.value)
                costs = [np.maximum(c, prices.value.of_sample(s)) for c, s in zip(costs, sets, strict=True)]
                sig, doc, place, bad = signatures(sets, join, costs)
                failing += bad
                packer.add(keys[at:to], sets, sig, doc, place)
                at = to
                if packer.n_sigs > 1_500_000:
                    yield out()
        if packer.n_docs:
            yield out()
        if failing:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([None], pa.binary())], ["part", "blob"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for part, blobs in rows(batches, "part", "blob"):
            for p, b in zip(part, blobs, strict=True):
                if b is None:
                    yield _step(kind=[-1])
                else:
                    by.setdefault(p, []).append(b)
        for p in list(by):
            got = [unpack(b) for b in by.pop(p)]
            a, b = candidates([x[:6] for x in got], join)
            got = [(None,) * 6 + x[6:] for x in got]
            if len(a):
                ga, gb = a % grid, b % grid
                a, b = np.where(ga <= gb, a, b), np.where(ga <= gb, b, a)
                g = a % grid * grid + b % grid
                order = np.argsort(g, kind="stable")
                a, b, g = a[order], b[order], g[order]
                first = _runs(g)
                yield _step(kind=[PAIRS] * len(first), group=g[first], blob=[x.tobytes() + y.tobytes() for x, y in zip(np.split(a, first[1:]), np.split(b, first[1:]), strict=True)])
            ids, cls, n = (np.concatenate([x[k] for x in got]) for k in (6, 7, 8))
            long = [s for x in got for s in x[9]]
            order = np.lexsort((ids, cls))
            first = _runs(cls[order])
            for at in range(0, len(ids), 50_000):
                o = order[at : at + 50_000]
                yield _step(kind=[DOC] * len(o), x=ids[o], y=cls[o], n=n[o].astype(np.int64))
            rep, weight = order[first], np.diff(np.append(first, len(order)))
            for at in range(0, len(rep), 10_000):
                r = rep[at : at + 10_000]
                yield _step(kind=[CLASS] * len(r), x=ids[r], y=cls[r], n=n[r].astype(np.int64), w=weight[at : at + 10_000], blob=[long[i] for i in r])

    found = written(docs.mapInArrow(frugal(emit), "part int, blob binary").repartitionById(parts, F.col("part")).mapInArrow(frugal(reduce), STEP))
    return None if found.where("kind = -1").count() else found


def _within_bounds(found: DataFrame, join: Join, grid: int) -> DataFrame:
    """a, b (least doc_ids of two classes, a < b): candidate pairs whose sketches allow a link."""
    classes = found.where(f"kind = {CLASS} and n > 0").withColumn("block", F.pmod("y", F.lit(grid)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    sent = classes.withColumn("other", other).withColumn("group", F.least("block", "other") * grid + F.greatest("block", "other"))
    both = sent.select("kind", "group", "x", "y", "n", "blob").union(found.where(f"kind = {PAIRS}").select("kind", "group", "x", "y", "n", "blob"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kind = t["kind"].to_numpy()
        at = np.flatnonzero(kind == PAIRS)
        known = t.take(pa.array(np.flatnonzero(kind == CLASS)))
        cls, rep, n = (known[c].to_numpy() for c in "yxn")
        order = np.argsort(cls)
        ids = cls[order]
        raw = known["blob"].combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        flat = raw.buffers()[2] or b""
        flat = np.frombuffer(flat, U, len(flat) // 8)  # every sketch is of whole words
        offset = np.frombuffer(raw.buffers()[1], "<i4")[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
        offset //= 8
        words = np.diff(offset)
        blobs = t["blob"]
        out: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        for k in at:  # a partition's pairs after another; most false ones are in one partition only
            pair = np.frombuffer(blobs[int(k)].as_buffer(), "<i8").reshape(2, -1)
            i, j = order[np.searchsorted(ids, pair[0])], order[np.searchsorted(ids, pair[1])]
            far = join.far(n[i], n[j])
            level = np.minimum(words[i], words[j])  # sketches of equal length are compared together, longer ones folded first
            for w in np.unique(level):
                at_w = np.flatnonzero(level == w)
                for lo in range(0, len(at_w), max(1, 1_000_000 // int(w))):
                    s = at_w[lo : lo + max(1, 1_000_000 // int(w))]
                    sides = [folded(flat, offset, words, side, int(w)) for side in (i[s], j[s])]
                    s = s[np.bitwise_count(sides[0] ^ sides[1]).sum(1, dtype=np.int64) <= far[s]]
                    out.append(np.stack([np.minimum(rep[i[s]], rep[j[s]]), np.maximum(rep[i[s]], rep[j[s]])]))
        a, b = np.concatenate(out, axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.table({"a": a[fresh], "b": b[fresh]})

    return both.repartition(grid * (grid + 1) // 2, "group").groupBy("group").applyInArrow(run, "a long, b long").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, join: Join, width: int, block: int = 512) -> DataFrame:
    """a, b: the pairs whose sets are linked. Sets go once to each block of their component."""
    spark = docs.sparkSession
    reach = cut(components(pairs))
    size = reach.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    place = cut(reach.join(size, "root").select("node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    texts = docs.select("doc_id", "text").join(place.select(F.col("node").alias("doc_id"), "root", "blocks", "block"), "doc_id")
    sent = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    of_a = place.select(F.col("node").alias("a"), "root", F.col("block").alias("ba"))
    of_b = place.select(F.col("node").alias("b"), F.col("block").alias("bb"))
    asked = pairs.join(of_a, "a").join(of_b, "b").select("root", F.least("ba", "bb").alias("i"), F.greatest("ba", "bb").alias("j"), "a", "b", F.lit(None).cast("string").alias("text"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        text = t["text"].to_pylist()
        a, b = t["a"].to_pylist(), t["b"].to_pylist()
        at = [k for k, x in enumerate(b) if x is None]
        sets = {a[k]: s for k, s in zip(at, shingle_sets([text[k] for k in at], width, 0), strict=True)}
        out: tuple[list, list] = ([], [])
        for x, y in zip(a, b, strict=True):
            if y is None:
                continue
            s, r = sets[x], sets[y]
            if len(s) < len(r):
                s, r = r, s
            at_s = np.minimum(np.searchsorted(s, r), len(s) - 1)
            common = int((s[at_s] == r).sum())
            if join.q * common >= join.p * (len(s) + len(r) - common):
                out[0].append(x)
                out[1].append(y)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return sent.union(asked).repartition(parallelism(spark), "root", "i", "j").groupBy("root", "i", "j").applyInArrow(run, "a long, b long")


def similar(docs: DataFrame, threshold: tuple[int, int] = (3, 5), width: int = 2, sample: int = 2_000) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id of every row of docs (doc_id, text).

    threshold: the least Jaccard similarity as a fraction. sample: about so
    many documents price the signatures. Equal sets are one class with a
    weight from the first shuffle on, so copies make no pairs. Shingles and
    sets go by 64-bit hashes. Null texts and texts without words have no
    shingle and link with nothing. Rows without doc_id can't be named: they link
    with nothing and come back with null n_shingles and component_id, and
    n_similar 0. doc_id should be unique (rows that share one count as one
    another's copies). Very long texts are read whole, in slices of bounded
    memory. An empty table gives no rows.

    1. Each task turns texts into sets and sets into signatures (see
       :func:`signatures`), packed into one blob for each partition of the shuffle.
    2. A partition finds pairs of classes that share one, within the bounds of
       size, place and sketch, and keeps documents and classes.
    3. Longer sketches, in blocks of classes, leave hardly a false pair.
    4. What is left is verified on the texts' own shingles, component by component.
    """
    join = Join(*threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    nameless = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_similar"), F.lit(None).cast("long").alias("component_id"))
    docs = docs.where("doc_id is not null")
    grid = max(8, math.ceil(math.sqrt(docs.count() / 10_000)))
    salt, found = 0, None
    while found is None:
        found = _found(docs, join, width, salt, sample, grid)
        salt += 1
    pairs = written(_within_bounds(found, join, grid))
    links = written(_verified(docs, pairs, join, width))
    reach = components(links)
    classes = found.where(f"kind = {CLASS}").select(F.col("x").alias("rep"), F.col("y").alias("cls"), F.col("w").alias("weight"))
    ends = links.union(links.select("b", "a")).toDF("rep", "other")
    others = ends.join(classes.select(F.col("rep").alias("other"), F.col("weight").alias("w")), "other").groupBy("rep").agg(F.sum("w").alias("links"))
    known = classes.join(others, "rep", "left").join(reach.select(F.col("node").alias("rep"), "root"), "rep", "left").select("cls", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    each = found.where(f"kind = {DOC}").select(F.col("x").alias("doc_id"), F.col("y").alias("cls"), F.col("n").alias("n_shingles"))
    some = F.col("n_shingles") > 0
    return nameless.union(each.join(known, "cls").select("doc_id", "n_shingles", F.when(some, F.col("links")).otherwise(0).cast("long").alias("n_similar"), F.when(some, F.col("root")).otherwise(F.col("doc_id")).alias("component_id")))


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') as words from documents),
s as (select doc_id, list_distinct(case when len(words) = 0 then cast([] as varchar[]) when len(words) = 1 then [words[1]]
        else list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) end) as sh from w),
t as (select doc_id, unnest(sh) as x from s),
rare as (select x from t group by x having count(*) > 1),
u as (select t.* from t join rare using (x)),
n as (select doc_id, cast(len(sh) as bigint) as n from s),
c as (select a.doc_id as i, b.doc_id as j, count(*) as k from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select i, j from c join n p on p.doc_id = i join n q on q.doc_id = j where 100 * k >= 60 * (p.n + q.n - k)),
e as (select i, j from l union all select j, i from l),
r as (with recursive z(i, j) as (select i, j from e union select z.i, e.j from z join e on z.j = e.i) select i, min(j) as m from z group by i),
d as (select i, count(*) as n from e group by i)
select n.doc_id, n.n as n_shingles, cast(coalesce(d.n, 0) as bigint) as n_similar, least(n.doc_id, coalesce(r.m, n.doc_id)) as component_id
from n left join d on d.i = n.doc_id left join r on r.i = n.doc_id
"""
