"""Near-duplicate lines by an exact set-similarity join with prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.llm.common import frugal, parallelism, release, rows, table, written
from quiltframe.llm.op5_shingle_join import Join, _runs
from quiltframe.llm.words import U, mix, word_hashes

#: Buckets of the table of word counts, of one byte each: its size does not grow with the corpus. A byte is
#: 0 for no word, 1 for one, else 1 more than 7 times the binary logarithm of the count.
BUCKETS = 1 << 24
SLICES = 64
GONE, PAIR, HOT, REST = 0, 1, 2, 3


def token_sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct word hashes of each line, sorted."""
    h, of = word_hashes(lines)
    edge = np.searchsorted(of, np.arange(len(lines) + 1))
    return [np.unique(h[edge[i] : edge[i + 1]]) for i in range(len(lines))]


def _scaled(n: np.ndarray) -> np.ndarray:
    return np.where(n < 2, n, np.minimum(255, 1 + np.ceil(7 * np.log2(np.maximum(n, 1))))).astype(np.uint8)


def counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How often the words of each hash bucket are in all texts, on a scale of logarithms, and their number. Summed in each task, then slice by slice."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BUCKETS // SLICES

        def out(held: list) -> pa.RecordBatch:
            ids, n = np.unique(np.concatenate(held), return_counts=True)
            edge = np.searchsorted(ids, np.arange(SLICES + 1) * width)
            blob = [(ids[a:b] % width).astype("<u4").tobytes() + n[a:b].astype("<u4").tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blob, pa.binary())], ["part", "blob"])

        held, size = [], 0
        for (texts,) in rows(batches, "text"):
            for at in range(0, len(texts), 500):
                h = (word_hashes(texts[at : at + 500])[0] & U(BUCKETS - 1)).astype(np.uint32)
                held.append(h)
                size += len(h)
                if size > 2_000_000:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for parts, blobs in rows(batches, "part", "blob"):
            for p, b in zip(parts, blobs, strict=True):
                n = len(b) // 8
                s = sums.setdefault(p, np.zeros(BUCKETS // SLICES, np.int64))
                s[np.frombuffer(b, "<u4", n)] += np.frombuffer(b, "<u4", n, 4 * n)
        for p, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_scaled(s).tobytes()], pa.binary()), pa.array([int(s.sum())])], ["part", "blob", "n"])

    got = docs.select("text").mapInArrow(frugal(run), "part int, blob binary").repartitionById(min(SLICES, parallelism(spark)), F.pmod("part", F.lit(min(SLICES, parallelism(spark))))).mapInArrow(frugal(total), "part int, blob binary, n long").collect()  # BUCKETS bytes in all
    out = np.zeros((SLICES, BUCKETS // SLICES), np.uint8)
    for r in got:
        out[r.part] = np.frombuffer(r.blob, np.uint8)
    return out.reshape(-1), sum(r.n for r in got)


def prefixes(h: np.ndarray, of: np.ndarray, n_lines: int, rarity: np.ndarray, join: Join) -> tuple[np.ndarray, ...]:
    """Class, size and sketch of each line; token, line and place of each prefix entry that another line may share.

    The tokens of a line in a global order, rarest first: linked sets that
    differ in d tokens share one among the first d + 1 of each. A token whose
    bucket counts one in all texts is in no other line.
    """
    price = rarity[(h & U(BUCKETS - 1)).astype(np.int64)]
    order = np.argsort(of.astype(U) << U(40) | price.astype(U) << U(32) | h >> U(32), kind="stable")
    h, of, price = h[order], of[order], price[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of, price = h[fresh], of[fresh], price[fresh]
    n = np.bincount(of, minlength=n_lines).astype(np.int64)
    cls, sketch = np.zeros(n_lines, U), np.zeros((n_lines, 2), U)
    first = _runs(of)
    if len(first):
        bit = (mix(h ^ U(0x51ED27)) >> U(40)) % U(96)
        for k in range(2):
            sketch[of[first], k] = np.bitwise_xor.reduceat(np.where(bit >> U(6) == k, U(1) << (bit & U(63)), U(0)), first)
        cls[of[first]] = np.add.reduceat(mix(h), first)
    cls = (mix(cls + n.astype(U)) >> U(1)).astype(np.int64)
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    longest = np.minimum(join.far(n, join.partner(n)), n - (-(-n * join.p // join.q)))
    keep = (place <= longest[of]) & (price > 1)
    return cls, n, sketch, h[keep], of[keep], place[keep]


def _close(key: np.ndarray, n: np.ndarray, place: np.ndarray, sketch: np.ndarray, join: Join, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j and flips for entries, ordered by token and size, of one token within the bounds of size, place and sketch; runs are gone through by distance.

    A sketch is 96 parities: a token that two lines don't share flips one at most. With sides only pairs across them count.
    No i and no j is twice in what is given at once, and no list of all pairs is held.
    """
    starts = _runs(key)
    end = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key)))) if len(key) else starts
    at, step = np.arange(len(key)), 1
    while True:
        at = at[at + step < end[at]]
        at = at[n[at + step] * join.p <= n[at] * join.q]  # sizes grow with the step, so no later one fits either
        if not len(at):
            break
        for lo in range(0, len(at), 250_000):
            i = at[lo : lo + 250_000]
            yield _bounded(i, i + step, n, place, sketch, join, side)
        step += 1


def _bounded(i: np.ndarray, j: np.ndarray, n: np.ndarray, place: np.ndarray, sketch: np.ndarray, join: Join, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    far = join.far(n[i], n[j])
    ok = place[i] + place[j] <= far
    if side is not None:
        ok &= side[i] != side[j]
    i, j, far = i[ok], j[ok], far[ok]
    flips = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1)
    ok = flips <= far
    return i[ok], j[ok], flips[ok].astype(np.int64)


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate(pairs, axis=1)
    both = both[:, np.lexsort((both[1], both[0]))]
    fresh = np.ones(both.shape[1], bool)
    fresh[1:] = (both[:, 1:] != both[:, :-1]).any(0)
    return both[:, fresh]


#: The columns of an entry that follow its token, and their types; n, place and number are of 2 bytes where all of a blob fit.
ENTRY = {"cls": "<i8", "n": "", "place": "", "number": "", "low": "<u8", "high": "<u4", "doc": "<u4"}
#: GONE: key, h, number of a line. PAIR: a is a partition, b a unit, blob pairs for a. HOT: a is a token, b a block of its run that meets
#: blocks number to last. REST: b is a unit, blob its entries that have candidates. A unit is a partition of tokens or two blocks.
FOUND = "kind int, a long, b long, key long, h long, number long, last long, blob binary"
NAMES = ["kind", "a", "b", "key", "h", "number", "last", "blob"]
TYPES = [pa.int32()] + [pa.int64()] * 6 + [pa.binary()]
#: The classes of a later and an earlier line, where their first lines are, and whether the unit has more earlier candidates.
PAIRS = ["a", "b", "key", "h", "number", "key2", "h2", "number2", "more"]


def _packed(sig: np.ndarray, col: dict[str, np.ndarray], keys: np.ndarray, hs: np.ndarray) -> bytes:
    wide = 4 if max(col[c].max(initial=0) for c in ("n", "place", "number")) > 65_535 else 2
    out = [np.array([len(sig), len(keys), wide], "<u4"), np.ascontiguousarray(sig >> U(16)).view(np.uint8).reshape(-1, 8)[:, :5]]
    out += [col[c].astype(t or f"<u{wide}") for c, t in ENTRY.items()] + [keys.astype("<i8"), hs.astype("<i8")]
    return b"".join(x.tobytes() for x in out)


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The entries of some blobs: sig (without the 16 bits that told the partition), the columns of ENTRY, key and h."""
    parts: dict[str, list[np.ndarray]] = {}
    for b in blobs:
        m, d, wide = np.frombuffer(b, "<u4", 3).astype(int)
        six = np.zeros((m, 8), np.uint8)
        six[:, :5] = np.frombuffer(b, "u1", 5 * m, 12).reshape(-1, 5)
        at = 12 + 5 * m
        col = {"sig": six.view("<u8")[:, 0]}
        for c, t in ENTRY.items():
            col[c] = np.frombuffer(b, t or f"<u{wide}", m, at)
            at += col[c].nbytes
        doc = col.pop("doc")
        col["key"], col["h"] = (np.frombuffer(b, "<i8", d, at + k * 8 * d)[doc] for k in range(2))
        for c, x in col.items():
            parts.setdefault(c, []).append(x)
    return {c: np.concatenate(x) for c, x in parts.items()}


def _found(kind: int, **cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    size = len(next(iter(cols.values())))
    for at in range(0, size, 50_000):
        m = min(50_000, size - at)
        have = {"kind": np.full(m, kind, "i4")} | {c: x[at : at + m] for c, x in cols.items()}
        yield pa.RecordBatch.from_arrays([pa.array(have[c], t) if c in have else pa.nulls(m, t) for c, t in zip(NAMES, TYPES, strict=True)], NAMES)


def _by_size(col: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Entries by token and size, their sketches, and their ranks by (key, h, number)."""
    o = np.lexsort((col["n"], col["sig"]))
    col = {c: x[o] for c, x in col.items()} | {c: col[c][o].astype(np.int64) for c in ("n", "place")}
    rank = np.empty(len(o), np.int64)
    rank[np.lexsort((col["number"], col["h"], col["key"]))] = np.arange(len(o))
    return col, np.stack([col["low"], col["high"].astype(U)], axis=1), rank


def _sent(col: dict[str, np.ndarray], late: np.ndarray, early: np.ndarray, more: np.ndarray, unit: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind PAIR for pairs of entries, to the partitions of their later classes."""
    if not len(late):
        return
    pairs = np.stack([col["cls"][late], col["cls"][early], *(col[c][k].astype(np.int64) for k in (late, early) for c in ("key", "h", "number")), more.astype(np.int64)])
    part = pairs[0] % parts
    order = np.argsort(part, kind="stable")
    pairs, part = pairs[:, order], part[order]
    start = _runs(part)
    blobs = [pairs[:, x:y].astype("<i8").tobytes() for x, y in zip(start, np.append(start[1:], len(part)), strict=True)]
    yield from _found(PAIR, a=part[start], b=np.full(len(start), unit), blob=np.array(blobs, object))


def _met(col: dict[str, np.ndarray], join: Join, parts: int, unit: int, side: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows for entries of which each token and class has one: each with its likeliest earlier candidate, and what it takes to find the others.

    A line goes by one earlier match, whichever it is, so the pairs of lines that are all alike, which grow as their square, are never listed.
    """
    col, sketch, rank = _by_size(col if side is None else col | {"side": side})
    side = col.pop("side", None)
    size, cls = len(rank), col["cls"]
    best, with_, many, met = np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    for i, j, flips in _close(col["sig"], col["n"], col["place"], sketch, join, side):
        later = rank[i] > rank[j]
        for late, early, f in ((i[later], j[later], flips[later]), (j[~later], i[~later], flips[~later])):
            score = f << 56 | cls[early] >> 7  # the same choice under every token that sees both
            better = score < best[late]
            best[late[better]], with_[late[better]] = score[better], early[better]
            many[late] += 1
        met[i] = met[j] = True
    late = np.flatnonzero(many)
    if not len(late):
        return
    yield from _sent(col, late, with_[late], many[late] > 1, unit, parts)
    start = _runs(col["sig"])
    open_ = np.maximum.reduceat(many, start) > 1
    keep = np.flatnonzero(met & np.repeat(open_, np.diff(np.append(start, size))))
    edge = np.append(_runs(col["sig"][keep]), len(keep))
    lo = 0
    while lo < len(edge) - 1:
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + 200_000, "right")) - 1)
        k = keep[edge[lo] : edge[hi]]
        c = {name: x[k] for name, x in col.items()}
        blob = _packed(c["sig"] << U(16), c | {"doc": np.arange(len(k))}, c["key"], c["h"])
        yield from _found(REST, b=np.array([unit]), blob=np.array([blob], object))
        lo = hi


def _all_of(col: dict[str, np.ndarray], late: np.ndarray, join: Join, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind PAIR for every earlier candidate of the entries of some classes."""
    col, sketch, rank = _by_size(col)
    start = _runs(col["sig"])
    length = np.diff(np.append(start, len(rank)))
    first, length = np.repeat(start, length), np.repeat(length, length)
    asks = np.flatnonzero(np.isin(col["cls"], late))
    total, lo = np.cumsum(length[asks]), 0
    while lo < len(asks):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 500_000, "right")))
        m = length[asks[lo:hi]]
        i = np.repeat(asks[lo:hi], m)
        j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + first[i]
        ok = (rank[j] < rank[i]) & join.sized(col["n"][i], col["n"][j])
        i, j, _ = _bounded(i[ok], j[ok], col["n"], col["place"], sketch, join)
        yield from _sent(col, i, j, np.zeros(len(i), bool), -1, parts)
        lo = hi


def removed_lines(docs: DataFrame, threshold: tuple[int, int] = (4, 5), min_tokens: int = 5, run: int = 4_096) -> DataFrame:
    """key, h, gone: for each row of docs (key long, h long, text) with lines to remove their numbers from 0.

    A line is removed if an earlier one, by (key, h, number), has a Jaccard
    similarity of at least the threshold, by the sets of their lower-case (A-Z)
    words. Lines of fewer than min_tokens distinct words neither remove nor go.

    All lines of one set share their prefix, so the partition of its rarest
    token sees every copy and the partitions of all its tokens agree which is
    the first. A token that more than ``run`` classes share is cut into blocks,
    whose pairs are spread over tasks of their own.

    Under each token a line first meets the likeliest of its earlier candidates
    alone. Only lines that no such pair removes meet all the others.
    """
    spark = docs.sparkSession
    join = Join(*threshold)
    docs = docs.where("text <> ''")
    table_, tokens = counts(docs)
    rarity = spark.sparkContext.broadcast(table_)  # BUCKETS bytes
    # about a fifth of all tokens are prefix entries, of some 40 bytes: partitions of at most about 32 MB
    parts = min(60_000, max(parallelism(spark), tokens // 4_000_000 + 1))
    flush = min(1_000_000, max(200_000, 32 * parts))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        keys, hs, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            sig, *cols = (np.concatenate([x[k] for x in held]) for k in range(8))
            held.clear()
            part = (sig & U(0xFFFF)).astype(np.int64) % parts
            o = np.lexsort((cols[-1], part))
            sig, part = sig[o], part[o]
            col = {c: x[o] for c, x in zip(ENTRY, cols, strict=True)}
            doc = col["doc"].astype(np.int64)
            fresh = np.ones(len(o), bool)
            fresh[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
            local, of = np.cumsum(fresh) - 1, doc[fresh]
            k, h = np.array(keys, "<i8")[of], np.array(hs, "<i8")[of]
            start = _runs(part)
            ids, blobs = part[start], []
            for a, b in zip(start, np.append(start[1:], len(part)), strict=True):
                c = {name: x[a:b] for name, x in col.items()} | {"doc": local[a:b] - local[a]}
                blobs.append(_packed(sig[a:b], c, k[local[a] : local[b - 1] + 1], h[local[a] : local[b - 1] + 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype("i4")), pa.array(blobs, pa.binary())], ["part", "blob"])

        for some_keys, some_hs, texts in rows(batches, "key", "h", "text"):
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) < 1_000_000):
                    chars += len(texts[to])
                    to += 1
                split = [t.split("\n") for t in texts[at:to]]
                n_of = np.array([len(x) for x in split])
                words, of = word_hashes([x for y in split for x in y])
                cls, n, sketch, sig, line, place = prefixes(words, of, int(n_of.sum()), rarity.value, join)
                take = n[line] >= min_tokens
                sig, line, place = sig[take], line[take], place[take]
                doc = np.repeat(np.arange(len(keys), len(keys) + to - at), n_of)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
                keys += some_keys[at:to]
                hs += some_hs[at:to]
                # n fits 32 bits; places and numbers too
                held.append((sig, cls[line], n[line].astype("<u4"), place.astype("<u4"), number[line].astype("<u4"), sketch[line, 0], sketch[line, 1].astype("<u4"), doc[line].astype("<u4")))
                size += len(sig)
                at = to
                if size > flush:
                    yield from out()
                    keys, hs, size = [], [], 0
        if size:
            yield from out()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for part, some in rows(batches, "part", "blob"):
            for p, b in zip(part, some, strict=True):
                blobs.setdefault(p, []).append(b)
        for p in list(blobs):
            col = _unpacked(blobs.pop(p))
            home = np.flatnonzero(col["place"] == 0)  # all copies of a class are here by their rarest token
            home = home[np.lexsort(tuple(col[c][home] for c in ("number", "h", "key", "cls")))]
            start = _runs(col["cls"][home])
            first = np.repeat(home[start], np.diff(np.append(start, len(home)))) if len(home) else home
            # equal rows have the same place twice: it goes or stays as one
            gone = home[np.logical_or.reduce([col[c][home] != col[c][first] for c in ("key", "h", "number")])]
            yield from _found(GONE, key=col["key"][gone], h=col["h"][gone], number=col["number"][gone])
            # the first of each class; tokens that only one class has are done
            order = np.lexsort(tuple(col[c] for c in ("number", "h", "key", "cls", "sig")))
            sig, cls = col["sig"][order], col["cls"][order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
            order, sig = order[fresh], sig[fresh]
            start = _runs(sig)
            length = np.diff(np.append(start, len(sig)))
            much = np.repeat(length, length) if len(sig) else length
            yield from _met({c: x[order[(much > 1) & (much <= run)]] for c, x in col.items()}, join, parts, p)
            for k in np.flatnonzero(length > run):
                o = order[start[k] : start[k] + length[k]]
                o = o[np.lexsort((col["cls"][o], col["n"][o]))]
                cuts = [o[x : x + run // 2] for x in range(0, len(o), run // 2)]
                for b, some in enumerate(cuts):
                    c = {name: x[some] for name, x in col.items()}
                    blob = _packed(c["sig"] << U(16), c | {"doc": np.arange(len(some))}, c["key"], c["h"])
                    # a pair of blocks whose sizes are too far apart is never made
                    last = next((x for x in range(len(cuts) - 1, b, -1) if int(col["n"][cuts[x][0]]) * join.p <= int(c["n"][-1]) * join.q), b)
                    first_ = next((x for x in range(b) if int(c["n"][0]) * join.p <= int(col["n"][cuts[x][-1]]) * join.q), b)
                    yield from _found(HOT, a=np.array([p << 40 | int(sig[start[k]]) & (1 << 40) - 1]), b=np.array([b]), number=np.array([first_]), last=np.array([last]), blob=np.array([blob], object))

    def across(key: tuple, t: pa.Table) -> pa.Table:
        cols = [_unpacked([x]) for x in t["blob"].to_pylist()]
        side = np.repeat(np.arange(len(cols)), [len(c["sig"]) for c in cols]) if len(cols) > 1 else None
        unit = xxhash.xxh3_64_intdigest(repr([k.as_py() for k in key]).encode()) >> 1
        return pa.Table.from_batches(list(_met({c: np.concatenate([x[c] for x in cols]) for c in cols[0]}, join, parts, unit, side)), pa.schema(list(zip(NAMES, TYPES, strict=True))))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, "<i8").reshape(len(PAIRS), -1)[:-1] for (some,) in rows(batches, "blob") for x in some]
        if held:
            pairs = _distinct(held)
            held.clear()
            for at in range(0, pairs.shape[1], 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in pairs], PAIRS[:-1])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds, some in rows(batches, "kind", "blob"):
            held = []
            for kind, x in zip(kinds, some, strict=True):
                if kind == PAIR:
                    p = np.frombuffer(x, "<i8").reshape(len(PAIRS), -1)
                    held += [p[[0, 2, 3, 4]], p[[1, 5, 6, 7]]]
                else:
                    col = _unpacked([x])
                    held.append(np.stack([col[c].astype(np.int64) for c in ("cls", "key", "h", "number")]))
            if held:
                held = np.concatenate(held, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[:, np.unique(held[0], return_index=True)[1]]], ["cls", "key", "h", "number"])

    def unsettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held = [], []
        for units, cls, some in rows(batches, "unit", "cls", "blob"):
            for u, c, x in zip(units, cls, some, strict=True):
                if x is None:
                    done.append(c)
                else:
                    p = np.frombuffer(x, "<i8").reshape(len(PAIRS), -1)
                    late = p[0, p[-1] > 0]
                    held.append(np.stack([np.full(len(late), u), late]))
        if held:
            u, c = np.concatenate(held, axis=1)
            left = ~np.isin(c, done)
            yield pa.RecordBatch.from_arrays([pa.array(u[left]), pa.array(c[left])], ["unit", "cls"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late: dict[int, list[int]] = {}
        held: list[tuple[int, bytes]] = []
        for units, cls, some in rows(batches, "unit", "cls", "blob"):
            for u, c, x in zip(units, cls, some, strict=True):
                if x is None:
                    late.setdefault(u, []).append(c)
                else:
                    held.append((u, x))
        for u, x in held:
            if u in late:
                yield from _all_of(_unpacked([x]), np.array(late[u]), join, parts)

    def by_part(df: DataFrame, part: Column, n: int, *names: str) -> DataFrame:
        return df.withColumn("part", F.pmod(F.pmod(part, F.lit(parts)), F.lit(n)).cast("int")).select("part", *names).repartitionById(n, F.col("part"))

    found = written(docs.mapInArrow(frugal(emit), "part int, blob binary").repartitionById(parts, F.col("part")).mapInArrow(frugal(reduce), FOUND))
    met = found.where(f"kind in ({PAIR}, {REST})")
    hot = found.where(f"kind = {HOT}")
    if not hot.isEmpty():
        sent = hot.select(F.col("a").alias("token"), F.col("b").alias("mine"), F.explode(F.sequence("number", "last")).alias("other"), "blob")
        sent = sent.select("token", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "blob")
        met = met.unionByName(written(sent.repartition(parts, "token", "i", "j").groupBy("token", "i", "j").applyInArrow(across, FOUND)))
    lines = written(_lines(docs, met.select("kind", "blob").mapInArrow(frugal(nodes), "cls long, key long, h long, number long")))  # its shuffle of the texts is gone before the caller's
    columns = ", ".join(f"{c} long" for c in PAIRS[:-1])
    pairs = met.where(f"kind = {PAIR}")
    first = written(_verified(lines, by_part(pairs, F.col("a"), parts, "blob").mapInArrow(frugal(distinct), columns), join, parts))
    gone = found.where(f"kind = {GONE}").select("key", "h", "number").union(first.select("key", "h", "number"))
    rest = met.where(f"kind = {REST}").select(F.col("b").alias("unit"), F.lit(None).cast("long").alias("cls"), "blob")
    few = max(8, parts // 4)  # hardly any line is left
    if not rest.isEmpty():
        settled = first.select("a", F.lit(None).cast("long").alias("unit"), F.col("a").alias("cls"), F.lit(None).cast("binary").alias("blob"))
        tried = pairs.select("a", F.col("b").alias("unit"), F.lit(None).cast("long").alias("cls"), "blob").union(settled)
        asked = by_part(tried, F.col("a"), few, "unit", "cls", "blob").mapInArrow(frugal(unsettled), "unit long, cls long").select("unit", "cls", F.lit(None).cast("binary").alias("blob"))
        more = by_part(rest.union(asked), F.col("unit"), few, "unit", "cls", "blob").mapInArrow(frugal(others), FOUND)
        more = by_part(more, F.col("a"), few, "blob").mapInArrow(frugal(distinct), columns)
        gone = gone.union(written(_verified(lines, more, join, few)).select("key", "h", "number"))
    return gone.groupBy("key", "h").agg(F.collect_set("number").alias("gone"))


def _lines(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """cls, text: the lines of docs that nodes (cls, key, h, number) name; equal rows give theirs each."""
    wanted = nodes.groupBy("key", "h").agg(F.collect_set(F.struct("number", "cls")).alias("some"))  # of one document

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.column(1)
            edge, flat = some.offsets.to_numpy(), some.flatten()
            edge = edge - edge[0]
            number = flat.field("number").to_numpy()
            out: list[str] = []
            for k in range(b.num_rows):
                lines = b.column(0)[k].as_py().split("\n")
                out += [lines[i] for i in number[edge[k] : edge[k + 1]]]
            yield pa.RecordBatch.from_arrays([flat.field("cls"), pa.array(out, pa.string())], ["cls", "text"])

    return docs.join(wanted, ["key", "h"]).select("text", "some").mapInArrow(frugal(cut_out), "cls long, text string")


def _verified(lines: DataFrame, pairs: DataFrame, join: Join, parts: int) -> DataFrame:
    """a, key, h, number of the later line of each pair that is linked; a line goes once to each partition with pairs of it."""
    placed = pairs.withColumn("part", F.pmod("a", F.lit(parts)).cast("int"))
    needed = placed.select("part", F.explode(F.array("a", "b")).alias("cls")).distinct()
    none = [F.lit(None).cast("long").alias(c) for c in ("b", "key", "h", "number")]
    sent = lines.join(needed, "cls").select("part", F.col("cls").alias("a"), none[0], "text", *none[1:])
    asked = placed.select("part", "a", "b", F.lit(None).cast("string").alias("text"), "key", "h", "number")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, asks = [], [], [np.zeros((5, 0), np.int64)]
        for x in batches:
            line = x.column(1).is_null()
            of = x.filter(line)
            ids.append(of.column(0).to_numpy())
            texts += of.column(2).to_pylist()
            pair = x.filter(x.column(1).is_valid())
            asks.append(np.stack([pair.column(k).to_numpy() for k in (0, 1, 3, 4, 5)]))
        if not texts:
            return
        cls, at = np.unique(np.concatenate(ids), return_index=True)  # equal rows give a line twice
        words, of = word_hashes([texts[k] for k in at])
        del texts
        words, of = words[(o := np.lexsort((words, of)))], of[o]
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[1:] != words[:-1]) | (of[1:] != of[:-1])
        words, of = np.unique(words[fresh], return_inverse=True)[1], of[fresh]
        n = np.bincount(of, minlength=len(cls))
        edge = np.append(0, np.cumsum(n))
        a, b, *where = np.concatenate(asks, axis=1)
        late = a
        a, b = np.searchsorted(cls, a), np.searchsorted(cls, b)
        both, lo = np.cumsum(n[a] + n[b]), 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(both, (both[lo - 1] if lo else 0) + 2_000_000, "right")))
            got = np.concatenate([_spread(edge, n, x[lo:hi], words) for x in (a, b)])
            got.sort()
            common = np.bincount(got[1:][got[1:] == got[:-1]] >> 32, minlength=hi - lo)
            ok = lo + np.flatnonzero(join.q * common >= join.p * (n[a[lo:hi]] + n[b[lo:hi]] - common))
            ok = ok[np.unique(late[ok], return_index=True)[1]]  # a line goes once
            yield pa.RecordBatch.from_arrays([pa.array(w[ok]) for w in (late, *where)], ["a", "key", "h", "number"])
            lo = hi

    return sent.union(asked).repartitionById(parts, F.col("part")).select("a", "b", "text", "key", "h", "number").mapInArrow(frugal(verify), "a long, key long, h long, number long")


def _spread(edge: np.ndarray, n: np.ndarray, which: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The numbers of the words of some sets one after another, below the place of each in which."""
    m = n[which]
    at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(edge[which], m)
    return np.repeat(np.arange(len(which), dtype=np.int64), m) << 32 | words[at]


def dedup(docs: DataFrame, threshold: tuple[int, int] = (4, 5), min_tokens: int = 5) -> DataFrame:
    """docs with later matches cut out of text, and n_lines, n_removed beside all other columns (columns of those names are replaced).

    Lines end at \\n. See :func:`removed_lines` for what is a match. Null and
    empty texts stay, with 0 and 1 lines. The order of documents is doc_id
    (null first), then a hash of the text; equal rows go through alike, a line
    of theirs counting once. A line whose every word repeats is one set. An
    empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.select(key.alias("key"), F.xxhash64("text").alias("h"), "text")
    gone = removed_lines(keyed.where("text is not null"), threshold, min_tokens)
    release(docs.sparkSession)
    names = docs.columns
    rows_ = docs.withColumn("__qf_key", key).withColumn("__qf_h", F.xxhash64("text"))
    got = rows_.join(gone.toDF("__qf_key", "__qf_h", "__qf_gone"), ["__qf_key", "__qf_h"], "left")
    some = F.col("__qf_gone").isNotNull()

    @F.arrow_udf("string")
    def without(text: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True):
            if t is not None:
                g = set(g)
                t = "\n".join([x for k, x in enumerate(t.split("\n")) if k not in g])
            out.append(t)
        return pa.array(out, pa.string())

    kept = without(F.when(some, F.col("text")), "__qf_gone")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return got.select(*[F.when(some, kept).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in names], n.alias("n_lines"), F.coalesce(F.size("__qf_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


SQL = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as number from documents where text is not null),
s as (select doc_id, number, line, list_distinct(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as w from l),
k as (select row_number() over (order by doc_id, number) as id, doc_id, number, w, len(w) as n from s where len(w) >= 5),
t as (select id, n, unnest(w) as x from k),
f as (select x, count(*) as c from t group by x),
p as (select id, n, x from (select t.*, row_number() over (partition by id order by c, x) as r from t join f using (x)) where r <= n - cast(ceil(0.8 * n) as bigint) + 1),
c as (select distinct a.id as i, b.id as j from p a join p b on a.x = b.x and a.id < b.id and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
g as (select distinct j from (select j, len(list_intersect(a.w, b.w)) as m, a.n + b.n as u from c join k a on a.id = i join k b on b.id = j) where 5 * m >= 4 * (u - m)),
d as (select s.doc_id, s.number, s.line, g.j is not null as gone from s left join k on k.doc_id = s.doc_id and k.number = s.number left join g on g.j = k.id)
select doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_removed, coalesce(string_agg(line, chr(10) order by number) filter (where not gone), '') as text from d group by doc_id
union all select doc_id, 0, 0, null from documents where text is null
"""
