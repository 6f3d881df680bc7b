"""Personal data by patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.llm.common import frugal, rows, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # never fails once begun, so long runs are read once
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def _emails(text: str) -> Iterator[Span]:
    """Around each @: as far left as the local part goes, which no other start can beat."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        parts = [p.span() for p in _PART.finditer(text, *run.span())]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four):
                yield four[0][0], four[3][1]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and start."""
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *s) for s in _ips(text)] + [(2, *s) for s in _cards(text)]
        if "+" in text:
            out += [(3, *s) for s in _phones(text)]
    return out


# What a pattern misses but the model may label: numbers written otherwise, spelt-out and cut addresses.
_NUMBER = re.compile(r"(?<![\w.+])\(?[0-9][0-9() .\-/]*[0-9](?![\w])")
#: Parts of a run of digits that is too long for a pattern, as where a phone and a card number follow one another.
_GROUPED = re.compile(r"(?<![\w.+])\+?(?:[0-9]{1,3} )?\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_SOLID = re.compile(r"(?<![\w.+])[0-9]{16,19}(?!\w)")
#: Digits and what may part them: those of a longer run than a pattern takes are cut by _runs.
_CHUNK = re.compile(r"[0-9]+")
_GAP = re.compile(r"[() .\-/]{1,3}")
_BRACKET_AT = re.compile(r"[\[({] ?(?:at|AT|@)")
_SPELT = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]+ ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({] ?(?:dot|DOT|\.) ?[\])}]) ?[A-Za-z0-9-]+)+")
_HALF = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?![\w.-])")
_SPELT_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}|\(\.\)[0-9]{1,3}|\[dot\][0-9]{1,3}){3}(?![\w.])")
_AT = re.compile(r" ?[\[({] ?(?:at|@) ?[\])}] ?", re.I)
_DOT = re.compile(r" ?[\[({] ?(?:dot|\.) ?[\])}] ?", re.I)
_CUES = (re.compile(r"mail|contact|write", re.I), re.compile(r"\bip\b|host|server|addr", re.I), re.compile(r"card|visa|credit|pay", re.I), re.compile(r"tel|phone|call|fax|mobil|ruf", re.I))
N_FEATURES = 22


def _runs(text: str, start: int, end: int) -> Iterator[Span]:
    """What lies in a run of more than 15 digits: a card number, else what is between slashes or more than one separator, else groups of 7 to 15 digits that end a number of 4."""
    chunks = [m.span() for m in _CHUNK.finditer(text, start, end)]
    i = 0
    while i < len(chunks):
        best, digits, j = None, "", i
        while j < len(chunks) and len(digits) < 19:
            if j > i and not _GAP.fullmatch(text, chunks[j - 1][1], chunks[j][0]):
                break
            digits += text[chunks[j][0] : chunks[j][1]]
            if 16 <= len(digits) <= 19 and luhn(digits):
                best = (j, len(digits))
            j += 1
        if best is None:  # a phone: up to a wide gap, else as far as the first number of four digits from the seventh on
            size, j = 0, i
            while j < len(chunks):
                gap = text[chunks[j - 1][1] : chunks[j][0]] if j > i else ""
                if j > i and ("/" in gap or (len(gap) > 1 and "(" in gap and size >= 7) or gap.count(" ") > 1):
                    break
                size += chunks[j][1] - chunks[j][0]
                if size > 15:
                    break
                if size >= 7:
                    best = (j, size)
                    if chunks[j][1] - chunks[j][0] == 4 and size >= 10:
                        break
                j += 1
        if best is None:
            i += 1
            continue
        a, b = chunks[i][0], chunks[best[0]][1]
        yield (a - 1 if a > start and text[a - 1] == "(" else a), b
        i = best[0] + 1


@dataclass
class Mention:
    start: int
    end: int
    kind: int  # index in KINDS of the pattern that matched, -1 if none
    keys: tuple[str, ...]  # what it shares with repeated or similar mentions
    features: np.ndarray


def _mention(text: str, start: int, end: int, kind: int) -> Mention:
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    plain = _DOT.sub(".", _AT.sub("@", s)).lower()
    keys = [plain]
    if "@" in plain:
        keys.append("@" + plain.partition("@")[0] + "@" + plain.partition("@")[2].partition(".")[0])  # the same box at the same first name of a host
    elif len(digits) >= 8:
        keys.append("#" + digits[-9:] if len(digits) >= 9 else "#" + digits)
    f = np.zeros(N_FEATURES)
    f[0] = 1
    f[1], f[2], f[3] = "@" in plain, plain.count(".") == 3, "@" in plain and "." in plain.partition("@")[2]
    f[4 + min(6, len(digits) // 3)] = 1  # 4 to 10
    f[11] = 16 <= len(digits) <= 19 and luhn(digits)
    f[12], f[13], f[14] = "(" in s, "-" in s, " " in s
    f[15] = plain.count(".") == 3 and len(plain.split(".")) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in plain.split("."))
    before = text[max(0, start - 24) : start]
    for k, cue in enumerate(_CUES):
        f[16 + k] = bool(cue.search(before))
    f[20] = s[0] == "+"
    f[21] = plain.count(".") > 0
    return Mention(start, end, kind, tuple(keys), f)


def mentions(text: str, base: list[tuple[int, int, int]] | None = None) -> list[Mention]:
    """The pattern matches of a text and what else might be one, by start."""
    base = base_spans(text) if base is None else base
    out = [_mention(text, a, b, k) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    reach: list[int] = []  # the furthest end of the spans up to each, as spans of two kinds may overlap
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    starts = [a for a, _ in taken]
    last = 0
    found: list[Span] = []
    if "@" in text or _BRACKET_AT.search(text):
        found += [m.span() for p in (_SPELT, _HALF) for m in p.finditer(text)]
    if _DIGIT.search(text):
        found += [m.span() for p in (_GROUPED, _SOLID, _SPELT_IP) for m in p.finditer(text)]
        for m in _NUMBER.finditer(text):
            digits = len(_NOT_DIGIT.sub("", m[0]))
            if digits > 15:
                found += _runs(text, *m.span())
            elif len(m[0]) >= 7:
                found.append(m.span())
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        k = bisect_left(starts, b)
        if a >= last and not (k and reach[k - 1] > a):
            out.append(_mention(text, a, b, -1))
            last = b
    out.sort(key=lambda m: (m.start, m.kind))
    return out


@dataclass(frozen=True)
class Model:
    """weights: features by label. agree: what equal labels of two mentions that share a key gain. follow: label after label, for neighbours."""

    weights: np.ndarray
    agree: float
    follow: np.ndarray

    def beliefs(self, found: list[Mention], rounds: int = 30) -> np.ndarray:
        """The marginals of each mention by loopy sum-product.

        A key that two or more mentions share is a variable of its own, tied to
        each of them: copies exchange messages through it, however far apart,
        at a cost in proportion to their number. Neighbours within 40
        characters are tied by the chain. Pattern matches are observed.
        """
        n, m = len(found), len(LABELS)
        unary = np.stack([x.features for x in found]) @ self.weights
        for i, x in enumerate(found):
            if x.kind >= 0:
                unary[i] = -60.0
                unary[i, x.kind + 1] = 0.0
        at: dict[str, int] = {}
        member = [(i, at.setdefault(k, len(at))) for i, x in enumerate(found) for k in dict.fromkeys(x.keys)]
        size = np.bincount([h for _, h in member], minlength=len(at))
        member = [(i, n + h) for i, h in member if size[h] > 1]
        chain = [(i, i + 1) for i in range(n - 1) if found[i + 1].start - found[i].end <= 40]
        if not member and not chain:
            b = np.exp(unary - unary.max(1, keepdims=True))
            return b / b.sum(1, keepdims=True)
        total = n + len(at)
        own = np.zeros((total, m))
        own[:n] = unary
        same = np.where(np.eye(m, dtype=bool), self.agree, 0.0)
        edges = np.array(member + chain)
        pot = np.stack([same] * len(member) + [self.follow] * len(chain))
        src = np.concatenate([edges[:, 0], edges[:, 1]])
        dst = np.concatenate([edges[:, 1], edges[:, 0]])
        pots = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        msg = np.zeros((len(src), m))
        for _ in range(rounds):
            node = own.copy()
            np.add.at(node, dst, msg)
            out = (node[src] - msg[back])[:, :, None] + pots
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            change = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if change < 1e-4:
                break
        node = own.copy()
        np.add.at(node, dst, msg)
        b = np.exp(node[:n] - node[:n].max(1, keepdims=True))
        return b / b.sum(1, keepdims=True)

    def spans(self, text: str, least: float = 0.9) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The patterns' spans, and all spans: those and what the model adds with a marginal of at least so much."""
        base = base_spans(text)
        found = mentions(text, base) if base or "@" in text or _DIGIT.search(text) or "at" in text or "AT" in text else []
        if not any(x.kind < 0 for x in found):
            return base, base
        b = self.beliefs(found)
        more = [(int(b[i].argmax()) - 1, x.start, x.end) for i, x in enumerate(found) if x.kind < 0 and b[i].argmax() > 0 and b[i].max() >= least]
        return base, sorted(base + more)


def variants(kind: int, s: str) -> list[str]:
    """What a pattern's match looks like where the pattern would miss it."""
    if KINDS[kind] == "email":
        box, _, host = s.rpartition("@")
        return [f"{box} [at] {host.replace('.', ' [dot] ')}", f"{box}(at){host}", f"{box}@{host.partition('.')[0]}"]
    if KINDS[kind] == "ip":
        return [s.replace(".", "[.]"), s.replace(".", "(.)")]
    digits = _NOT_DIGIT.sub("", s)
    if KINDS[kind] == "card":
        return [".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), "/".join(digits[k : k + 4] for k in range(0, len(digits), 4))]
    return [s[1:], s[s.index(" ") + 1 :] if " " in s else s[1:], f"{digits[-10:-7]} {digits[-7:-4]}-{digits[-4:]}".strip(), f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}".strip(".")]


def fit(rows_: list[tuple], ridge: float = 2e-4, steps: int = 600) -> Model:
    """Weights, agreement and transitions together, by penalised maximum pseudo-likelihood of the field.

    rows_: features, label of what shares a key (-1: nothing does), label
    before, label after (-1: none is near), own label, how often. A row's label
    is scored given those of its neighbours, so all three kinds of potential
    compete for what they explain. The agreement learned is that of two
    mentions; each is tied to their common variable so that both ties in a row
    have that strength.
    """
    m = len(LABELS)
    w, agree, follow = np.zeros((N_FEATURES, m)), 0.0, np.zeros((m, m))
    if rows_:
        x = np.array([r[0] for r in rows_], float)
        hub, before, after, y, n = (np.array([r[k] for r in rows_], int) for k in range(1, 6))
        n = n / n.sum()
        linked, has_before, has_after = ((v >= 0).astype(float) for v in (hub, before, after))
        same, prior, later, own = np.eye(m)[hub] * linked[:, None], np.eye(m)[before] * has_before[:, None], np.eye(m)[after] * has_after[:, None], np.eye(m)[y]
        speed = [np.zeros_like(w), 0.0, np.zeros_like(follow)]
        for _ in range(steps):
            z = x @ w + agree * same + prior @ follow + later @ follow.T
            z = np.exp(z - z.max(1, keepdims=True))
            error = (z / z.sum(1, keepdims=True) - own) * n[:, None]
            grads = [x.T @ error + ridge * w, float((error * same).sum()) + ridge * agree, prior.T @ error + (later.T @ error).T + ridge * follow]
            speed = [0.9 * v - 0.5 * g for v, g in zip(speed, grads, strict=True)]
            w, agree, follow = w + speed[0], max(0.0, agree + speed[1]), follow + speed[2]
    low, high = 0.0, 30.0
    for _ in range(60):
        a = (low + high) / 2
        low, high = (a, high) if np.log((np.exp(2 * a) + m - 1) / (2 * np.exp(a) + m - 2)) < agree else (low, a)
    return Model(w, (low + high) / 2, follow)


def examples(text: str) -> Iterator[tuple[list[float], int, int, int, int]]:
    """Rows of :func:`fit` that a text gives: candidates that no pattern matches, and its matches as they look where patterns miss them.

    A match hidden so keeps its label; it is seen once with a copy of itself
    elsewhere in the text and once alone. A candidate that shares a key with a
    match has its label, others have none.
    """
    found = mentions(text)
    label = [x.kind + 1 for x in found]
    by_key: dict[str, list[int]] = {}
    for i, x in enumerate(found):
        for k in x.keys:
            by_key.setdefault(k, []).append(i)
    known = {k: next((label[i] for i in some if found[i].kind >= 0), 0) for k, some in by_key.items()}
    for i, x in enumerate(found):
        if x.kind < 0:
            label[i] = next((known[k] for k in x.keys if known[k]), 0)
    for i, x in enumerate(found):
        before = label[i - 1] if i and x.start - found[i - 1].end <= 40 else -1
        after = label[i + 1] if i + 1 < len(found) and found[i + 1].start - x.end <= 40 else -1
        if x.kind < 0:
            shared = any(len(by_key[k]) > 1 for k in x.keys)
            yield x.features.tolist(), label[i] if shared else -1, before, after, label[i]
            continue
        around = text[max(0, x.start - 40) : x.start]
        for v in [text[x.start : x.end], *variants(x.kind, text[x.start : x.end])]:  # as it is too: another match may be in its way
            f = _mention(around + v, len(around), len(around) + len(v), -1).features.tolist()
            yield f, label[i], before, after, label[i]
            yield f, -1, before, after, label[i]


def train(docs: DataFrame, sample: int = 10_000) -> Model:
    """A model from about so many documents of least hash of doc_id (the documented bound of what training reads).

    The patterns' matches are its labels, hidden from it: it learns to know
    them by other shapes, by copies and by neighbours. See :func:`examples`.
    """
    n = docs.count()
    share = min(1.0, sample / max(1, n))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1_000_000)) < int(share * 1_000_000)).where("text is not null").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in rows(batches, "text"):
            got = [r for t in texts for r in sorted({(tuple(f), *y) for f, *y in examples(t)})]
            columns = list(zip(*got, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.list_(pa.float64())), *(pa.array(c, pa.int64()) for c in columns[1:])], ["f", "hub", "before", "after", "y"])

    # a document counts each of its shapes once, so that none outweighs the others by repeating itself; examples of one shape are one row with a count: the driver gets shapes, of which there are few
    shapes = chosen.mapInArrow(frugal(run), "f array<double>, hub long, before long, after long, y long").groupBy("f", "hub", "before", "after", "y").agg(F.count("*").alias("n")).collect()
    return fit(sorted((r.f, r.hub, r.before, r.after, r.y, r.n) for r in shapes))


def text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model, least: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs (doc_id, text).

    Counts and base_sha256 are of the patterns' matches, spans of all that is
    found. Null and empty texts have none; rows with equal or null doc_id stay
    as they are; other columns are ignored. One pass in Arrow batches; the
    work in a text is in proportion to its length, also where one value repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows(batches, "doc_id", "text"):
            n, sha, spans = ([], [], [], []), [], []
            for t in texts:
                base, every = model.spans(t, least)
                kinds = [k for k, _, _ in base]
                for k in range(4):
                    n[k].append(kinds.count(k))
                sha.append(hashlib.sha256(text_of(base).encode()).hexdigest())
                spans.append(text_of(every))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(frugal(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with <KIND> in place of each span; overlapping spans become one of the first's kind."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model, least: float = 0.9) -> DataFrame:
    """docs with every span of text masked; other columns and null texts stay. Columns may be of any kind and name."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            got = [masked(t, s) if t and (s := model.spans(t, least)[1]) else t for t in texts]
            yield b.set_column(at, b.schema.field(at), pa.array(got, b.schema.field(at).type))

    return docs.mapInArrow(frugal(run), docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
