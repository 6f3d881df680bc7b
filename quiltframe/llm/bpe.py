"""Byte-pair encoding: exact encoders over the vocabulary files of the tokenizers library.

A text is cut at white space into chunks that no merge crosses, so that the ids
of a text are the ids of its chunks one after another. Chunks repeat, so each
worker keeps the ids of those it has met. Where a text has white space that
cannot be cut that way (runs of it, at the ends), the whole text is encoded.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from quiltframe.llm.words import hashed

#: Chunks a worker remembers; beyond that it starts anew. It bounds memory, not results.
REMEMBERED = 1_500_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ends_in_space(chunk: str) -> bool:
    """Whether white space at its ends could belong to a longer run."""
    return chunk[-1].isspace() or (chunk[0] != " " and chunk[0].isspace()) or chunk[1:2].isspace()


def spaced_chunks(text: str) -> list[str]:
    """Chunks that keep their leading space; a single line feed is a chunk of its own."""
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


#: White space beyond ASCII's, and what str.split takes for it: texts that hold one are split by Python.
_WIDE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Characters whose lower case or composition may depend on others: texts that hold one keep their case.
_BOUND = re.compile("[\u0130\u0300-\U0010ffff]")


def word_chunks(text: str) -> list[str]:
    """Words for a vocabulary of lower case that drops white space."""
    return (text if _BOUND.search(text) else text.lower()).split()


#: Bytes by what the splitting of lower-case ASCII makes of them: 0 white space, 1 letters, 2 digits, 3 others; a word with any of 4 is left whole.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[128:] = _CLASS[[39, 60]] = 4


def pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where what is encoded by itself begins and ends: runs of letters, single digits, runs of other characters, and words left whole."""
    kind = np.zeros(len(raw) + 2, np.uint8)
    kind[1:-1] = _CLASS[raw]
    some = kind != 0
    edge = np.flatnonzero(some[1:] != some[:-1])
    whole = np.append(0, np.cumsum(kind[1:-1] == 4))
    whole = whole[edge[1::2]] > whole[edge[0::2]]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[edge[0::2][whole] + 1] += 1
    inside[edge[1::2][whole] + 1] -= 1
    inside = np.cumsum(inside, dtype=np.int8) > 0
    cut = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~(inside[1:] & inside[:-1])
    return np.flatnonzero(cut & some[1:]), np.flatnonzero(cut[: len(raw) + 1] & some[:-1])


class ChunkEncoder:
    """Texts to ids, as bytes of little-endian unsigned 16-bit numbers.

    words: encodes chunks, each to bytes; text: encodes a whole text, to a list of ids.
    spaced: whether white space takes part in the encoding.
    """

    def __init__(self, words: Callable, text: Callable, spaced: bool):
        self.words, self.text, self.spaced = words, text, spaced
        self.known: dict[str, bytes | None] = {}
        self._forget()

    def _forget(self) -> None:
        """No words by hash: where the ids of each are in one array, and how many."""
        self.place: dict[int, int] = {}
        self.first, self.count, self.ids, self.n_ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint16), 0

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that only ASCII white space parts, cut where the vocabulary's splitting cuts: pieces go by 64-bit hashes, all of a group at once."""
        raw = [(t if _BOUND.search(t) else t.lower()).encode() for t in texts]
        joined = b"\n".join(raw)
        if not joined.strip():
            return [b""] * len(texts)
        data = np.frombuffer(joined, np.uint8)
        start, end = pieces(data)
        h = hashed(data, start, end)
        unique, at, of = np.unique(h, return_index=True, return_inverse=True)
        if len(self.place) + len(unique) > REMEMBERED:
            self._forget()
        keys = unique.tolist()
        new = [k for k, x in enumerate(keys) if x not in self.place]
        for lo in range(0, len(new), 4_000):
            some = new[lo : lo + 4_000]
            ids = self.words([joined[start[at[k]] : end[at[k]]].decode() for k in some])
            n = np.array([len(x) // 2 for x in ids])
            a, b = len(self.place), len(self.place) + len(some)
            while b > len(self.first):
                self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
            while self.n_ids + n.sum() > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.first[a:b], self.count[a:b] = self.n_ids + np.cumsum(n) - n, n
            self.ids[self.n_ids : self.n_ids + n.sum()] = np.frombuffer(b"".join(ids), "<u2")
            self.n_ids += int(n.sum())
            self.place.update(zip((keys[k] for k in some), range(a, b), strict=True))
        word = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[of]
        n = self.count[word]
        upto = np.cumsum(n)
        out = self.ids[np.arange(int(upto[-1])) - np.repeat(upto - n, n) + np.repeat(self.first[word], n)].astype("<u2").tobytes()
        last = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raw]))  # words of each text and those before
        edge = (2 * np.append(0, upto)[last]).tolist()
        return [out[a:b] for a, b in zip([0, *edge[:-1]], edge, strict=True)]

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        good = [c for c in new if c and not (self.spaced and c != "\n" and _ends_in_space(c))]
        self.known.update(dict.fromkeys(new))
        for at in range(0, len(good), 4_000):
            part = good[at : at + 4_000]
            self.known.update(zip(part, self.words(part), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        import gc

        on = gc.isenabled()
        gc.disable()  # many lists and no cycles
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):  # a group of bounded size at a time
            group, chars = [], 0
            while at < len(texts) and (not group or chars + len(texts[at]) < (500_000 if self.spaced else 1_500_000)):
                chars += len(texts[at])
                group.append(texts[at])
                at += 1
            if not self.spaced and not any(map(_WIDE.search, group)):
                out += self._encode_words(group)
                continue
            cut = [spaced_chunks(t) if self.spaced else word_chunks(t) for t in group]
            new: set[str] = set()
            for chunks in cut:
                new.update(chunks)
            new = new.difference(self.known)  # unlike difference_update, it doesn't go through all that is known
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = {c for chunks in cut for c in chunks}
            if new:
                self._learn(list(new))
            known = self.known.__getitem__
            for t, chunks in zip(group, cut, strict=True):
                odd = "\0" in t if self.spaced else any(c in t for c in "\x1c\x1d\x1e\x1f")
                try:
                    out.append(b"" if not t else np.array(self.text(t), "<u2").tobytes() if odd else b"".join(map(known, chunks)))
                except TypeError:  # a chunk that cannot stand alone
                    out.append(np.array(self.text(t), "<u2").tobytes())
        return out


@lru_cache(maxsize=4)
def library_encoder(path: str, spaced: bool) -> ChunkEncoder:
    """The encoder of the tokenizers library for the vocabulary at path.

    spaced: True for byte-level vocabularies that keep white space, False for
    those that drop it. One encoder is kept for each worker process.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    if tok.get_vocab_size(with_added_tokens=True) > 1 << 16:
        raise ValueError("the vocabulary has more than 65,536 ids")
    mark, mark_id = next((str(t), i) for i, t in sorted(tok.get_added_tokens_decoder().items()) if t.special)
    tok_text = lambda text: tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def words(chunks: list[str]) -> list[bytes]:
        """The library splits a text at its special tokens first, so one of them parts the chunks of one call."""
        if any(mark in c for c in chunks):
            return [np.array(tok_text(c), "<u2").tobytes() for c in chunks]
        ids = np.array(tok_text(mark.join(chunks)), "<u2")
        at = np.flatnonzero(ids == mark_id)
        if len(at) != len(chunks) - 1:
            return [np.array(tok_text(c), "<u2").tobytes() for c in chunks]
        raw, ends = ids.tobytes(), (2 * at).tolist()
        return [raw[a:b] for a, b in zip([0, *(e + 2 for e in ends)], [*ends, len(raw)], strict=True)]

    width = np.zeros(tok.get_vocab_size(), np.int64)  # bytes of each id of a byte-level vocabulary
    for s, i in tok.get_vocab().items():
        width[i] = len(s) - (4 if not spaced and s.endswith("</w>") else 0)

    def plain(chunk: str) -> bool:
        return (chunk[0] == " " if spaced else not _BOUND.search(chunk) and chunk == chunk.lower()) and "<|" not in chunk

    def following(chunks: list[str]) -> list[bytes]:
        """Plain chunks may follow one another (with a space, if they have none); their ids end where their bytes do."""
        every = " ".join(chunks)
        if not spaced and "<|" not in every and not _BOUND.search(every) and every == every.lower():
            follow, rest = chunks, []
        else:
            fit = [plain(c) for c in chunks]
            follow, rest = [c for c, f in zip(chunks, fit, strict=True) if f], [c for c, f in zip(chunks, fit, strict=True) if not f]
        got = dict.fromkeys(chunks, b"")
        if follow:
            ids = np.array(tok_text(("" if spaced else " ").join(follow)), "<u2")
            ends = np.cumsum([len(c.encode()) for c in follow])
            upto = np.cumsum(width[ids])
            at = np.searchsorted(upto, ends)
            if at[-1] != len(ids) - 1 or (upto[at] != ends).any():  # never seen
                follow, rest = [], chunks
            else:
                raw, at = ids.tobytes(), (2 * at + 2).tolist()
                got.update(zip(follow, [raw[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)], strict=True))
        if rest:
            got.update(zip(rest, words(rest), strict=True))
        return list(got.values())

    return ChunkEncoder(following, tok_text, spaced)


def _ranges(codes: list[int]) -> str:
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[i]:08x}" + (f"-\\U{codes[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=1)
def splitter() -> re.Pattern:
    """The pattern that splits text before merging, with Unicode classes spelt out."""
    kinds: dict[str, list[int]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        if (k := unicodedata.category(chr(c))[0]) in kinds:
            kinds[k].append(c)
    letter, number = _ranges(kinds["L"]), _ranges(kinds["N"])
    white = r"\t-\r \x85\xa0  -     　"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class MergeQueue:
    """Byte-level BPE by a priority queue of merges over a doubly linked symbol list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.special = spec["model"], {a["content"]: a["id"] for a in spec["added_tokens"]}
        vocab, symbols = model["vocab"], byte_symbols()
        back = {s: b for b, s in symbols.items()}
        self.of_byte = [vocab[symbols[b]] for b in range(256)]
        self.merge: dict[int, int] = {}  # left << 16 | right -> rank << 16 | id
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault(vocab[left] << 16 | vocab[right], rank << 16 | vocab[left + right])
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, list[int]] = {}

    def word(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        of, merge = self.of_byte, self.merge
        sym = [of[b] for b in raw]
        n = len(sym)
        if n == 1:
            return sym
        # an entry is rank, place and the pair it was made for, in one number
        heap = [(m >> 16 << 32 | i, k) for i in range(n - 1) if (m := merge.get(k := sym[i] << 16 | sym[i + 1]))is not None]
        if not heap:
            return sym
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, get = heapq.heappop, heapq.heappush, merge.get
        while heap:
            e, k = pop(heap)
            i = e & 0xFFFFFFFF
            j = after[i]
            if j >= n or sym[i] << 16 | sym[j] != k or sym[i] < 0:
                continue  # stale: one of its symbols was merged since
            new = sym[i] = merge[k] & 0xFFFF
            sym[j] = -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (m := get(k := new << 16 | sym[j])) is not None:
                    push(heap, (m >> 16 << 32 | i, k))
            if (p := before[i]) >= 0 and (m := get(k := sym[p] << 16 | new)) is not None:
                push(heap, (m >> 16 << 32 | p, k))
        return [s for s in sym if s >= 0]

    def text(self, text: str) -> list[int]:
        """The ids of a text or of a chunk of it."""
        out: list[int] = []
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if (i := self.special.get(part)) is not None:
                out.append(i)
                continue
            for w in splitter().findall(part):
                ids = self.known.get(w)
                if ids is None:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    ids = self.known[w] = self.word(w.encode())
                out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8; bytes that are no text become U+FFFD, as in the library."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


@lru_cache(maxsize=2)
def queue_encoder(path: str) -> tuple[MergeQueue, ChunkEncoder]:
    """Our own encoder and its cache of chunks, one for each worker process."""
    q = MergeQueue(path)
    return q, ChunkEncoder(lambda words: [np.array(q.text(w), "<u2").tobytes() for w in words], q.text, spaced=True)
