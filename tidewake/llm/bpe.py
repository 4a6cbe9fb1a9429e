"""Byte-level BPE encoding and decoding in padded numpy matrices.

A text is cut into chunks at single spaces and the chunks into words by the vocabulary's pattern; a Python worker keeps
the ids of the words and chunks it has seen, so the matrices hold only words that are new. Words of like length share a
matrix padded to the length of their bucket; in each round every row merges its leftmost pair of least rank, found by a
hashed table of pairs, and closes the gap; rows without a pair leave the matrix. Words longer than LONGEST_ROW bytes go
through a heap instead, which gives the same merges, so no word is cut or skipped.

Nulls count as empty texts, which have no ids. Rows may repeat; extra columns are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tidewake.llm.common import gather, in_worker, offsets, passes, texts_of

#: Bytes of the widest padded row.
LONGEST_ROW = 256
#: Chunks whose ids a Python worker keeps; of words it keeps a quarter as many.
WORDS_KEPT = 400_000
#: Letters below this place, and marks that are no letters, digits or spaces: such chunks need no pattern.
LATIN_END, MARKS = "\u0250", (".", ",", ";", ":", "!", "?")
NO_PAIR = np.int32(2**31 - 1)
#: A space with white space after it: only there can a run of white space reach over a cut.
_RUN = re.compile(r" \s")


class PairTable:
    """Open-addressed hash table in numpy from (left id, right id) to the rank of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_PAIR, np.int32)
        todo = (left.astype(np.int64) << 32) | right.astype(np.int64)
        ranks, slot = rank.astype(np.int32), None
        slot = self._home(todo)
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = todo[free]  # of those that meet in a slot, one stays
            placed = self.keys[slot] == todo
            self.ranks[slot[placed]] = ranks[placed]
            todo, ranks, slot = todo[~placed], ranks[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NO_PAIR where there is none; negative ids are padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        shape, keys = keys.shape, keys.ravel()
        out = np.full(len(keys), NO_PAIR, np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._home(keys[at])
        while len(at):
            held = self.keys[slot]
            hit = held == keys[at]
            out[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (held != -1)
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class ByteBpe:
    """A vocabulary of byte strings with ranks, which are also the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank
        flat = np.array([(a, b, r) for (a, b), r in self.pairs.items()], np.int64).reshape(-1, 3)
        self.table = PairTable(flat[:, 0], flat[:, 1], flat[:, 2])
        top = max(ranks.values()) + 1
        names = [b""] * top
        for token, rank in ranks.items():
            names[rank] = token
        self.bytes_of = _strings(names)
        self.decimal_of = _strings([b"%d " % i for i in range(top)])
        self.chunker = Chunker(pattern, self.encode_words)

    @classmethod
    def read(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit numbers."""
        raw = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(w) > LONGEST_ROW:
                out[i] = np.array(self._by_heap(w), "<u4").tobytes()
            elif w:
                buckets.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, members in buckets.items():
            step = max(1, 2_000_000 // width)
            for k in range(0, len(members), step):
                some = members[k : k + step]
                for i, ids in zip(some, self._by_rows([raw[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _by_rows(self, words: list[bytes], width: int) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self.single[flat], np.int32(-1))
        rank = np.full(ids.shape, NO_PAIR, np.int32)  # of the pair that starts at each column
        rank[:, :-1] = self.table.find(ids[:, :-1], ids[:, 1:])
        done: list[bytes] = [b""] * len(words)
        row = np.arange(len(words))
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            ended = best == NO_PAIR
            if ended.any():
                for i, r in zip(row[ended], ids[ended], strict=True):
                    done[i] = r[r >= 0].tobytes()
                row, ids, rank, at, best = row[~ended], ids[~ended], rank[~ended], at[~ended], best[~ended]
                if not len(row):
                    break
            here, width = np.arange(len(row)), ids.shape[1]
            ids[here, at] = best
            take = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            if width == 2:
                rank[:] = NO_PAIR
                continue
            for first in (at - 1, at):
                ok = np.flatnonzero((first >= 0) & (first < width - 2))
                rank[ok, first[ok]] = self.table.find(ids[ok, first[ok]], ids[ok, first[ok] + 1])
            last = at == width - 2
            rank[last, width - 2] = NO_PAIR
        return done

    def _by_heap(self, word: bytes) -> list[int]:
        """The same merges for one long word, in n log n steps."""
        ids = [int(self.single[b]) for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < len(ids) and (r := self.pairs.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more entry for the end)."""
        each = self.chunker.encode(texts)
        return np.frombuffer(b"".join(each), "<u4"), offsets(len(x) // 4 for x in each)

    def decode(self, ids: np.ndarray) -> bytes:
        return _spell(self.bytes_of, ids)

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each with a space after it."""
        return _spell(self.decimal_of, ids)


def _strings(names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = offsets(map(len, names))
    return np.frombuffer(b"".join(names), np.uint8), ends[:-1], np.diff(ends)


def _spell(strings: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    flat, starts, lengths = strings
    return gather(flat, starts[ids], lengths[ids]).tobytes()


def _latin(chunk: str) -> bool:
    return chunk.isalpha() and (chunk.isascii() or max(chunk) < LATIN_END)


class Kept:
    """Ids of what was seen before, ``most`` entries or what one call needs: when the newer half is full, it takes the place
    of the older, of which only what is asked for again is kept."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def age(self) -> None:
        if len(self.new) > self.most // 2:
            self.new, self.old = {}, self.new

    def without(self, keys: Iterable[str]) -> list[str]:
        """The keys that are not kept; those that are kept are among the newer ones afterwards."""
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                if (ids := old.get(k)) is None:
                    out.append(k)
                else:
                    new[k] = ids
        return out


class Chunker:
    """Cuts texts at single spaces and by the pattern, and keeps the ids of chunks and words seen before.

    A space opens a new match of the pattern unless it stands in a longer run of white space, so the chunks between
    single spaces encode alone as they do in their text. Texts with a longer run after a space are matched whole. A chunk
    of Latin letters is one word, and one with a mark behind it two, for any pattern that keeps runs of letters together.
    Each distinct chunk of a call is looked up once; the texts' ids are gathered from those.
    """

    def __init__(self, pattern: str, encode_words: Callable[[list[str]], list[bytes]]):
        self.find, self.encode_words = regex.compile(pattern).findall, encode_words
        self.words = Kept(WORDS_KEPT // 4)
        self.chunks = Kept(WORDS_KEPT)  # without the space before them, which their ids have

    def _learn(self, chunks: list[str], others: set[str]) -> None:
        """Ids of new chunks, and of the words of texts and first chunks that are matched whole."""
        plain, words, split = [], {*others, *MARKS}, []
        for c in chunks:
            if _latin(c):
                plain.append(c)
                continue
            if c[-1:] in MARKS and _latin(c[:-1]):
                first, rest = c[:-1], [c[-1]]
            else:
                ws = self.find(" " + c)
                first, rest = (ws[0][1:], ws[1:]) if ws and ws[0][:1] == " " and _latin(ws[0][1:]) else (None, ws)
            split.append((c, first, rest))
            words.update(rest)
        firsts = {first for _, first, _ in split if first is not None}
        plain += self.chunks.without(firsts.difference(plain))
        todo = self.words.without(words)
        ids = self.encode_words([*todo, *[" " + c for c in plain]])
        word, chunk = self.words.new, self.chunks.new
        word.update(zip(todo, ids, strict=False))
        chunk.update(zip(plain, ids[len(todo) :], strict=True))
        for c, first, rest in split:
            ids = b"".join([word[w] for w in rest])
            chunk[c] = ids if first is None else chunk[first] + ids

    def encode(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # nothing here points in a circle, and the collector would walk the kept words again and again
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        self.words.age()
        self.chunks.age()
        heads: list[list[str]] = []  # what is matched
        tails: list[str | None] = []  # what is cut at its spaces
        for t in texts:
            first, space, rest = (t, "", "") if _RUN.search(t) else t.partition(" ")
            heads.append(self.find(first))
            tails.append(rest if space else None)
        cut = pc.split_pattern(pa.array(tails, pa.string()), " ")
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(self.chunks.without(chunks), {w for ws in heads for w in ws})
        word, ids = self.words.new, list(map(self.chunks.new.__getitem__, chunks))
        at, code = offsets(map(len, ids)) // 4, coded.indices.to_numpy()
        lengths = np.diff(at)[code]
        data = gather(np.frombuffer(b"".join(ids), "<u4"), at[code], lengths).tobytes()
        ends = 4 * np.append(0, np.cumsum(lengths))[offsets(pc.fill_null(cut.value_lengths(), 0).to_numpy())]
        return [b"".join([word[w] for w in ws]) + data[i:j] for ws, i, j in zip(heads, ends.tolist(), ends[1:].tolist(), strict=False)]


def vocabulary(path: str, pattern: str) -> ByteBpe:
    """The vocabulary at path, read once in each Python worker."""
    return in_worker(("bpe", path, pattern), lambda: ByteBpe.read(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text; an empty or null text has an empty array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path, pattern)
        for b in batches:
            for part in passes(texts := b["text"].tolist()):
                ids, at = bpe.encode(texts[part])
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[part], "ids": np.split(ids.astype(np.int32), at[1:-1])})

    return texts_of(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data (binary), the bytes that the ids stand for; null ids count as none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path, pattern)
        for b in batches:
            data = [b"" if x is None else bpe.decode(np.asarray(x, np.int64)) for x in b["ids"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "data": data})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes every text and decodes its ids, and keeps the digests of both instead of the ids and bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path, pattern)
        for b in batches:
            for part in passes(texts := b["text"].tolist()):
                ids, at = bpe.encode(texts[part])
                back, written = bpe.decode(ids), bpe.decimals(ids)
                byte_at = offsets(bpe.bytes_of[2][ids])[at]
                text_at = offsets(bpe.decimal_of[2][ids])[at]
                yield pd.DataFrame(
                    {
                        "doc_id": b["doc_id"].iloc[part],
                        "n_tokens": np.diff(at),
                        "ids_sha256": [hashlib.sha256(written[i : max(i, j - 1)]).hexdigest() for i, j in zip(text_at[:-1], text_at[1:], strict=True)],
                        "decoded_sha256": [hashlib.sha256(back[i:j]).hexdigest() for i, j in zip(byte_at[:-1], byte_at[1:], strict=True)],
                    }
                )

    return texts_of(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
