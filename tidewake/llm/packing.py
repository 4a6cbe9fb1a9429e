"""Concatenate and cut: all documents' tokens as one stream, cut into windows of fixed length.

First pass: each partition encodes its documents and numbers their tokens from its own start; the result is a table in the
shared folder. The partitions' totals, summed up before each, turn those numbers into places in the whole stream. Second
pass: each document is cut where a window ends, into one boundary record for each window it reaches into. Only totals,
one row for each partition, are ever summed across partitions; no document leaves its partition.

A null or empty text is its end mark alone. Rows may repeat: each is packed. Null doc_ids stay null. Extra columns are not
read. An empty table gives no records. Order within the stream is that of the input's partitions and rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.bpe import Chunker
from tidewake.llm.common import in_worker, offsets, passes, texts_of, written

END_ID = 1
#: Partitions up to which their totals (two longs each, 32 MB at most) are broadcast; beyond, they are joined by shuffle.
TOTALS_BROADCAST = 1_000_000
#: Partitions whose totals one window sums.
TOTALS_PER_BLOCK = 1_000

#: New words that one line given to the tokenizer holds.
WORDS_A_CALL = 64
#: A byte that no UTF-8 has, between words.
BETWEEN = b"\xff"


def _spelling() -> np.ndarray:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one; a space for BETWEEN."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = np.zeros(256, "<u4")
    table[shown] = shown
    hidden = np.flatnonzero(table == 0)
    table[hidden] = 256 + np.arange(len(hidden))
    table[BETWEEN[0]] = ord(" ")
    return table


class Encoder:
    """A byte-level tokenizer file's ids of texts. Tokens that the file adds to its vocabulary (such as an end mark spelt out) are found
    in a text first, as the library does; what stands between them goes through the chunker."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        own = Tokenizer.from_file(path)
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in own.get_added_tokens_decoder().items()}
        names = sorted(self.added, key=len, reverse=True)
        self.find_added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        # A token of this vocabulary is spelt with one character for each of its bytes, none of them white space.
        self.spelt = np.zeros(own.get_vocab_size(), np.int64)
        for token, i in own.get_vocab().items():
            self.spelt[i] = len(token)
        self.model = Tokenizer(own.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.spelling = _spelling()
        self.chunker = Chunker(pattern, self._encode_words)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The words in the vocabulary's spelling, with spaces between, many in one call; ids' spellings say whose they are."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        at = offsets(len(w) + 1 for w in raw)
        spelt = self.spelling[np.frombuffer(BETWEEN.join(raw), np.uint8)].tobytes().decode("utf-32-le")
        cuts = at[:-1:WORDS_A_CALL].tolist()
        lines = [spelt[i : j - 1] for i, j in zip(cuts, [*cuts[1:], int(at[-1])], strict=True)]
        ids = np.array([x for e in self.model.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids], "<u4")
        ends = np.searchsorted(np.cumsum(self.spelt[ids]), np.cumsum(np.diff(at) - 1), "left") + 1
        data, stops = ids.tobytes(), (4 * ends).tolist()
        return [data[i:j] for i, j in zip([0, *stops], stops, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not any(name in t for name in self.added for t in texts):
            return self.chunker.encode(texts)
        cut = [self.find_added.split(t) for t in texts]  # what stands between added tokens, and every second part such a token
        plain = iter(self.chunker.encode([p for parts in cut for p in parts[::2]]))
        return [b"".join(self.added[p] if k % 2 else next(plain) for k, p in enumerate(parts)) for parts in cut]


def _encoder(path: str, pattern: str) -> Encoder:
    """The tokenizer file at path, read once in each Python worker."""
    return in_worker(("packing", path, pattern), lambda: Encoder(path, pattern))


def encode_partitions(docs: DataFrame, path: str, pattern: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part (partition), before (tokens before it in its partition), doc_tokens, ids (32-bit little-endian)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, part, before = _encoder(path, pattern), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for some in passes(texts := b["text"].tolist()):
                ids = [x + end for x in own.encode(texts[some])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[some], "part": part, "before": before + np.cumsum(n) - n, "doc_tokens": n, "ids": ids})
                before += int(n.sum())

    return texts_of(docs).mapInPandas(run, "doc_id long, part int, before long, doc_tokens long, ids binary")


def partition_starts(encoded: DataFrame) -> DataFrame:
    """part and first: the tokens in all partitions before it. Two levels of running sums, so no task sums more than a block."""
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("tokens")).withColumn("block", F.floor(F.col("part") / TOTALS_PER_BLOCK))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each thousand partitions
    blocks = totals.groupBy("block").agg(F.sum("tokens").alias("block_tokens"))
    block_first = blocks.select("block", F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("block_first"))
    within = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = totals.withColumn("within", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return inside.join(block_first, "block").select("part", (F.col("within") + F.col("block_first")).alias("first"))


def pack(docs: DataFrame, path: str, pattern: str, length: int = 2048, end_id: int = END_ID) -> DataFrame:
    """One boundary record for each document and window that share tokens.

    doc_id, start (tokens of the document before the piece), length, ids (the piece's, binary), ids_crc32, doc_tokens,
    sequence_id, offset (place in the window), continues (the document goes on in the next window).
    """
    encoded = written(encode_partitions(docs, path, pattern, end_id), "packing", "snappy")
    starts = partition_starts(encoded)
    if docs.rdd.getNumPartitions() <= TOTALS_BROADCAST:
        starts = F.broadcast(starts)
    placed = encoded.join(starts, "part").withColumn("at", F.col("first") + F.col("before"))
    n, last = F.lit(length), F.col("at") + F.col("doc_tokens") - 1

    def piece(window):
        start = F.greatest(window * n - F.col("at"), F.lit(0))
        stop = F.least((window + 1) * n - F.col("at"), F.col("doc_tokens"))
        ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int"))
        return F.struct(
            start.alias("start"), (stop - start).alias("length"), ids.alias("ids"), F.crc32(ids).alias("ids_crc32"),
            window.alias("sequence_id"), (F.col("at") + start - window * n).alias("offset"), (stop < F.col("doc_tokens")).alias("continues"),
        )

    windows = F.sequence(F.floor(F.col("at") / n), F.floor(last / n))
    pieces = placed.select("doc_id", "doc_tokens", F.inline(F.transform(windows, piece)))
    return pieces.select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continues")
