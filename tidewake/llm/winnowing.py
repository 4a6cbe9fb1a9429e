"""Document fingerprints by winnowing.

Every run of K code points of a text is hashed (a rolling polynomial hash, mixed to 32 bits); of every window of W
consecutive hashes the least is chosen, the rightmost on ties, and a hash chosen again by the next window counts once.
Each choice keeps its position, so any passage of K + W - 1 code points that two texts share has a choice in common, at
places that tell where it stands. Texts shorter than K are hashed as one gram; texts with fewer than W grams have one
window. An empty (or null) text has no choice; two empty fingerprints are alike (1.0), an empty and another are not (0.0).

Whole texts only: one pass of numpy over a batch of texts, bounded in characters. Rows may repeat, extra columns are not
read; null doc_ids come first in the order of documents and equal doc_ids are ordered by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import offsets, passes, texts_of

GRAM, WINDOW = 12, 24
#: Of one numpy pass: arrays of this many characters stay in a core's cache.
PASS_CHARS, PASS_ROWS = 150_000, 1_000
BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and positions chosen in all texts, one after the other, and where each text's choices begin."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    at = offsets(map(len, texts))
    n = np.diff(at)
    short = np.flatnonzero((n > 0) & (n < gram))
    total = len(points)
    if not total:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    # Hash of the run of `gram` points from each place, from runs of powers of two.
    run, have, power = points * _MIX >> np.uint64(20), 1, BASE
    gathered, done, left = None, 0, gram
    while left:
        if left & 1:
            if gathered is None:
                gathered = run.copy()
            else:
                ahead = np.zeros_like(run)
                ahead[: max(0, total - done)] = run[done:]
                gathered = gathered * power_of(have) + ahead
            done += have
        left >>= 1
        if left:
            ahead = np.zeros_like(run)
            ahead[: max(0, total - have)] = run[have:]
            run = run * power_of(have) + ahead
            have *= 2
    hashes = gathered * _MIX
    hashes ^= hashes >> np.uint64(29)
    hashes = (hashes * _MIX) >> np.uint64(32)
    for i in short:  # the whole text is the gram
        whole = 0
        for c in points[at[i] : at[i + 1]].tolist():
            whole = (whole * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        hashes[at[i]] = (whole * int(_MIX) & 0xFFFFFFFFFFFFFFFF) >> 32
    # Least key of each window: the hash, then the later place. Windows of powers of two make the window.
    grams = np.where(n == 0, 0, np.maximum(1, n - gram + 1))
    place = np.arange(total, dtype=np.uint64)
    key = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - place)
    edge = np.ones(total, bool)
    edge[np.repeat(at[:-1], n) + np.repeat(grams, n) > place.astype(np.int64)] = False
    key[edge] = np.uint64(0xFFFFFFFFFFFFFFFF)  # a run over the end of its text is no gram
    least, have = key, 1
    while have * 2 <= window:
        least, have = _least(least, have), have * 2
    if have < window:
        least = _least(least, window - have)
    windows = np.where(grams == 0, 0, np.maximum(1, grams - window + 1))
    first = np.repeat(at[:-1] - offsets(windows)[:-1], windows) + np.arange(windows.sum())
    chosen = least[first]
    few = np.flatnonzero((grams > 0) & (grams < window))  # one window, which ends with the text
    if len(few):
        bounds = np.stack([at[few], at[few] + grams[few]], 1).ravel()
        chosen[offsets(windows)[few]] = np.minimum.reduceat(np.append(key, key[-1:]), bounds)[::2]
    owner = np.repeat(np.arange(len(texts)), windows)
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    chosen, owner = chosen[fresh], owner[fresh]
    where = (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return (chosen >> np.uint64(32)).astype(np.uint32), where - at[owner], offsets(np.bincount(owner, minlength=len(texts)))


def power_of(exponent: int) -> np.uint64:
    return np.uint64(pow(int(BASE), exponent, 1 << 64))


def _least(keys: np.ndarray, ahead: int) -> np.ndarray:
    out = keys.copy()
    if ahead < len(keys):
        np.minimum(keys[:-ahead], keys[ahead:], out=out[:-ahead])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct hashes of two fingerprints."""
    a, b = np.unique(a), np.unique(b)
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def as_text(hashes: np.ndarray, places: np.ndarray) -> str:
    """Ten hexadecimal digits a choice: steps from the choice before it (modulo 256; never more than a window), then the hash."""
    rows = np.zeros((len(hashes), 5), np.uint8)
    rows[:, 0] = np.diff(places, prepend=0) & 255
    rows[:, 1:] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    return rows.tobytes().hex()


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, hashes (array<long>) and positions (array<int>, code points from 0) of every text's choices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in passes(texts := b["text"].tolist(), PASS_CHARS):
                some = texts[part]
                hashes, places, at = winnow(some, gram, window)
                yield pd.DataFrame(
                    {
                        "doc_id": b["doc_id"].iloc[part],
                        "n_chars": [len(t) for t in some],
                        "hashes": np.split(hashes.astype(np.int64), at[1:-1]),
                        "positions": np.split(places.astype(np.int32), at[1:-1]),
                    }
                )

    return texts_of(docs).mapInPandas(run, "doc_id long, n_chars long, hashes array<long>, positions array<int>")


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) of code points replaced by as many of the following text's first (or all)."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, span, extra: dealt out so that each document stands just before its next by doc_id in one span.

    Spans are runs of ascending doc_id (four for each shuffle partition, cut at quantiles), each sorted in one task. The
    first row of each span also ends the span before (extra = 1), and the first of all ends the last.
    """
    spark = docs.sparkSession
    spans = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts_of(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    share = F.array(*[F.lit(i / spans) for i in range(1, spans)])
    cuts = sorted(set(rows.agg(F.percentile_approx("key", share, F.lit(20 * spans)).alias("c")).first()["c"] or []))
    span = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    rows = rows.withColumn("span", span)
    firsts = sorted((r["span"], r["key"]) for r in rows.groupBy("span").agg(F.min("key").alias("key")).collect())  # a row a span
    if not firsts:
        return rows.select("doc_id", "text", "span", F.lit(0).alias("extra"))
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}
    ends = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    both = F.array_compact(F.array(F.col("span"), F.element_at(ends, F.col("key"))))
    out = rows.select("doc_id", "text", "key", F.posexplode(both).alias("extra", "span"))
    return out.repartition(spans, "span").sortWithinPartitions("span", "extra", "key", "text").select("doc_id", "text", "span", "extra")


def neighbour_likeness(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are to each other and to the next document's.

    The document after the last is the first; a document alone is its own next.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for b in batches:
            rows = held + list(zip(b["doc_id"].tolist(), b["text"].tolist(), b["extra"].tolist(), strict=True))
            while len(rows) > 1:
                part = next(passes([r[1] for r in rows[:PASS_ROWS]], PASS_CHARS))
                upto = min(max(part.stop, 2), len(rows))
                yield _pairs(rows[:upto], gram, window)
                rows = rows[upto - 1 :]
            held = rows

    return neighbours(docs).select("doc_id", "text", "extra").mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _pairs(rows: list[tuple], gram: int, window: int) -> pd.DataFrame:
    """The results of all rows but the last and the extra ones; the row after each is its next."""
    texts = [t for _, t, _ in rows]
    own = [i for i in range(len(rows) - 1) if not rows[i][2]]
    changed = [edited(texts[i], texts[i + 1]) for i in own]
    out = []
    h, p, at = winnow(texts, gram, window)
    eh, ep, eat = winnow(changed, gram, window)
    for k, i in enumerate(own):
        a, b = slice(at[i], at[i + 1]), slice(eat[k], eat[k + 1])
        after = slice(at[i + 1], at[i + 2])
        out.append(
            (
                rows[i][0], len(texts[i]), hashlib.sha256(changed[k].encode()).hexdigest(), as_text(h[a], p[a]), as_text(eh[b], ep[b]),
                likeness(h[a], eh[b]), likeness(h[a], h[after]),
            )
        )
    return pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
