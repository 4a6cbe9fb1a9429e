"""Near duplicates by HyperMinHash, confirmed on full shingle sets.

A document's set: the distinct runs of ``size`` words (A-Z lower-cased, cut at ASCII white space); with fewer words the
whole sequence is the one shingle; without words the set is empty. Texts with equal sets are one class, named by its least
doc_id. Each class keeps REGISTERS registers of 16 bits: the least value of a hash permutation, stored as its count of
leading zeros and the mantissa bits behind them. Runs of BAND_ROWS registers make the keys of the buckets; at a Jaccard
likeness of 0.8 a pair has no bucket in common with a chance of 4e-7.

Candidates, in two steps that never list the pairs of a bucket that its links already join:

1. Each member of a bucket meets the bucket's leader, the member with the largest buckets in all (a text that its copies
   were made from shares more buckets with them than they do with each other).
2. Links found so far make components. In buckets that still hold several, each member outside the largest meets the
   others in blocks of bounded size, inside tasks: by registers, and where these leave doubt by full sets. Only links
   leave a task, one for each two components that it joins.

Either way a pair is compared in full only if its estimate, corrected for equal registers by chance, leaves the threshold within six
standard errors, and becomes a link only by the sizes of the full sets' intersection and union. Members are dealt to a
leader's copies in salted groups, so no task gathers a large group, and texts are read again only for candidates.

Null or empty texts, and texts of white space, are linked with nothing. Repeated rows (equal doc_id) are one document.
Rows without doc_id count with their class and are never kept if the class has another row. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import in_worker, offsets, passes, texts_of, written

REGISTERS, BAND_ROWS, MANTISSA = 112, 4, 10
#: Members that one copy of a leader's set meets; members of a block in the second step.
SALT_ROWS, BLOCK_ROWS = 4_096, 512
#: Documents named as candidates up to which their ids (8 bytes each) are broadcast; beyond, they are joined by shuffle.
IDS_BROADCAST = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.random.default_rng(20240607).integers(0, 2**63, (2, REGISTERS), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a Python worker keeps.
WORDS_KEPT = 250_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = value
        return value


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    words = [t.encode().translate(_LOWER).split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    at = offsets(n)
    hash_of = in_worker("neardup", _Hashes)
    flat = np.fromiter((hash_of[w] for ws in words for w in ws), np.uint64, int(at[-1]))
    whole = len(flat)
    mixed = flat * _MIX
    for k in range(1, min(size, whole)):
        mixed[: whole - k] = ((mixed[: whole - k] ^ (mixed[: whole - k] >> np.uint64(31))) * _MIX) + flat[k:]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    out = []
    for i, count in enumerate(n.tolist()):
        a = at[i]
        if count >= size:
            out.append(np.unique(mixed[a : a + count - size + 1]))
        elif count:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words[i]))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit registers for each set; empty sets have zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    start = 0
    while start < len(full):
        stop, held = start, 0
        while stop < len(full) and (stop == start or held + len(sets[full[stop]]) <= 60_000):
            held += len(sets[full[stop]])
            stop += 1
        some = full[start:stop]
        flat, starts = np.concatenate([sets[i] for i in some]), offsets(len(sets[i]) for i in some)[:-1]
        least = np.empty((REGISTERS, len(some)), np.uint64)
        for j in range(REGISTERS):
            least[j] = np.minimum.reduceat((flat ^ _ODD[0, j]) * _ODD[1, j], starts)
        part, power = np.frexp((least >> np.uint64(11)).astype(np.float64))
        mantissa = np.where(part > 0, (part * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
        out[some] = (((53 - power).astype(np.uint16) << MANTISSA) | mantissa).T
        start = stop
    return out


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard likeness from counts of equal registers, less those that are equal by chance (0.72 of a step of the mantissa
    times nm / (n + m)^2, the chance that two independent least values share a register)."""
    chance = 0.72 / (1 << MANTISSA) * n * m / (n + m) ** 2
    return np.clip((equal / REGISTERS - chance) / (1 - chance), 0, 1)


def may_reach(equal: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether a likeness of the percentage stands within six standard errors of the estimate, and the sizes allow it."""
    j = percent / 100
    slack = 6 * (j * (1 - j) / REGISTERS) ** 0.5
    return (estimate(equal, n, m) >= j - slack) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes that name the set; null: empty) and signature (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in passes(texts := b["text"].tolist(), 500_000):
                sets = shingle_sets(texts[part], size)
                rows = registers(sets)
                yield pd.DataFrame(
                    {
                        "doc_id": b["doc_id"].iloc[part], "n_shingles": [len(s) for s in sets],
                        "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                        "signature": [r.tobytes() for r in rows],
                    }
                )

    return texts_of(docs).mapInPandas(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def _bucket_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bands = REGISTERS // BAND_ROWS
    for b in batches:
        if not len(b):
            continue
        rows = np.frombuffer(b"".join(b["signature"]), np.uint16).reshape(len(b), REGISTERS)
        keys = rows.reshape(len(b), bands, BAND_ROWS).copy().view(np.uint64)[:, :, 0]
        keys = (keys ^ (np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(58))) * _MIX
        keys = (keys ^ (keys >> np.uint64(29)) ^ np.arange(bands, dtype=np.uint64)) * _MIX
        yield pd.DataFrame({"key": keys.view(np.int64).ravel(), "node": np.repeat(b["node"].to_numpy(), bands)})


def buckets(classes: DataFrame) -> DataFrame:
    """key, node and members for the buckets with two members or more."""
    each = classes.select("node", "signature").mapInPandas(_bucket_keys, "key long, node long")
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return each.join(counts, "key")


def _rows_of(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def plausible(edges: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the edges (a, b), those whose estimate may reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                equal = (_rows_of(x["sa"]) == _rows_of(x["sb"])).sum(1)
                yield x.loc[may_reach(equal, x["na"].to_numpy(), x["nb"].to_numpy(), percent), ["a", "b"]]

    a = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    b = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    near = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return edges.join(a, "a").join(b, "b").where(near).mapInPandas(run, "a long, b long")


def sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node and its full set (sorted 64-bit hashes, binary) of the documents named in ids (doc_id, distinct)."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for part in passes(texts := x["text"].tolist(), 500_000):
                yield pd.DataFrame({"node": x["doc_id"].iloc[part], "shingles": [s.tobytes() for s in shingle_sets(texts[part], size)]})

    nodes = written(ids, "neardup-nodes")
    few = nodes.limit(IDS_BROADCAST + 1).count() <= IDS_BROADCAST
    named = texts_of(docs).join(F.broadcast(nodes) if few else nodes, "doc_id")
    return written(named.mapInPandas(sets, "node long, shingles binary").dropDuplicates(["node"]), "neardup-sets")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets, a not empty."""
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())


def confirmed(edges: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the edges (a, b), the links: 100 * intersection >= percent * union of the full sets."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own = None, np.zeros(0, np.uint64)
        for x in batches:
            links = []
            for a, salt, member, data in zip(x["a"].tolist(), x["salt"].tolist(), x["b"].tolist(), x["shingles"], strict=True):
                held = np.frombuffer(data, np.uint64)
                if (a, salt) != key:  # the leader's row comes first
                    key, own = (a, salt), held
                    continue
                both = shared(own, held)
                if 100 * both >= percent * (len(own) + len(held) - both):
                    links.append((a, member))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    held = sets_of(edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, size)
    salts = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    leaders = held.join(salts, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"), "shingles")
    of_edge = edges.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = held.join(of_edge, F.col("node") == F.col("b")).select("a", "salt", F.lit(1).alias("kind"), "b", "shingles")
    met = leaders.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return met.select("a", "salt", "b", "shingles").mapInPandas(meet, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node that links reach) of all nodes of links (a, b): least labels of neighbours, then of
    the label's own label, until none changes; each round is a written table."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "neardup-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "neardup-labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("told"))
        new = labels.join(told, "node").select("node", F.least("label", "told").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = written(new.join(jump, "new").select("node", F.least("new", "far").alias("label"), "old"), "neardup-labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def _dealt(rest: DataFrame) -> DataFrame:
    """Buckets of several components (rest: key, node, label), dealt out so that each member outside a bucket's largest
    component (side 0) meets each member (side 1) in one group of two blocks: key, one, two."""
    of = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    of = of.groupBy("key").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("major"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    rows = rest.join(of.select("key", "major", F.ceil((F.col("all") - F.col("most")) / BLOCK_ROWS).cast("int").alias("ones"), F.ceil(F.col("all") / BLOCK_ROWS).cast("int").alias("twos")), "key")
    at = F.xxhash64("node")
    minor = rows.where("label <> major").select("key", F.pmod(at, F.col("ones")).cast("int").alias("one"), F.explode(F.sequence(F.lit(0), F.col("twos") - 1)).alias("two"), F.lit(0).alias("side"), "node", "label")
    every = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("ones") - 1)).alias("one"), F.pmod(at, F.col("twos")).cast("int").alias("two"), F.lit(1).alias("side"), "node", "label")
    return minor.unionByName(every)


def _likely(x: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of side 0 and, for each, the rows of side 1 of other components that may be linked to it by registers and size."""
    n, label, side, rows = x["n_shingles"].to_numpy(), x["label"].to_numpy(), x["side"].to_numpy(), _rows_of(x["signature"])
    second = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        other = second[(label[second] != label[i]) & (100 * np.minimum(n[i], n[second]) >= percent * np.maximum(n[i], n[second]))]
        if len(other):
            other = other[may_reach((rows[other] == rows[i]).sum(1), n[i], n[other], percent)]
            if len(other):
                yield i, other


def across(rest: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different components within buckets (rest: key, node, label). First the members that registers leave in
    doubt are named, then these meet with their full sets; a task stops comparing two components that it has joined."""

    def name(x: pd.DataFrame) -> pd.DataFrame:
        found: set[int] = set()
        for i, other in _likely(x, percent):
            found.update((i, *other.tolist()))
        return x.iloc[sorted(found)][["key", "node"]].drop_duplicates()

    def join(x: pd.DataFrame) -> pd.DataFrame:
        root = {v: v for v in x["label"].tolist()}

        def top(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        node, label, out = x["node"].to_numpy(), x["label"].tolist(), []
        sets = [np.frombuffer(s, np.uint64) for s in x["shingles"]]
        for i, other in _likely(x, percent):
            for k in other.tolist():
                a, b = top(label[i]), top(label[k])
                if a != b:
                    both = shared(sets[i], sets[k])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[k]) - both):
                        root[max(a, b)] = min(a, b)
                        out.append((min(node[i], node[k]), max(node[i], node[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    sketch = classes.select("node", "n_shingles", "signature")
    doubt = _dealt(rest).join(sketch, "node").groupBy("key", "one", "two").applyInPandas(name, "key long, node long").distinct()
    doubt = written(rest.join(doubt, ["key", "node"], "left_semi"), "neardup-doubt")
    held = sets_of(doubt.select(F.col("node").alias("doc_id")).distinct(), docs, size)
    met = _dealt(doubt).join(sketch, "node").join(held, "node")
    return met.groupBy("key", "one", "two").applyInPandas(join, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept (doc_id = component_id)."""
    known = written(sketches(docs, size), "neardup-sketches")
    of_set = known.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = written(of_set.where("node is not null"), "neardup-classes")
    held = written(buckets(classes), "neardup-buckets")
    weight = held.groupBy("node").agg(F.sum("members").alias("weight"))
    leader = held.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("leader"))
    led = held.join(leader, "key").where("node <> leader")
    stars = written(plausible(led.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), classes, percent), "neardup-stars")
    links = written(confirmed(stars, docs, size, percent), "neardup-links")
    labels = components(links)
    # Members besides the leader, which all have met; buckets where these are of different components go on.
    rest = written(led.where("members > 2").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "neardup-rest")
    more = written(across(rest, docs, classes, size, percent), "neardup-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    least = classes.join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("component"))
    component = F.coalesce("component", "doc_id")
    return known.join(least, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("component").isNull()).alias("kept"))


def without_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component; rows without doc_id stay."""
    gone = written(near_duplicates(docs, size, percent).where("not kept and doc_id is not null").select("doc_id").distinct(), "neardup-gone")
    few = gone.limit(IDS_BROADCAST + 1).count() <= IDS_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
