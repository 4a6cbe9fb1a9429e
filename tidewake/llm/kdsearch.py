"""Exact top-k by inner product with a KD-tree for each shard of the vectors.

Components are quantised to floor(scale * x), so scores are whole numbers and ties are real ties (the smaller vec_id
wins). A shard's tree is built by median splits along the widest side until a leaf is small; each node keeps the tight box
of its vectors. The most that any vector of a box can score with a query is the sum over components of the larger of
q*low and q*high. A query goes down the tree best first: of the nodes seen, the one with the largest bound is opened next,
until that bound is below the kth score. The kth score starts from a bounded pilot sample of all vectors, and is carried on
from leaf to leaf and from round to round: some shards are searched first, and what they find is where the others start.

Shards hold a bounded number of vectors and groups a bounded number of queries; a task holds one tree and one group. Each
query meets each shard once, which a search of all rows needs, and only the k best of a shard leave it.

Scores are exact at every size that fits in a long: products that floats cannot hold are summed as 64-bit integers, and
bounds are rounded up. Scores beyond a long are not defined. Vectors that are null or hold null or non-finite components
take no part, as queries or candidates; nor do empty ones. Vectors of another length than the query's are no candidates. Rows
with one vec_id and different vectors are candidates each, though not of their own id's query; a repeated row counts once. Of
such rows the shortest and then the least vector asks. A table with one vector gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import written

#: Vectors of a shard at most, about, and at least where the table fills the cores; vectors of a leaf; queries of a group.
SHARD_ROWS, LEAST_SHARD_ROWS, LEAF_ROWS, GROUP_ROWS = 65_536, 2_048, 256, 65_536
#: Vectors whose scores give the queries their first kth score. A bound only: every vector is searched after it.
PILOT_ROWS = 2_048
#: One in so many shards is searched in the first round.
SCOUTS = 8
#: The kth score of a query that has none yet.
NONE = -(2**63)


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, dim and v (array<long>) of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull() & ~odd)
    return held.select("vec_id", F.size("embedding").alias("dim"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def scores(rows: np.ndarray, query: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Inner products as 64-bit integers. rows: whole numbers as floats where these are exact, else as integers."""
    return (rows @ query.astype(float)).astype(np.int64) if exact_floats else (rows.astype(np.int64) * query).sum(1)


class Tree:
    """A KD-tree: rows in leaf order; for each node its box, its rows and its first child (0: a leaf; the other child is next)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.child, spans, todo = [0], [(0, len(ids))], [0]
        while todo:
            node = todo.pop()
            a, b = spans[node]
            if b - a <= leaf_rows:
                continue
            box = rows[order[a:b]]
            side = int(np.argmax(box.max(0).astype(float) - box.min(0)))
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(box[:, side], half)]
            self.child[node] = len(spans)
            todo += [len(spans), len(spans) + 1]
            spans += [(a, a + half), (a + half, b)]
            self.child += [0, 0]
        self.ids, rows = ids[order], rows[order]
        self.spans = spans
        self.low = np.array([rows[a:b].min(0) for a, b in spans], float)
        self.high = np.array([rows[a:b].max(0) for a, b in spans], float)
        self.most = float(np.abs(np.stack([self.low, self.high])).max())
        self.small = self.most**2 * rows.shape[1] < 2**53
        self.rows = rows.astype(float) if self.small else rows

    def search(self, query_id: int, query: np.ndarray, k: int, kth: int = NONE) -> list[tuple[int, int]]:
        """(score, id) of the k best of the rows that reach kth, the query's own id left out."""
        q, least = query.astype(float), float(np.abs(query).max())
        exact = self.small and least * self.most * len(query) < 2**53
        # Bounds are summed in floats: rounded up by what the sum can be off.
        slack = 0.0 if exact else 2.0**-50 * least * self.most * len(query) ** 2 + 1
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        heap = [(-float("inf"), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            first = self.child[node]
            if first:
                two = np.maximum(q * self.low[first : first + 2], q * self.high[first : first + 2]).sum(1) + slack
                for i in (0, 1):
                    if two[i] >= kth:
                        heapq.heappush(heap, (-float(two[i]), first + i))
                continue
            a, b = self.spans[node]
            score = scores(self.rows[a:b], query, exact)
            for i in np.flatnonzero(score >= kth):
                entry = (int(score[i]), -int(self.ids[a + i]))
                if -entry[1] == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == k:
                    kth = max(kth, best[0][0])
        return [(s, -i) for s, i in best]


def _pilot(all_of: DataFrame) -> DataFrame:
    """The vectors that count of PILOT_ROWS ids at most."""
    ids = all_of.select("vec_id").limit(PILOT_ROWS).distinct()
    of_id = all_of.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x"))
    return of_id.select("vec_id", "x.dim", "x.v")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other vectors for each vector where is_query holds."""
    spark = vectors.sparkSession
    all_of = quantised(vectors, scale)
    n = all_of.count()
    shards = max(1, -(-n // shard_rows), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_SHARD_ROWS))
    pilot = spark.sparkContext.broadcast({dim: (x["vec_id"].to_numpy(), np.array(x["v"].tolist(), np.int64)) for dim, x in _pilot(all_of).toPandas().groupby("dim")})

    def first_kth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kth = []
            for i, dim, v in zip(b["vec_id"], b["dim"], b["v"], strict=True):
                ids, rows = pilot.value.get(dim, (np.zeros(0, np.int64), None))
                own = scores(rows, np.array(v, np.int64), False)[ids != i] if len(ids) else ids
                kth.append(int(np.sort(own)[-k]) if len(own) >= k else NONE)
            yield b[["vec_id", "dim", "v"]].assign(kth=kth)

    picked = all_of.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v")
    queries = written(picked.mapInPandas(first_kth, "vec_id long, dim int, v array<long>, kth long"), "kd-queries")
    groups = max(1, -(-queries.count() // group_rows))
    rows = all_of.withColumns({"shard": F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"), "kth": F.lit(NONE), "kind": F.lit(0)})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by shard and group: first the vectors by vec_id, dim and v, then the queries."""
        key, waiting, trees = None, [], {}
        for b in batches:
            for (shard, group, kind), x in b.groupby(["shard", "grp", "kind"], sort=True):
                if (shard, group) != key:
                    key, waiting, trees = (shard, group), [], {}
                if kind == 0:
                    waiting.append(x[["vec_id", "dim", "v"]])
                    continue
                if waiting:
                    own, waiting = pd.concat(waiting), []
                    own = own[~own.assign(v=[np.asarray(v).tobytes() for v in own["v"]]).duplicated()]
                    trees = {dim: Tree(t["vec_id"].to_numpy(), np.array(t["v"].tolist(), np.int64)) for dim, t in own.groupby("dim")}
                out = []
                for i, dim, v, kth in zip(x["vec_id"], x["dim"], x["v"], x["kth"], strict=True):
                    if dim in trees:
                        out += [(i, j, s) for s, j in trees[dim].search(i, np.array(v, np.int64), k, kth)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    def searched(asked: DataFrame, some: list[int]) -> DataFrame:
        """The k best of these shards."""
        line = ["shard", "grp", "kind", "vec_id", "dim", "v", "kth"]
        of_shard = F.explode(F.array(*map(F.lit, some)) if len(some) < shards else F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        there = rows.where(F.col("shard").isin(some)) if len(some) < shards else rows
        there = there.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*line)
        asked = asked.select(of_shard, F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(groups)).cast("int").alias("grp"), F.lit(1).alias("kind"), "vec_id", "dim", "v", "kth")
        met = there.unionByName(asked).repartition(len(some) * groups, "shard", "grp").sortWithinPartitions("shard", "grp", "kind", "vec_id", "dim", "v")
        return met.mapInPandas(search, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scouts = list(range(0, shards, SCOUTS)) if shards >= SCOUTS else list(range(shards))
    found = searched(queries, scouts)
    if len(scouts) < shards:
        found = written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "kd-found")
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("seen"))
        asked = queries.join(kth, "vec_id", "left").withColumn("kth", F.greatest("kth", F.coalesce("seen", F.lit(NONE)))).drop("seen")
        found = found.drop("rank").unionByName(searched(asked, [i for i in range(shards) if i % SCOUTS]))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
