"""Quality by co-training: a text-content classifier and a page-metadata classifier teach each other.

The content view is what the words are: hashed words and shapes of words, and shares of symbols, capitals, digits and
repeats. The metadata view is what a crawl's record tells without reading: language, source, length and layout (lines and
their length). Each view is a logistic regression, fitted to the labelled rows by Adagrad. Then, in each round, both views
score all documents but the fitted ones on Spark, labels unseen; those beyond a view's own quantiles of score, a larger
share in each round and in the labelled rows' proportion, are lessons for the other view: the gradients of all of them are
summed on Spark and make a step, as if they were LESSONS times as many rows as the labelled ones, STEPS times over, and a pass
over the labelled rows follows. A held-back part of the labelled rows calibrates either view, and a last regression weighs the two
calibrated views; in both, rows count as often as all labelled rows of their class have them. Every document is scored, and
a document is rejected only if its combined score is below CUT.

Every whole text is read once, for its features, which are a table that rounds and scoring read where it is, without a
shuffle. The fitted rows are a bounded sample of the labelled ones, chosen by hash (ROWS_PER_CLASS, BYTES_PER_CLASS); all
other documents count as unlabelled, those with a label that the fit does not read too. Per round, the driver gets counts by
score bin and one sum for each feature, which do not grow with the documents.

Null and empty texts have no words and are scored by their metadata and bias. Null lang, source or n_chars are values of
their own; a null quality is no label, and a document with both labels has 0. Without labelled rows of both classes every
score is 1 (all kept). Repeated rows score alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import kept_rows, offsets, passes, texts_of, within_bytes, written
from tidewake.llm.toxicity import picked_labels, with_weights

#: Labelled rows of either class that training reads at most, and the bytes of their features.
ROWS_PER_CLASS, BYTES_PER_CLASS = 2_000, 12_000_000
BUCKETS, META_BUCKETS = 1 << 16, 1 << 10
#: Rounds, the share of unlabelled documents that each round adds to the lessons, what all lessons weigh against the labelled rows, and
#: the steps that a round makes over its lessons.
ROUNDS, SHARE_A_ROUND, LESSONS, STEPS = 3, 0.07, 2.0, 3
#: Score bins in a unit of log-odds, and the log-odds at which they end on either side.
BINS, BIN_END = 64, 30
CUT = 0.4
_SYMBOL = bytes(1 if b in b"#$%&*+/<=>@[\\]^_`{|}~" else 0 for b in range(256))
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
N_DENSE = 10
FEATURES = "keys binary, weights binary, dense binary, meta_keys binary, meta_weights binary, meta_dense binary"


def content_row(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features, their weights and the dense shares of one text."""
    raw = text.encode()
    ws = raw.split()
    if not ws:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(N_DENSE, np.float32)
    distinct = set(ws)
    shapes: dict[bytes, int] = {}
    for s in raw.translate(_SHAPE).split():
        shapes[s] = shapes.get(s, 0) + 1
    marks: dict[bytes, float] = {}
    for s, n in shapes.items():
        end = s[-2:] if not s[-1:].isalnum() else b"."
        start = b"A" if s[:2].isupper() else b"a"
        for m in (b"e" + end, b"s" + start):
            marks[m] = marks.get(m, 0) + n
    n = len(ws)
    keys = [xxhash.xxh3_64_intdigest(w) % BUCKETS for w in distinct] + [xxhash.xxh3_64_intdigest(b"\0" + m) % BUCKETS for m in marks]
    weights = [0.2 / len(distinct) ** 0.5] * len(distinct) + [v / n for v in marks.values()]
    counts = np.bincount(np.frombuffer(raw.translate(_SHAPE), np.uint8), minlength=256) / len(raw)
    symbols = sum(counts[b] for b in range(256) if _SYMBOL[b])
    alone = raw.count(b" | ") / n
    dense = [symbols, counts[65], counts[97], counts[48], len(distinct) / n, len(distinct) / n**0.8, raw.count(b"!") / n, alone, raw.count(b".") / n, (len(raw) - n) / n / 10]
    bucket, at = np.unique(np.array(keys, np.int64), return_inverse=True)  # words that share a bucket are one feature
    return bucket, np.bincount(at, np.array(weights)).astype(np.float32), np.array(dense, np.float32)


def metadata_row(lang: str | None, source: str | None, n_chars: float, n_bytes: int, n_lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a document's record: language, source, length and layout."""
    known = n_chars == n_chars and n_chars is not None
    length = np.log1p(max(0.0, float(n_chars))) if known else 0.0
    line = np.log1p(n_bytes / max(1, n_lines))
    names = [f"lang={lang}", f"source={source}", f"length={int(2 * length) if known else None}", f"line={int(2 * line)}", f"lines={int(2 * np.log1p(n_lines))}"]
    keys = [xxhash.xxh3_64_intdigest(x) % META_BUCKETS for x in names]
    dense = np.zeros(N_DENSE, np.float32)
    dense[:3] = length / 10, line / 10, np.log1p(n_lines) / 10
    bucket, n = np.unique(np.array(keys, np.int64), return_counts=True)
    return bucket, (0.3 * n).astype(np.float32), dense


class Rows:
    """Features of many rows in one view: hashed ones one after the other (a row's begin at at[i]), and the dense ones."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, at: np.ndarray, dense: np.ndarray):
        self.keys, self.weights, self.at, self.dense = keys, weights, at, dense

    def __len__(self) -> int:
        return len(self.at) - 1

    @classmethod
    def of(cls, b: pd.DataFrame, view: str = "") -> Rows:
        """From the columns of FEATURES."""
        keys = np.frombuffer(b"".join(b[f"{view}keys"]), "<u2").astype(np.int64)
        dense = np.frombuffer(b"".join(b[f"{view}dense"]), "<f4").astype(float).reshape(-1, N_DENSE)
        return cls(keys, np.frombuffer(b"".join(b[f"{view}weights"]), "<f4").astype(float), offsets(len(x) // 2 for x in b[f"{view}keys"]), dense)

    def some(self, index: np.ndarray) -> Rows:
        n = (self.at[1:] - self.at[:-1])[index]
        flat = np.concatenate([np.arange(self.at[i], self.at[i + 1]) for i in index]) if len(index) else np.zeros(0, np.int64)
        return Rows(self.keys[flat], self.weights[flat], offsets(n), self.dense[index])


class View:
    """Logistic regression over hashed and dense features, by Adagrad."""

    def __init__(self, buckets: int):
        self.hashed, self.dense, self.bias = np.zeros(buckets), np.zeros(N_DENSE), 0.0
        self.mean, self.spread = np.zeros(N_DENSE), np.ones(N_DENSE)
        self.squares = [np.full(buckets, 0.1), np.full(N_DENSE, 0.1), 0.1]
        self.of_class = np.ones(2)
        self.a, self.b = 1.0, 0.0

    def start(self, rows: Rows, labels: np.ndarray) -> None:
        """Scale and class weights from the labelled rows."""
        self.mean, self.spread = rows.dense.mean(0), rows.dense.std(0) + 1e-6
        share = min(max(float(labels.mean()), 0.02), 0.98)
        self.of_class = np.array([0.5 / (1 - share), 0.5 / share])

    def _scaled(self, rows: Rows) -> np.ndarray:
        return np.clip((rows.dense - self.mean) / self.spread, -8, 8)

    def epochs(self, rows: Rows, labels: np.ndarray, seed: int, n: int) -> None:
        scaled, weight, rng = self._scaled(rows), self.of_class[labels], np.random.default_rng(seed)
        gh, gd, gb = self.squares
        for _ in range(n):
            for i in rng.permutation(len(rows)):
                k, w = rows.keys[rows.at[i] : rows.at[i + 1]], rows.weights[rows.at[i] : rows.at[i + 1]]
                g = weight[i] * (1 / (1 + np.exp(-np.clip(self.hashed[k] @ w + scaled[i] @ self.dense + self.bias, -30, 30))) - labels[i])
                step = g * w + 1e-4 * self.hashed[k]
                gh[k] += step * step
                self.hashed[k] -= 0.2 * step / np.sqrt(gh[k])
                step = g * scaled[i] + 1e-4 * self.dense
                gd += step * step
                self.dense -= 0.1 * step / np.sqrt(gd)
                gb += g * g
                self.bias -= 0.1 * g / np.sqrt(gb)
        self.squares[2] = gb

    def gradient(self, rows: Rows, labels: np.ndarray) -> np.ndarray:
        """Summed over rows: hashed features, dense ones, bias."""
        g = self.of_class[labels] * (1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30))) - labels)
        hashed = np.bincount(rows.keys, np.repeat(g, np.diff(rows.at)) * rows.weights, len(self.hashed))
        return np.concatenate([hashed, g @ self._scaled(rows), [g.sum()]])

    def step(self, gradient: np.ndarray) -> None:
        parts = np.split(gradient, [len(self.hashed), len(self.hashed) + N_DENSE])
        gh, gd, gb = self.squares
        gh += parts[0] ** 2
        gd += parts[1] ** 2
        self.squares[2] = gb = gb + float(parts[2][0]) ** 2
        self.hashed -= 0.2 * parts[0] / np.sqrt(gh)
        self.dense -= 0.1 * parts[1] / np.sqrt(gd)
        self.bias -= 0.1 * float(parts[2][0]) / np.sqrt(gb)

    def raw(self, rows: Rows) -> np.ndarray:
        so_far = np.concatenate([[0.0], np.cumsum(self.hashed[rows.keys] * rows.weights)])
        return self._scaled(rows) @ self.dense + self.bias + so_far[rows.at[1:]] - so_far[rows.at[:-1]]

    def logit(self, rows: Rows) -> np.ndarray:
        return self.a * self.raw(rows) + self.b

    def for_tasks(self) -> View:
        """Without the state of training."""
        own = View(1)
        own.hashed, own.dense, own.bias, own.mean, own.spread, own.of_class, own.a, own.b = self.hashed.copy(), self.dense.copy(), self.bias, self.mean, self.spread, self.of_class, self.a, self.b
        return own


def _logistic(x: np.ndarray, labels: np.ndarray, start: np.ndarray, weights: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights (the last is the bias) by Newton's method with a small ridge, kept from being negative but for the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    weights = weights / weights.mean()
    w = start.astype(float)
    for _ in range(steps // 20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (weights * (p - labels)) + 1e-2 * (w - start))
    w[:-1] = np.maximum(w[:-1], 0)
    return w


class CoTraining:
    """The two views, their calibration and their weights."""

    def __init__(self):
        self.content, self.meta = View(BUCKETS), View(META_BUCKETS)
        self.weights, self.constant = np.array([1.0, 0.0, 0.0]), None

    def fit(self, content: Rows, meta: Rows, labels: np.ndarray, pool: DataFrame | None = None, seed: int = 11, weights: np.ndarray | None = None) -> CoTraining:
        """pool: the features of the documents that count as unlabelled."""
        weights = np.ones(len(labels)) if weights is None else weights
        if len(set(labels.tolist())) < 2:
            self.constant = 1.0
            return self
        rng = np.random.default_rng(seed)
        held = np.zeros(len(labels), bool)
        held[rng.permutation(len(labels))[: len(labels) // 4]] = True
        if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
            held[:] = False
        own = np.flatnonzero(~held)
        share = float(np.average(labels[own], weights=weights[own]))
        each = [(self.content, content.some(own)), (self.meta, meta.some(own))]
        for view, rows in each:
            view.start(rows, labels[own])
            view.epochs(rows, labels[own], seed, 6)
        for turn in range(ROUNDS if pool is not None else 0):
            ends = confident(pool, self.content, self.meta, SHARE_A_ROUND * (turn + 1), share)
            teachers = self.content.for_tasks(), self.meta.for_tasks()  # a round's pseudo-labels stay as they are over its steps
            for _ in range(STEPS):
                for (view, _), (total, n) in zip(each, lessons(pool, teachers, (self.content, self.meta), ends), strict=True):
                    if n:
                        view.step(total * (LESSONS * len(own) / n))
            for view, rows in each:
                view.epochs(rows, labels[own], seed + 1 + turn, 1)
        check = np.flatnonzero(held) if held.any() else own
        y = labels[check]
        for view, rows in ((self.content, content), (self.meta, meta)):
            z = view.raw(rows.some(check))
            view.a, view.b = _logistic(z[:, None], y, np.array([1 / max(float(z.std()), 1e-6), 0.0]), weights[check])
        both = np.column_stack([self.content.logit(content.some(check)), self.meta.logit(meta.some(check))])
        self.weights = _logistic(both, y, np.array([1.0, 0.2, 0.0]), weights[check])
        self.content, self.meta = self.content.for_tasks(), self.meta.for_tasks()
        return self

    def score(self, content: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, content and metadata scores (1: good)."""
        if self.constant is not None:
            return (np.full(len(content), self.constant),) * 3
        a, b = self.content.logit(content), self.meta.logit(meta)
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (np.column_stack([a, b, np.ones(len(a))]) @ self.weights, a, b))


def confident(pool: DataFrame, content: View, meta: View, share: float, good: float) -> list[tuple[float, float]]:
    """For each view, the scores below and above which its most confident documents are: share of all, good of these above."""
    given = pool.sparkSession.sparkContext.broadcast((content.for_tasks(), meta.for_tasks()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 2 * BIN_END * BINS + 1), np.int64)
        for b in batches:
            for k, (view, name) in enumerate(zip(given.value, ("", "meta_"), strict=True)):
                z = np.floor((np.clip(view.raw(Rows.of(b, name)), -BIN_END, BIN_END) + BIN_END) * BINS).astype(np.int64)
                counts[k] += np.bincount(z, minlength=counts.shape[1])
        k, z = np.nonzero(counts)
        yield pd.DataFrame({"view": k, "bin": z, "n": counts[k, z]})

    found = pool.mapInPandas(run, "view int, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).toPandas()  # bins of two views
    out = []
    for k in (0, 1):
        own = found[found["view"] == k].sort_values("bin")
        if not len(own):
            out.append((-np.inf, np.inf))
            continue
        edge, n = own["bin"].to_numpy(), own["n"].to_numpy(float)
        up, down = np.cumsum(n), np.cumsum(n[::-1])[::-1]
        low = edge[max(0, int(np.searchsorted(up, share * (1 - good) * up[-1], "right")) - 1)] + 1
        high = edge[min(len(edge) - 1, int((down > share * good * up[-1]).sum()))]
        out.append((low / BINS - BIN_END, high / BINS - BIN_END))
    return out


def lessons(pool: DataFrame, teachers: tuple[View, View], learners: tuple[View, View], ends: list[tuple[float, float]]) -> list[tuple[np.ndarray, int]]:
    """For each of the learners, the summed gradient of the documents that the other view's teacher is confident of, and their number."""
    given = pool.sparkSession.sparkContext.broadcast((teachers, tuple(v.for_tasks() for v in learners)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taught, views = given.value
        total, n = [np.zeros(len(v.hashed) + N_DENSE + 1) for v in views], [0, 0]
        for b in batches:
            rows = [Rows.of(b, ""), Rows.of(b, "meta_")]
            for k in (0, 1):
                z = taught[1 - k].raw(rows[1 - k])
                at = np.flatnonzero((z < ends[1 - k][0]) | (z >= ends[1 - k][1]))
                if len(at):
                    total[k] += views[k].gradient(rows[k].some(at), (z[at] >= ends[1 - k][1]).astype(np.int64))
                    n[k] += len(at)
        for k in (0, 1):
            at = np.flatnonzero(total[k])
            yield pd.DataFrame({"view": k, "key": np.append(at, -1), "g": np.append(total[k][at], float(n[k]))})

    found = pool.mapInPandas(run, "view int, key int, g double").groupBy("view", "key").agg(F.sum("g").alias("g")).toPandas()  # a row a feature
    out = []
    for k, view in enumerate(learners):
        own, total = found[found["view"] == k], np.zeros(len(view.hashed) + N_DENSE + 1)
        real = own[own["key"] >= 0]
        total[real["key"].to_numpy()] = real["g"].to_numpy()
        out.append((total, int(own.loc[own["key"] < 0, "g"].sum())))
    return out


def features_of(b: pd.DataFrame) -> pd.DataFrame:
    """The columns of FEATURES for rows of text, lang, source, n_chars."""
    out = []
    for t, lang, source, n in zip(b["text"], b["lang"], b["source"], b["n_chars"], strict=True):
        row = (*content_row(t), *metadata_row(lang, source, n, len(t.encode()), t.count("\n") + 1))
        out.append(tuple(x.astype(kind).tobytes() for x, kind in zip(row, ("<u2", "<f4", "<f4") * 2, strict=True)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every whole text and its record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in passes(b["text"].tolist(), 300_000):
                some = b.iloc[part].reset_index(drop=True)
                yield pd.concat([some[["doc_id"]], features_of(some)], axis=1)

    return texts_of(docs, "lang", "source", "n_chars").mapInPandas(run, f"doc_id long, {FEATURES}")


def train_on(rows: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> CoTraining:
    """Views taught by a sample of the labelled rows of a table of features, and by all other rows, without their labels."""
    there, picked = picked_labels(labels, "quality", F.lit(True), per_class)
    bound = F.broadcast(picked)  # 2 * per_class rows at most
    held = rows.join(bound, "doc_id").withColumn("of_row", F.xxhash64(*[c.split()[0] for c in FEATURES.split(", ")])).dropDuplicates(["doc_id", "of_row"])
    held = written(held.withColumns({"bytes": (F.octet_length("keys") * 3).cast("long"), "place": F.xxhash64("doc_id")}), "quality-training")
    known = within_bytes(held, "label", "bytes", ["place", "doc_id", "of_row"], bytes_per_class).drop("bytes", "place").toPandas()
    known = with_weights(known.sort_values(["doc_id", "of_row"]).reset_index(drop=True), there)
    fitted = rows.sparkSession.createDataFrame(known[["doc_id"]].drop_duplicates(), "doc_id long")  # the same bound
    pool = rows.join(F.broadcast(fitted), "doc_id", "left_anti")
    return CoTraining().fit(Rows.of(known), Rows.of(known, "meta_"), known["label"].to_numpy(np.int64), pool, weights=known["weight"].to_numpy())


def train_and_rows(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> tuple[CoTraining, DataFrame]:
    """A model of docs and the table of their features, for score_rows."""
    rows = written(features(docs), "quality-features")
    return train_on(rows, labels, per_class), rows


def train(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> CoTraining:
    return train_and_rows(docs, labels, per_class)[0]


def score_rows(rows: DataFrame, model: CoTraining) -> DataFrame:
    """doc_id, score, content_score, metadata_score (1: good), rejected (score < CUT) of every row of features."""
    given = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            value, content, meta = given.value.score(Rows.of(b), Rows.of(b, "meta_"))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": value, "content_score": content, "metadata_score": meta, "rejected": value < CUT})

    return rows.mapInPandas(run, "doc_id long, score double, content_score double, metadata_score double, rejected boolean")


def score(docs: DataFrame, model: CoTraining) -> DataFrame:
    """The same of every document."""
    return score_rows(features(docs), model)


def without_rejected(docs: DataFrame, model: CoTraining) -> DataFrame:
    """docs without the rows that the model rejects."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def keep(b: pa.RecordBatch) -> np.ndarray:
        rows = b.select(["text", "lang", "source", "n_chars"]).to_pandas()
        rows["text"] = rows["text"].where(rows["text"].notna(), "")
        made = [features_of(rows.iloc[part]) for part in passes(rows["text"].tolist(), 300_000)]
        return np.concatenate([given.value.score(Rows.of(x), Rows.of(x, "meta_"))[0] for x in made]) >= CUT if made else np.zeros(0, bool)

    return kept_rows(docs, keep)
