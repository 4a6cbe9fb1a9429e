"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

A word (lower case, cut at ASCII characters other than letters) has the sum of the hashed embeddings of itself and of its
first bytes; filters of several widths run over a whole text's words, each keeps its largest value (max pooling), and a
logistic layer makes the score. Embeddings start from how much more often a feature's documents are toxic, and all layers
are trained by Adagrad on a bounded sample of labelled rows (ROWS_PER_CLASS, BYTES_PER_CLASS). Then all texts are scored
on Spark, and the scores, not the texts, meet the labels: all usable labelled rows that the fit has not read, counted by
language, class and score, calibrate the score (so that 0.7 is the cut that parts the classes best) and, by language, the
thresholds; a language's own cut is drawn towards 0.7 the more, the fewer rows it has. Rows count as often as all labelled
rows of their class have them, so the cuts do not follow the sample's share of classes.

Scores depend on the text alone; language picks a threshold only, never the score. Null and empty texts have no words and
the score of the pooled bias; repeated texts score alike. With no labelled rows, or one class, every score is the sample's
share of toxic rows (0 without rows). Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import in_worker, kept_rows, offsets, passes, texts_of, within_bytes, written

#: Labelled rows of either class that training reads at most, and the bytes of their texts.
ROWS_PER_CLASS, BYTES_PER_CLASS = 2_000, 12_000_000
BUCKETS, WIDTH, FILTERS, WIDTHS = 1 << 17, 8, 6, (1, 2, 3)
#: Bytes of a word's first parts that are features beside the word.
PARTS = (5, 6, 7, 8, 9)
EPOCHS, RATE = 4, 0.08
CUT = 0.7
#: Rows of a language's rarer class at which its threshold is half way between 0.7 and its own cut, in log-odds.
LANGUAGE_PRIOR = 20
#: Score bins in a unit of log-odds.
BINS = 64
#: Words whose products a Python worker keeps.
WORDS_KEPT = 200_000
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split()


def features(word: bytes) -> list[int]:
    """Hashed features of a word, the word first."""
    out = [xxhash.xxh3_64_intdigest(word) % BUCKETS]
    out += [xxhash.xxh3_64_intdigest(b"\0" + word[:k]) % BUCKETS for k in PARTS if len(word) > k]
    return out


def cut_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text's words one after the other, and how many each word has."""
    each = [features(w) for w in words(text)]
    return np.fromiter((x for e in each for x in e), np.int32), np.fromiter(map(len, each), np.uint8, len(each))


class _Words:
    """Words seen and a row of their products with the filters for each."""

    def __init__(self, columns: int):
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((0, columns), np.float32)


class Model:
    """Embeddings, filters, the logistic layer, calibration and thresholds."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.name = uuid.uuid4().hex  # tells workers' words of one model from another's
        self.table = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
        self.filters = [rng.normal(0, 0.15, (FILTERS, w, WIDTH)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[: FILTERS // 2, :, 0] = 1.0 / f.shape[1]  # half of the filters start from the evidence of words
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.tile(np.r_[np.full(FILTERS // 2, 0.3), np.zeros(FILTERS - FILTERS // 2)], len(WIDTHS)).astype(np.float32)
        self.out0 = np.float32(-1)
        self.scale, self.shift, self.constant = 1.0, 0.0, None
        self.thresholds: dict[str, float] = {}
        self.fitted = np.zeros(0, bool)  # rows of the sample that the layers were trained on

    # Scoring: each distinct word's products with all filters are kept, so a text costs additions and maxima.

    def _products(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([(vectors @ f[:, k].T) for f in self.filters for k in range(f.shape[1])], 1)

    def _vectors(self, ws: list[bytes]) -> np.ndarray:
        each = [features(w) for w in ws]
        at = offsets(map(len, each))[:-1]
        n = np.fromiter(map(len, each), np.float32, len(each))
        flat = np.fromiter((x for e in each for x in e), np.int64)
        return np.add.reduceat(self.table[flat], at, axis=0) / np.sqrt(n)[:, None] if len(ws) else np.zeros((0, WIDTH), np.float32)

    def pooled(self, texts: list[str], seen: _Words) -> np.ndarray:
        """A row of pooled filters for each text."""
        cut = [words(t) for t in texts]
        new = list({w for ws in cut for w in ws if w not in seen.known})
        if len(seen.known) + len(new) > WORDS_KEPT:
            seen.known, seen.rows = {}, seen.rows[:0].copy()
            new = list({w for ws in cut for w in ws})
        if new:
            first = len(seen.known)
            seen.known.update((w, first + i) for i, w in enumerate(new))
            if first + len(new) > len(seen.rows):
                grown = np.zeros((max(len(seen.rows) * 3 // 2, first + len(new)), seen.rows.shape[1]), np.float32)
                grown[:first] = seen.rows[:first]
                seen.rows = grown
            seen.rows[first : first + len(new)] = self._products(self._vectors(new))
        out = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        get = seen.known.__getitem__
        for i, ws in enumerate(cut):
            if not ws:
                continue
            p = seen.rows[np.fromiter(map(get, ws), np.int64, len(ws))]
            column = 0
            for j, w in enumerate(WIDTHS):
                n = max(1, len(ws) - w + 1)
                total = np.zeros((n, FILTERS), np.float32)
                for k in range(w):
                    part = p[k : k + n, column : column + FILTERS]
                    total[: len(part)] += part
                    column += FILTERS
                out[i, j * FILTERS : (j + 1) * FILTERS] = total.max(0)
        return out

    def raw(self, texts: list[str], seen: _Words | None = None) -> np.ndarray:
        """Scores before calibration; seen: the words of earlier calls."""
        if self.constant is not None:
            return np.zeros(len(texts))
        pooled = self.pooled(texts, seen or _Words(sum(WIDTHS) * FILTERS))
        return (np.maximum(pooled + self.bias, 0) @ self.out + self.out0).astype(np.float64)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1."""
        if self.constant is not None:
            return np.full(len(z), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def least(self, languages: Iterable[str | None]) -> np.ndarray:
        """The thresholds of languages."""
        return np.array([self.thresholds.get(x or "", CUT) for x in languages], np.float64)

    # Training.

    def fit(self, texts: list[str], labels: np.ndarray, languages: list[str], seed: int = 7, weights: np.ndarray | None = None) -> Model:
        weights = np.ones(len(labels)) if weights is None else weights
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.0
            return self
        rng = np.random.default_rng(seed)
        held = np.zeros(len(texts), bool)
        held[rng.permutation(len(texts))[: len(texts) // 4]] = True
        if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
            held[:] = False
        train = np.flatnonzero(~held)
        self.fitted = ~held
        cut = [cut_text(t) for t in texts]
        self._evidence([cut[i] for i in train], labels[train])
        squares = [np.full_like(a, 0.1) for a in (*self.filters, self.bias, self.out)]
        table_squares, square0 = np.full(BUCKETS, 0.1, np.float32), 0.1
        balance = np.where(labels == 1, 0.5 / max(labels[train].mean(), 0.02), 0.5 / max(1 - labels[train].mean(), 0.02))
        for _ in range(EPOCHS):
            for i in rng.permutation(train):
                if not len(cut[i][0]):
                    continue
                square0 = self._step(cut[i], float(labels[i]), float(balance[i]), squares, table_squares, square0)
        check = np.flatnonzero(held) if held.any() else np.arange(len(texts))
        self.calibrate(self.raw([texts[i] for i in check]), labels[check], [languages[i] for i in check], np.ones(len(check)), weights[check])
        return self

    def _evidence(self, cut: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """First component of each embedding: the log of how much likelier the feature is in toxic documents."""
        counts = np.zeros((2, BUCKETS))
        for (flat, _), label in zip(cut, labels, strict=True):
            counts[int(label), np.unique(flat)] += 1
        b, a = counts + 0.5
        toxic, clean = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
        # Shrunk towards none, by the square root of its standard error, where few documents have the feature.
        log, error = np.log(a / toxic) - np.log(b / clean), np.sqrt(1 / a + 1 / b)
        there = counts.sum(0) > 0
        self.table[there, 0] = (np.sign(log) * np.maximum(0.0, np.abs(log) - 1.5 * error))[there]

    def _step(self, doc: tuple[np.ndarray, np.ndarray], label: float, weight: float, squares: list[np.ndarray], table_squares: np.ndarray, square0: float) -> float:
        flat, sizes = doc
        ends = np.cumsum(sizes, dtype=np.int64)
        at = ends - sizes
        root = 1 / np.sqrt(sizes.astype(np.float32))
        x = np.add.reduceat(self.table[flat], at, axis=0) * root[:, None]
        best, value = [], []
        for f in self.filters:
            w = f.shape[1]
            n = max(1, len(x) - w + 1)
            total = np.zeros((n, FILTERS), np.float32)
            for k in range(w):
                part = x[k : k + n] @ f[:, k].T
                total[: len(part)] += part
            top = total.argmax(0)
            best.append(top)
            value.append(total[top, np.arange(FILTERS)])
        pooled = np.concatenate(value) + self.bias
        on = np.maximum(pooled, 0)
        z = float(on @ self.out + self.out0)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        back = g * self.out * (pooled > 0)
        grads = [np.zeros_like(f) for f in self.filters]
        rows: dict[int, np.ndarray] = {}
        for j, f in enumerate(self.filters):
            for c in range(FILTERS):
                b = back[j * FILTERS + c]
                if b == 0:
                    continue
                for k in range(f.shape[1]):
                    place = int(best[j][c]) + k
                    if place < len(x):
                        grads[j][c, k] += b * x[place]
                        rows[place] = rows.get(place, 0) + b * f[c, k]
        for value_, grad, square in zip((*self.filters, self.bias, self.out), (*grads, back, g * on + 1e-4 * self.out), squares, strict=True):
            square += grad * grad
            value_ -= RATE * grad / np.sqrt(square)
        square0 += g * g
        self.out0 -= np.float32(RATE * g / np.sqrt(square0))
        for place, grad in rows.items():
            for r in flat[at[place] : ends[place]]:
                table_squares[r] += float(grad @ grad)
                self.table[r] -= RATE * root[place] * grad / np.sqrt(table_squares[r])
        return square0

    def calibrate(self, z: np.ndarray, labels: np.ndarray, languages: list[str], counts: np.ndarray, weights: np.ndarray) -> None:
        """Scale and shift by logistic regression; then a shift that puts the best cut at CUT; then thresholds by language.

        z: raw scores of rows, or of groups of counts rows; weights: what they count for, with the weight of their class.
        """
        part = weights / weights.sum()
        spread = max(float(np.sqrt(part @ (z - part @ z) ** 2)), 1e-6)
        a, b = 1 / spread, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            d = part * (p - labels)
            a -= 0.5 * (float(d @ z) / spread + 1e-3 * a) / spread
            b -= 0.5 * float(d.sum())
        self.scale = max(a, 1e-3)
        cut = _best_cut(z, labels, weights)
        self.shift = float(np.log(CUT / (1 - CUT)) - self.scale * cut)
        odds, middle = np.clip(self.scale * z + self.shift, -30, 30), np.log(CUT / (1 - CUT))
        names = np.array([x or "" for x in languages])
        self.thresholds = {}
        for name in set(names.tolist()):
            own = names == name
            n = min(counts[own & (labels == 1)].sum(), counts[own & (labels == 0)].sum())
            if n:
                at = (n * _best_cut(odds[own], labels[own], weights[own]) + LANGUAGE_PRIOR * middle) / (n + LANGUAGE_PRIOR)
                self.thresholds[name] = float(1 / (1 + np.exp(-at)))


def _best_cut(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The cut with the largest F1 of the weighted rows, in the middle of its gap."""
    order = np.argsort(-z, kind="stable")
    zs, hit = z[order], np.cumsum((weights * labels)[order])
    f1 = 2 * hit / (np.cumsum(weights[order]) + hit[-1])
    last = np.append(zs[1:] < zs[:-1], True)
    f1[~last] = -1
    k = int(np.argmax(f1))
    return float((zs[k] + zs[k + 1]) / 2) if k + 1 < len(zs) else float(zs[k])


def picked_labels(labels: DataFrame, label: str, usable: Column, per_class: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, label of all usable labelled documents (one with both labels has 0), and of per_class of each class at most,
    those of least hash of doc_id."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    some = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return rows, some[0].union(some[1])


def with_weights(rows: pd.DataFrame, there: DataFrame) -> pd.DataFrame:
    """rows (doc_id, label, ...) and weight: how many documents of there (doc_id, label) stand behind each document of its class."""
    of_class = dict(there.groupBy("label").count().collect())  # two rows
    own = rows.groupby("label")["doc_id"].nunique()
    return rows.assign(weight=rows["label"].map(lambda c: of_class[c] / own[c]).astype(float))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int = ROWS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> pd.DataFrame:
    """doc_id, text, lang, label, weight of at most per_class labelled documents of each class, and of texts that add up to
    bytes_per_class at most; repeated rows count once. weight: see with_weights."""
    there, picked = picked_labels(labels, label, usable, per_class)
    picked = F.broadcast(picked)  # 2 * per_class rows at most
    held = written(texts_of(docs, "lang").join(picked, "doc_id").dropDuplicates(["doc_id", "text"]).withColumn("bytes", F.octet_length("text").cast("long")), "training")
    some = within_bytes(held.select("doc_id", "label", "bytes", F.xxhash64("text").alias("of_text"), F.xxhash64("doc_id").alias("place")), "label", "bytes", ["place", "doc_id", "bytes", "of_text"], bytes_per_class)
    keys = some.select("doc_id", F.col("of_text"))
    out = held.withColumn("of_text", F.xxhash64("text")).join(F.broadcast(keys), ["doc_id", "of_text"], "left_semi").select("doc_id", "text", "lang", "label")
    return with_weights(out.toPandas().sort_values(["doc_id", "text"]).reset_index(drop=True), there)


def third(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def raw_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, held_out and z (the score before calibration) of every whole text."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = given.value
        seen = in_worker(("toxicity", own.name), lambda: _Words(sum(WIDTHS) * FILTERS))
        for b in batches:
            for part in passes(texts := b["text"].tolist(), 1_000_000):
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[part], "lang": b["lang"].iloc[part], "held_out": b["held_out"].iloc[part], "z": own.raw(texts[part], seen)})

    rows = texts_of(docs, "lang").withColumn("held_out", F.coalesce(third() == 1, F.lit(False)))
    return rows.mapInPandas(run, "doc_id long, lang string, held_out boolean, z double")


def _calibrate_on_all(model: Model, scored: DataFrame, labels: DataFrame, fitted: pd.DataFrame) -> None:
    """Calibrate by all usable labelled rows that the layers were not trained on, from counts by language, class and score."""
    usable, _ = picked_labels(labels, "toxic", third() != 1, 0)
    known = scored.sparkSession.createDataFrame([(int(x),) for x in fitted["doc_id"].unique()], "doc_id long")  # 2 * per_class rows at most
    rest = usable.join(F.broadcast(known), "doc_id", "left_anti")
    # A bin holds scores that round to the same part of the first calibration's log-odds, so the cells are bounded in each language.
    odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z") * model.scale + model.shift))
    cells = scored.where("not held_out").select("doc_id", "lang", F.floor(odds * BINS).cast("int").alias("bin")).join(rest, "doc_id")
    cells = cells.groupBy("lang", "label", "bin").count().toPandas().sort_values(["lang", "label", "bin"])
    n = cells.groupby("label")["count"].sum()
    if len(n) < 2:
        return
    weight = {c: 1 + (fitted["label"] == c).sum() / n[c] for c in (0, 1)}
    z = ((cells["bin"].to_numpy() + 0.5) / BINS - model.shift) / model.scale
    counts = cells["count"].to_numpy(float)
    names = [x if isinstance(x, str) else "" for x in cells["lang"]]
    model.calibrate(z, cells["label"].to_numpy(), names, counts, counts * cells["label"].map(weight).to_numpy(float))


def train_and_score(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> tuple[Model, DataFrame]:
    """A model from labelled rows outside the held-out third (crc32(doc_id) mod 3 = 1), and the raw scores of all of docs, a
    table in the shared folder: each text is scored once."""
    rows = training_rows(docs, labels, "toxic", third() != 1, per_class)
    y = rows["label"].to_numpy(np.int64)
    model = Model().fit(rows["text"].tolist(), y, rows["lang"].tolist(), weights=rows["weight"].to_numpy())
    fitted = rows.loc[model.fitted, ["doc_id", "label"]] if model.constant is None else None
    del rows
    scored = written(raw_scores(docs, model), "toxicity-scores")
    if fitted is not None:
        _calibrate_on_all(model, scored, labels, fitted)
    return model, scored


def train(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> Model:
    return train_and_score(docs, labels, per_class)[0]


def graded(scored: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7), threshold (its language's), flagged (score >= threshold) from raw scores."""
    given = scored.sparkSession.sparkContext.broadcast((model.constant, model.scale, model.shift, model.thresholds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model.__new__(Model)  # calibration alone
        own.constant, own.scale, own.shift, own.thresholds = given.value
        for b in batches:
            value, least = own.calibrated(b["z"].to_numpy()), own.least(b["lang"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": value, "predicted": (value >= CUT).astype(np.int32), "threshold": least, "flagged": value >= least})

    return scored.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every whole text scored and graded: see graded."""
    return graded(raw_scores(docs, model), model)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model flags by their language's threshold."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def keep(b: pa.RecordBatch) -> np.ndarray:
        texts, own = [t or "" for t in b["text"].to_pylist()], given.value
        seen = in_worker(("toxicity", own.name), lambda: _Words(sum(WIDTHS) * FILTERS))
        value = [own.calibrated(own.raw(texts[part], seen)) for part in passes(texts, 1_000_000)]
        return np.concatenate(value) < own.least(b["lang"].to_pylist()) if value else np.zeros(0, bool)

    return kept_rows(docs, keep)
