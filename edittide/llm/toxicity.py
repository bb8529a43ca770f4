"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each has a logistic model over hashed words, and later
models also see the probabilities of the earlier categories. For training, these are out-of-fold: a
row's earlier probabilities come from models that have not seen it, as at prediction time.

The models are fitted on the driver, on a bounded sample of the labelled documents (FIT_ROWS, the smallest
hashes of their ids, so the same ones each time); every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edittide.llm import words as W
from edittide.llm.common import free

#: Labelled rows to fit on; bits of the word hash; rows that must hold a word before it counts; folds.
FIT_ROWS, BITS, LEAST_ROWS, FOLDS = 8_000, 20, 5, 3


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside = W.table("alnum")
    for b in batches:
        for first, rows, h, at in W.shingles(b.column(b.schema.get_field_index("text")), 1, inside):
            pair = np.unique(np.repeat(np.arange(rows), np.diff(at)) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
            at = np.searchsorted(pair >> BITS, np.arange(rows + 1))
            ids = pa.array((pair & ((1 << BITS) - 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), ids)
            rest = [b.column(i).slice(first, rows) for i, n in enumerate(b.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, lists], names=[*(n for n in b.schema.names if n != "text"), "words"])


class Rows:
    """Sparse rows of present words, as one run of column numbers."""

    def __init__(self, columns: np.ndarray, at: np.ndarray, width: int):
        self.columns, self.at, self.width = columns, at, width
        self.own = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.own, w[self.columns], len(self.at) - 1)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, g[self.own], self.width)

    def take(self, keep: np.ndarray) -> Rows:
        n = np.diff(self.at)
        return Rows(self.columns[keep[self.own]], np.concatenate([[0], np.cumsum(n[keep])]), self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: Rows, extra: np.ndarray, y: np.ndarray, penalty: float = 0.3, steps: int = 150, least: float = 5.0) -> np.ndarray:
    """Weights (words, extra columns, intercept) of a ridge logistic model over the words whose share of positive rows is
    `least` standard deviations from the share of all rows; other words weigh 0."""
    n, positive = x.back(np.ones(len(y))), x.back(y)
    rate = min(max(y.mean(), 1e-9), 1 - 1e-9)
    apart = np.abs(positive - n * rate) / np.sqrt(np.maximum(n * rate * (1 - rate), 1e-9))
    kept = np.flatnonzero(apart >= least)
    spot = np.full(x.width, -1)
    spot[kept] = np.arange(len(kept))
    ok = spot[x.columns] >= 0
    inner = Rows(spot[x.columns[ok]], np.concatenate([[0], np.cumsum(np.bincount(x.own[ok], minlength=len(y)))]), len(kept))
    w = _solved(inner, extra, y, np.ones(len(y)), penalty, steps)
    out = np.zeros(x.width + extra.shape[1] + 1)
    out[kept], out[x.width :] = w[: len(kept)], w[len(kept) :]
    return out


def _solved(x: Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """Accelerated gradient steps with a diagonal scale, so frequent words do not hold back rare ones."""
    width, n = x.width, len(y)
    scale = x.back(weight) / 4
    dense = np.column_stack([extra, np.ones(n)])
    scale = np.concatenate([scale, (dense**2 * weight[:, None]).sum(0) / 4])
    pen = np.concatenate([np.full(width, penalty), np.full(extra.shape[1], 0.01), [1e-6]])
    length = np.maximum(np.diff(x.at), 1).mean() ** 0.5 + extra.shape[1] + 1
    rate = 1 / (scale * length + pen)
    w = np.zeros(width + dense.shape[1])
    ahead, last = w.copy(), w.copy()
    best, at_best = np.inf, w
    for i in range(steps):
        z = x.dot(ahead[:width]) + dense @ ahead[width:]
        loss = float((weight * np.logaddexp(0, np.where(y > 0, -z, z))).sum() + 0.5 * (pen * ahead * ahead).sum())
        if loss < best:
            best, at_best = loss, ahead.copy()
        elif loss > 1.5 * best + 1:
            rate, last, ahead = rate / 2, at_best.copy(), at_best.copy()
            continue
        g = weight * (_sigmoid(z) - y)
        w = ahead - rate * (np.concatenate([x.back(g), dense.T @ g]) + pen * ahead)
        ahead = w + i / (i + 3) * (w - last)
        last = w
    return at_best


@dataclass
class Chain:
    """Fitted chain: for each category the weights of words, of earlier categories, an intercept and a threshold."""

    categories: list[str]
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold probabilities, halfway to the next row; 0.5 if a class is missing."""
    if y.sum() in (0, len(y)):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(np.argmax(f1))
    return float((p[order[i]] + p[order[min(i + 1, len(y) - 1)]]) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], fit_rows: int = FIT_ROWS) -> Chain:
    """Fits a chain on `fit_rows` labelled documents at most. categories: name to a SQL condition over labels, in chain
    order; a null label counts as false. Of rows that share a doc_id the text with the largest hash counts, so `fit_rows` bounds what reaches the
    driver. Without labelled rows every probability is 0.5 and nothing is flagged."""
    names = list(categories)
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(F.expr(c), F.lit(False)).cast("int")).alias(f"_{i}") for i, c in enumerate(categories.values())])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = marks.join(texts.select("doc_id"), "doc_id", "left_semi")
    picked = known.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(fit_rows).drop("_h")
    some = texts.join(F.broadcast(picked), "doc_id")  # of fit_rows rows at most
    one = some.groupBy("doc_id", *[f"_{i}" for i in range(len(names))]).agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    fields = "doc_id long, " + ", ".join(f"_{i} int" for i in range(len(names))) + ", words array<int>"
    got = one.mapInArrow(_features, fields).orderBy("doc_id").toArrow().combine_chunks()
    chain = Chain(names)
    rows = got.num_rows
    if not rows:
        chain.weights = [np.zeros(i + 1) for i in range(len(names))]
        chain.thresholds = [0.5] * len(names)
        return chain
    lists = got["words"].chunk(0) if got["words"].num_chunks else pa.array([], pa.list_(pa.int32()))
    raw, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    held = np.bincount(raw, minlength=1 << BITS)
    chain.words = np.flatnonzero((held >= LEAST_ROWS) & (held <= 0.7 * max(rows, 8)))
    spot = np.full(1 << BITS, -1, np.int32)
    spot[chain.words] = np.arange(len(chain.words))
    spot = spot[raw]
    own = np.repeat(np.arange(rows, dtype=np.int32), n)[spot >= 0]
    x = Rows(spot[spot >= 0], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=rows))]), len(chain.words))
    marks, ids = [got[f"_{i}"].to_numpy().astype(float) for i in range(len(names))], got["doc_id"].to_numpy()
    del got, lists, raw, spot, own, held
    fold = np.argsort(np.argsort(W.mix(ids.astype(np.uint64)), kind="stable"), kind="stable") % FOLDS
    earlier = np.zeros((rows, 0))
    for i in range(len(names)):
        y = marks[i]
        out = np.zeros(rows)
        for f in range(FOLDS):
            train_, test = fold != f, fold == f
            if not test.any() or not train_.any():
                continue
            w = fit(x.take(train_), earlier[train_], y[train_])
            out[test] = _sigmoid(x.take(test).dot(w[: x.width]) + np.column_stack([earlier[test], np.ones(test.sum())]) @ w[x.width :])
        chain.weights.append(fit(x, earlier, y))
        chain.thresholds.append(_threshold(out, y))
        earlier = np.column_stack([earlier, out])
    return chain


def _scored(chain, text: int, at: str):
    inside = W.table("alnum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = chain.value
        names = [*(f"p_{n}" for n in c.categories), *(f"is_{n}" for n in c.categories)]
        tables = []
        for w in c.weights:
            table = np.zeros(1 << BITS)
            table[c.words] = w[: len(c.words)]
            tables.append(table)
        for b in batches:
            parts: list[list[np.ndarray]] = [[] for _ in c.categories]
            for _, rows, h, begin in W.shingles(b.column(text), 1, inside):
                own = np.repeat(np.arange(rows), np.diff(begin))
                pair = np.unique(own.astype(np.int64) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
                own, ids = pair >> BITS, pair & ((1 << BITS) - 1)
                earlier = np.zeros((rows, 0))
                for i, w in enumerate(c.weights):
                    p = _sigmoid(np.bincount(own, tables[i][ids], rows) + np.column_stack([earlier, np.ones(rows)]) @ w[len(c.words) :])
                    parts[i].append(p)
                    earlier = np.column_stack([earlier, p])
            scores = [np.concatenate(p) if p else np.zeros(0) for p in parts]
            cells = pa.StructArray.from_arrays([*(pa.array(s) for s in scores), *(pa.array(s > t) for s, t in zip(scores, c.thresholds))], names=names)
            yield pa.RecordBatch.from_arrays([*b.columns, cells], names=[*b.schema.names, at])

    return run


def scored(docs: DataFrame, chain: Chain, at: str = "scores") -> DataFrame:
    """`docs` with a column `at`, which no column of docs may be named: p_<category> and is_<category> (probability above the category's
    threshold). A null or empty text has no words and gets the intercept's probability."""
    if free(at, docs.columns) != at:
        raise ValueError(f"docs has a column {at}")
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    cells = T.StructType([*(T.StructField(f"p_{n}", T.DoubleType()) for n in chain.categories), *(T.StructField(f"is_{n}", T.BooleanType()) for n in chain.categories)])
    return docs.mapInArrow(_scored(sent, docs.columns.index("text"), at), T.StructType([*docs.schema.fields, T.StructField(at, cells)]))
