"""Quality classifier: a support vector machine over naive Bayes features.

Indicators of hashed token unigrams and bigrams are scaled by the log ratio of
their smoothed counts in good and bad documents; a linear hinge-loss model over
them is fitted by dual coordinate descent. Runs of capitals, numbers and
immediate repeats become marker tokens, so that their n-grams carry over to
words never seen in training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemap.llm.common import chunks, least_hashed, release, spread, table, tidy

DIM_BITS = 20
#: Most labelled documents that the model is fitted on, taken in the order of a hash of their ids.
MAX_LABELLED = 6000
#: Share of good holdout documents that the cutoff may reject.
MAX_FALSE_REJECTION = 0.002
HOLDOUT = 0.25
COST = 1.0
EPOCHS = 20
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _marker(word: str) -> str:
    if word[0].isdigit():
        return "<num>"
    return "<caps>" if len(word) > 1 and word.isupper() else word.lower()


def ngrams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, document, feature) of each chunk of texts: the distinct hashed uni- and bigrams of each document, in order."""
    repeated = np.uint64(xxhash.xxh3_64_intdigest("<rep>"))
    shift = np.uint64(64 - DIM_BITS)
    for a, b in chunks(texts):
        tokens = [_TOKEN.findall(t) if t else [] for t in texts[a:b]]
        n = np.fromiter(map(len, tokens), np.int64, b - a)
        if not n.sum():
            yield a, b, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        codes, vocabulary = pd.factorize(np.array([w for t in tokens for w in t], dtype=object))
        del tokens
        h = np.fromiter((xxhash.xxh3_64_intdigest(_marker(w)) for w in vocabulary), np.uint64, len(vocabulary))[codes]
        doc = np.repeat(np.arange(b - a), n)
        together = doc[1:] == doc[:-1]
        h[1:][together & (codes[1:] == codes[:-1])] = repeated
        two = ((h[:-1] * _MIX) ^ (h[1:] + (h[:-1] >> np.uint64(29)))) * _MIX
        feature = np.concatenate([h * _MIX >> shift, two[together] >> shift]).astype(np.int64)
        key = np.unique(np.concatenate([doc, doc[1:][together]]) << DIM_BITS | feature)
        yield a, b, key >> DIM_BITS, key & ((1 << DIM_BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    cutoff: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Margins; 0 for texts without a token."""
        out = np.zeros(len(texts))
        for a, b, doc, feature in ngrams(texts):
            n = np.bincount(doc, minlength=b - a)
            total = np.bincount(doc, self.weights[feature], minlength=b - a)
            out[a:b] = np.where(n > 0, total / np.sqrt(np.maximum(n, 1)) + self.bias, 0.0)
        return out


def dual_descent(values: list[np.ndarray], at: list[np.ndarray], sides: np.ndarray, cost: np.ndarray, dim: int, rng: np.random.Generator, epochs: int = EPOCHS) -> tuple[np.ndarray, float, np.ndarray]:
    """(w, bias, alpha) of the linear hinge-loss model: least (|w|^2 + bias^2) / 2 + sum of cost * max(0, 1 - side * (w x + bias)), by dual coordinate descent in random order over rows with values at features."""
    w, bias, alpha = np.zeros(dim), 0.0, np.zeros(len(values))
    square = [x @ x + 1 for x in values]
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(values)).tolist():
            x, y = values[i], sides[i]
            gradient = y * (w[at[i]] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y:
                worst, alpha[i] = max(worst, abs(step)), new
                w[at[i]] += step * x
                bias += step
        if worst < 1e-3:
            break
    return w, bias, alpha


def fit(rows: list[np.ndarray], good: np.ndarray, seed: int = 11) -> Model | None:
    """Model from the feature ids of each document; None unless both classes occur."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = max(1, int(len(rows) * HOLDOUT))
    test, train = order[:held], order[held:]
    train = np.array([i for i in train if len(rows[i])], dtype=int)
    if not len(train) or good[train].all() or not good[train].any():
        return None
    counts = []
    for kind in (True, False):
        c = np.ones(1 << DIM_BITS)
        np.add.at(c, np.concatenate([rows[i] for i in train if good[i] == kind]), 1)
        counts.append(c / c.sum())
    ratio = np.log(counts[0] / counts[1])
    share = good[train].mean()
    cost = np.where(good[train], COST * 0.5 / share, COST * 0.5 / (1 - share))
    w, bias, _ = dual_descent([ratio[rows[i]] / np.sqrt(len(rows[i])) for i in train], [rows[i] for i in train], np.where(good[train], 1.0, -1.0), cost, 1 << DIM_BITS, rng)
    model = Model((w * ratio).astype(np.float32), bias, 0.0)
    margins = np.sort([model.weights[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + bias if len(rows[i]) else 0.0 for i in test if good[i]])
    if len(margins):
        model.cutoff = min(0.0, float(margins[int(len(margins) * MAX_FALSE_REJECTION)]))
    return model


def labelled_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature ids and goodness of at most limit labelled documents. A document whose labels differ counts as bad."""
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_gm_id")).agg(F.min(F.col("quality").cast("int")).alias("_gm_good"))
    chosen = least_hashed(chosen, "_gm_id", limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b, doc, feature in ngrams(texts):
                offsets = np.searchsorted(doc, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(feature.astype(np.int32)))
                order = pa.array([xxhash.xxh3_64_intdigest(t or "") >> 1 for t in texts[a:b]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), order, batch.column(1).slice(a, b - a), lists], ["id", "text", "good", "features"])

    # the sample is bounded by `limit`, so that it can be sent to the documents whatever their number
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("_gm_id"), F.col("text").cast("string").alias("_gm_text"))).join(F.broadcast(chosen), "_gm_id")
    found = texts.select("_gm_id", "_gm_good", "_gm_text").mapInArrow(tidy(run), "id long, text long, good int, features array<int>").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    rows = [x.values.to_numpy().astype(np.int64) for x in found["features"]]
    return rows, np.array(found["good"].to_pylist(), dtype=int) > 0


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model | None:
    return fit(*labelled_rows(docs, labels, limit))


def margin(model: Model | None, text: Column) -> Column:
    """The model's margin minus its cutoff: a document below 0 is rejected. Null texts count as empty; without a model all are 0."""
    if model is None:
        return F.lit(0.0)
    # of fixed size: 2**DIM_BITS floats
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        m = shared.value
        out = pd.Series(m.score(texts.where(texts.notna(), None).tolist()) - m.cutoff)
        release()
        return out

    # not deterministic in the planner's eyes, else it would copy a filter on the margin below the projection and score each text twice
    return run.asNondeterministic()(text)


def good_documents(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """docs without those that the classifier rejects, all their columns as they are.

    The model is fitted on labelled rows of docs itself. A text without a
    token (null, empty) has no evidence against it and stays, as does every row
    when the labels lack a class or no labelled document is there. Each row is
    judged by its own text, read to its end, so that repeated rows meet the
    same fate, and rows of one id with different texts each their own; all of
    those are fitted on. An empty table stays empty.
    """
    model = train(docs, labels, limit)
    return spread(docs).filter(margin(model, F.col("text").cast("string")) >= 0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, margin) of each document that the classifier keeps."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return spread(docs.select("doc_id", "text")).select("doc_id", margin(model, F.col("text")).alias("margin")).filter("margin >= 0")
