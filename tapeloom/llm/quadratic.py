"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Method: each text gives ``FEATURES``, ratios pulled towards a common value for short texts and put on log or logit scales.
Per class the mean and covariance are summed over all labelled rows in Spark; the covariance is shrunk towards the pooled
diagonal. The score is the logistic of the difference of the two log densities (Mahalanobis distances through cached Cholesky
factors) plus the log prior odds. Only the text is read for features.

What reaches the driver is one row of sums per class and pair of features. Fitting uses every label; nothing is sampled.

Defined cases: null and empty texts have the features of no evidence and a score like any other; label rows that are
null, not 0 or 1, or of unknown documents are ignored, repeated ones count each; with a class missing the score is the
prior; an empty table gives no rows; further columns are kept. A null doc_id is not held out and never labelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.tables import free_name, map_arrow, quoted, store
from tapeloom.llm.wordhash import NOT_SPACE, U, Words, mix, words_of

FEATURES = ["symbols", "pipes", "exclamations", "capitals", "digits", "marks", "word_bytes", "same_as_before", "distinct", "same_lines", "words"]
SHRINKAGE, ACCEPT = 0.1, 0.7


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(characters.encode())] = 1
    return out


CLASSES = {
    "symbols": _table("#*$%&<>@=^~{}[]\\/+_"), "pipes": _table("|"), "exclamations": _table("!"),
    "capitals": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _table("0123456789"), "marks": _table(".,;:?"),
}
#: Expected share and weight (bytes or words) of the pull for short texts.
PULL = {"symbols": (0.001, 200.0), "pipes": (0.0005, 200.0), "exclamations": (0.0005, 200.0), "capitals": (0.03, 100.0), "digits": (0.003, 200.0), "marks": (0.03, 100.0)}
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False


def _distinct(w: Words, n: int) -> np.ndarray:
    """Number of different words of each text."""
    _, first = np.unique(mix(w.hash + w.text.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(w.text[first], minlength=n)


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    out = []
    lines = words_of(column, NOT_NEWLINE)
    for (_, _, w), (_, _, line) in zip(words_of(column, NOT_SPACE), lines, strict=True):
        n = len(w.counts)
        size = np.diff(w.offsets).astype(float)
        columns = []
        for name, table in CLASSES.items():
            total = np.concatenate(([0], np.cumsum(table[w.data])))
            share, weight = PULL[name]
            columns.append(np.log((np.diff(total[w.offsets]) + share * weight) / (size + weight)))
        counts = w.counts.astype(float)
        letters = np.bincount(w.text, weights=w.ends - w.starts, minlength=n)
        columns.append(np.log((letters + 6.0 * 20) / (counts + 20)))
        again = np.zeros(len(w), bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
        columns.append(np.log((np.bincount(w.text, weights=again, minlength=n) + 0.2) / (counts + 20)))
        columns.append(np.log((_distinct(w, n) + 20.0) / (counts + 20)) / np.log(counts + 20))
        columns.append(np.log((line.counts - _distinct(line, n) + 0.2) / (line.counts + 5.0)))
        columns.append(np.log(counts + 20))
        out.append(np.stack(columns, axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def with_features(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` without its text, and the features as array<double>."""
    place, kept = docs.columns.index(text), [c for c in docs.columns if c != text]
    places = [docs.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(place))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), lists], names=[*kept, name])
    return map_arrow(docs, run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.ArrayType(T.DoubleType()))]))


class Model(NamedTuple):
    """Per class: mean, inverse Cholesky factor and log determinant; the log prior odds of class 1."""
    means: list
    factors: list
    log_dets: list
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        if not self.means:
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -700, 700)))


def fit(rows: DataFrame, label: str, name: str, shrinkage: float = SHRINKAGE) -> Model:
    """Model from all rows with a label of 0 or 1; sums are made in Spark with map-side combine."""
    d = len(FEATURES)
    x = F.col(quoted(name))
    pairs = F.concat(F.array(F.lit(1.0)), x, F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b))))
    sums = rows.where(F.col(quoted(label)).isin(0, 1)).select(F.col(quoted(label)).alias("c"), F.posexplode(pairs).alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + d + d * d))
    for row in sums.collect():  # 2 * (1 + d + d * d) rows
        total[int(row["c"]), row["i"]] = row["v"]
    n = total[:, 0]
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return Model([], [], [], odds)
    means = total[:, 1 : d + 1] / n[:, None]
    covariances = [total[c, d + 1 :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.diag(sum(np.diag(covariances[c]) * n[c] for c in (0, 1)) / n.sum() + 1e-6)
    factors = [np.linalg.cholesky((1 - shrinkage) * s + shrinkage * pooled) for s in covariances]
    return Model(list(means), [np.linalg.inv(f) for f in factors], [2 * float(np.log(np.diag(f)).sum()) for f in factors], odds)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", accept: float = ACCEPT,
          shrinkage: float = SHRINKAGE) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows whose crc32(doc_id) mod 4 is 2 are held out of the fit."""
    name, out = free_name([doc_id], "features"), free_name([doc_id], "held_out")
    held = F.coalesce(F.crc32(F.col(quoted(doc_id)).cast("string")) % 4 == 2, F.lit(False))
    known = store(with_features(docs.select(F.col(quoted(doc_id)), F.col(quoted(text))), text, name).withColumn(out, held), "features")
    marks = labels.select(F.col(quoted(doc_id)).alias("label_id"), F.col(quoted(label)).alias("label"))
    model = fit(known.where(~F.col(out)).join(marks, F.col(quoted(doc_id)) == F.col("label_id")), "label", name, shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            p = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= accept).astype(np.int32))], names=[doc_id, "held_out", "score", "predicted"])
    fields = [docs.schema[doc_id], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_arrow(known, run, T.StructType(fields))


def model_of(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", shrinkage: float = SHRINKAGE) -> Model:
    """A model from the labelled documents that are not held out."""
    marks = labels.select(F.col(quoted(doc_id)).alias("label_id"), F.col(quoted(label)).alias("label"))
    held = F.coalesce(F.crc32(F.col(quoted(doc_id)).cast("string")) % 4 == 2, F.lit(False))
    rows = docs.where(~held).select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("body"))
    return fit(with_features(rows, "body", "features").join(marks, F.col("id") == F.col("label_id")), "label", "features", shrinkage)


def accept(docs: DataFrame, model: Model, text: str = "text", at: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose score is ``at`` or more."""
    place, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(features(batch.column(place))) >= at)).rename_columns(names)
    return map_arrow(docs, run, docs.schema)
