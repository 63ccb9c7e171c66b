"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of transformed statistics; covariances
are shrunk towards the pooled one and its diagonal. A document's score is the
logistic of the difference of the two log densities (Mahalanobis distances
through Cholesky factors, which are computed once and broadcast) plus the log
prior ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import chunks, lean, materialise, utf8

NAMES = ("length", "words", "word_len", "upper", "digit", "symbol", "line", "spread", "repeat", "stutter", "common", "bytes", "marks", "mark_mark", "letter_mark", "mark_letter", "space_mark", "mark_space", "letter_digit")
#: Bytes counted as symbols: ASCII punctuation but . , ; : ' " - ? ( ).
_TABLE = np.zeros((256, 4), bool)
_TABLE[0x41:0x5B, 0] = True  # upper
_TABLE[0x30:0x3A, 1] = True  # digit
for _c in b"!#$%&*+/<=>@[\\]^_`{|}~":
    _TABLE[_c, 2] = True
_TABLE[0x0A, 3] = True  # line
#: Kinds of bytes: 0 letters and all non-ASCII, 1 digits, 2 spaces, 3 marks (all else).
_KIND = np.where(ts.LETTERS, 0, 3).astype(np.int64)
_KIND[0x30:0x3A] = 1
_KIND[~ts.SPACED] = 2


def _entropy(count: np.ndarray) -> np.ndarray:
    """Bits a symbol of each row of counts."""
    share = count / np.maximum(count.sum(axis=1), 1)[:, None]
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)


def _counted(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each row's bytes, and of its pairs of neighbouring kinds. Long rows are counted in pieces, as a byte takes some tens of bytes on the way."""
    rows = len(offsets) - 1
    bytes_of, pair = np.zeros((rows, 256)), np.zeros((rows, 16))
    for lo in range(0, len(data), piece):
        part = data[lo : lo + piece + 1]  # and the byte after, for the last pair
        hi = min(lo + piece, len(data))
        a, b = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
        at = np.repeat(np.arange(b - a), np.diff(np.clip(offsets[a : b + 1], lo, hi)))
        bytes_of[a:b] += np.bincount(at * 256 + part[: hi - lo], minlength=(b - a) * 256).reshape(-1, 256)
        kind = _KIND[part]
        inner = np.ones(len(part) - 1, bool)
        ends = offsets[(offsets > lo) & (offsets <= lo + len(inner))]
        inner[ends - lo - 1] = False
        pair[a:b] += np.bincount((at[: len(inner)] * 16 + kind[:-1] * 4 + kind[1:])[inner], minlength=(b - a) * 16).reshape(-1, 16)
    return bytes_of, pair


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics (rows x len(NAMES)) of whole texts: sizes, shares of kinds of bytes and of their neighbourships, entropies, repetition.

    Ratios are damped by 20 bytes or 5 words, so that short texts stay near the middle.
    """
    n = np.diff(offsets).astype(np.float64)
    out = np.zeros((len(n), len(NAMES)))
    bytes_of, pair = _counted(data, offsets)
    count = bytes_of @ _TABLE.astype(np.float64)
    w = ts.words(data, offsets, ts.SPACED)
    words = w.counts.astype(np.float64)
    row = w.row
    same = np.zeros(len(w.hashes), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
    stutter = np.bincount(row[same], minlength=len(n)).astype(np.float64)
    lengths = np.bincount(row, weights=(w.end - w.begin), minlength=len(n))
    sets, first = ts.distinct_sorted(w.hashes.copy(), w.first.copy())
    distinct = np.diff(first).astype(np.float64)
    common = np.bincount(row[(w.end - w.begin) <= 3], minlength=len(n)).astype(np.float64)
    bytes_, many = n + 20, words + 5
    marks = bytes_of[:, _KIND == 3]
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.log1p(words)
    out[:, 2] = np.log((lengths + 25) / many)
    out[:, 3:7] = np.sqrt(count / bytes_[:, None])
    out[:, 7] = np.log((distinct + 5) / (np.sqrt(words) + 5))
    out[:, 8] = np.sqrt((words - distinct) / many)
    out[:, 9] = np.sqrt(stutter / many)
    out[:, 10] = np.sqrt(common / many)
    out[:, 11] = _entropy(bytes_of)
    out[:, 12] = _entropy(marks) * marks.sum(axis=1) / (marks.sum(axis=1) + 5)
    for j, pairs in enumerate(((15,), (3,), (12,), (11,), (14,), (1, 4))):
        out[:, 13 + j] = np.sqrt(pair[:, pairs].sum(axis=1) / bytes_)
    return out


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants by class, and the log prior ratio."""

    mean: np.ndarray
    factor: np.ndarray
    logdet: np.ndarray
    prior: float

    @classmethod
    def fit(cls, n: np.ndarray, s: np.ndarray, q: np.ndarray, pool: float = 0.5, ridge: float = 0.1) -> Model | None:
        """From counts, sums and sums of outer products by class; None unless both classes have a row.

        Covariance of a class: (1 - pool) its own + pool the pooled one, then (1 - ridge) that + ridge its diagonal + a floor.
        """
        if (n < 1).any():
            return None
        mean = s / n[:, None]
        own = [q[c] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
        pooled = (own[0] + own[1]) / 2
        factor, logdet = [], []
        for c in (0, 1):
            m = (1 - pool) * own[c] + pool * pooled
            m = (1 - ridge) * m + ridge * np.diag(np.diag(m)) + 1e-4 * np.eye(len(m))
            low = np.linalg.cholesky(m)
            factor.append(np.linalg.inv(low))
            logdet.append(2 * np.log(np.diag(low)).sum())
        return cls(mean, np.array(factor), np.array(logdet), float(np.log(n[1] / n[0])))

    def score(self, x: np.ndarray) -> np.ndarray:
        side = [((x - self.mean[c]) @ self.factor[c].T) for c in (0, 1)]
        log = [-0.5 * ((z * z).sum(axis=1) + self.logdet[c]) for c, z in enumerate(side)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + self.prior, -700, 700)))


def _featured(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows = [features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks(offsets)]
            x = np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), vec], names=[*keep, "x"])

    return lean(run)


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and x (array of double) of every row; null text counts as empty."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_featured(keep), f"{schema}, x array<double>")


def fit(featured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", train=None) -> Model | None:
    """Fit on all labelled rows of ``featured`` (id, x) for which the condition ``train`` holds.

    Sums are taken per partition and then together, so no row reaches the
    driver. Labels other than 0 and 1 and null ids are ignored.
    """
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("int").alias("y"))
    if train is not None:
        y = y.where(train)
    d = len(NAMES)

    def moments(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x, c = batch.column("x").flatten().to_numpy().reshape(-1, d), batch.column("y").to_numpy()
            for k in (0, 1):
                part = x[c == k]
                n[k] += len(part)
                s[k] += part.sum(axis=0)
                q[k] += part.T @ part
        flat = np.concatenate([n, s.ravel(), q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    sums = featured.join(y, id_col).select("x", "y").mapInArrow(lean(moments), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for r in sums.collect():  # 2 + 2 d + 2 d d numbers
        flat[r.i] = r.v
    return Model.fit(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d))


def scored(df: DataFrame, model: Model | None) -> DataFrame:
    """``df`` with score instead of x. Without a model (no labels of one class) every score is 0.5."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c != "x"]

    def run(batches):
        for batch in batches:
            x, m = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES)), shared.value
            y = m.score(x) if m is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(y)], names=[*keep, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.mapInArrow(lean(run), f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, train=None, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, score (double) and predicted (int, 1 from ``threshold`` on).

    Null and empty texts get the score of an empty text. Repeated ids are
    scored row by row and each counts in the fit. Columns of ``docs`` other
    than the id and text are never read.
    """
    featured = materialise(with_features(docs, [id_col]), "features")
    model = fit(featured, labels, id_col, train=train)
    return scored(featured, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, train=None, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns. The text is read twice and never shuffled.

    Null and empty texts are judged as an empty text; repeated rows one by one;
    without labels of both classes every row stays.
    """
    featured = materialise(with_features(docs, [id_col]), "features")
    model = docs.sparkSession.sparkContext.broadcast(fit(featured, labels, id_col, train=train))
    names = docs.columns

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows = [features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks(offsets)]
            if rows:
                m = model.value
                good = m.score(np.concatenate(rows)) >= threshold if m is not None else np.ones(batch.num_rows, bool)
                yield batch.filter(pa.array(good))

    return docs.select(*names).mapInArrow(lean(run), docs.schema)
