"""Quality classifier: regularised quadratic discriminant.

Every text becomes a few transformed statistics, in one pass.  Per class the
mean and covariance of the labelled rows follow from sums that executors add
up, so all labelled rows count and only ``2 * (1 + d + d*d)`` numbers reach the
driver.  Covariances are shrunk towards their pooled diagonal and factored once
(Cholesky); a text's score is the logistic of the difference of the classes'
log-densities, by Mahalanobis distance from the cached factors, with the
classes' log prior.  The difference is divided by ``sqrt(d)``, as statistics
of one text are not independent.

Defined results: a null or empty text has all statistics 0 and is scored like
any other; labels that are null or neither 0 nor 1 teach nothing; with a class
missing the score is the share of label 1 (0.5 if nothing is labelled);
repeated rows get equal scores; repeated labels count as often as they stand;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import stage, table

SHRINK = 0.2
THRESHOLD = 0.3
NAMES = (
    "log_words", "word_length", "word_length_sd", "symbols", "upper", "digits", "punctuation", "exclamation",
    "bars", "ended_lines", "line_words", "distinct", "twice", "most_common", "short_words", "repeated_lines",
)
#: Bytes of each class that is counted.
CLASSES = (b"#*$%&|<>@~^\\=+_", bytes(range(65, 91)), b"0123456789", b".,;:!?\"'()-", b"!", b"|")
LOOK = np.zeros((256, len(CLASSES)), dtype=np.float64)
for _i, _c in enumerate(CLASSES):
    LOOK[list(_c), _i] = 1
ENDS = (".", "!", "?", ":", ";", '"', "'", ")", "…", "”")


def statistics(text: str) -> np.ndarray:
    out = np.zeros(len(NAMES))
    words = text.split()
    if not words:
        return out
    n = len(words)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    by_class = np.bincount(raw, minlength=256) @ LOOK
    chars = max(len(text), 1)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [s for s in text.split("\n") if s and not s.isspace()]
    counts = Counter(words)
    twice = sum(map(str.__eq__, words[1:], words))
    out[:] = (
        np.log1p(n),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        np.log1p(20 * by_class[0] / n),
        np.log1p(20 * by_class[1] / chars),
        np.log1p(20 * by_class[2] / chars),
        np.log1p(20 * by_class[3] / n),
        np.log1p(20 * by_class[4] / n),
        np.log1p(20 * by_class[5] / n),
        sum(s.rstrip().endswith(ENDS) for s in lines) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)),
        np.log(len(counts) / n),
        np.log1p(20 * twice / n),
        np.log1p(20 * max(counts.values()) / n),
        np.mean(lengths <= 3),
        np.log1p(20 * (len(lines) - len(set(lines))) / max(len(lines), 1)),
    )
    return out


@dataclass
class Model:
    means: np.ndarray
    inverse: np.ndarray
    """Inverted Cholesky factors, one per class."""
    offset: np.ndarray
    """Log prior less half the log determinant, per class."""
    share: float

    @staticmethod
    def fit(n: np.ndarray, s: np.ndarray, ss: np.ndarray, shrink: float = SHRINK) -> Model:
        """From per-class counts, sums and sums of outer products."""
        d = s.shape[1]
        share = float(n[1] / n.sum()) if n.sum() else 0.5
        if n.min() < 2:
            return Model(np.zeros((2, d)), np.zeros((2, d, d)), np.log([max(1 - share, 1e-9), max(share, 1e-9)]) * np.sqrt(d), share)
        means = s / n[:, None]
        covs = ss / n[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = np.diag(np.maximum(np.diagonal(covs, axis1=1, axis2=2).mean(axis=0), 1e-4))
        factors = [np.linalg.cholesky((1 - shrink) * c + shrink * pooled) for c in covs]
        inverse = np.stack([np.linalg.inv(f) for f in factors])
        log_det = np.array([np.log(np.diag(f)).sum() for f in factors])
        return Model(means, inverse, np.log([1 - share, share]) * np.sqrt(d) - log_det, share)

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = [
            self.offset[k] - 0.5 * (((x - self.means[k]) @ self.inverse[k].T) ** 2).sum(axis=1) for k in (0, 1)
        ]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / np.sqrt(x.shape[1]), -30, 30)))


def measure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``stats``, the text's statistics as an array."""

    def run(batches):
        for batch in batches:
            x = np.zeros((batch.num_rows, len(NAMES)))
            for i, t in enumerate(batch.column(1)):
                x[i] = statistics(t.as_py() or "")
            stats = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["id", "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, stats array<double>").withColumnRenamed("id", id_col)


def fit(labelled: DataFrame, shrink: float = SHRINK) -> Model:
    """From ``labelled(stats, label)``; all rows count."""
    d = len(NAMES)

    def run(batches):
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist())
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        label, place = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label.ravel(), pa.int32()), pa.array(place.ravel(), pa.int32()), pa.array(sums.ravel())], names=["label", "place", "value"]
        )

    rows = labelled.where("label in (0, 1)").select("stats", F.col("label").cast("int")).mapInArrow(run, "label int, place int, value double")
    sums = np.zeros((2, 1 + d + d * d))
    for r in rows.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        sums[r["label"], r["place"]] = r["value"]
    return Model.fit(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d), shrink)


def score(measured: DataFrame, model: Model, id_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["id", "score"])

    kind = measured.schema[id_col].dataType.simpleString()
    return measured.select(id_col, "stats").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col, score`` of every row; rows of ``labels`` where ``teaches`` holds are learned from."""
    measured = stage(measure(docs, id_col, text_col), "quality-stats")
    own = labels.where(teaches).select(F.col(id_col), F.col(label_col).alias("label"))
    return score(measured, fit(own.join(measured, id_col)), id_col)


def op8_quality_score(spark, sf_dir: str) -> DataFrame:
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), part != 0)
    return out.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
