"""Quality by regularised quadratic discriminant analysis over transformed statistics of a text.

Each class is a normal distribution of the transformed statistics, its covariance shrunk towards a mix of the pooled
covariance and its diagonal. A text's score is the logistic of the difference of the two log-densities (Mahalanobis
distances by triangular solves with the Cholesky factors, which are computed once), scaled and shifted to fit the
training labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, remainder, training_rows

#: At most so many labelled documents are learned from.
TRAINING_ROWS = 12_000
THRESHOLD = 0.7
#: Shares of the pooled covariance and of its diagonal in a class's covariance.
POOLED, DIAGONAL = 0.1, 0.05
N_STATISTICS = 13
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def shares(text: bytes) -> np.ndarray:
    """How often each byte occurs."""
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of a whole text; a text without words has those of no words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * N_STATISTICS
    h = shares(text)
    points = int(h[:128].sum() + h[192:].sum())
    space = int(h[9:14].sum() + h[32])
    inside = max(1, points - space)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words[1:], words))
    distinct = len(set(words))
    lower = int(h[97:123].sum())
    upper = int(h[65:91].sum())
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(n)),
        float(np.log(inside / n)),
        float(np.log(n / distinct) / np.log1p(n)),
        root(same / n),
        root(h[SYMBOLS].sum() / inside),
        root(h[124] / n),
        root(upper / (upper + lower + 1)),
        root(h[48:58].sum() / inside),
        root((h[44] + h[46] + h[59] + h[58]) / n),
        root(h[33] / n),
        root(1 - len(set(lines)) / len(lines)),
        float(np.log(n / len(lines) + 1)),
        root((h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()) / inside),
    ]


@dataclass
class Model:
    """means and inverse Cholesky factors by class, scale of the statistics, slope and base of the logistic."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    slope: float = 1.0
    base: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log-density in class 1 less that in class 0."""
        z, out = (x - self.centre) / self.scale, []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            out.append(-0.5 * ((z - mean) @ factor.T) ** 2 @ np.ones(z.shape[1]) - 0.5 * logdet)
        return out[1] - out[0] if len(out) == 2 else np.zeros(len(z))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.base, -30, 30)))


def collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the training rows, at most TRAINING_ROWS short arrays."""

    def run(batches):
        for b in batches:
            x = [statistics(t.encode() if t else None) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    found = sorted((tuple(r.x), int(r.y > 0)) for r in rows.select("label", "text").mapInArrow(run, "y int, x array<double>").collect())
    return np.array([x for x, _ in found]).reshape(-1, N_STATISTICS), np.array([y for _, y in found], float)


def fitted(x: np.ndarray, y: np.ndarray) -> Model:
    """With one class only, or none, every text gets the share of ones (0.5 without rows)."""
    d = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(d), np.ones(d), [], [], [], 0.0, float(np.log(share / (1 - share))))
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - centre) / scale
    means, scatter, sizes = [], [], []
    for c in (0, 1):
        part = z[y == c]
        means.append(part.mean(0))
        scatter.append((part - means[c]).T @ (part - means[c]))
        sizes.append(len(part))
    pooled = (scatter[0] + scatter[1]) / len(y)
    factors, logdets = [], []
    for c in (0, 1):
        own = (scatter[c] + d * pooled) / (sizes[c] + d)  # small classes lean on the pooled covariance
        cov = (1 - POOLED - DIAGONAL) * own + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        logdets.append(float(2 * np.log(np.diag(low)).sum()))
    out = Model(centre, scale, means, factors, logdets)
    v = np.clip(out.difference(x), -50, 50)
    a, b = 0.1, float(np.log(share / (1 - share)))
    for _ in range(100):  # Newton's method, with a mild pull to a flat curve
        p = 1 / (1 + np.exp(-np.clip(a * v + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - y) * v).sum() + 0.1 * a, (p - y).sum() + 0.01 * b])
        h = np.array([[(w * v * v).sum() + 0.1, (w * v).sum()], [(w * v).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 0.5 / max(1e-12, abs(step[0])))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    out.slope, out.base = float(max(a, 0.0)), float(b)
    return out


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", bound: int = TRAINING_ROWS) -> Model:
    """Learns from at most ``bound`` labelled documents outside the hold-out."""
    return fitted(*collected(training_rows(docs, labels, "quality", bound, doc_id, text)))


def quality(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1, higher: better) and predicted (1 from 0.7 on) to the columns of ``carry`` (default: all).

    Null, empty and wordless texts are scored by statistics that are all 0. Carried columns named score or predicted
    are returned as score_in and predicted_in.
    """

    def setup():
        def work(texts):
            s = model.score(np.array([statistics(t) for t in texts]).reshape(-1, N_STATISTICS))
            return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

        return work

    return map_text(docs, text, setup, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], carry)


def op7(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality(docs, learn(docs, labels), carry=["doc_id"])
    return rows.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
