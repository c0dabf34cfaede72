"""Quality rules by labelling lines: a linear-chain conditional random field marks content and boilerplate.

Each line with a word is described by a few features; the field has a weight for each feature and label and one for
each pair of labels of neighbouring lines. Viterbi decoding finds the best labels of all lines of a text together. The
share of words in content lines decides whether the text is kept.

Lines carry no labels of their own: only documents do. So the lines' labels are hidden, and learned by expectation and
maximisation: a line of a good document is content with PURE odds to begin with, one of a bad document boilerplate;
each round takes the labels' and label pairs' probabilities under the field and these odds for the truth of the next.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text, training_rows
from .quality_classifier import SYMBOLS, shares

#: At most so many labelled documents are learned from, all lines of each, in runs of SEGMENT.
TRAINING_ROWS, SEGMENT = 3_000, 16
#: How sure a document's label is of a line before the field is heard, and rounds of learning with steps of each.
PURE, ROUNDS, STEPS = 0.9, 3, 50
#: Pulls to zero. That of the steps is stronger, as documents of one kind alone would make a change of label impossible.
PULL, PULL_STEPS = 1e-4, 2e-2
N_FEATURES = 12
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split() if text else []
    if not words:
        return 0, 0, int(shares(text)[SYMBOLS].sum()) if text else 0, 0, 0
    h = shares(text)
    chars = int(h[:128].sum() + h[192:].sum() - h[9:14].sum() - h[32])
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, int(h[SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of 5 words that the text has twice or more."""
    n, k = len(words), REPEAT_WINDOW
    if n <= k:
        return 0
    number: dict[bytes, int] = {}
    code = ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    base, width = len(number), 1
    if len(number) == n:
        return 0
    if base < 6_000:  # five numbers fit in 63 bits
        m = n - k + 1
        code = ids[:m].copy()
        for j in range(1, k):
            code = code * base + ids[j : j + m]
    else:
        for step in (1, 2, 1):  # windows of 2, 4 and 5 words, each numbered anew
            m = len(code) - step
            code = code[:m] * (max(base, int(code.max()) + 1)) + (code[step : step + m] if width + step != k else ids[width : width + m])
            code = np.unique(code, return_inverse=True)[1]
            width += step
    order = np.argsort(code, kind="stable")
    s = code[order]
    twice = np.zeros(len(s), bool)
    twice[1:] |= s[1:] == s[:-1]
    twice[:-1] |= s[1:] == s[:-1]
    edge = np.zeros(n + 1, np.int64)
    at = order[twice]
    edge[at] += 1
    edge[at + k] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def line_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line with a word, and its number of words."""
    rows, sizes = [], []
    seen: set[bytes] = set()
    for line in text.split(b"\n") if text else []:
        words = line.split()
        n = len(words)
        if not n:
            continue
        h = shares(line)
        chars = max(1, int(h[:128].sum() + h[192:].sum() - h[9:14].sum() - h[32]))
        upper, lower = int(h[65:91].sum()), int(h[97:123].sum())
        same = sum(map(bytes.__eq__, words[1:], words))
        rows.append(
            (
                1.0, min(n, 40) / 40, (chars / n - 5) / 5, (int(h[SYMBOLS].sum()) / chars) ** 0.5, (int(h[124]) / n) ** 0.5, upper / (upper + lower + 1),
                (same / n) ** 0.5, 1 - len(set(words)) / n, (int(h[48:58].sum()) / chars) ** 0.5, float(line.rstrip()[-1:] in b".!?"), (int(h[33]) / n) ** 0.5, float(line in seen),
            )
        )
        sizes.append(n)
        seen.add(line)
    return np.array(rows).reshape(-1, N_FEATURES), np.array(sizes, np.int64)


@dataclass
class Field:
    """weights[label, feature], steps[label, next label]; label 1 is content. Kept: content share of least or more."""

    weights: np.ndarray
    steps: np.ndarray
    least: float = 0.5

    def labels(self, x: np.ndarray) -> np.ndarray:
        """The best labels of the lines together (Viterbi); ties go to boilerplate."""
        emit = (x @ self.weights.T).tolist()
        if not emit:
            return np.zeros(0, np.int64)
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = emit[0]
        back = []
        for e0, e1 in emit[1:]:
            from0, from1 = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + s00 if from0 else b + s10) + e0, (a + s01 if from1 else b + s11) + e1
        now = 1 if b > a else 0
        out = [now]
        for choice in reversed(back):
            now = choice[now]
            out.append(now)
        return np.array(out[::-1], np.int64)

    def content_share(self, text: bytes | None) -> float:
        x, sizes = line_features(text)
        return float((self.labels(x) * sizes).sum() / sizes.sum()) if len(sizes) else 0.0


class Chains:
    """Runs of lines with the label of their document, side by side."""

    def __init__(self, segments: list[tuple[np.ndarray, int]]) -> None:
        n, longest = len(segments), max(len(x) for x, _ in segments)
        self.y, self.size = np.array([c for _, c in segments]), np.array([len(x) for x, _ in segments])
        self.x = np.zeros((n, longest, N_FEATURES))
        for i, (x, _) in enumerate(segments):
            self.x[i, : len(x)] = x
        self.live = np.arange(longest)[None, :] < self.size[:, None]
        lines = np.array([max(1, self.size[self.y == c].sum()) for c in (0, 1)])
        self.weight = (0.5 / lines)[self.y]  # each class of documents weighs the same

    def expected(self, weights: np.ndarray, steps: np.ndarray, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the lines' labels, and of the pairs of neighbours' labels (forward and backward). prior: log
        odds of the labels by the document's."""
        emit = self.x @ weights.T + (prior[self.y][:, None, :] if prior is not None else 0)
        e, s = np.exp(emit - emit.max(2, keepdims=True)), np.exp(steps - steps.max())
        forward, backward = np.empty_like(e), np.ones_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, e.shape[1]):
            v = (forward[:, t - 1] @ s) * e[:, t]
            forward[:, t] = np.where(self.live[:, t, None], v / v.sum(1, keepdims=True), forward[:, t - 1])
        for t in range(e.shape[1] - 2, -1, -1):
            v = (e[:, t + 1] * backward[:, t + 1]) @ s.T
            backward[:, t] = np.where(self.live[:, t + 1, None], v / v.sum(1, keepdims=True), 1.0)
        node = forward * backward
        node *= self.live[..., None] / node.sum(2, keepdims=True)
        pair = forward[:, :-1, :, None] * s * (e[:, 1:] * backward[:, 1:])[:, :, None, :]
        return node, pair * (self.live[:, 1:] / pair.sum((2, 3)))[..., None, None]

    def sums(self, node: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """What the field's parameters gain from labels with these probabilities."""
        by_line = (node * self.weight[:, None, None]).reshape(-1, 2).T @ self.x.reshape(-1, N_FEATURES)
        return np.concatenate([by_line.ravel(), np.tensordot(self.weight, pair.sum(1), 1).ravel()])


def train(segments: list[tuple[np.ndarray, int]], rounds: int = ROUNDS, steps: int = STEPS) -> Field:
    """Learns the field from runs of lines and their documents' labels: rounds of expectation, each followed by Adam steps
    up the expected likelihood."""
    chains = Chains(segments)
    prior = np.log(np.array([[PURE, 1 - PURE], [1 - PURE, PURE]]))
    sticky = np.log(np.array([[PURE, 1 - PURE], [1 - PURE, PURE]]))
    cut, theta, pull = 2 * N_FEATURES, np.zeros(2 * N_FEATURES + 4), np.repeat([PULL, PULL_STEPS], [2 * N_FEATURES, 4])
    split = lambda v: (v[:cut].reshape(2, -1), v[cut:].reshape(2, 2))
    for r in range(rounds):
        weights, between = split(theta)
        truth = chains.sums(*chains.expected(weights, between if r else sticky, prior))
        moment, spread = 0.0, 0.0
        for k in range(1, steps + 1):
            g = truth - chains.sums(*chains.expected(*split(theta))) - pull * theta
            moment, spread = 0.9 * moment + 0.1 * g, 0.99 * spread + 0.01 * g * g
            theta = theta + 0.15 * (moment / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.99**k)) + 1e-8)
    return Field(*split(theta))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", bound: int = TRAINING_ROWS) -> Field:
    """Learns from at most ``bound`` labelled documents outside the hold-out (crc32 remainder 2 of 4). With one class
    only, or none, every line is content."""

    def run(batches):
        for b in batches:
            y, x, w = [], [], []
            for label, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f, sizes = line_features(t.encode() if t else None)
                y.append(int(label > 0))
                x.append(f.astype(np.float32).tobytes())
                w.append(sizes.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.binary()), pa.array(w, pa.binary())], ["y", "x", "w"])

    rows = training_rows(docs, labels, "quality", bound, doc_id, text).select("label", "text")
    # 52 bytes for each line of at most ``bound`` documents
    found = sorted((bytes(r.x), r.y, bytes(r.w)) for r in rows.mapInArrow(run, "y int, x binary, w binary").collect() if r.x)
    every = [(np.frombuffer(x, np.float32).reshape(-1, N_FEATURES).astype(float), y, np.frombuffer(w, np.int32)) for x, y, w in found]
    if len({y for _, y, _ in every}) < 2:
        content = Field(np.zeros((2, N_FEATURES)), np.zeros((2, 2)))
        content.weights[1, 0] = 1.0
        return content
    out = train([(x[i : i + SEGMENT], y) for x, y, _ in every for i in range(0, len(x), SEGMENT)])
    share = np.array([(out.labels(x) * w).sum() / w.sum() for x, _, w in every])
    y = np.array([y for _, y, _ in every])
    # the share at which both classes together are told apart best; of equals the one nearest to a half
    grid = np.linspace(0.05, 0.95, 19)
    right = [(share[y == 1] >= g).mean() + (share[y == 0] < g).mean() for g in grid]
    out.least = float(max(zip(right, -np.abs(grid - 0.5), grid, strict=True))[2])
    return out


def quality_rules(docs: DataFrame, model: Field, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share and kept to the
    columns of ``carry`` (default: all).

    Words are [^\\x20\\x09-\\x0D]+. Null, empty and wordless texts have no words, fail the base rules and aren't kept.
    Equal texts get equal results. A carried column with such a name is returned with _in behind it.
    """

    def setup():
        def work(texts):
            base = [base_counts(t) for t in texts]
            failed = [c[0] < MIN_WORDS or 100 * c[4] > REPEAT_PERCENT * c[0] for c in base]
            share = [model.content_share(t) for t in texts]
            kept = [not f and s >= model.least for f, s in zip(failed, share, strict=True)]
            return [*[pa.array([c[i] for c in base], pa.int64()) for i in range(5)], pa.array(failed), pa.array(share, pa.float64()), pa.array(kept)]

        return work

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [*[T.StructField(n, T.LongType()) for n in names], T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return map_text(docs, text, setup, fields, carry)


def op4(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, learn(docs, labels), carry=["doc_id"])
