"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts to Latin ones, digits and signs that stand
for letters to those letters. The lexicon holds whole words and beginnings of words with a weight; hits inside an
exception phrase don't count. The weights of the hits, normalised by the length of the text, give the score through a
logistic curve. Lexicon, exceptions, weights and curve are learned from labelled documents outside the hold-out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, materialised, remainder, training_rows

#: At most so many labelled documents are learned from.
TRAINING_ROWS = 12_000
THRESHOLD = 0.3
#: Lengths of the word beginnings that may become entries, besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Of the entries taken, so large a share may be chance findings (Benjamini-Hochberg).
FALSE_SHARE = 0.05
# Look-alikes and substitutions, by the Latin letter they are read as.
LOOKALIKES = {
    "a": "аα@4ａ", "b": "Ьвβ8", "c": "сϲ", "d": "ԁ", "e": "еєε3", "g": "ɡ", "h": "һн", "i": "іι1!|ı", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м",
    "n": "ո", "o": "оο0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "тτ7+", "u": "υ", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уγ", "z": "ʐ2",
}
FOLD = {ord(c): latin for latin, others in LOOKALIKES.items() for c in others}
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """The lower-cased text with look-alikes folded, sign for sign. A sign such as ! may stand for a letter or not, so
    the borders of a match are looked for in the unfolded text."""
    return text.lower().translate(FOLD)


@dataclass
class Model:
    """words and beginnings: weight by entry; exceptions: phrases of two folded words; slope and base of the curve."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    slope: float = 0.0
    base: float = -4.0

    def score(self, rate: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + self.slope * math.log1p(rate)))))


class Matcher:
    """Counts a text's weighted hits by Aho-Corasick."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.found, self.model, self.empty = ahocorasick.Automaton(), model, not (model.words or model.beginnings)
        kinds: dict[str, list] = {}
        for w, x in model.words.items():
            kinds.setdefault(w, []).append((True, x))
        for w, x in model.beginnings.items():
            kinds.setdefault(w, []).append((False, x))
        for w, k in kinds.items():
            self.found.add_word(w, (w, k))
        self.found.make_automaton()

    def rate(self, text: str) -> float:
        """Weights of the hits for each 100 words. A word counts once, by its heaviest entry."""
        n = len(text.split())
        if self.empty or not n:
            return 0.0
        low, total, best = text.lower(), 0.0, {}
        folded = low.translate(FOLD)
        for end, (entry, kinds) in self.found.iter(folded):
            begin = end + 1 - len(entry)
            if begin and (low[begin - 1].isalpha() or low[begin - 1].isdigit()):
                continue
            after = low[end + 1 : end + 2]
            whole = not (after.isalpha() or after.isdigit())
            for only_whole, weight in kinds:
                if whole or not only_whole:
                    best[begin] = max(best.get(begin, 0.0), weight)
        for begin, weight in best.items():
            if not (self.model.exceptions and self.excepted(folded, begin)):
                total += weight
        return 100.0 * total / n

    def excepted(self, folded: str, begin: int) -> bool:
        """Whether the word at ``begin`` with the word before or after it is an exception phrase."""
        me = WORD.match(folded, begin)
        if not me:
            return False
        after, end = WORD.search(folded, me.end()), begin
        while end and not WORD.match(folded, end - 1, end):
            end -= 1
        start = end
        while start and WORD.match(folded, start - 1, start):
            start -= 1
        phrases = {f"{me.group()} {after.group()}"} if after else set()
        return bool((phrases | ({f"{folded[start:end]} {me.group()}"} if end else set())) & self.model.exceptions)


def entries_of(text: str) -> set[tuple[str, str]]:
    """The candidate entries of a document: ('w', word) and ('b', beginning)."""
    out = set()
    for w in set(WORD.findall(fold(text))):
        if len(w) > 2:
            out.add(("w", w))
        for n in BEGINNINGS:
            if len(w) > n:
                out.add(("b", w[:n]))
    return out


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", bound: int = TRAINING_ROWS) -> Model:
    """Learns from at most ``bound`` labelled documents outside the hold-out. Without both classes the model is empty
    and scores every text alike, under the threshold."""
    # kept, as each step below reads them; at most ``bound`` documents
    rows = materialised(training_rows(docs, labels, "toxic", bound, doc_id, text).select("label", "text"))

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        n = Counter()
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = int(y > 0)
                n[y] += 1
                seen[y].update(entries_of(t or ""))
        rows = [("", "", n[0], n[1])] + [(k, e, seen[0][(k, e)], seen[1][(k, e)]) for k, e in seen[0].keys() | seen[1].keys()]
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[i : i + 20_000], strict=True)], ["kind", "entry", "clean", "toxic"])

    counts = rows.mapInArrow(count, "kind string, entry string, clean long, toxic long").groupBy("kind", "entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counts.filter("kind = ''").first()
    if total is None or not total.clean or not total.toxic:
        return Model()
    share = total.toxic / (total.clean + total.toxic)
    # far more often toxic than the share of toxic documents; as all entries, from at most ``bound`` documents
    strong = counts.filter(f"kind <> '' AND toxic >= 2 AND toxic > 4 * clean * {share / (1 - share)!r} + 1").orderBy(F.desc("toxic"), "clean", "kind", "entry").collect()
    likely = significant([(r.kind, r.entry, r.clean, r.toxic) for r in strong], total.clean, total.toxic)
    model = explain(rows, likely, total.clean, total.toxic)
    learn_exceptions(rows, model)
    fit_curve(rows, model)
    return model


def significant(strong: list[tuple[str, str, int, int]], clean: int, toxic: int) -> list[tuple[str, str, int, int]]:
    """The entries whose toxic documents are too many for chance."""
    share = toxic / (clean + toxic)

    def log_tail(k: int, n: int) -> float:
        """log P(X >= k), X binomial with n trials and the share of toxic documents: terms until they change nothing."""
        first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
        term = total = 1.0
        for i in range(k, n):
            term *= (n - i) / (i + 1) * share / (1 - share)
            total += term
            if term < 1e-17 * total:
                break
        return first + math.log(total)

    ranked = sorted((log_tail(t, t + c), k, e, c, t) for k, e, c, t in strong if t / (t + c) >= min(0.6, 4 * share))
    tested = max(2_000, len(strong))
    last = max((i for i, x in enumerate(ranked) if x[0] <= math.log(FALSE_SHARE * (i + 1) / tested)), default=-1)
    return [x[1:] for x in ranked[: last + 1]]


def explain(rows: DataFrame, likely: list[tuple[str, str, int, int]], clean: int, toxic: int) -> Model:
    """Takes entries one by one, each time the one that explains most toxic documents that have none yet, less half
    its clean ones or more: words that merely stand in the same documents, or in copies of them, explain nothing new.
    Of equals a whole word comes before a beginning, and a longer entry before a shorter one."""
    number = {(k, e): i for i, (k, e, _, _) in enumerate(likely)}

    def present(batches):
        for batch in batches:
            out = [sorted(number[x] for x in entries_of(t or "") if x in number) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if y > 0]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["k"])

    docs = [set(r.k) for r in rows.mapInArrow(present, "k array<int>").filter("size(k) > 0").collect()]  # TRAINING_ROWS short lists at most
    left = Counter(i for d in docs for i in d)
    out, cost = Model(), max(0.5, 3 * toxic / clean)
    while left:
        best = max(left, key=lambda i: (left[i] - cost * likely[i][2], likely[i][0] == "w", len(likely[i][1]), -i))
        if left[best] - cost * likely[best][2] < 2:
            break
        k, e, c, t = likely[best]
        (out.words if k == "w" else out.beginnings)[e] = max(0.1, math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)))
        for d in docs:
            if best in d:
                left.subtract(d)
        docs = [d for d in docs if best not in d]
        left = Counter({i: n for i, n in left.items() if n > 0})
    # as frequent as what was taken, and never clean: entries that nearly always stand beside others
    most = max((t for k, e, c, t in likely if e in (out.words if k == "w" else out.beginnings)), default=0)
    for k, e, c, t in sorted(likely, key=lambda x: (-x[3], x[0] != "w", -len(x[1]), x[1])):
        covered = e in out.words or any(e.startswith(b) for b in out.beginnings)
        if not c and 4 * t >= most and not covered and not any(w.startswith(e) for w in out.words.keys() | out.beginnings.keys()):
            (out.words if k == "w" else out.beginnings)[e] = math.log((t + 0.5) / (toxic + 1)) - math.log(0.5 / (clean + 1))
    return out


def learn_exceptions(rows: DataFrame, model: Model) -> None:
    """Phrases of an entry and a neighbouring word that stand in 3 clean documents or more, and in 3 times as many
    clean as toxic ones."""
    words, beginnings = frozenset(model.words), frozenset(model.beginnings)

    def phrases(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws, mine = WORD.findall(fold(t or "")), set()
                for i, w in enumerate(ws):
                    if w in words or any(w[:n] in beginnings for n in BEGINNINGS):
                        if i:
                            mine.add(f"{ws[i - 1]} {w}")
                        if i + 1 < len(ws):
                            mine.add(f"{w} {ws[i + 1]}")
                seen[int(y > 0)].update(mine)
        rows = [(p, seen[0][p], seen[1][p]) for p in seen[0]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["phrase", "clean", "toxic"])

    counts = rows.mapInArrow(phrases, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    model.exceptions = {r.phrase for r in counts.filter("clean >= 3 AND clean >= 3 * toxic").collect()}


def fit_curve(rows: DataFrame, model: Model) -> None:
    """Fits the logistic curve over log(1 + rate) to the training documents, with a mild pull to a flat curve; each
    class weighs as much as its documents."""

    def rates(batches):
        m = Matcher(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.rate(t or "") for t in batch.column(1).to_pylist()], pa.float64())], ["y", "rate"])

    found = rows.mapInArrow(rates, "y int, rate double").groupBy(F.round("rate", 3).alias("rate"), F.expr("int(y > 0)").alias("y")).count().collect()  # at most a row a document
    x, y, n = (np.array(v, float) for v in zip(*[(math.log1p(r.rate), r.y, r["count"]) for r in found], strict=True))
    a, b = 1.0, -2.0
    for _ in range(60):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * n * x).sum() + 0.05 * a, ((p - y) * n).sum() + 0.05 * b])
        w = p * (1 - p) * n
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.base = float(a), float(b)


def toxicity(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.3 on) to the columns of ``carry`` (default: all).

    The whole text is read. Null, empty and wordless texts have no hits and get the curve's lowest score. Equal texts
    get equal scores. A carried column named score or predicted is returned as score_in or predicted_in.
    """

    def setup():
        m = Matcher(model)
        return lambda texts: (lambda s: [pa.array(s), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())])([model.score(m.rate(t.decode())) if t else model.score(0.0) for t in texts])

    return map_text(docs, text, setup, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], carry)


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity(docs, learn(docs, labels), carry=["doc_id"])
    return rows.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
