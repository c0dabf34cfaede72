"""Token counts of a unigram tokenizer without the tokens: Viterbi over Aho-Corasick matches.

The automaton gives, at each place of the text, the vocabulary pieces that end there. The dynamic programme carries
only the best score and the number of pieces up to each of the last places, as many as the longest piece has signs; no
path is kept. Rules are those of the tokenizers
library's Unigram model: of equal scores the piece that begins first wins; a character that is no piece by itself may
be an unknown piece at the least score of the vocabulary less 10; unknown pieces in a row count as one.

The vocabulary and its scores come from a public model file; nothing is trained.
"""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

VOCABULARY = "piece_bpe_32k.model"
#: The sign that stands for a space; one is put before the text.
SPACE = "▁"
UNKNOWN, UNKNOWN_PENALTY = "<unk>", 10.0
#: Words remembered in a task; beyond that it forgets them all and goes on.
REMEMBERED = 300_000


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """The unknown piece and the model's ordinary pieces with their scores (about a megabyte; read by the driver)."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    plain = (i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))
    return [(UNKNOWN, 0.0), *((m.id_to_piece(i), m.get_score(i)) for i in plain)]


class Counter:
    """Counts the pieces of texts."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for p, score in pieces:
            if p:
                self.found.add_word(p, (len(p), score))
        self.found.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.longest = max(len(p) for p, _ in pieces)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        # words can be counted one by one if no piece reaches over the space between two, and if sums of scores are
        # exact, so that what stands before a word changes no comparison
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p, _ in pieces) and all(float(s).is_integer() for _, s in pieces) and SPACE in self.single
        self.most = max(1.0, *(abs(s) for _, s in pieces), abs(self.unknown))
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> int:
        """Number of pieces of a text as it is."""
        size = self.longest + 1
        best, count, lost = [0.0] * size, [0] * size, [False] * size  # by place, modulo size
        matches = self.found.iter(text)
        next_end, piece = next(matches, (-1, None))
        now = 0
        for e, sign in enumerate(text):
            top, at, here = None, 0, []
            while next_end == e:
                here.append(piece)
                next_end, piece = next(matches, (-1, None))
            for length, score in sorted(here, reverse=True) if len(here) > 1 else here:
                k = (e + 1 - length) % size
                if top is None or best[k] + score > top:
                    top, at = best[k] + score, k
            after = (e + 1) % size
            if sign not in self.single and (top is None or best[now] + self.unknown > top):
                best[after], count[after], lost[after] = best[now] + self.unknown, count[now] + (not lost[now]), True
            else:
                best[after], count[after], lost[after] = top, count[at] + 1, False
            now = after
        return count[now]

    def count(self, text: str | None) -> int:
        """Number of pieces of a text with its spaces replaced and one before it; none for a null or empty text."""
        if not text:
            return 0
        if not self.by_word or (len(text) + 1) * self.most >= 2**53:
            return self.pieces(SPACE + text.replace(" ", SPACE))
        known, total = self.known, 0
        words = text.replace(SPACE, " ").split(" ")
        blank = 0
        for i, w in enumerate(words):
            if not w and i + 1 < len(words):
                blank += 1
                continue
            if not blank:
                if (k := known.get(w)) is None:
                    k = known[w] = self.pieces(SPACE + w)
                total += k
            else:
                total += self.pieces(SPACE * (blank + 1) + w)
                blank = 0
        if len(known) > REMEMBERED:
            known.clear()
        return total


def token_counts(docs: DataFrame, text: str = "text", carry: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Adds n_tokens to the columns of ``carry`` (default: all). Whole texts are counted; null and empty ones have no
    tokens. A carried column named n_tokens is returned as n_tokens_in."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def setup():
        counter = Counter(shared.value)
        return lambda texts: [pa.array([counter.count(t.decode()) if t else 0 for t in texts], pa.int64())]

    return map_text(docs, text, setup, [T.StructField("n_tokens", T.LongType())], carry)


def op3(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
