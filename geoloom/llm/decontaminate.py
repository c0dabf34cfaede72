"""Benchmark decontamination by a prefix-filtered containment join.

Every window of an item must occur whole in a document, so of its shingles (3 words; the window itself when it has
fewer) one is a sufficient prefix: if the window occurs, so does that shingle. Shingles are ordered by their number
of occurrences in all documents, and each distinct window is filed under its rarest one. A document's shingles are
looked up in that prefix index; the position of the shingle in the window fixes where the window would begin, which
must leave room on both sides (positional and length bounds); what is left is verified word for word.

Benchmark items are read and handled in blocks of at most ``block_words`` words (a longer item is cut into pieces that
share all but their windows' first words), each broadcast on its own. Of several blocks each is gone through by itself:
what it finds is kept, its broadcast is freed, and the findings are joined to the documents by row at the end. So neither
the driver nor an executor ever holds more than a block. Documents stay where they are but for that last join.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_WORDS, map_text, materialised

WINDOW = 10
SHINGLE = 3
#: Words of benchmark text in a block; a block's index takes about 150 bytes a word.
BLOCK_WORDS = 400_000
#: Candidates verified at a time.
VERIFY = 50_000


class Windows:
    """The distinct windows of a block of items, with words as numbers from 1."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in text.translate(LOWER_WORDS).split()]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.windows, self.items = list(found), [sorted(x) for x in found.values()]
        self.base = len(self.vocab) + 1
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.words = np.zeros((len(self.windows), window), np.int32)
        for i, w in enumerate(self.windows):
            self.words[i, : len(w)] = w
        codes = {self.code(w[j : j + SHINGLE]) for w in self.windows for j in range(max(1, len(w) - SHINGLE + 1))}
        self.codes = np.array(sorted(codes), np.int64)

    def code(self, shingle: tuple[int, ...]) -> int:
        """Shingles of fewer than SHINGLE words get zeros in front, so that lengths can't be mistaken for each other."""
        out = 0
        for w in shingle:
            out = out * self.base + w
        return out

    def order(self, counts: np.ndarray) -> None:
        """Files each window under its rarest shingle, ties to the first in the window."""
        rarity = dict(zip(self.codes.tolist(), counts.tolist(), strict=True))
        filed = []
        for i, w in enumerate(self.windows):
            shingles = [self.code(w[j : j + SHINGLE]) for j in range(max(1, len(w) - SHINGLE + 1))]
            at = min(range(len(shingles)), key=lambda j: (rarity[shingles[j]], j))
            filed.append((shingles[at], i, at))
        filed.sort()
        self.prefix = np.array([x[0] for x in filed], np.int64)
        self.filed_window = np.array([x[1] for x in filed], np.int64)
        self.filed_at = np.array([x[2] for x in filed], np.int64)
        self.short = {n for n in self.lengths.tolist() if n < SHINGLE}


def word_numbers(vocab: dict[bytes, int], texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers (0: not in a benchmark) with a 0 after each text, and where each begins."""
    get, out, starts, n = vocab.get, [], [], 0
    for t in texts:
        words = t.translate(LOWER_WORDS).split() if t else []
        out.extend([get(w, 0) for w in words])
        out.append(0)
        starts.append(n)
        n += len(words) + 1
    return np.array(out, np.int64), np.array([*starts, n], np.int64)


def shingle_codes(ids: np.ndarray, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and codes of the shingles of ``size`` words that are all in the vocabulary."""
    m = len(ids) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = ids[:m] > 0
    for k in range(1, size):
        ok &= ids[k : k + m] > 0
    at = np.flatnonzero(ok)
    code = np.zeros(len(at), np.int64)
    for k in range(size):
        code = code * base + ids[at + k]
    return at, code


def look_up(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the range of equal entries of sorted_keys."""
    return np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")


def hits(index: Windows, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified occurrences (document, window) and a mark for each word inside one."""
    covered, docs, wins = np.zeros(len(ids) + WINDOW + 1, np.int32), [], []
    for size in sorted({SHINGLE, *index.short}):
        at, code = shingle_codes(ids, index.base, size)
        lo, hi = look_up(code, index.prefix)
        some = np.flatnonzero(hi > lo)
        at, lo, n = at[some], lo[some], (hi - lo)[some]
        ends = np.cumsum(n)
        done = 0
        while done < len(at):  # so many lookups that they have about VERIFY candidates
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + VERIFY, "right")))
            k = n[done:upto]
            entry = np.repeat(lo[done:upto] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            win, begin = index.filed_window[entry], np.repeat(at[done:upto], k) - index.filed_at[entry]
            done = upto
            doc = np.searchsorted(starts, np.repeat(at[upto - len(k) : upto], k), "right") - 1
            length = index.lengths[win]
            room = (begin >= starts[doc]) & (begin + length < starts[doc + 1]) & ((length >= SHINGLE) if size == SHINGLE else (length == size))
            win, begin, doc, length = win[room], begin[room], doc[room], length[room]
            same = np.ones(len(win), bool)
            for j in range(index.words.shape[1]):
                here = np.flatnonzero(same & (length > j))
                same[here] = ids[begin[here] + j] == index.words[win[here], j]
            win, begin, doc, length = win[same], begin[same], doc[same], length[same]
            np.add.at(covered, begin, 1)
            np.add.at(covered, begin + length, -1)
            docs.append(doc)
            wins.append(win)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(docs or none), np.concatenate(wins or none), np.cumsum(covered)[: len(ids)] > 0


def shingle_counts(docs: DataFrame, text: str, index: Windows) -> np.ndarray:
    """How often each shingle of the block occurs in all documents: counted in each task, then summed."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches):
        index = shared.value
        total = np.zeros(len(index.codes), np.int64)
        sizes = {min(SHINGLE, n) for n in index.lengths.tolist()}
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for i in range(0, len(texts), 256):
                ids, _ = word_numbers(index.vocab, texts[i : i + 256])
                for size in sizes:
                    _, code = shingle_codes(ids, index.base, size)
                    at = np.searchsorted(index.codes, code)
                    at[at == len(index.codes)] = 0
                    total += np.bincount(at[index.codes[at] == code], minlength=len(index.codes))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["k", "n"])

    rows = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(index.codes), np.int64)
    for k, n in rows.collect():  # a row for each shingle of the block, at most BLOCK_WORDS * 3
        counts[k] = n
    shared.unpersist()
    return counts


def blocks(benchmark: DataFrame, item: str, text: str, block_words: int):
    """The items in blocks, read one after the other. A null text has no words; a null id counts as an empty one."""
    rows = benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).toLocalIterator()
    out, words = [], 0
    for i, t in rows:
        all_words = (t or "").encode().translate(LOWER_WORDS).split()
        step = max(block_words, WINDOW)
        for k in range(0, max(1, len(all_words) - WINDOW + 1), step):  # every window lies in one piece
            piece = all_words[k : k + step + WINDOW - 1]
            if words + len(piece) > block_words and out:
                yield out
                out, words = [], 0
            out.append((i or "", b" ".join(piece)))
            words += len(piece)
    yield out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    carry: list[str] | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """For each document n_words, n_hit, items (ids of the items with a window in it, sorted as strings) and
    contaminated, beside the columns of ``carry``.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A window is 10 consecutive words of an
    item; an item of fewer, but not none, is one window. Null, empty or wordless texts have no words and no hits; an
    empty benchmark hits nothing; repeated items of one id count as one, repeated documents each for themselves. A
    carried column with the name of a result is returned with _in behind it.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    sent = text in carry  # then it isn't sent twice
    out = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], *([] if sent else [docs[text].alias("text")]))
    name = f"c{carry.index(text)}" if sent else "text"
    every = blocks(benchmark, item, item_text, block_words)
    first, second = next(every), next(every, None)
    if second is None:
        index = Windows(first)
        index.order(shingle_counts(out, name, index))
        out = mark(out, name, spark.sparkContext.broadcast(index))
    else:
        # numbered once and kept, so that each block's findings meet their rows again
        out = materialised(out.withColumn("row", F.monotonically_increasing_id()))
        words, kept = None, []
        for items in chain([first, second], every):
            index = Windows(items)
            index.order(shingle_counts(out, name, index))
            shared = spark.sparkContext.broadcast(index)
            made = mark(out.select("row", name), name, shared)
            kept.append(materialised(made.filter(F.size("found") > 0).select("row", "runs", "found")))
            if words is None:
                words = materialised(made.select("row", "words"))
            shared.unpersist()
        hits = reduce(DataFrame.unionByName, kept).groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("found")).alias("found"))
        none = [F.coalesce(F.col(c), F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("runs", "found")]
        out = out.join(words, "row").join(hits, "row", "left").select(*[f"c{i}" for i in range(len(carry))], "words", *none)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
    hit = F.aggregate(
        F.array_sort("runs"), start, lambda a, r: F.struct((a.n + F.greatest(F.lit(0), r.e - F.greatest(r.b, a.e))).alias("n"), F.greatest(a.e, r.e).alias("e"))
    ).n
    return out.select(
        *[F.col(f"c{i}").alias(f"{c}_in" if c in ("n_words", "n_hit", "items", "contaminated") else c) for i, c in enumerate(carry)],
        F.col("words").alias("n_words"),
        hit.alias("n_hit"),
        F.array_sort(F.array_distinct("found")).alias("items"),
        (hit > 0).alias("contaminated"),
    )


def mark(out: DataFrame, text: str, shared) -> DataFrame:
    """Adds the number of words, the runs of hit words and the items found."""

    def setup():
        index = shared.value

        def work(texts):
            ids, starts = word_numbers(index.vocab, texts)
            docs, wins, hit = hits(index, ids, starts)
            items: list[set[str]] = [set() for _ in texts]
            for d, w in set(zip(docs.tolist(), wins.tolist(), strict=True)):
                items[d].update(index.items[w])
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))  # runs never pass a text's end
            runs: list[list[dict]] = [[] for _ in texts]
            for b, e, d in zip(edge[::2].tolist(), edge[1::2].tolist(), (np.searchsorted(starts, edge[::2], "right") - 1).tolist(), strict=True):
                runs[d].append({"b": b - int(starts[d]), "e": e - int(starts[d])})
            return [pa.array(np.diff(starts) - 1), runs, [sorted(x) for x in items]]

        return work

    run = T.ArrayType(T.StructType([T.StructField("b", T.LongType()), T.StructField("e", T.LongType())]))
    fields = [T.StructField("words", T.LongType()), T.StructField("runs", run), T.StructField("found", T.ArrayType(T.StringType()))]
    return map_text(out, text, setup, fields)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The digest columns of decontaminate()'s rows."""
    return found.select(
        doc_id, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def oracle() -> str:
    """The same rows as SQL for DuckDB, over the tables documents and benchmark."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS win, least(len(w), {WINDOW}) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT s.r, s.k, s.n, win.item_id FROM spots s JOIN win ON s.win = win.win AND s.n = win.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.r = pos.r LEFT JOIN items ON d.r = items.r"""


def op1(spark, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return digest(decontaminate(docs, bench, carry=["doc_id"]))
