"""Hierarchical Pitman-Yor language model: seating by Gibbs sampling, scores by averaged predictive probabilities.

Restaurants: one for each word before (a text's beginning counts as one), as many as the corpus has; the parent of a
word's restaurant is that of its ending, the last two bytes, which all words with that ending share; their parent is the
root, whose base is uniform over the V words of training and one for all others.

The texts are tokenised once, into blocks. A block's words and pairs go to two kinds of buckets, both in number
proportional to the corpus, and both set by the corpus alone:

* Context buckets hold the restaurants of words before. All contexts lie on a line, ending after ending, each ending as
  long as its tokens and its contexts spread over that length by hash; a bucket is a stretch of the line. A context with
  very many tokens has a stretch of its own, over which its pairs are spread by the hash of the word, so that it's dealt
  to as many buckets as it needs; its totals are then summed over them.
* Word buckets hold all that concerns a word in the endings' restaurants and in the root.

A round: each context bucket draws its words' tables anew, given the words' probabilities in the parents, and sends the
numbers of tables to the word buckets; those draw the tables of endings and root, and send customers and tables back.
Totals of the endings (at most 65,536), of the root and of the split contexts are summed by Spark and pass through the
driver. After the first rounds each round's seating is a sample; a pair's probability is averaged over the samples,
and each block adds up its texts from the probabilities of its distinct pairs. No row is sent for each token.
"""

from __future__ import annotations

import gc
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialised, remainder, removed, shared_dir, small_batches

#: Tokens of a block: what a task counts, or asks for, at a time. A longer text is a block by itself.
BLOCK_TOKENS = 2_000_000
#: Tokens of a context bucket, and distinct words (of all blocks together) of a word bucket, about.
BUCKET_TOKENS, BUCKET_WORDS = 1_500_000, 1_500_000
#: A context of so many tokens, or of a millionth of all if that is more, is dealt to several buckets: at most a million.
SPLIT_TOKENS, MOST_SPLIT = 500_000, 1_000_000
#: Rounds before the first sample, samples that are averaged, and draws of the tables within a round.
BURN_IN, SAMPLES, DRAWS = 1, 2, 4
#: Strength of each level: contexts, endings, root.
STRENGTH = (1.0, 1.0, 1.0)
#: The tables of so many customers of a word in a restaurant are drawn from their exact conditional. Further ones are
#: seated in order, in groups of an eighth of those seated, with the odds at the group's beginning: that gives a few
#: tables too many for more than a thousand customers, which moves a probability by less than a hundredth (tested).
EXACT = 1_024
#: The end of a text; no word has white space.
END = b"\n"
ENDINGS = 1 << 16
SENT = "kind string, bucket long, sender long, blob binary"
#: Keys of summed totals: endings by their code, then single numbers, then split contexts.
NUMBERS, SPLIT = 1 << 20, 1 << 32


def ending(word: bytes) -> int:
    """The code of a word's last two bytes."""
    return int.from_bytes(word[-2:], "big")


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text.translate(LOWER).split() if text else []), END]


# ---- packing ----


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, byte by byte of their numbers, which suits sorted ones."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(f"{a.dtype.str} {len(a)};".encode())
        out.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        stop = data.index(b";", at, at + 40)
        kind, n = data[at:stop].split()
        kind, n = np.dtype(kind.decode()), int(n)
        at = stop + 1
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def rows(*made: tuple[str, int, int, bytes]) -> pa.RecordBatch:
    """Rows of SENT."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], ["kind", "bucket", "sender", "blob"])


def firsts(x: np.ndarray) -> np.ndarray:
    """Of a sorted array: where each of its values begins."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def parts_of(owner: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(owner, rows) for each owner in ascending order; rows keep their order."""
    order = np.argsort(owner, kind="stable")
    first = firsts(owner[order])
    return [(int(owner[p[0]]), p) for p in np.split(order, first[1:])] if len(order) else []


def word_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int64)


# ---- blocks ----


class Numbers(dict):
    """Numbers words as they appear."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Block:
    """Texts as numbers of their words, in the order in which words appear."""

    def __init__(self) -> None:
        self.number = Numbers()
        self.parts, self.sizes, self.learn, self.ids, self.n = [], [], [], [], 0

    def add(self, doc_id, learn: bool, text: bytes | None) -> None:
        words = tokens(text)
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.sizes.append(len(words))
        self.learn.append(learn)
        self.ids.append(doc_id)
        self.n += len(words)

    def blob(self) -> bytes:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.number), np.uint64, len(self.number))
        endings = np.fromiter(map(ending, self.number), np.uint16, len(self.number))
        return pack(narrow(np.array(self.sizes)), np.array(self.learn, np.uint8), narrow(np.concatenate(self.parts)), hashes, endings)


class Texts:
    """A block as it was packed, its words in the order of their hashes."""

    def __init__(self, blob: bytes) -> None:
        sizes, learn, at, hashes, endings = unpack(blob)
        self.sizes = sizes.astype(np.int64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.h, self.e, self.at = hashes[order], endings[order], rank[at]
        self.learn = np.repeat(learn.astype(np.int64), self.sizes)
        # each text ends with the end, so that comes before each text
        end = np.searchsorted(self.h, np.uint64(xxhash.xxh64_intdigest(END)))
        self.key = np.concatenate([[end], self.at[:-1]]) * len(self.h) + self.at

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its tokens in training texts and in all."""
        n = len(self.h)
        return np.bincount(self.at, self.learn, n).astype(np.int64), np.bincount(self.at, minlength=n)

    def pairs(self, line: Line) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs in the order of (bucket, word before, word): key, bucket, word before, word, and tokens
        in training."""
        x = np.sort(self.key * 2 + self.learn)
        first = firsts(x >> 1)
        key, c = x[first] >> 1, np.add.reduceat(x & 1, first)
        u, w = key // len(self.h), key % len(self.h)
        bucket = line.buckets_of(self.h, self.e, u, w)
        order = np.argsort(bucket, kind="stable")
        return key[order], bucket[order], u[order], w[order], c[order]


def blocks(batches, limit: int):
    now = Block()
    for batch in batches:
        for doc_id, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            now.add(doc_id, learn, text)
            if now.n >= limit:
                yield now
                now = Block()
    if now.n:
        yield now


class Line:
    """Where contexts lie: endings one after the other, each as long as its tokens; split contexts after them."""

    def __init__(self, endings: dict[int, int], split: list[tuple[int, int, int, int]], size: int) -> None:
        """endings: tokens by code; split: (hash, ending, tokens, tokens in training)."""
        self.length = np.zeros(ENDINGS, np.float64)
        for code, n in endings.items():
            self.length[code] = n
        split = sorted(split)
        for _, code, n, _ in split:
            self.length[code] -= n
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.h = np.array([x[0] for x in split], np.uint64)
        self.own = np.array([x[2] for x in split], np.float64)
        self.learned = np.array([x[3] for x in split], np.int64)
        self.own_start = self.length.sum() + np.concatenate([[0], np.cumsum(self.own)[:-1]]) if split else np.zeros(0)
        total = float(self.length.sum() + self.own.sum())
        self.buckets = max(1, int(-(-total // size)))
        self.size = max(1.0, total / self.buckets)

    def split(self, h: np.ndarray) -> np.ndarray:
        """The numbers of the contexts among those that are split, -1 for others."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)

    def buckets_of(self, h: np.ndarray, e: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The buckets of pairs (u, w), numbers of words with hashes h and endings e."""
        share, own = h.astype(np.float64) / 2.0**64, self.split(h)
        place = (self.start[e] + self.length[e] * share)[u]
        some = np.flatnonzero(own[u] >= 0)
        k = own[u[some]]
        place[some] = self.own_start[k] + self.own[k] * share[w[some]] if len(some) else 0
        return np.clip(place // self.size, 0, self.buckets - 1).astype(np.int64)


# ---- seating ----


@lru_cache(maxsize=16)
def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of discount d: [customers, tables]."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[0, 0] = 0
    with np.errstate(invalid="ignore", divide="ignore"):
        for c in range(most):
            t = np.arange(1, c + 2)
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf) + out[c, 1 : c + 2])
    return out


def seat(c: np.ndarray, elsewhere: np.ndarray, strength: float, d: float, above: np.ndarray, rng, exact: int = EXACT) -> np.ndarray:
    """Draws the number of tables of each word in a restaurant given its customers c, the tables of other words and its
    probability in the parent: in proportion to stirling * product of (strength + d * tables before) * above ** tables."""
    t, first = np.minimum(c, 1), np.minimum(c, exact)
    stirling = log_stirling(d, exact)
    some = np.flatnonzero(c > 1)
    order = some[np.argsort(first[some], kind="stable")]
    for group in np.split(order, firsts(first[order])[1:]) if len(order) else []:
        n = int(first[group[0]])
        for part in np.array_split(group, max(1, len(group) * n // 1_000_000)):
            j = np.arange(n)
            new = np.log(strength + d * (elsewhere[part, None] + j)) + np.log(above[part, None])
            logit = stirling[n, 1 : n + 1] + np.cumsum(new, axis=1)
            p = np.cumsum(np.exp(logit - logit.max(1, keepdims=True)), axis=1)
            t[part] = 1 + (p < rng.random(len(part))[:, None] * p[:, -1:]).sum(1)
    many = np.flatnonzero(c > exact)
    seated = np.full(len(many), exact)
    while (live := np.flatnonzero(seated < c[many])).size:
        at = many[live]
        more = np.minimum(c[at] - seated[live], seated[live] // 8 + 1)
        new = (strength + d * (elsewhere[at] + t[at])) * above[at]
        t[at] += rng.binomial(more, new / (new + seated[live] - d * t[at]))
        seated[live] += more
    return np.minimum(t, c)


def discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, (once + 0.5) / (once + 2 * twice + 1)))


class Totals:
    """V, N, customers and tables of endings and root, discounts, and the tables of split contexts."""

    def __init__(self, summed: dict[int, tuple[int, int]], words: int, tokens: int, split: int) -> None:
        self.words, self.tokens = words, tokens
        self.n_g, self.t_g = np.zeros(ENDINGS), np.zeros(ENDINGS)
        self.t_split = np.zeros(split, np.int64)
        for key, (a, b) in summed.items():
            if key < ENDINGS:
                self.n_g[key], self.t_g[key] = a, b
            elif key >= SPLIT:
                self.t_split[key - SPLIT] = a
        once = [summed.get(NUMBERS + 1 + i, (0, 0)) for i in range(3)]
        self.n, self.s = summed.get(NUMBERS, (0, 0))
        self.d = tuple(discount(*x) for x in once)

    def probability(self, g: np.ndarray, n: np.ndarray, t: np.ndarray, n_w: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Of words in endings' restaurants: n, t are customers and tables there, n_w, s in the root."""
        root = self.root(n_w, s)
        return (np.maximum(n - self.d[1] * t, 0) + (STRENGTH[1] + self.d[1] * self.t_g[g]) * root) / (STRENGTH[1] + self.n_g[g])

    def root(self, n_w, s):
        return (np.maximum(n_w - self.d[2] * s, 0) + (STRENGTH[2] + self.d[2] * self.s) / (self.words + 1)) / (STRENGTH[2] + self.n)


class Contexts:
    """A context bucket: pairs in the order of (word before, word), c their tokens in training (0: only asked for), t
    their tables, p the sum of their probabilities in the samples so far."""

    def __init__(self, uh, ue, size, wh, w, c, t=None, p=None) -> None:
        self.uh, self.ue, self.size, self.wh = uh, ue, size.astype(np.int64), wh
        self.w, self.c = w.astype(np.int64), c.astype(np.int64)
        self.t = np.minimum(self.c, 1) if t is None else t.astype(np.int64)
        self.p = np.zeros(len(self.c), np.float32) if p is None else p
        self.u = np.repeat(np.arange(len(uh)), self.size)
        # entries: the distinct (ending, word) of the pairs, dealt to word buckets
        code, self.entry = np.unique(self.ue[self.u].astype(np.int64) * max(1, len(wh)) + self.w, return_inverse=True)
        self.entry_g, self.entry_w = code // max(1, len(wh)), code % max(1, len(wh))

    def fixed(self) -> bytes:
        return pack(self.uh, self.ue, narrow(self.size), self.wh, narrow(self.w), narrow(self.c))

    def seats(self) -> bytes:
        return pack(narrow(self.t), self.p.astype(np.float32))

    def order(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """The entries of each word bucket."""
        return parts_of(word_bucket(self.wh[self.entry_w], buckets))

    def tables(self) -> np.ndarray:
        """Of each entry: the tables of its pairs."""
        return np.bincount(self.entry, self.t, len(self.entry_g)).astype(np.int64)

    def restaurants(self, line: Line, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each context: customers, the tables it has in other buckets, and its number among the split ones. before:
        all tables of the split contexts when this bucket had the tables it has now."""
        c_u, own = np.bincount(self.u, self.c, len(self.uh)), line.split(self.uh)
        elsewhere, some = np.zeros(len(self.uh)), np.flatnonzero(own >= 0)
        if len(some):
            c_u[some] = line.learned[own[some]]
            elsewhere[some] = before[own[some]] - np.bincount(self.u, self.t, len(self.uh))[some]
        return c_u, elsewhere, own

    def predictive(self, c_u: np.ndarray, elsewhere: np.ndarray, d: float, above: np.ndarray) -> np.ndarray:
        t_u = np.bincount(self.u, self.t, len(self.uh)) + elsewhere
        return (np.maximum(self.c - d * self.t, 0) + ((STRENGTH[0] + d * t_u)[self.u]) * above) / (STRENGTH[0] + c_u[self.u])

    def draw(self, elsewhere: np.ndarray, d: float, above: np.ndarray, rng, draws: int = DRAWS) -> None:
        """Draws all tables anew, so many times; the words of a restaurant at once, given each other's tables before."""
        some = np.flatnonzero(self.c > 1)
        u, c, p = self.u[some], self.c[some], above[some]
        for _ in range(draws):
            t_u = np.bincount(self.u, self.t, len(self.uh)) + elsewhere
            self.t[some] = seat(c, np.maximum(0, t_u[u] - self.t[some]), STRENGTH[0], d, p, rng)


class Words:
    """A word bucket: entries (ending g, word w) with n customers and t tables, and of each word n_w and s in the root.
    at: the entries that each sending context bucket has, in its order."""

    def __init__(self, senders, sizes, at, words, w, g, t=None, s=None) -> None:
        self.senders, self.sizes, self.at = senders.astype(np.int64), sizes.astype(np.int64), at.astype(np.int64)
        self.words, self.w, self.g = int(words), w.astype(np.int64), g.astype(np.int64)
        self.t, self.s = t, s

    def fixed(self) -> bytes:
        return pack(self.senders, self.sizes, narrow(self.at), np.array([self.words]), narrow(self.w), narrow(self.g))

    def seats(self) -> bytes:
        return pack(narrow(self.t), narrow(self.s))

    def customers(self, sent: np.ndarray) -> np.ndarray:
        """sent: what the senders have, one after the other."""
        return np.bincount(self.at, sent, len(self.w)).astype(np.int64)

    def in_root(self) -> np.ndarray:
        return np.bincount(self.w, self.t, self.words).astype(np.int64)

    def begin(self, n: np.ndarray) -> None:
        self.t = np.minimum(n, 1)
        self.s = np.minimum(self.in_root(), 1)

    def draw(self, n: np.ndarray, totals: Totals, rng, draws: int = DRAWS) -> None:
        before, above_before = self.t, self.s
        for _ in range(draws):
            root = totals.root(self.in_root(), self.s)
            self.t = seat(n, np.maximum(0, totals.t_g[self.g] - before), STRENGTH[1], totals.d[1], root[self.w], rng)
            self.s = seat(self.in_root(), np.maximum(0, totals.s - above_before), STRENGTH[2], totals.d[2], np.full(self.words, 1 / (totals.words + 1)), rng)

    def down(self, n: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
        """For each sender: customers and tables of its entries, in their restaurant and in the root."""
        per = [x[self.at] for x in (n, self.t, self.in_root()[self.w], self.s[self.w])]
        cut = np.cumsum(self.sizes)[:-1]
        return list(zip(self.senders.tolist(), zip(*(np.split(x, cut) for x in per), strict=True), strict=True))

    def totals(self, n: np.ndarray) -> list[tuple[int, int, int]]:
        g, at = np.unique(self.g, return_inverse=True)
        n_w = self.in_root()
        out = list(zip(g.tolist(), np.bincount(at, n, len(g)).astype(np.int64).tolist(), np.bincount(at, self.t, len(g)).astype(np.int64).tolist(), strict=True))
        out += [(NUMBERS, int(n_w.sum()), int(self.s.sum()))]
        return out + [(NUMBERS + 2 + i, int((x == 1).sum()), int((x == 2).sum())) for i, x in enumerate((n, n_w))]


# ---- on Spark ----


def packed_totals(found: list[tuple[int, int, int]]) -> bytes:
    x = np.array(found, np.int64).reshape(-1, 3)
    return pack(*(np.ascontiguousarray(x[:, i]) for i in range(3)))


def summed(stored: DataFrame) -> dict[int, tuple[int, int]]:
    """The rows of kind totals added up by key: at most ENDINGS, a few, and MOST_SPLIT keys reach the driver."""

    def opened(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in unpack(x)], ["k", "a", "b"])

    found = stored.filter("kind = 'totals'").select("blob").mapInArrow(opened, "k long, a long, b long").groupBy("k").agg(F.sum("a"), F.sum("b")).collect()
    return {k: (a, b) for k, a, b in found}


class Folder:
    """Tables of one run in the shared folder, each removed when it is no longer needed."""

    def __init__(self, spark) -> None:
        self.spark, self.name, self.tables = spark, f"language_model_{uuid.uuid4().hex}", set()
        self.path = f"{shared_dir(spark).rstrip('/')}/{self.name}"

    def keep(self, df: DataFrame, name: str, bucketed: int = 0) -> DataFrame:
        """With bucketed the table is dealt to so many files by its bucket, so that no later round shuffles it."""
        out = df.write.option("compression", "none").option("parquet.block.size", str(16 << 20))
        if "kind" in df.columns:
            out = out.partitionBy("kind")
        if bucketed:
            out.option("path", f"{self.path}/{name}").bucketBy(bucketed, "bucket").saveAsTable(f"{self.name}_{name}")
            self.tables.add(f"{self.name}_{name}")
        else:
            out.parquet(f"{self.path}/{name}")
        gc.collect()  # what the table was made from is no longer used: Spark removes its shuffle files
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.table(f"{self.name}_{name}").select(*df.columns) if bucketed else self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        for table in [t for t in self.tables if not name]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        removed(self.spark, f"{self.path}/{name}".rstrip("/"))


def language_model(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", seed: int = 1, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """Learns from the rows where ``learn`` is true and scores all: (doc_id, n_tokens, n_known, train_tokens,
    base_score, score) of each row.

    Tokens are words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, then one end. A null text is an empty one: an end; a
    null learn is false. base_score adds up log10((c + 1) / (N + V + 1)), score log10 of the model's probability.
    Repeated ids and rows get a row each, ids of any type are returned as they are; other columns aren't read. Without
    training rows every probability is 1, so scores are 0; an empty table gives an empty one. Draws depend on the seed
    and on the training texts, not on partitions or settings.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    folder = Folder(spark)
    try:
        out, n = scored(source, folder, seed, burn_in, samples)
        return materialised(out.select(F.col("id").cast(id_type).alias(doc_id), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"))
    finally:
        folder.drop()


def scored(source: DataFrame, folder: Folder, seed: int, burn_in: int, samples: int) -> tuple[DataFrame, int]:
    """(id, n_tokens, n_known, base_score, score) of source's rows (id, learn, text), and the tokens in training."""
    spark, limit = source.sparkSession, BLOCK_TOKENS

    def tokenised(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, block in enumerate(blocks(batches, limit)):
            ids = pa.array([[str(i) if i is not None else None for i in block.ids]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k]), pa.array([block.n]), pa.array([len(block.number)]), ids, pa.array([block.blob()], pa.binary())], ["bucket", "tokens", "words", "ids", "blob"])

    made = source.mapInArrow(tokenised, "bucket long, tokens long, words long, ids array<string>, blob binary")
    texts = folder.keep(made, "blocks", max(1, source.rdd.getNumPartitions()))
    size = texts.agg(F.sum("tokens"), F.sum("words")).first()
    all_tokens, word_buckets = size[0] or 0, max(1, -(-(size[1] or 0) // BUCKET_WORDS))
    split_from = max(SPLIT_TOKENS, -(-all_tokens // MOST_SPLIT))

    def send_words(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = Texts(blob)
                counts = t.counts()
                yield rows(*(("word", k, block, pack(t.h[p], t.e[p], *(narrow(c[p]) for c in counts))) for k, p in parts_of(word_bucket(t.h, word_buckets))))

    def count_words(key, table):
        parts = [unpack(x.as_py()) for x in table.column("blob")]
        h, first, at = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        e = np.concatenate([p[1] for p in parts])[first].astype(np.int64)
        c, every = (np.bincount(at, np.concatenate([p[i] for p in parts]).astype(np.int64), len(h)).astype(np.int64) for i in (2, 3))
        made, start = [], 0
        for sender, p in zip(table.column("sender").to_pylist(), parts, strict=True):
            made.append(("count", sender, key[0].as_py(), pack(narrow(c[at[start : start + len(p[0])]]))))
            start += len(p[0])
        g, at_g = np.unique(e, return_inverse=True)
        found = list(zip(g.tolist(), np.bincount(at_g, every, len(g)).astype(np.int64).tolist(), [0] * len(g), strict=True))
        made.append(("totals", 0, 0, packed_totals([*found, (NUMBERS, int((c > 0).sum()), int(c.sum()))])))
        hot = np.flatnonzero(every >= split_from)
        if len(hot):
            made.append(("split", 0, 0, pack(h[hot], e[hot], every[hot], c[hot])))
        return pa.Table.from_batches([rows(*made)])

    counted = folder.keep(texts.select("bucket", "blob").mapInArrow(send_words, SENT).groupBy("bucket").applyInArrow(count_words, SENT), "counts")
    found = summed(counted)
    words, n = found.pop(NUMBERS, (0, 0))
    split = [tuple(int(y) for y in x) for r in counted.filter("kind = 'split'").select("blob").collect() for x in zip(*unpack(bytes(r.blob)), strict=True)]
    line = Line({k: a for k, (a, _) in found.items()}, split, BUCKET_TOKENS)
    shared = spark.sparkContext.broadcast(line)  # ENDINGS numbers, and MOST_SPLIT contexts at most

    def send_pairs(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = Texts(blob)
                _, bucket, u, w, c = t.pairs(shared.value)
                for k, p in parts_of(bucket):
                    a, b = u[p], w[p]
                    first = firsts(a)
                    there = np.zeros(len(t.h), bool)
                    there[b] = True
                    yield rows(("pair", k, block, pack(t.h[a[first]], t.e[a[first]], narrow(np.diff(np.append(first, len(a)))), t.h[there], narrow((np.cumsum(there) - 1)[b]), narrow(c[p]))))

    def merge(key, table):
        me, parts = key[0].as_py(), [unpack(x.as_py()) for x in table.column("blob")]
        uh, first, u = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        ue = np.concatenate([p[1] for p in parts])[first]
        u = np.repeat(u, np.concatenate([p[2] for p in parts]).astype(np.int64))
        wh, w = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
        shift = np.cumsum([0, *(len(p[3]) for p in parts)])
        w = w[np.concatenate([p[4].astype(np.int64) + s for p, s in zip(parts, shift, strict=False)])]
        pair, at = np.unique(u * len(wh) + w, return_inverse=True)
        c = np.bincount(at, np.concatenate([p[5] for p in parts]).astype(np.int64), len(pair)).astype(np.int64)
        u, w = pair // len(wh), pair % len(wh)
        state = Contexts(uh, ue, np.bincount(u, minlength=len(uh)), wh, w, c)
        made, start = [("fixed", me, -1, state.fixed())], 0
        for sender, p in zip(table.column("sender").to_pylist(), parts, strict=True):
            made.append(("ask", me, sender, pack(narrow(at[start : start + len(p[4])]))))
            start += len(p[4])
        tables = state.tables()
        made += [("up", k, me, pack(wh[state.entry_w[p]], narrow(state.entry_g[p]), narrow(tables[p]))) for k, p in state.order(word_buckets)]
        made.append(("totals", 0, 0, packed_totals([(NUMBERS + 1, int((c == 1).sum()), int((c == 2).sum())), *split_tables(state, shared.value)])))
        return pa.Table.from_batches([rows(*made)])

    pairs = folder.keep(texts.select("bucket", "blob").mapInArrow(send_pairs, SENT).groupBy("bucket").applyInArrow(merge, SENT), "pairs", line.buckets)

    def gather(key, table):
        got = sorted(zip(table.column("sender").to_pylist(), table.column("blob").to_pylist(), strict=True))
        parts = [unpack(x) for _, x in got]
        wh, w = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        pair, at = np.unique(w * ENDINGS + np.concatenate([p[1] for p in parts]).astype(np.int64), return_inverse=True)
        state = Words(np.array([s for s, _ in got]), np.array([len(p[0]) for p in parts]), at, len(wh), pair // ENDINGS, pair % ENDINGS)
        n = state.customers(np.concatenate([p[2] for p in parts]))
        state.begin(n)
        return pa.Table.from_batches([rows(("fixed", key[0].as_py(), -1, state.fixed())), word_rows(key[0].as_py(), state, n)])

    of_words = folder.keep(pairs.filter("kind = 'up'").groupBy("bucket").applyInArrow(gather, SENT), "words", word_buckets)
    first = summed(pairs) | summed(of_words)
    totals, once = Totals(first, words, n, len(split)), first.get(NUMBERS + 1, (0, 0))
    in_pairs, in_words = (x.filter("kind = 'fixed'").groupBy("bucket") for x in (pairs, of_words))
    # what a round leaves: of the context buckets seats and up, of the word buckets seats and down
    states, seats = None, of_words
    for k in range(burn_in + samples - 1):
        sent = seats.filter("kind = 'down'")
        sent = sent.unionByName(states.filter("kind = 'seats'")) if states else sent
        states = folder.keep(in_pairs.cogroup(sent.groupBy("bucket")).applyInArrow(context_round(totals, shared, word_buckets, [seed, k, 0], k >= burn_in), SENT), f"states{k}")
        sent = states.filter("kind = 'up'").unionByName(seats.filter("kind = 'seats'"))
        seats = folder.keep(in_words.cogroup(sent.groupBy("bucket")).applyInArrow(word_round(totals, [seed, k, 1]), SENT), f"seats{k}")
        totals = Totals({NUMBERS + 1: once} | summed(states) | summed(seats), words, n, len(split))
        if k:
            folder.drop(f"states{k - 1}")
            folder.drop(f"seats{k - 1}")

    sent = seats.filter("kind = 'down'")
    sent = sent.unionByName(states.filter("kind = 'seats'")) if states else sent
    held = pairs.filter("kind IN ('fixed', 'ask')").groupBy("bucket")
    answers = held.cogroup(sent.groupBy("bucket")).applyInArrow(answered(totals, shared, word_buckets, samples), SENT)
    sent = answers.unionByName(counted.filter("kind = 'count'"))
    return texts.select("bucket", "ids", "blob").groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(added(shared, word_buckets, words, n), "id string, n_tokens long, n_known long, base_score double, score double"), n


def split_tables(state: Contexts, line: Line) -> list[tuple[int, int, int]]:
    """This bucket's tables of the split contexts, as rows of totals."""
    own = line.split(state.uh)
    t_u = np.bincount(state.u, state.t, len(state.uh)).astype(np.int64)
    return [(SPLIT + int(own[i]), int(t_u[i]), 0) for i in np.flatnonzero(own >= 0).tolist()]


def word_rows(bucket: int, state: Words, n: np.ndarray) -> pa.RecordBatch:
    down = [("down", sender, bucket, pack(*map(narrow, x))) for sender, x in state.down(n)]
    return rows(("seats", bucket, -1, state.seats()), ("totals", 0, 0, packed_totals(state.totals(n))), *down)


def split_by_kind(table: pa.Table) -> dict[str, list[tuple[int, bytes]]]:
    """(sender, blob) by kind, in the order of the senders."""
    out: dict[str, list] = {}
    for kind, sender, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "sender", "blob")), strict=True):
        out.setdefault(kind, []).append((sender, blob))
    return {k: sorted(x) for k, x in out.items()}


def opened(fixed: bytes, sent: dict, totals: Totals, buckets: int) -> tuple[Contexts, np.ndarray]:
    """A context bucket, and of each pair the word's probability in the ending's restaurant, from what the word buckets
    sent."""
    state = Contexts(*unpack(fixed), *(unpack(sent["seats"][0][1]) if "seats" in sent else ()))
    parts = zip(*(unpack(x) for _, x in sent["down"]), strict=True)
    order = np.concatenate([p for _, p in state.order(buckets)])
    above = np.empty(len(order))
    above[order] = totals.probability(state.entry_g[order], *(np.concatenate(x).astype(np.float64) for x in parts))
    return state, above[state.entry]


def context_round(totals: Totals, shared, word_buckets: int, seed: list[int], sample: bool):
    """A context bucket's part of a round; with sample, the seating it begins with is one."""

    def run(key, fixed, sent):
        me = key[0].as_py()
        state, above = opened(fixed.column("blob")[0].as_py(), split_by_kind(sent), totals, word_buckets)
        c_u, elsewhere, _ = state.restaurants(shared.value, totals.t_split)
        if sample:
            state.p = state.p + state.predictive(c_u, elsewhere, totals.d[0], above)
        state.draw(elsewhere, totals.d[0], above, np.random.default_rng([*seed, me]))
        tables = state.tables()
        up = [("up", k, me, pack(narrow(tables[p]))) for k, p in state.order(word_buckets)]
        return pa.Table.from_batches([rows(("seats", me, -1, state.seats()), ("totals", 0, 0, packed_totals(split_tables(state, shared.value))), *up)])

    return run


def word_round(totals: Totals, seed: list[int]):
    """A word bucket's part of a round."""

    def run(key, fixed, sent):
        me, sent = key[0].as_py(), split_by_kind(sent)
        t, s = unpack(sent["seats"][0][1])
        state = Words(*unpack(fixed.column("blob")[0].as_py()), t=t.astype(np.int64), s=s.astype(np.int64))
        n = state.customers(np.concatenate([unpack(x)[0] for _, x in sent["up"]]))
        state.draw(n, totals, np.random.default_rng([*seed, me]))
        return pa.Table.from_batches([word_rows(me, state, n)])

    return run


def answered(totals: Totals, shared, word_buckets: int, samples: int):
    """The last sample, and to each block log10 of its pairs' averaged probabilities."""

    def run(key, held, sent):
        me, held = key[0].as_py(), split_by_kind(held)
        state, above = opened(held["fixed"][0][1], split_by_kind(sent), totals, word_buckets)
        c_u, elsewhere, _ = state.restaurants(shared.value, totals.t_split)
        p = np.log10((state.p + state.predictive(c_u, elsewhere, totals.d[0], above)) / samples).astype(np.float32)
        return pa.Table.from_batches([rows(*(("answer", s, me, pack(p[unpack(x)[0]])) for s, x in held["ask"]))])

    return run


def added(shared, word_buckets: int, words: int, n: int):
    """A block's texts with their sums."""

    def run(key, held, sent):
        t = Texts(held.column("blob")[0].as_py())
        got = sorted(zip(sent.column("kind").to_pylist(), sent.column("sender").to_pylist(), sent.column("blob").to_pylist(), strict=True))
        c = np.empty(len(t.h), np.int64)
        c[np.concatenate([p for _, p in parts_of(word_bucket(t.h, word_buckets))])] = np.concatenate([unpack(x)[0] for kind, _, x in got if kind == "count"])
        pair = t.pairs(shared.value)[0]
        p = np.concatenate([unpack(x)[0] for kind, _, x in got if kind == "answer"]).astype(np.float64)
        order = np.argsort(pair)
        p = p[order][np.searchsorted(pair[order], t.key)]
        known = c[t.at]
        starts = np.concatenate([[0], np.cumsum(t.sizes)[:-1]])
        sums = [np.add.reduceat(x, starts) for x in ((known > 0).astype(np.int64), np.log10((known + 1) / (n + words + 1)), p)]
        return pa.table([held.column("ids")[0].values, pa.array(t.sizes), *map(pa.array, sums)], ["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_model(docs, remainder(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
