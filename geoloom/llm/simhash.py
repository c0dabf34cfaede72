"""SimHash fingerprints and groups of near-duplicates by anchor-point covering.

Anchors are the code words of a product of perfect codes over the 64 bits: two binary Golay codes [23,12] (covering
radius 3), a Hamming code [15,11] and a repetition code [3,1] (radius 1 each). Every fingerprint lies within radius
3 + 3 + 1 + 1 of exactly one anchor, block by block. If two fingerprints differ in at most 2 bits, some point z is
within one bit of both; so it is enough to copy each fingerprint to the anchors of itself and of its 64 one-bit
neighbours (about 17 distinct ones), which are anchors within covering radius plus threshold of it: both then meet at
the anchor of z. Within an anchor, fingerprints are compared by their one-bit neighbourhoods.

Exact copies collapse to one fingerprint first, and links are kept as a forest for each anchor. An anchor with more than
CROWD fingerprints is split by its points: each of its fingerprints goes to the 65 points within one bit, where no more
than 65 distinct ones can meet. Components are found by rounds of minimum labels over a table. So no group of copies, no
hot fingerprint and no crowded anchor is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, map_text, materialised

SEED = 42
SHINGLE = 3
#: Fingerprints link at so many differing bits or fewer; the anchors' reach of one bit each side is made for it.
THRESHOLD = 2
#: Distinct fingerprints of an anchor that are compared in one piece; others are split by points, which is as exact.
CROWD = 4_096
#: Row numbers of this size at most, in bytes, are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
FLIPS = np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))]).astype(np.uint64)


def fingerprint(text: bytes | None) -> int:
    """A bit is 1 if it is set in over half the XXH64 (seed 42) of the 3-word shingles, repeats included.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; of fewer than 3 words the whole sequence is the shingle;
    no words, or null: 0.
    """
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    h, seed = xxhash.xxh64_intdigest, SEED
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 65536):  # a long text doesn't hold all its shingles at once
        part = words[i : i + 65536 + SHINGLE - 1]
        if len(part) >= SHINGLE:
            joined = map(b" ".join, zip(part, part[1:], part[2:], strict=False))
        else:
            joined = [b" ".join(part)]
        hashes = np.array([h(s, seed) for s in joined], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * votes > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds fp, the fingerprint as a (signed) long, to the columns of ``carry``."""

    def setup():
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    return map_text(docs, text, setup, [T.StructField("fp", T.LongType())], carry)


# ---- anchors ----


def _golay_decoder() -> np.ndarray:
    """For each 11-bit syndrome of the Golay code with generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1, the error of
    weight 3 at most."""
    poly = 0b110001110101

    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= poly << (i - 11)
        return x

    one = [syndrome(1 << i) for i in range(23)]
    out = np.zeros(2048, np.uint64)
    for i in range(23):
        out[one[i]] = 1 << i
        for j in range(i):
            out[one[i] ^ one[j]] = 1 << i | 1 << j
            for k in range(j):
                out[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k
    return out


def _syndromes(width: int, of_bit: list[int]) -> list[np.ndarray]:
    """Tables by which the syndrome of a block is the XOR of one entry for each of its bytes."""
    tables = []
    for low in range(0, width, 8):
        t = np.zeros(256, np.uint64)
        for b in range(min(8, width - low)):
            t[np.arange(256) >> b & 1 == 1] ^= np.uint64(of_bit[low + b])
        tables.append(t)
    return tables


def _codes() -> list[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """Of each block: first bit, width, syndrome tables, error of each syndrome."""
    poly, golay = 0b110001110101, []
    for i in range(23):
        x = 1 << i
        for j in range(22, 10, -1):
            if x >> j & 1:
                x ^= poly << (j - 11)
        golay.append(x)
    error = _golay_decoder()
    hamming = np.array([0, *[1 << i for i in range(15)]], np.uint64)
    repeat = np.array([0, 1, 2, 4], np.uint64)
    return [
        (0, 23, _syndromes(23, golay), error),
        (23, 23, _syndromes(23, golay), error),
        (46, 15, _syndromes(15, list(range(1, 16))), hamming),
        (61, 3, _syndromes(3, [1, 2, 3]), repeat),
    ]


CODES = _codes()


def anchor(x: np.ndarray) -> np.ndarray:
    """The anchor of each fingerprint (uint64): the nearest code word in each block."""
    out = np.zeros_like(x)
    for first, width, tables, error in CODES:
        block = (x >> np.uint64(first)) & np.uint64((1 << width) - 1)
        s = np.zeros_like(x)
        for i, t in enumerate(tables):
            s ^= t[(block >> np.uint64(8 * i) & np.uint64(255)).astype(np.int64)]
        out |= (block ^ error[s.astype(np.int64)]) << np.uint64(first)
    return out


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into x, anchor) for the distinct anchors of each fingerprint and its one-bit neighbours."""
    near = np.sort(anchor((x[:, None] ^ FLIPS[None, :]).ravel()).reshape(len(x), 65), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    return np.nonzero(new)[0], near[new]


def forest(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that join, for each key, all its fingerprints that are chained by 2 differing bits or fewer; at
    most about one for each row with a key."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(keys)))
    a, b = [], []
    small = np.repeat(size <= 24, size)
    for shift in range(1, 24):  # small groups: all at once, one distance in the order at a time
        if len(keys) <= shift:
            break
        at = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:])
        if not len(at):
            break
        at = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= THRESHOLD]
        a.append(fps[at])
        b.append(fps[at + shift])
    for s, n in zip(start[size > 24].tolist(), size[size > 24].tolist(), strict=True):
        x, y = by_neighbours(np.unique(fps[s : s + n]))
        a.append(x)
        b.append(y)
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def by_neighbours(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: two of them link if they share a point within one
    bit, so each point links those that reach it to the first of them. Work is 65 points for each, never all pairs."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = [], []
    points = (fps[:, None] ^ FLIPS[None, :]).ravel()
    order = np.argsort(points, kind="stable")
    points, owner = points[order], order // 65
    for k in np.flatnonzero(points[1:] == points[:-1]).tolist():
        i, j = find(int(owner[k])), find(int(owner[k + 1]))
        if i != j:
            root[max(i, j)] = min(i, j)
            a.append(owner[k])
            b.append(owner[k + 1])
    return fps[np.array(a, np.int64)], fps[np.array(b, np.int64)]


def links(nodes: DataFrame) -> DataFrame:
    """Distinct links (a, b), a < b as longs, that connect the distinct fingerprints of nodes (column fp)."""

    def replicate(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 20_000):
                part = fps[i : i + 20_000]
                at, key = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[at].view(np.int64))], ["key", "fp"])

    def compare(batches):
        # rows come sorted by key within the partition; an anchor's rows may go on in the next batch
        held_key, held_fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(key):
                continue
            last = np.flatnonzero(key != key[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            held_key, held_fp = key[cut:], fp[cut:]
            if cut:
                yield linked(key[:cut], fp[:cut])
        if len(held_key):
            yield linked(held_key, held_fp)

    def linked(key, fp):
        a, b = forest(key, fp)
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def to_points(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 5_000):
                points = fps[i : i + 5_000, None] ^ FLIPS[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(points.ravel().view(np.int64)), pa.array(np.repeat(fps[i : i + 5_000], 65).view(np.int64))], ["key", "fp"])

    compared = lambda df: df.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    copies = nodes.select("fp").mapInArrow(replicate, "key long, fp long")
    crowded = materialised(copies.groupBy("key").count().filter(F.col("count") > CROWD).select("key"))
    if crowded.isEmpty():
        return compared(copies).distinct()
    rest = copies.join(crowded, "key", "left_anti").select("key", "fp")
    points = copies.join(crowded, "key", "left_semi").select("fp").distinct().mapInArrow(to_points, "key long, fp long")
    return compared(rest).unionByName(compared(points)).distinct()


# ---- components ----


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the links (a, b): root is the smallest node of the component.

    Large-star and small-star rounds in turn, each materialised, until the links stop changing: a number of rounds
    that grows with the logarithm of the largest component. A star round needs a node's smallest neighbour only, which
    is a partial aggregate and a join, so a node with very many links isn't gathered in one task.
    """
    now = materialised(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        now = materialised(small_star(large_star(now)))
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them. The links are (smaller, larger)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).filter("a <> b").distinct()


def grouped(prints: DataFrame) -> DataFrame:
    """Of each distinct fingerprint of prints (id, fp, and row) as l_fp: component_id, and the row first that stands for
    its component."""
    nodes = materialised(prints.groupBy("fp").agg(F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "row")).alias("first")))
    roots = components(links(nodes))
    labels = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(nodes["fp"], "id", "first", F.coalesce("root", nodes["fp"]).alias("root"))
    least = labels.groupBy("root").agg(F.min("id").alias("component_id"), F.min("first").alias("first")).withColumnRenamed("root", "r")
    return materialised(labels.join(least, labels["root"] == least["r"]).select(F.col("fp").alias("l_fp"), "component_id", least["first"]["row"].alias("first")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of each document.

    component_id is the smallest id among the documents that a chain of links reaches, the document itself included;
    where all their ids are null it is null. Null and wordless texts have fingerprint 0 and link like any other.
    Repeated rows stay as they are. Links: at most 2 differing bits; no link is dropped.
    """
    prints = materialised(fingerprints(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("row")), "text", ["id", "row"]))
    by_fp = grouped(prints)
    return prints.join(by_fp, prints["fp"] == by_fp["l_fp"]).select(F.col("id").alias(doc_id), "fp", "component_id")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, one of each component: that with the smallest id (an id before none), of those the one with the
    smallest fingerprint, and of equal ones the first as the rows are read.

    Fingerprints are made once, and the rows are kept with them and numbered; the numbers of rows that go are broadcast
    if they are few enough, so that no text changes place.
    """
    names = docs.columns
    numbered = docs.toDF(*[f"k{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id())
    rows = materialised(fingerprints(numbered, f"k{names.index(text)}"))
    prints = rows.select(F.col(f"k{names.index(doc_id)}").alias("id"), "fp", "row")
    by_fp = grouped(prints)
    gone = materialised(prints.join(by_fp, prints["fp"] == by_fp["l_fp"]).filter("row <> first").select(F.col("row").alias("gone")))
    few = gone.count() * 16 <= BROADCAST_BYTES
    return rows.join(F.broadcast(gone) if few else gone, F.col("row") == F.col("gone"), "left_anti").drop("row", "fp").toDF(*names)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
