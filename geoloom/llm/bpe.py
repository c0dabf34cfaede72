"""Byte-level BPE: encoding in overlapping chunks, decoding by concatenating raw bytes.

Pre-tokens of a text are found by a pattern that looks at what follows a place, never at what stands before it. So if
the scans of two chunks have a boundary in common, they agree from there on, and the scan of the later chunk can be
taken over. Every text is cut into chunks with an overlap, the pre-tokens of each chunk are found, the boundaries of
neighbouring chunks are stitched where they first coincide, and the pre-tokens between the seams are encoded; a text of
one chunk has no seam. The chunks of a text of more than SPREAD of them are dealt over tasks. Where an overlap has no
common boundary (a pre-token longer than the overlap), the rest of that text is one run: slower, but right.
"""

from __future__ import annotations

import base64
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 1 << 14, 1 << 8
#: Chunks of a text that one task goes through; those of a longer text are dealt over tasks, by the same steps.
SPREAD = 8
#: The end of a match is certain only if so many code points of the text follow it in the chunk: the longest
#: contraction has three.
AHEAD = 3
#: Distinct pre-tokens remembered in a task; beyond that it forgets them all and goes on.
REMEMBERED = 100_000
IDS = T.ArrayType(T.IntegerType())


def ranks_of(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


def vocabulary_bytes(path: str | None = None) -> bytes:
    """The vocabulary file; the driver reads it and broadcasts it (under a megabyte)."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


class Encoder:
    """Encodes the pre-tokens of texts."""

    def __init__(self, lines: bytes) -> None:
        import regex
        import tiktoken

        ranks = ranks_of(lines)
        self.find = regex.compile(public_tokenizers.PATTERN)
        self.one = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.ranks, self.known = ranks, {}
        self.of_id = {i: b for b, i in ranks.items()}.__getitem__

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.of_id, ids))

    def ids(self, pieces: list[str], out: list[int]) -> None:
        """Appends the ids of the pre-tokens."""
        known, ranks = self.known, self.ranks
        for p in pieces:
            if (found := known.get(p)) is None:
                b = p.encode()
                found = known[p] = [ranks[b]] if b in ranks else self.one(b)
            out.extend(found)
        if len(known) > REMEMBERED:
            known.clear()

    def pieces(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        """The pre-tokens of a text, from its chunks."""
        n = len(text)
        if n <= chunk:
            return self.find.findall(text)
        starts = list(range(0, n, chunk))
        found = [boundaries(self.find, text[k : k + chunk + overlap], k + chunk + overlap >= n) for k in starts]
        out = []
        for k, (b, e) in enumerate(runs := seams(starts, found, n)):
            if e == n and k + 1 == len(runs) < len(starts):  # no seam further on
                out += self.run(text[b:], e - b)
            else:
                at = found[k]
                at = at[bisect_left(at, b - starts[k]) : bisect_left(at, e - starts[k]) + 1]
                out += [text[starts[k] + x : starts[k] + y] for x, y in zip(at, at[1:], strict=False)]
        return out

    def run(self, text: str, length: int) -> list[str]:
        """The pre-tokens of the first ``length`` code points; what follows is only looked at."""
        if length == len(text):
            return self.find.findall(text)
        out = []
        for m in self.find.finditer(text):
            if m.start() >= length:
                break
            out.append(m.group())
        return out


_ENCODERS: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """One encoder in each worker process for a vocabulary."""
    lines = shared.value
    if (k := hash(lines)) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[k] = Encoder(lines)
    return _ENCODERS[k]


def lists(flat: list[int], sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.array(flat, np.int32)))


def boundaries(find, chunk: str, last: bool) -> list[int]:
    """Where the pre-tokens of the chunk begin, up to the first whose beginning isn't certain; of the last chunk of a
    text all, and its end."""
    out = [0]
    for m in find.finditer(chunk):
        if not last and m.end() > len(chunk) - AHEAD:
            break
        out.append(m.end())
    return out


def seams(starts: list[int], found: list[list[int]], end: int) -> list[tuple[int, int]]:
    """The runs (begin, end) of a text whose chunks begin at ``starts`` and have the boundaries ``found`` (counted from
    the chunk's beginning; those in the overlaps are enough): each seam is the first common boundary of two neighbours.
    The k-th run lies in the k-th chunk; without a further seam the last one goes on to the end."""
    out, begin = [], 0
    for k in range(len(starts) - 1):
        shift = starts[k + 1] - starts[k]
        mine, theirs = found[k], set(found[k + 1])
        seam = next((b for b in mine[bisect_left(mine, max(shift, begin - starts[k])) :] if b - shift in theirs), None)
        if seam is None:
            break
        out.append((begin, begin := starts[k] + seam))
    out.append((begin, end))
    return out


def encode(docs: DataFrame, text: str = "text", carry: list[str] | None = None, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD, decoded: bool = False) -> DataFrame:
    """Adds ids, the tokens of the whole text, to the columns of ``carry`` (default: all).

    The ids are those of the tiktoken library without special tokens: their strings are ordinary text. Null and empty
    texts have no ids (an empty list). With decoded the bytes that the ids decode to are added as well, made from them in the same task.
    Carried columns named ids or decoded are returned as ids_in and decoded_in.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_bytes(path))
    carry = docs.columns if carry is None else carry
    docs = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], docs[text].cast("string").alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk * spread

    fields = [T.StructField("ids", IDS), *([T.StructField("decoded", T.BinaryType())] if decoded else [])]

    def setup():
        e = encoder(shared)

        def work(texts):
            flat, sizes, back = [], [], []
            for t in texts:
                n = len(flat)
                if t:
                    e.ids(e.pieces(t.decode(), chunk, overlap), flat)
                sizes.append(len(flat) - n)
                if decoded:
                    back.append(e.bytes_of(flat[n:]))
            return [lists(flat, sizes), *([pa.array(back, pa.binary())] if decoded else [])]

        return work

    short = map_text(docs.filter(~is_long), "text", setup, fields, [f"c{i}" for i in range(len(carry))])
    rows = docs.filter(is_long).withColumn("h", F.sha2("text", 256))
    made = encode_long(rows.select("h", "text"), shared, chunk, overlap)
    made = decode(made, path=path) if decoded else made
    long = rows.drop("text").join(made, "h").drop("h").select(*short.columns)
    out = short.unionByName(long)
    names = {f.name for f in fields}
    return out.select(*[F.col(f"c{i}").alias(f"{c}_in" if c in names else c) for i, c in enumerate(carry)], *[f.name for f in fields])


def encode_long(rows: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """(h, ids) of texts keyed by their hash; equal texts are encoded once. A task holds a chunk of a text, but for the
    one that cuts it, and of a text's boundaries only those in the overlaps are brought together."""
    texts = rows.dropDuplicates(["h"])

    def cut(batches):
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i in range(0, len(text), 64 * chunk):
                    starts = range(i, min(len(text), i + 64 * chunk), chunk)
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(starts)), pa.array([k // chunk for k in starts], pa.int32()), pa.array([len(text)] * len(starts), pa.int64()), pa.array([text[k : k + chunk + overlap] for k in starts])], ["h", "k", "n", "text"])

    chunks = texts.mapInArrow(cut, "h string, k int, n long, text string").repartition("h", "k")

    def scan(batches):
        e = encoder(shared)
        for batch in batches:
            found = []
            for k, n, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                found.append([b for b in boundaries(e.find, t, k * chunk + chunk + overlap >= n) if b <= overlap or b >= chunk])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], ["h", "k", "n", "found"])

    def stitch(table: pa.Table) -> pa.Table:
        t = table.sort_by("k")
        h, n, found = t.column("h")[0].as_py(), t.column("n")[0].as_py(), t.column("found").to_pylist()
        runs = seams([k * chunk for k in t.column("k").to_pylist()], found, n)
        return pa.table({"h": [h] * len(runs), "k": pa.array(range(len(runs)), pa.int32()), "b": pa.array([x[0] for x in runs], pa.int64()), "e": pa.array([x[1] for x in runs], pa.int64()), "chunks": pa.array([len(found)] * len(runs), pa.int32()), "runs": pa.array([len(runs)] * len(runs), pa.int32())})

    runs = chunks.mapInArrow(scan, "h string, k int, n long, found array<int>").groupBy("h").applyInArrow(stitch, "h string, k int, b long, e long, chunks int, runs int")
    # the last run of a text without a further seam goes over its chunk's end
    over = (F.col("k") + 1 == F.col("runs")) & (F.col("runs") < F.col("chunks"))
    within = chunks.select("h", "k", "text").join(runs.filter(~over), ["h", "k"]).select("h", "b", "e", (F.col("k").cast("long") * chunk).alias("start"), "text")
    beyond = texts.select("h", "text").join(runs.filter(over), "h").select("h", "b", "e", F.lit(0).cast("long").alias("start"), "text")

    def encode_run(batches):
        e = encoder(shared)
        for batch in batches:
            flat, sizes = [], []
            for b, stop, start, t in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                n = len(flat)
                e.ids(e.run(t[b - start : stop - start + AHEAD], stop - b), flat)
                sizes.append(len(flat) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(flat, sizes)], ["h", "b", "ids"])

    pieces = within.unionByName(beyond).mapInArrow(encode_run, "h string, b long, ids array<int>")
    return pieces.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("b", "ids"))).alias("parts")).select("h", F.flatten("parts.ids").alias("ids"))


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, name: str = "decoded") -> DataFrame:
    """Adds ``name``, the bytes of the ids, to all columns. Null ids give null; an id outside the vocabulary raises."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_bytes(path))
    columns = [c for c in rows.columns if c != name]
    source = rows.select(*[rows[c].alias(f"c{i}") for i, c in enumerate(columns)])
    at, n = columns.index(ids), len(columns)

    def run(batches):
        table = {b: a for a, b in ranks_of(shared.value).items()}
        get = table.__getitem__
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                col = part.column(at)
                flat, offsets = col.values.to_numpy(zero_copy_only=False), col.offsets.to_pylist()
                valid = col.is_valid().to_pylist()
                out = [b"".join(map(get, flat[a:b].tolist())) if v else None for a, b, v in zip(offsets, offsets[1:], valid, strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*[f"c{i}" for i in range(n)], "made"])

    out = source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("made", T.BinaryType())]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("made").alias(name))


def digest(rows: DataFrame) -> list:
    """The digest columns of rows with ids and decoded."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = encode(docs, carry=["doc_id"], decoded=True)
    return rows.select("doc_id", *digest(rows))
