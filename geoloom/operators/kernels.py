"""Operators whose inner loop is numpy over a bounded block: components, morphology with a large radius, rings, hulls,
simplification, clipping, patch scoring. Each task holds one block; blocks meet through joins on their borders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

WIDTH = 1 << 31
RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


# ---- connected components ----


def block_labels(block: np.ndarray, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For pixels of many blocks the smallest r * WIDTH + c of their 4-connected component of equal value within their
    block: labels sink to the least of their neighbours, and to the label's label, until nothing moves."""
    r0, c0 = r - r.min(), c - c.min()
    tall, wide = int(r0.max()) + 2, int(c0.max()) + 2
    order = np.lexsort((c0, r0, block))
    place = ((block[order] - block.min()) * tall + r0[order]) * wide + c0[order]
    value = v[order]
    pairs = []
    for step in (1, wide):  # the pixel to the right and the one below
        at = np.searchsorted(place, place + step)
        at[at == len(place)] = 0
        ok = np.flatnonzero((place[at] == place + step) & (value[at] == value))
        pairs.append((ok, at[ok]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    label = np.arange(len(place))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(order), np.int64)
    out[order] = (r * WIDTH + c)[order][label]
    return out


def labelled(pixels: DataFrame, raster: str, chunk: int, row: str = "r", col: str = "c", value: str = "v", across: bool = True) -> DataFrame:
    """Adds label, the same for the pixels of a 4-connected component of equal value in a raster. Across chunk borders
    components are joined; with across=False each chunk is a world of its own, as where chunks are files."""
    kind = dict(pixels.dtypes)
    schema = f"{raster} {kind[raster]}, {row} bigint, {col} bigint, {value} {kind[value]}, label bigint"

    def run(frames):
        # chunks come one after the other; the last of a batch may go on in the next
        held = None
        for pdf in frames:
            if len(pdf):
                held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                key = held[[raster, "chunk_r", "chunk_c"]]
                block = (key != key.shift()).any(axis=1).cumsum().to_numpy()
                done = block < block[-1]
                if done.any():
                    yield made(held[done], block[done])
                    held = held[~done]
        if held is not None:
            yield made(held, np.zeros(len(held), np.int64))

    def made(pdf: pd.DataFrame, block: np.ndarray) -> pd.DataFrame:
        out = pdf[[raster, row, col, value]].copy()
        out["label"] = block_labels(block, pdf[row].to_numpy(), pdf[col].to_numpy(), pdf[value].to_numpy())
        return out

    by = [F.floor(F.col(row) / chunk).alias("chunk_r"), F.floor(F.col(col) / chunk).alias("chunk_c")]
    keys = [raster, "chunk_r", "chunk_c"]
    local = pixels.select(raster, row, col, value, *by).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
    if not across:
        return local
    local = local.checkpoint()
    # of two neighbours on both sides of a border the lower one is moved onto the upper one
    edge = local.filter((F.col(row) % chunk == chunk - 1) | (F.col(col) % chunk == chunk - 1) | (F.col(row) % chunk == 0) | (F.col(col) % chunk == 0))
    down = edge.filter(F.col(row) % chunk == 0).select(raster, (F.col(row) - 1).alias(row), col, value, F.col("label").alias("other"))
    right = edge.filter(F.col(col) % chunk == 0).select(raster, row, (F.col(col) - 1).alias(col), value, F.col("label").alias("other"))
    links = edge.join(down.unionByName(right), [raster, row, col, value]).select(raster, F.col("label").alias("a"), F.col("other").alias("b")).filter("a <> b").distinct()
    roots = joined_labels(links, raster)
    out = local.join(roots.select(raster, F.col("node").alias("label"), "root"), [raster, "label"], "left")
    return out.select(raster, row, col, value, F.coalesce("root", "label").alias("label"))


def joined_labels(links: DataFrame, by: str) -> DataFrame:
    """(by, node, root) of linked nodes, root the smallest of the component: minimum of the neighbours' roots and the
    root's root in turn, so chains halve each round; every round is checkpointed."""
    both = links.select(by, "a", "b").union(links.select(by, F.col("b"), F.col("a"))).distinct().checkpoint()
    now = both.select(by, F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    changed = 1
    while changed:
        seen = both.join(now.select(by, F.col("node").alias("b"), "root"), [by, "b"]).groupBy(by, F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = now.join(seen, [by, "node"], "left").select(by, "node", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("was"))
        up = least.select(by, F.col("node").alias("root"), F.col("root").alias("above"))
        new = least.join(up, [by, "root"], "left").select(by, "node", F.least("root", F.coalesce("above", "root")).alias("root"), "was").checkpoint()
        changed = new.filter("root <> was").limit(1).count()
        now = new.drop("was")
    return now


def polygonised(pixels: DataFrame, raster: str, chunk: int, include_nodata: bool = False, across: bool = True) -> DataFrame:
    """(raster, label, v, n, rings): a feature for each component, with its outer ring and holes along pixel borders.
    Value 0 makes no feature, nor does 255, the nodata value, unless it is asked for."""
    some = pixels.filter("v <> 0") if include_nodata else pixels.filter("v <> 0 AND v <> 255")
    lab = labelled(some, raster, chunk, across=across)
    return lab.groupBy(raster, "label", "v").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("r", "c")).alias("cells")).select(raster, "label", "v", "n", rings_of("cells").alias("rings"))


def trace(cells: set[tuple[int, int]]) -> list[list[dict]]:
    """The closed rings around a set of pixels: borders run with the pixel on the left, the outer ring first; at a
    point where two pixels touch diagonally the ring turns left, so that it stays with its pixel."""
    ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in cells:
        for inside, a, b in (((r + 1, c), (c + 1, r + 1), (c, r + 1)), ((r - 1, c), (c, r), (c + 1, r)), ((r, c - 1), (c, r + 1), (c, r)), ((r, c + 1), (c + 1, r), (c + 1, r + 1))):
            if inside not in cells:
                ahead.setdefault(a, []).append(b)
    rings = []
    while ahead:
        start = min(ahead)
        here, came, ring = start, None, [start]
        while True:
            options = ahead[here]
            if len(options) > 1 and came is not None:
                d = (here[0] - came[0], here[1] - came[1])
                options.sort(key=lambda b: d[0] * (b[1] - here[1]) - d[1] * (b[0] - here[0]))
                new = options.pop(-1)
            else:
                new = options.pop()
            if not options:
                del ahead[here]
            came, here = here, new
            ring.append(here)
            if here == start:
                break
        keep = [p for q, p, n in zip([ring[-2], *ring[:-2]], ring[:-1], ring[1:], strict=True) if (p[0] - q[0]) * (n[1] - p[1]) != (p[1] - q[1]) * (n[0] - p[0])]
        rings.append([*keep, keep[0]])
    size = lambda g: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(g, g[1:]))) / 2  # noqa: B905, E731
    rings.sort(key=size, reverse=True)
    return [[{"x": float(x), "y": float(y)} for x, y in g] for g in rings]


@pandas_udf(T.ArrayType(RING))
def rings_of(cells: pd.Series) -> pd.Series:
    return pd.Series([trace({(int(x["r"]), int(x["c"])) for x in group}) for group in cells])


# ---- morphology with a halo ----

#: Cells of blocks that are gone through in one call, about.
BLOCK_CELLS = 1 << 20


def open_close_blocks(pixels: DataFrame, raster: str, radius: int, chunk: int = 64, row: str = "r", col: str = "c", value: str = "v") -> DataFrame:
    """Opening, then closing, by a disc, in blocks with a halo of four radii: each pixel is copied to the blocks it
    can bear on, and a block keeps its own pixels. Pixels outside a raster don't count."""
    halo, kind = 4 * radius, dict(pixels.dtypes)
    # a block without pixels of its own makes nothing: none beyond a raster's are made. Pixels may look few to the planner
    # and be many, so they aren't broadcast
    ends = [f(F.floor(F.col(x) / chunk)).alias(n) for f, x, n in ((F.min, row, "br0"), (F.max, row, "br1"), (F.min, col, "bc0"), (F.max, col, "bc1"))]
    reach = pixels.groupBy(F.col(raster).alias("b_raster")).agg(*ends).hint("merge")
    axis = lambda x, lo, hi: F.sequence(F.greatest(F.floor((F.col(x) - halo) / chunk), lo), F.least(F.floor((F.col(x) + halo) / chunk), hi))
    ended = pixels.join(reach, F.col(raster).eqNullSafe(F.col("b_raster")))
    sent = ended.select(raster, row, col, value, "bc0", "bc1", F.explode(axis(row, "br0", "br1")).alias("br")).select(raster, row, col, value, "br", F.explode(axis(col, "bc0", "bc1")).alias("bc"))
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]

    size, keys = chunk + 2 * halo, [raster, "br", "bc"]

    def made(pdf: pd.DataFrame, block: np.ndarray) -> pd.DataFrame:
        """The own pixels of blocks, numbered from 0."""
        br, bc = pdf["br"].to_numpy() * chunk - halo, pdf["bc"].to_numpy() * chunk - halo
        r, c = pdf[row].to_numpy() - br, pdf[col].to_numpy() - bc
        own = (r >= halo) & (r < halo + chunk) & (c >= halo) & (c < halo + chunk)
        shape = (int(block[-1]) + 1, size, size)
        a, there = np.zeros(shape), np.zeros(shape, bool)
        a[block, r, c], there[block, r, c] = pdf[value].to_numpy(), True

        def step(a: np.ndarray, grow: bool) -> np.ndarray:
            fill, pick = (-np.inf, np.maximum) if grow else (np.inf, np.minimum)
            p = np.pad(np.where(there, a, fill), ((0, 0), (radius, radius), (radius, radius)), constant_values=fill)
            out = np.full(a.shape, fill)
            for i, j in offsets:
                pick(out, p[:, radius + i : radius + i + size, radius + j : radius + j + size], out=out)
            return out

        for grow in (False, True, True, False):
            a = step(a, grow)
        out = pdf.loc[own, [raster, row, col, value]].copy()
        out[value] = a[block[own], r[own], c[own]].astype(out[value].dtype)
        return out

    together = max(1, BLOCK_CELLS // (size * size))

    def run(frames):
        # blocks come one after the other; the last of a batch may go on in the next
        held = None
        for pdf in frames:
            if len(pdf):
                held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                new = (held[keys] != held[keys].shift()).any(axis=1).to_numpy()
                block = new.cumsum() - 1
                for first in range(0, int(block[-1]), together):
                    a, b = np.searchsorted(block, [first, min(first + together, int(block[-1]))])
                    yield made(held.iloc[a:b], block[a:b] - first)
                held = held.iloc[np.searchsorted(block, block[-1]) :].reset_index(drop=True)
        if held is not None:
            yield made(held, np.zeros(len(held), np.int64))

    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, f"{raster} {kind[raster]}, {row} bigint, {col} bigint, {value} {kind[value]}")


# ---- rings ----


def _xy(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


def _ring(points) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def hull(points: np.ndarray) -> list[tuple[float, float]]:
    """Convex hull, closed, counter-clockwise."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return [*p, p[0]] if p else []

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    h = half(p) + half(p[::-1])
    return [*h, h[0]]


@pandas_udf(RING)
def convex_hull(ring: pd.Series) -> pd.Series:
    return ring.map(lambda g: None if g is None else _ring(hull(_xy(g))))


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker of a closed ring; a ring never falls below a triangle."""
    n = len(points)
    if n <= 4:
        return points
    far = int(np.argmax(((points - points[0]) ** 2).sum(1)))
    keep, stack = {0, far, n - 1}, [(0, far), (far, n - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, d = points[a + 1 : b] - points[a], points[b] - points[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / length if length else np.hypot(p[:, 0], p[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[sorted(keep)] if len(keep) > 3 else points


def simplified(ring: Column, tolerance: float) -> Column:
    @pandas_udf(RING)
    def run(rings: pd.Series) -> pd.Series:
        return rings.map(lambda g: None if g is None else _ring(simplify(_xy(g), tolerance)))

    return run(ring)


def clip(points: np.ndarray, window: np.ndarray) -> list:
    """Sutherland-Hodgman: a ring clipped to a convex, counter-clockwise window; closed, or empty."""
    out = points[:-1].tolist()
    for a, b in zip(window[:-1], window[1:], strict=True):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        new = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            s, t = side(p), side(q)
            if s >= 0:
                new.append(p)
            if (s > 0 > t) or (s < 0 < t):
                u = s / (s - t)
                new.append([p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])])
        out = new
        if not out:
            return []
    return [*out, out[0]]


@pandas_udf(RING)
def clipped(ring: pd.Series, window: pd.Series) -> pd.Series:
    return pd.Series([None if g is None or w is None else _ring(clip(_xy(g), _xy(w))) for g, w in zip(ring, window, strict=True)])


def simple(points: np.ndarray) -> bool:
    """Whether a closed ring of three corners or more has an area and doesn't cross or touch itself."""
    n = len(points) - 1
    if n < 3 or (points[0] != points[-1]).any() or len(set(map(tuple, points[:-1].tolist()))) < n:
        return False
    turn = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            a, b, c, d = points[i], points[i + 1], points[j], points[j + 1]
            if turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0:
                return False
    return True


@pandas_udf(T.BooleanType())
def is_valid(ring: pd.Series) -> pd.Series:
    return ring.map(lambda g: g is not None and simple(_xy(g)))


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring holds a point, by counting crossings; an expression, not a UDF."""
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
    def crosses(p: Column) -> Column:
        a, b = p["a"], p["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], 1.0).otherwise(b["y"] - a["y"]) + a["x"])
    return F.size(F.filter(pairs, crosses)) % 2 == 1


# ---- scoring ----


def scored(patches: DataFrame, model: Callable[[np.ndarray], np.ndarray], keep: list[str], values: str = "values", batch: int = 50) -> DataFrame:
    """Adds scores to patches (arrays of pixels): a model takes a matrix of ``batch`` patches, the last one fewer."""
    schema = ", ".join(f"{c} {dict(patches.dtypes)[c]}" for c in keep) + ", scores array<double>"

    def run(frames):
        for pdf in frames:
            out = pdf[keep].copy()
            made = []
            for i in range(0, len(pdf), batch):
                made += list(model(np.stack(pdf[values].iloc[i : i + batch].to_numpy())))
            out["scores"] = made
            yield out

    return patches.select(*keep, values).mapInPandas(run, schema)


def looked_up(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between the pixels of a frame, bilinear; places outside take the nearest border."""
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    r, c = np.floor(y).astype(int), np.floor(x).astype(int)
    r1, c1, fy, fx = np.minimum(r + 1, a.shape[0] - 1), np.minimum(c + 1, a.shape[1] - 1), y - r, x - c
    return (a[r, c] * (1 - fx) + a[r, c1] * fx) * (1 - fy) + (a[r1, c] * (1 - fx) + a[r1, c1] * fx) * fy


def bent(a: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Piecewise-affine change: the points of an even grid over the frame are moved (rows, columns, 2: shares of height
    and width), and what lies between them moves in proportion to its distance from them."""
    y, x = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
    at = lambda v, n, m: v / max(n - 1, 1) * (m - 1)
    gy, gx = at(y, a.shape[0], moves.shape[0]), at(x, a.shape[1], moves.shape[1])
    return looked_up(a, y + looked_up(moves[..., 0], gy, gx) * a.shape[0], x + looked_up(moves[..., 1], gy, gx) * a.shape[1])


def seen_aslant(a: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Perspective change: the quadrilateral whose corners (upper left, upper right, lower right, lower left) lie so
    far inside the frame's (4, 2: shares of height and width) fills the frame."""
    h, w = a.shape[0] - 1, a.shape[1] - 1
    to = np.array([(0, 0), (0, w), (h, w), (h, 0)], float)
    here = to + corners * [a.shape] * [(1, 1), (1, -1), (-1, -1), (-1, 1)]
    rows, right = [], []
    for (ty, tx), (sy, sx) in zip(to, here, strict=True):
        rows += [[tx, ty, 1, 0, 0, 0, -sx * tx, -sx * ty], [0, 0, 0, tx, ty, 1, -sy * tx, -sy * ty]]
        right += [sx, sy]
    if min(h, w) < 1:
        return a
    m = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1).reshape(3, 3)
    y, x = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
    px, py, scale = (m[k, 0] * x + m[k, 1] * y + m[k, 2] for k in range(3))
    return looked_up(a, py / scale, px / scale)


def augmented(frames: DataFrame, id_: str, values: str, height: int, width: int, seed: int = 1, middle: float = 0.0) -> DataFrame:
    """Frames (arrays of height x width) changed in a drawn order, each change with its chance: flipped either way, cropped by up to a tenth
    and filled up again, blurred, contrast about ``middle``, bent and seen aslant. Draws depend on the frame's id and
    the seed only, so a lost task repeats them."""
    schema = f"{id_} {dict(frames.dtypes)[id_]}, {values} array<double>"

    def cropped(rng, a):
        r, c = (int(rng.integers(0, max(1, n // 10) + 1)) for n in (height, width))
        part = a[r : height - r or None, c : width - c or None]
        return part[np.arange(height)[:, None] * part.shape[0] // height, np.arange(width)[None, :] * part.shape[1] // width]

    def blurred(rng, a):
        p = np.pad(a, 1, mode="edge")
        return (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] + 4 * p[1:-1, 1:-1]) / 8

    changes = (
        (0.5, lambda rng, a: np.flip(a, 0)), (0.5, lambda rng, a: np.flip(a, 1)), (0.5, cropped), (0.3, blurred), (0.3, lambda rng, a: (a - middle) * rng.uniform(0.3, 1.2) + middle),
        (0.3, lambda rng, a: bent(a, rng.normal(0, 0.05, (4, 4, 2)))), (0.1, lambda rng, a: seen_aslant(a, np.minimum(np.abs(rng.normal(0, 0.01, (4, 2))), 0.4))),
    )

    def one(key: int, v: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng((seed, abs(int(key))))
        a = np.asarray(v, float).reshape(height, width)
        for k in rng.permutation(len(changes)):
            chance, change = changes[k]
            if rng.random() < chance:
                a = change(rng, a)
        return a.ravel()

    def run(batches):
        for pdf in batches:
            out = pdf[[id_]].copy()
            out[values] = [one(k, v) for k, v in zip(pdf[id_], pdf[values], strict=True)]
            yield out

    return frames.select(id_, values).mapInPandas(run, schema)


# ---- sums over overlapping boxes, without their pairs ----

#: Numbers in one matrix of a cell, at most.
MATRIX = 1 << 22


def summed(i: np.ndarray, j: np.ndarray, w: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.bincount(i * shape[1] + j, w, shape[0] * shape[1]).astype(float).reshape(shape)


def prefix(a: np.ndarray) -> np.ndarray:
    """Sums of all before a place on both axes, with a row and a column of zeros first."""
    return np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)


def paired_sums(q: np.ndarray, qs: np.ndarray, b: np.ndarray, bs: np.ndarray, w: np.ndarray, low: tuple, high: tuple, most: int = MATRIX) -> tuple[np.ndarray, np.ndarray]:
    """As gridded_sums, pair by pair; any boxes, with the whole area of a pair where it counts, if low is infinite."""
    n, area = np.zeros(q.shape[1]), np.zeros(q.shape[1])
    step = max(1, most // max(1, b.shape[1]))
    for at in range(0, q.shape[1] if b.shape[1] else 0, step):
        a, s = q[:, at : at + step, None], qs[:, at : at + step, None]
        hit = (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])
        here = hit & np.where(a[0] >= b[0], s[0], bs[0]) & np.where(a[1] >= b[1], s[1], bs[1])
        n[at : at + step] = here @ w
        x, y = (np.minimum(np.minimum(a[k + 2], b[k + 2]), high[k]) - np.maximum(np.maximum(a[k], b[k]), low[k]) for k in (0, 1))
        part = here if np.isinf(low[0]) else hit & (x > 0) & (y > 0)
        area[at : at + step] = np.where(part, x * y, 0.0) @ w
    return n, area


def gridded_sums(q: np.ndarray, qs: np.ndarray, b: np.ndarray, bs: np.ndarray, w: np.ndarray, low: tuple, high: tuple, most: int = MATRIX) -> tuple[np.ndarray, np.ndarray]:
    """For each box of q (x0, y0, x1, y1 as rows; all with an area) the weight of the boxes of b that it overlaps, those
    whose common lower corner lies in the cell from low to high, and the common area within the cell. qs and bs say for
    each axis whether a box starts in the cell.

    Corners lie on the grid of all coordinates, so sums are taken over matrices of it. On one axis, the lower corner of
    two boxes is where b starts within q, or where q starts and b goes on.
    """
    if not q.shape[1] or not b.shape[1]:
        return np.zeros(q.shape[1]), np.zeros(q.shape[1])
    grids = [np.unique(np.concatenate([np.maximum(x[k], low[k]) for x in (q, b)] + [np.minimum(x[k + 2], high[k]) for x in (q, b)])) for k in (0, 1)]
    shape = (len(grids[0]), len(grids[1]))
    if shape[0] * shape[1] > min(most, max(1 << 14, q.shape[1] * b.shape[1])):
        k = int(shape[1] > shape[0])
        middle = grids[k][shape[k] // 2]
        sides = [[x[k] < middle if first else x[k + 2] > middle for x in (q, b)] for first in (True, False)]
        if low[k] < middle < high[k] and sum(i.sum() * j.sum() for i, j in sides) < 0.75 * q.shape[1] * b.shape[1]:
            n, area = np.zeros(q.shape[1]), np.zeros(q.shape[1])
            for first, (i, j) in zip((True, False), sides, strict=True):
                lo, hi, starts = list(low), list(high), []
                (hi if first else lo)[k] = middle
                for x, s, at in ((q, qs, i), (b, bs, j)):
                    t = s[:, at].copy()
                    t[k] &= (x[k, at] < middle) == first
                    starts.append(t)
                more = gridded_sums(q[:, i], starts[0], b[:, j], starts[1], w[j], tuple(lo), tuple(hi), most)
                n[i] += more[0]
                area[i] += more[1]
            return n, area
        if shape[0] * shape[1] > most:
            return paired_sums(q, qs, b, bs, w, low, high, most)
    place = lambda x: [np.searchsorted(grids[k % 2], np.maximum(x[k], low[k]) if k < 2 else np.minimum(x[k], high[k - 2])) for k in range(4)]
    (i0, j0, i1, j1), (a0, c0, a1, c1) = place(b), place(q)
    over = lambda p, r0, s0, r1, s1: p[r1, s1] - p[r0, s1] - p[r1, s0] + p[r0, s0]

    def covered(r0, s0, r1, s1, w):
        """The weight at each place that boxes cover from their first row and column up to their last, not included."""
        sign = np.concatenate([w, -w, -w, w])
        return summed(np.concatenate([r0, r1, r0, r1]), np.concatenate([s0, s0, s1, s1]), sign, shape).cumsum(0).cumsum(1)

    area = over(prefix(covered(i0, j0, i1, j1, w)[:-1, :-1] * np.outer(*map(np.diff, grids))), a0, c0, a1, c1)
    sx, sy = bs
    both = sx & sy
    n = over(prefix(summed(i0[both], j0[both], w[both], shape)), a0, c0, a1, c1)
    one = covered(i0[sx], (j0 + sy)[sx], i0[sx] + 1, j1[sx], w[sx])  # a row for the start, the columns gone on in
    one = np.pad(one, ((1, 0), (0, 0))).cumsum(0)
    n += np.where(qs[1], one[a1, c0] - one[a0, c0], 0.0)
    one = covered((i0 + sx)[sy], j0[sy], i1[sy], j0[sy] + 1, w[sy])
    one = np.pad(one, ((0, 0), (1, 0))).cumsum(1)
    n += np.where(qs[0], one[a0, c1] - one[a0, c0], 0.0)
    n += np.where(qs[0] & qs[1], covered(i0 + sx, j0 + sy, i1, j1, w)[a0, c0], 0.0)
    return n, area


def met_sums(boxes: DataFrame, box: tuple[str, str, str, str], copies: str, cell: float, most: int = MATRIX) -> DataFrame:
    """Of distinct boxes (x0, y0, x1, y1) and the number of rows with each: the box, n and area, the number of rows whose
    boxes overlap it (itself included, if it has an area) and the sum of the areas in common. Each task holds the boxes
    of one cell; no pairs are made where coordinates recur, and where they don't, cells are halved first."""
    from .vector import celled, highest

    kind = dict(boxes.dtypes)
    keys = ["cell_k", "cell_x", "cell_y"]

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        k, x, y = (int(pdf[c].iat[0]) for c in keys)
        size = cell * 4.0**k
        b, w = pdf[list(box)].to_numpy(float).T, pdf[copies].to_numpy(float)
        starts = np.floor(b[:2] / size) == [[x], [y]]
        low, high = (x * size, y * size), ((x + 1) * size, (y + 1) * size)
        own, sound = (pdf["cell_own"] == k).to_numpy(), (b[0] < b[2]) & (b[1] < b[3])
        n, area = np.zeros(len(pdf)), np.zeros(len(pdf))
        # pairs of boxes that are both of lower levels are counted in lower cells
        for q, to in ((own, np.ones_like(own)), (~own, own)):
            reach = (b[0] < high[0]) & (b[1] < high[1]) & (b[2] > low[0]) & (b[3] > low[1])
            cases = [(gridded_sums, q & sound & reach, to & sound & reach, low, high)]
            anywhere = ((-np.inf, -np.inf), (np.inf, np.inf))
            cases += [(paired_sums, q & ~sound, to, *anywhere), (paired_sums, q & sound, to & ~sound, *anywhere)]
            for f, i, j, lo, hi in cases:
                if i.any() and j.any():
                    more = f(b[:, i], starts[:, i], b[:, j], starts[:, j], w[j], lo, hi, most)
                    n[i] += more[0]
                    area[i] += more[1]
        out = pdf[list(box)].copy()
        out["n"], out["area"] = n.astype(np.int64), area
        return out

    def run(frames):
        # cells come one after the other; the last of a batch may go on in the next
        held = []
        for pdf in frames:
            new = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1))
            for at, end in zip(new, [*new[1:], len(pdf)], strict=True):
                part = pdf.iloc[at:end]
                if held and (held[-1][keys].iloc[0] != part[keys].iloc[0]).any():
                    yield made(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
        if held:
            yield made(pd.concat(held, ignore_index=True))

    dealt = celled(boxes, box, cell, highest(boxes, box, cell)).select(*keys, "cell_own", *box, copies).repartition(*keys).sortWithinPartitions(*keys)
    sums = dealt.mapInPandas(run, ", ".join([*(f"{c} {kind[c]}" for c in box), "n bigint", "area double"]))
    return sums.groupBy(*box).agg(F.sum("n").alias("n"), F.sum("area").alias("area"))
