import numpy as np
import xxhash

from geoloom.llm import simhash as S


def brute(rows):
    def fp(t):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        if not w:
            return 0
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and find(i) != find(j):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, fps[i], min(ids, default=None)))
    return out


def key(x):
    return (x[0] is None, x[0] or 0, x[1])


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_odd_rows_and_dedup(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_duplicates(odd).collect()]
    want = brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = S.deduplicated(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({(f, c) if c is None else c for _, f, c in want})
    assert S.near_duplicates(odd.limit(0)).count() == 0 and S.deduplicated(odd.limit(0)).count() == 0


def test_linked_pairs_share_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 500, dtype=np.uint64)
    one = np.uint64(1)
    y = x ^ (one << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (one << rng.integers(0, 64, 500, dtype=np.uint64))
    assert (np.bitwise_count(S.anchor(x) ^ x) <= 8).all()
    at = [{}, {}]
    for side, v in enumerate((x, y)):
        for i, k in zip(*S.anchors(v), strict=True):
            at[side].setdefault(int(i), set()).add(int(k))
    assert all(at[0][i] & at[1][i] for i in range(500))


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 3, dtype=np.uint64)
    fps = base[rng.integers(0, 3, 300)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    fps = np.unique(fps)

    def classes(pairs):
        root = {int(f): int(f) for f in fps}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in pairs:
            i, j = find(int(i)), find(int(j))
            root[max(i, j)] = min(i, j)
        return {i: find(i) for i in root}

    every = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if int(a ^ b).bit_count() <= 2]
    assert classes(every) == classes(zip(*S.forest(np.zeros(len(fps), np.uint64), fps), strict=True))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "a long, b long")
    assert {(r.node, r.root) for r in S.components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (200, 100)}


def test_crowded_anchors_are_split_by_points(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**64, 1, dtype=np.uint64)[0]
    near = [centre]
    for _ in range(400):  # a chain of neighbours, all about one anchor, and strangers
        near.append(near[rng.integers(len(near))] ^ np.uint64(1 << int(rng.integers(0, 12))) ^ np.uint64(1 << int(rng.integers(0, 64))))
    fps = np.unique(np.concatenate([np.array(near, np.uint64), rng.integers(0, 2**64, 300, dtype=np.uint64)]))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")

    def components():
        return sorted(tuple(r) for r in S.components(S.links(nodes)).collect())

    want = components()
    monkeypatch.setattr(S, "CROWD", 20)
    assert components() == want and len(want) > 300


def test_row_numbers_are_joined_by_a_shuffle_if_they_are_many(spark, odd, monkeypatch):
    want = sorted(map(str, S.deduplicated(odd).collect()))
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    assert sorted(map(str, S.deduplicated(odd).collect())) == want
