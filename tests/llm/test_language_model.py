import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geoloom.llm import language_model as M
from geoloom.llm.common import LOWER, remainder_of


def words(t):
    return [*(t or "").encode().translate(LOWER).split(), b"\n"]


def h(w):
    return xxhash.xxh64_intdigest(w)


def test_base_score_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in M.op8(spark, "/root/testdata/sf0.01").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    count = Counter(w for i, t in texts.items() if remainder_of(i, 7) != 2 for w in words(t))
    n, v = sum(count.values()), len(count)
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        w, r = words(t), rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in count for x in w), n, remainder_of(i, 7) == 2)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = [r for r in rows.values() if r.held_out]
    # an absolute-discount bigram gains 0.56 a token
    assert sum(r.score - r.base_score for r in out) > 0.6 * sum(r.n_tokens for r in out)


@pytest.mark.parametrize("d,above", [(0.3, 0.05), (0.8, 0.3)])
def test_tables_follow_their_conditional(d, above):
    c, strength, elsewhere, n = 6, 1.0, 7, 40_000
    s = M.log_stirling(d)
    weight = np.array([np.exp(s[c, t]) * np.prod([(strength + d * (elsewhere + j)) * above for j in range(t)]) for t in range(1, c + 1)])
    got = M.seat(np.full(n, c), np.full(n, elsewhere), strength, d, np.full(n, above), np.random.default_rng(1))
    assert np.allclose(np.bincount(got, minlength=c + 1)[1:] / n, weight / weight.sum(), atol=0.01)
    # two customers: apart or together
    assert math.isclose(np.exp(s[2, 1]), 1 - d) and s[2, 2] == 0


@pytest.mark.parametrize("above,elsewhere,d", [(0.01, 100, 0.5), (0.001, 20_000, 0.8), (0.05, 3_000, 0.3), (0.0001, 10, 0.7)])
def test_customers_seated_in_groups_hardly_move_probabilities(above, elsewhere, d):
    n, c = 1_000, 3_000
    exact, groups = (M.seat(np.full(n, c), np.full(n, elsewhere), 1.0, d, np.full(n, above), np.random.default_rng(2), limit).mean() for limit in (c, M.EXACT))
    assert abs((c - d * groups) / (c - d * exact) - 1) < 0.01


def test_packing():
    a, b = np.array([1, 5, 2**60], np.uint64), np.zeros(0, np.uint16)
    x, y = M.unpack(M.pack(a, b))
    assert (x == a).all() and y.dtype == np.uint16 and len(y) == 0
    assert [M.narrow(np.array([x])).dtype.itemsize for x in (255, 256, 2**32 - 1, 2**32)] == [1, 2, 4, 8]


def gibbs(texts, sweeps, seed=0):
    """Brute force: the same model by seating customers one by one at single tables, in dictionaries; returns the
    averaged predictive probability of a word after another."""
    rng = np.random.default_rng(seed)
    pairs = Counter((b, w) for t in texts for b, w in zip([b"\n", *words(t)], words(t), strict=False))
    vocabulary = sorted({w for _, w in pairs})
    d0 = M.discount(sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values()))
    tables = [defaultdict(list), defaultdict(list), defaultdict(list)]  # (restaurant, word): table sizes

    def restaurant(level, before):
        return before if not level else M.ending(before) if level == 1 else 0

    def sums(level, r):
        found = [x for (k, _), x in tables[level].items() if k == r]
        return sum(map(sum, found)), sum(map(len, found))

    def p(level, before, w, d):
        if level == 3:
            return 1 / (len(vocabulary) + 1)
        r = restaurant(level, before)
        n, t = sums(level, r)
        own = tables[level].get((r, w), [])
        return (sum(own) - d[level] * len(own) + (1 + d[level] * t) * p(level + 1, before, w, d)) / (1 + n)

    def sit(level, before, w, d):
        if level == 3:
            return
        r = restaurant(level, before)
        own = tables[level][r, w]
        odds = [x - d[level] for x in own] + [(1 + d[level] * sums(level, r)[1]) * p(level + 1, before, w, d)]
        k = rng.choice(len(odds), p=np.array(odds) / sum(odds))
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            sit(level + 1, before, w, d)

    def leave(level, before, w):
        if level == 3:
            return
        own = tables[level][restaurant(level, before), w]
        k = rng.choice(len(own), p=np.array(own) / sum(own))
        own[k] -= 1
        if not own[k]:
            del own[k]
            leave(level + 1, before, w)

    customers = [(b, w) for (b, w), c in pairs.items() for _ in range(c)]
    d = (d0, 0.5, 0.5)
    for b, w in customers:
        sit(0, b, w, d)
    total, kept = Counter(), 0
    asked = [(b, w) for b in {b for b, _ in pairs} for w in vocabulary]
    for sweep in range(sweeps):
        for b, w in customers:
            leave(0, b, w)
            sit(0, b, w, d)
        # discounts as the operator estimates them: from the customers of each level
        size = [[sum(x) for x in tables[level].values() if x] for level in (1, 2)]
        d = (d0, *(M.discount(sum(c == 1 for c in x), sum(c == 2 for c in x)) for x in size))
        if sweep >= sweeps // 3:
            kept += 1
            for b, w in asked:
                total[b, w] += p(0, b, w, d)
    return lambda b, w: total[b, w] / kept


def test_scores_are_near_those_of_a_sampler_that_seats_customers_singly(spark):
    texts = ["the cat sat on the mat", "the dog sat on the cat", "a cat and a dog", "the mat the mat the mat", "on and on and on"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in M.language_model(docs, F.lit(True), burn_in=4, samples=12).collect()}
    p = gibbs(texts, 60)
    for i, t in enumerate(texts[:5]):
        want = sum(math.log10(p(b, w)) for b, w in zip([b"\n", *words(t)], words(t), strict=False))
        assert abs(got[i] / want - 1) < 0.05, (t, got[i], want)


def test_scores_where_seating_is_certain(spark):
    """Each pair, each word of an ending, and each word occurs once, so that all have one table: the formula by hand."""
    text = "aa bb cc dd"
    docs = spark.createDataFrame([(1, text, True), (2, "bb aa zz", False)], "doc_id long, text string, learn boolean")
    got = {r.doc_id: r for r in M.language_model(docs, F.col("learn")).collect()}
    before = [b"\n", *words(text)]
    seen, d, v = set(zip(before, words(text), strict=False)), M.discount(5, 0), 5

    def p(b, w):
        root = ((1 - d if w in words(text) else 0) + (1 + d * v) / (v + 1)) / (1 + v)
        known = b in before[:-1]
        for _ in range(2):  # the ending's restaurant, then the word's
            root = (((1 - d) if (b, w) in seen else 0) + (1 + d) * root) / 2 if known else root
        return root

    for i, t in ((1, text), (2, "bb aa zz")):
        assert math.isclose(got[i].score, sum(math.log10(p(b, w)) for b, w in zip([b"\n", *words(t)], words(t), strict=False)), rel_tol=1e-6)


def test_probabilities_after_a_word_add_up_to_one(spark):
    texts = ["ab1cd p", "ab2cd q", "ab1cd p p", "r s", "", None] * 3
    vocabulary = sorted({w for t in texts for w in words(t)})
    asked = [f"{b} {w}" for b in ("ab1cd", "ab2cd", "p", "new") for w in ["p", "q", "r", "s", "ab1cd", "ab2cd", "unseen"]]
    assert len(vocabulary) == 7
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(100 + i, t, False) for i, t in enumerate([*asked, *(a.split()[0] for a in asked), *(a.split()[1] for a in asked), ""])]
    score = {r.doc_id: r.score for r in M.language_model(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), F.col("learn")).collect()}
    by_text = {t: score[100 + i] for i, t in enumerate([*asked, *(a.split()[0] for a in asked), *(a.split()[1] for a in asked), ""])}
    # score("b w") = p(b|start) p(w|b) p(end|w); score("b") = p(b|start) p(end|b); so p(w|b)/p(end|b) is known but for p(end|w)
    # and p(b|start), p(end|b) come from the texts of one word only together: take ratios of texts that end alike
    assert by_text["ab1cd p"] > by_text["ab1cd q"] + 0.3 and by_text["ab2cd q"] > by_text["ab2cd p"] + 0.3
    state, totals, line = in_memory([t for t in texts])
    for b in (b"ab1cd", b"ab2cd", b"p", b"\n"):
        assert math.isclose(sum(probability(state, totals, line, b, w) for w in [*vocabulary, b"unseen"]), 1, rel_tol=1e-9)


def in_memory(texts):
    """The state of one context bucket that asks for all words after all words, the totals after a round, the line."""
    vocabulary = sorted({w for t in texts for w in words(t)} | {b"unseen"}, key=h)
    pairs = Counter((b, w) for t in texts for b, w in zip([b"\n", *words(t)], words(t), strict=False))
    line = M.Line({}, [], 10**9)
    uh = np.array([h(w) for w in vocabulary], np.uint64)
    ue = np.array([M.ending(w) for w in vocabulary])
    c = np.array([pairs[b, w] for b in vocabulary for w in vocabulary])
    n = len(vocabulary)
    state = M.Contexts(uh, ue, np.full(n, n), uh, np.tile(np.arange(n), n), c)
    at = np.arange(len(state.entry_g))
    g = state.entry_g
    upper = M.Words(np.array([0]), np.array([len(at)]), at, n, state.entry_w, g)
    for k in range(3):
        tables = state.tables()
        if k:
            upper.draw(tables, totals, np.random.default_rng(k))
        else:
            upper.begin(tables)
        summed = {key: (a, b) for key, a, b in upper.totals(tables)} | {M.NUMBERS + 1: (3, 1)}
        totals = M.Totals(summed, n - 1, int(c.sum()), 0)
        (_, (x, t, n_w, s)), = upper.down(tables)
        above = totals.probability(g, x, t, n_w, s)[state.entry]
        c_u, elsewhere, _ = state.restaurants(line, totals.t_split)
        state.p = state.predictive(c_u, elsewhere, totals.d[0], above)
        if k < 2:
            state.draw(elsewhere, totals.d[0], above, np.random.default_rng(k))
    return (vocabulary, state), totals, line


def probability(state, totals, line, b, w):
    vocabulary, contexts = state
    n = len(vocabulary)
    return contexts.p[vocabulary.index(b) * n + vocabulary.index(w)]


def test_same_scores_however_rows_are_dealt_and_contexts_split(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    learn = F.col("doc_id") % 5 != 0
    score = lambda df: {r.doc_id: r.score for r in M.language_model(df, learn).collect()}
    one = score(docs)
    monkeypatch.setattr(M, "BLOCK_TOKENS", 3_000)
    other = score(docs.repartition(7))
    assert all(math.isclose(one[i], other[i], rel_tol=1e-6) for i in one)
    # split contexts and small buckets: other draws, nearly the same scores
    monkeypatch.setattr(M, "SPLIT_TOKENS", 300)
    monkeypatch.setattr(M, "BUCKET_TOKENS", 5_000)
    monkeypatch.setattr(M, "BUCKET_WORDS", 4_000)
    other = score(docs)
    assert all(abs(one[i] - other[i]) < 0.01 * abs(one[i]) + 0.5 for i in one)


def test_odd_rows_and_empty_tables(spark, odd, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 50)
    rows = M.language_model(odd, F.lit(True)).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(words(r.text)) for r in odd.collect())
    assert all(r.n_known == r.n_tokens and r.score < 0 for r in rows)
    rows = M.language_model(odd, F.lit(None).cast("boolean")).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(0, 0, 0.0, 0.0)}
    assert M.language_model(odd.limit(0), F.lit(True)).count() == 0
    names = spark.createDataFrame([("x", "a b"), (None, "a")], "name string, t string")
    assert {r.name for r in M.language_model(names, F.lit(True), "t", "name").collect()} == {"x", None}
