import re

import numpy as np

from geoloom.llm import quality_classifier as Q
from geoloom.llm import quality_rules as R
from geoloom.llm.common import remainder_of

SF = "/root/testdata/sf0.01"


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_base_counts_against_brute_force(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.collect() if len(r.text) < 8_000] + [r.text for r in odd.collect() if len(r.text or "") < 9_000]
    for t in [*texts, "a b c d e f a b c d e", "x " * 30, "##|<>", "a\x0bb\x0cc\rd"]:
        assert R.base_counts(t.encode() if t is not None else None) == brute(t)


def test_repeats_in_a_large_vocabulary():
    rng = np.random.default_rng(5)
    words = [str(i).encode() for i in rng.integers(0, 40_000, 30_000)]
    words[20_000:20_007] = words[100:107]
    assert R.repeated_words(words) == 14


def check_held_out(spark, rows, column, least):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(r[column], truth[r.doc_id]) for r in rows.collect() if r.doc_id in truth and remainder_of(r.doc_id, 4) == 2]
    assert len(got) > 50
    for y in (0, 1):
        assert np.mean([bool(g) == bool(y) for g, t in got if t == y]) >= least


def test_rules_on_held_out_rows(spark):
    check_held_out(spark, R.op4(spark, SF), "kept", 0.9)


def test_classifier_on_held_out_rows(spark):
    check_held_out(spark, Q.op7(spark, SF), "predicted", 0.95)


def test_classifier_ignores_labels_of_the_hold_out(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.learn(docs, labels), Q.learn(docs, turned)
    assert a.slope == b.slope and all(np.array_equal(x, y) for x, y in zip(a.factors, b.factors, strict=True))


def test_log_density_difference():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (200, Q.N_STATISTICS)), rng.normal(1, 2, (300, Q.N_STATISTICS))])
    m = Q.fitted(x, np.repeat([0.0, 1.0], [200, 300]))
    z = (x[:5] - m.centre) / m.scale
    for i in range(5):
        d = [-0.5 * np.sum((f @ (z[i] - mu)) ** 2) + np.log(np.abs(np.diag(f))).sum() for mu, f in zip(m.means, m.factors, strict=True)]
        assert np.isclose(d[1] - d[0], m.difference(x[:5])[i])


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(6)
    f = R.Field(rng.normal(size=(2, R.N_FEATURES)), rng.normal(size=(2, 2)))
    x = rng.normal(size=(7, R.N_FEATURES))

    def value(y):
        return sum(x[i] @ f.weights[c] for i, c in enumerate(y)) + sum(f.steps[a, b] for a, b in zip(y, y[1:]))

    every = [tuple(k >> i & 1 for i in range(7)) for k in range(128)]
    assert tuple(f.labels(x)) == max(every, key=value)


def test_odd_rows(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rules = R.quality_rules(odd, R.learn(docs, labels))
    assert rules.columns[:4] == ["doc_id", "text", "score", "n_words_in"] and rules.count() == odd.count()
    assert not any(r.kept for r in rules.collect() if not (r.text or "").split())
    scored = Q.quality(odd, Q.learn(docs, labels)).collect()
    assert len({r.score for r in scored if r.text in (None, "", " \n\t ")}) == 1 and all(0 <= r.score <= 1 for r in scored)
    none = Q.learn(docs, labels.limit(0))
    assert {r.score for r in Q.quality(odd, none).collect()} == {0.5}
    assert R.quality_rules(docs.limit(0), R.learn(docs.limit(0), labels)).count() == 0


def test_discriminant_against_densities_with_plain_inverses():
    """The model's covariances by their definition, and the log densities with inverses and determinants."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (150, Q.N_STATISTICS)), rng.normal(0.5, 1.5, (250, Q.N_STATISTICS))])
    y = np.repeat([0.0, 1.0], [150, 250])
    m, d = Q.fitted(x, y), Q.N_STATISTICS
    z = (x - x.mean(0)) / (x.std(0) + 1e-3)
    own = {c: z[y == c] for c in (0, 1)}
    centred = {c: own[c] - own[c].mean(0) for c in (0, 1)}
    pooled = sum(v.T @ v for v in centred.values()) / len(y)

    def density(v, c):
        cov = (centred[c].T @ centred[c] + d * pooled) / (len(own[c]) + d)
        cov = (1 - Q.POOLED - Q.DIAGONAL) * cov + Q.POOLED * pooled + Q.DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
        gap = v - own[c].mean(0)
        return -0.5 * gap @ np.linalg.inv(cov) @ gap - 0.5 * np.log(np.linalg.det(cov))

    want = [density(v, 1) - density(v, 0) for v in z[:20]]
    assert np.allclose(m.difference(x[:20]), want, rtol=1e-6)
    assert np.allclose(m.score(x[:20]), [1 / (1 + np.exp(-np.clip(m.slope * v + m.base, -30, 30))) for v in want], rtol=1e-6)


def test_lines_of_one_text_get_different_labels_and_kept_follows_them(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = R.learn(docs, labels)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    texts = [(quality[r.doc_id], r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in quality and 3 <= r.text.count(chr(10)) <= 8]
    good, bad = next(t for q, t in texts if q), next(t for q, t in texts if not q)
    labelled = m.labels(R.line_features(f"{good}\n{bad}".encode())[0])
    assert labelled[: good.count(chr(10)) + 1].mean() > 0.7 and labelled[good.count(chr(10)) + 1 :].mean() < 0.3
    # by brute force: the best of all labellings, the share of its content words, and the rules
    some = [t for _, t in texts[:25]] + [f"{good}\n{bad}"]
    got = {r.doc_id: r for r in R.quality_rules(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), m).collect()}
    for i, t in enumerate(some):
        x, sizes = R.line_features(t.encode())
        if len(x) > 11:
            continue
        every = [[k >> j & 1 for j in range(len(x))] for k in range(2 ** len(x))]
        value = lambda y: sum(x[j] @ m.weights[c] for j, c in enumerate(y)) + sum(m.steps[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(every, key=value)
        share = sum(s for s, c in zip(sizes, best) if c) / sizes.sum()
        n, _, _, _, repeated = brute(t)
        assert np.isclose(got[i].content_share, share)
        assert got[i].kept == (not (n < 10 or 100 * repeated > 20 * n) and share >= m.least)
