import random

from geoloom.llm import toxicity as X
from geoloom.llm.common import remainder_of


def corpus(spark):
    rng, docs, labels = random.Random(3), [], []
    for i in range(900):
        words = ["".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(1 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(["zwack", "grobfl" + rng.choice("aeiou")]))
        elif i % 30 == 1:
            words[3:3] = ["zwack", "hammer"]  # a harmless phrase
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    m = X.learn(docs, labels)
    assert "zwack" in m.words and any("grobfl".startswith(b) for b in m.beginnings)
    assert "zwack hammer" in m.exceptions
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in X.toxicity(docs, m).collect() if remainder_of(r.doc_id, 4) == 2]
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.97 * len(got)


def test_labels_of_the_hold_out_are_never_read(spark):
    from pyspark.sql import functions as F

    docs, labels = corpus(spark)
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.learn(docs, labels) == X.learn(docs, turned)


def test_folding_borders_length_and_exceptions():
    m = X.Matcher(X.Model({"zwack": 2.0}, {"grob": 1.0}, {"zwack hammer"}, 1.0, -1.0))
    assert m.rate("zwack") == 200.0 == m.rate("2w4ck") == m.rate("ZWАCK")  # the last with a Cyrillic letter
    assert m.rate("zwack and three more") == 50.0
    assert m.rate("zwacks azwack") == 0 and m.rate("grobian") == 100.0 and m.rate("begrob") == 0
    assert m.rate("zwack hammer") == 0 and m.rate("hammer zwack!") == 100.0
    assert m.rate("") == m.rate("   ") == 0


def test_odd_rows(spark, odd):
    docs, labels = corpus(spark)
    out = X.toxicity(odd, X.learn(docs, labels))
    assert out.columns == ["doc_id", "text", "score_in", "n_words", "score", "predicted"]
    assert all(0 <= r.score < X.THRESHOLD and r.predicted == 0 for r in out.collect())
    none = X.learn(docs.limit(0), labels)
    assert none == X.Model() and X.toxicity(docs.limit(0), none).count() == 0
    assert X.learn(docs, labels.limit(0)) == X.Model()


def naive_rate(m, text):
    """By trying every entry at every place."""
    low = text.lower()
    folded, inside = low.translate(X.FOLD), lambda c: c.isalpha() or c.isdigit()
    total, words = 0.0, [(w.start(), w.end(), w.group()) for w in X.WORD.finditer(folded)]
    for i in range(len(low)):
        if i and inside(low[i - 1]):
            continue
        here = [x for w, x in m.words.items() if folded.startswith(w, i) and not (i + len(w) < len(low) and inside(low[i + len(w)]))]
        here += [x for w, x in m.beginnings.items() if folded.startswith(w, i)]
        if not here:
            continue
        me = X.WORD.match(folded, i)
        if me:
            before = [w for _, e, w in words if e <= i][-1:]
            # a word that begins before i ends at i where a sign stands between them that folds to a letter
            cut = [folded[b:i] for b, e, _ in words if b < i < e]
            after = [w for b, _, w in words if b >= me.end()][:1]
            phrases = {f"{me.group()} {w}" for w in after} | {f"{w} {me.group()}" for w in (cut or before)}
            if phrases & m.exceptions:
                continue
        total += max(here)
    n = len(text.split())
    return 100 * total / n if n else 0.0


def test_rate_against_every_entry_at_every_place():
    rng = random.Random(9)
    for _ in range(300):
        syllable = lambda: rng.choice("abcdst") + rng.choice("aeio4 0!")
        entry = lambda: "".join(rng.choice("abcdst") + rng.choice("aeio") for _ in range(rng.randint(1, 2)))
        m = X.Model({entry(): rng.random() for _ in range(5)}, {entry(): rng.random() for _ in range(3)}, {f"{entry()} {entry()}" for _ in range(40)}, 1.0, -1.0)
        t = "".join(syllable() + rng.choice(["", "", " ", "  ", ". ", "9 "]) for _ in range(40)).upper()
        assert abs(X.Matcher(m).rate(t) - naive_rate(m, t)) < 1e-9, t


def test_exceptions_beside_very_long_words():
    m = X.Matcher(X.Model({"zwack": 2.0}, {}, {"zwack " + "b" * 500, "c" * 500 + " zwack"}, 1.0, -1.0))
    assert m.rate("zwack " + "b" * 500) == 0 and m.rate("c" * 500 + ", " * 200 + "zwack") == 0 and m.rate("zwack") > 0
