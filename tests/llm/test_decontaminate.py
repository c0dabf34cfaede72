import hashlib
import random
import re

import duckdb
import pytest

from geoloom.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            win = v[i : i + 10]
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add("" if item is None else str(item))
    return len(w), len(hit), sorted(ids), bool(hit)


def got(rows):
    return [(r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows]


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ä", "x1", "don", "t", "éé", "q", "zz", "Word"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 9, 10, 11, 30]))) for i in range(12)] + [(3, text(15)), (None, text(12)), (20, None), (21, "!?"), (22, "the of")]
    docs = [text(rng.randint(0, 80)) for _ in range(20)]
    docs += [text(5) + " " + (t or "") + " " + text(5) for _, t in items] + [(items[5][1] + " ") * 40, items[0][1], None, "", "..."]
    return docs, items


@pytest.mark.parametrize("seed,block", [(1, 400_000), (2, 25), (3, 1)])
def test_against_brute_force(spark, seed, block):
    docs, items = case(seed)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    b = spark.createDataFrame(items, "item_id int, text string")
    out = D.decontaminate(d, b, block_words=block).orderBy("doc_id").collect()
    assert got(out) == [brute(t, items) for t in docs]


def test_the_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(D.oracle())
    names = [c[0] for c in want.description]
    rows = D.op1(spark, sf)
    assert rows.columns == names
    assert sorted(map(tuple, rows.collect())) == sorted(want.fetchall())


def test_odd_rows_and_empty_tables(spark, odd):
    b = spark.createDataFrame([(7, "one two three one two three one two three one two")], "item_id int, text string")
    out = D.decontaminate(odd, b, carry=["doc_id", "text", "score"]).collect()
    assert sorted(map(str, got(out))) == sorted(str(brute(r.text, [(7, "one two three one two three one two three one two")])) for r in odd.collect())
    assert D.decontaminate(odd, b).columns == ["doc_id", "text", "score", "n_words_in", "n_words", "n_hit", "items", "contaminated"]
    none = D.decontaminate(odd, b.limit(0), carry=["doc_id"]).collect()
    assert len(none) == odd.count() and not any(r.contaminated or r.n_hit or r["items"] for r in none)
    assert D.decontaminate(odd.limit(0), b, carry=["doc_id"]).count() == 0
    digest = D.digest(D.decontaminate(odd, b.limit(0), carry=["doc_id"])).first()
    assert digest.items_sha256 == hashlib.sha256(b"").hexdigest()


def test_items_longer_than_a_block(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(2))
    long = " ".join(word() for _ in range(300))
    items = [(1, long), (2, "x y"), (3, " ".join(long.split()[35:50]))]
    docs = [" ".join(long.split()[k : k + n]) for k, n in ((0, 10), (31, 12), (100, 9), (290, 10), (50, 200))] + ["x y", "y x", long]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    b = spark.createDataFrame(items, "item_id int, text string")
    for block in (37, 1_000):
        assert got(D.decontaminate(d, b, block_words=block).orderBy("doc_id").collect()) == [brute(t, items) for t in docs]
