import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from geoloom.llm import bpe as B


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.ranks_of(B.vocabulary_bytes()), special_tokens={})


def test_digest_against_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {tuple(r) for r in B.op2(spark, "/root/testdata/sf0.001").collect()}
    want = set()
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), library.decode_bytes(ids))]
        want.add((r.doc_id, len(ids), *sha))
    assert got == want


@pytest.mark.parametrize("chunk,overlap,spread", [(40, 12, 1), (64, 64, 2), (1000, 8, 1), (40, 12, 10**6), (64, 64, 10**6), (7, 9, 10**6)])
def test_chunks_agree_with_the_whole(spark, library, odd, chunk, overlap, spread):
    more = spark.createDataFrame([(90, "it's we'll   I'd don't\n\n  x" * 30), (91, " " * 500 + "a'" * 300), (92, "12345678 " * 99 + "'r" * 50), (93, "<|endoftext|>é　  b" * 40)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    rows = B.decode(B.encode(docs, chunk=chunk, overlap=overlap, spread=spread)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_decoding_in_the_same_task(spark, odd):
    rows = B.encode(odd, chunk=500, spread=4, decoded=True).collect()
    assert len(rows) == odd.count() and all(bytes(r.decoded) == (r.text or "").encode() for r in rows)


def test_clashing_names_and_no_rows(spark, odd):
    rows = B.encode(odd.withColumnRenamed("n_words", "ids"))
    assert rows.columns == ["doc_id", "text", "score", "ids_in", "ids"]
    assert B.decode(B.encode(odd.limit(0))).count() == 0


def test_a_repeated_pretoken_longer_than_the_overlap(library):
    import regex

    text = "x" * 300 + " y z" * 50
    find = regex.compile(P.PATTERN)
    found = [B.boundaries(find, text[i : i + 50], i + 50 >= len(text)) for i in range(0, len(text), 40)]
    runs = B.seams(list(range(0, len(text), 40)), found, len(text))
    e = B.Encoder(B.vocabulary_bytes())
    assert [p for b, n in runs for p in e.run(text[b : n + B.AHEAD], n - b)] == find.findall(text)
    assert e.pieces(text, 40, 10) == find.findall(text)


def test_very_long_texts(spark, library):
    texts = ["word " * 400_000, "x" * 300_000, "a1 " * 50_000 + " " * 70_000 + "it's " * 40_000]
    rows = B.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), decoded=True).collect()
    for r in rows:
        assert r.decoded == texts[r.doc_id].encode() and len(r.ids) > 1_000
        if r.doc_id != 1:
            assert r.ids == library.encode_ordinary(texts[r.doc_id])
