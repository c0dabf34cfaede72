import random

from tokenizers import Tokenizer
from tokenizers.models import Unigram

from geoloom.llm import token_counts as C


def library(pieces):
    t = Tokenizer(Unigram(pieces, 0, False))
    return lambda text: len(t.encode(C.SPACE + text.replace(" ", C.SPACE)).ids) if text else 0


def test_documents_against_the_library(spark):
    count = library(C.vocabulary())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in C.op3(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: count(r.text) for r in docs.collect()}


def test_hard_texts_against_the_library():
    count, mine = library(C.vocabulary()), C.Counter(C.vocabulary())
    assert mine.by_word
    rng = random.Random(2)
    texts = ["", " ", "   ", "a  b", " a", "a ", "\n\n", "͸͹ ͸", "<unk> <s>", "日本語؀\U0001f600\U0001f600x", "x" * 3000, "▁▁a ▁b"]
    texts += ["".join(rng.choice("abe  \nßé<u0͸▁") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for t in texts:
        assert mine.count(t) == count(t), repr(t)


def test_ties_go_to_the_piece_that_begins_first():
    for scores in ([-1.0] * 7, [-2.0, -1.0, -1.0, -2.0, -2.0, -1.0, -1.0], [-1.5, -0.1, -0.2, -0.3, -0.4, -0.1, -0.2]):
        pieces = [("<unk>", 0.0), *zip(["a", "b", "ab", "ba", "aba", "bab", "▁"], scores, strict=True)]
        count, mine = library(pieces), C.Counter(pieces)
        rng = random.Random(3)
        for _ in range(300):
            t = "".join(rng.choice("aab b?") for _ in range(rng.randint(1, 25)))
            assert mine.count(t) == count(t), (t, scores)


def test_odd_rows(spark, odd):
    count = library(C.vocabulary())
    out = C.token_counts(odd.withColumnRenamed("n_words", "n_tokens"))
    assert out.columns == ["doc_id", "text", "score", "n_tokens_in", "n_tokens"]
    assert all(r.n_tokens == count(r.text or "") for r in out.collect())
    assert C.token_counts(odd.limit(0)).count() == 0


def test_a_long_text_without_spaces_needs_little_memory():
    import tracemalloc

    mine = C.Counter(C.vocabulary())
    text = "日本語のabc" * 100_000
    tracemalloc.start()
    n = mine.pieces(C.SPACE + text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == library(C.vocabulary())(text)
    assert peak < 8 * len(text)  # two copies of the text, of two and four bytes a sign
