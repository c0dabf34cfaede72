import hashlib

import pytest

from geoloom.llm import bpe, pii, toxicity
from geoloom.llm.common import written

from .test_pii import brute as brute_pii
from .test_simhash import brute as brute_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stage_by_stage(spark):
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    before = rows(docs)

    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    m = toxicity.Matcher(model)
    now = written(stages["toxicity"](spark, docs, SF))
    after = rows(now)
    assert now.columns == columns
    assert after.keys() == {i for i, r in before.items() if model.score(m.rate(r.text)) < 0.3}

    before, now = after, written(stages["near_duplicates"](spark, now, SF))
    after = rows(now)
    assert now.columns == columns
    assert after.keys() == {c for _, _, c in brute_groups([(i, r.text) for i, r in before.items()])}

    before, now = after, written(stages["decontamination"](spark, now, SF))
    after = rows(now)
    import re

    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word(r.text)
        windows |= {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    assert all(len(x.split()) == 10 for x in windows)
    clean = {i for i, r in before.items() if not any(" ".join(w[k : k + 10]) in windows for w in [word(r.text)] for k in range(len(w)))}
    assert now.columns == columns and after.keys() == clean and len(clean) < len(before)

    before, now = after, written(stages["personal_data"](spark, now, SF))
    after = rows(now)
    assert now.columns == columns and after.keys() == before.keys()
    for i, r in before.items():
        assert not brute_pii(after[i].text)
        if not brute_pii(r.text) and not any(c.isdigit() for c in r.text):
            assert after[i] == r

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(bpe.vocabulary_bytes()), special_tokens={})
    out = rows(stages["bpe_tokens"](spark, now, SF))
    assert out.keys() == after.keys()
    for i, r in after.items():
        assert out[i].ids == library.encode_ordinary(r.text)
        assert out[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_odd_rows_pass_through(spark, odd, tmp_path):
    from pyspark.sql import functions as F

    odd.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len({c if c is not None else ("none", f) for _, f, c in brute_groups([(r.doc_id, r.text) for r in odd.collect()])})
    assert pii is not None
