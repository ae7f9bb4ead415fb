import hashlib

import corpus_pipeline as c
from dayloom.llm import mixing, pieces, pii, quality
from test_ngram_join import brute
from test_pii import CONTRACT

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "", None, None, None), (None, "a b c d e f g", "en", "s", 1)], docs.schema)
    docs, seen = docs.union(extra).cache(), []
    for name, stage in c.STAGES:
        new = stage(spark, docs, SF)
        assert name == "encode" or new.columns == docs.columns
        new.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r for r in docs.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, single, clean, mixed, ids = seen
    judged = [(i in kept) == bool(y) for i, y in labels.items()]
    assert sum(judged) / len(judged) > 0.95
    truth = brute([(i, r.text) for i, r in kept.items()], 5, 80, 100)
    assert set(single) - {None} == {i for i, (_, top) in truth.items() if top == i}
    assert set(clean) == set(single) == set(mixed) == set(ids)
    import re

    for i, r in clean.items():
        assert not re.search(CONTRACT["email"], r.text or "") and (r.text is None or r.n_chars == len(r.text))
    processor = __import__("sentencepiece").SentencePieceProcessor(model_file=pieces.default_model_file())
    for i, r in ids.items():
        want = processor.encode(mixed[i].text or "")
        assert r.ids == want and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert mixing and pii and quality


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in c.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.collect() == []
