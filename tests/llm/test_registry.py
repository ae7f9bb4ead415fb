"""Every registered query over the whole tables of sf0.001, against a second implementation."""

import binascii
import hashlib
import re

import duckdb
import numpy as np
import pytest

from dayloom.llm import ann, pieces, quality, registry, toxicity
from test_ngram_join import brute as components
from test_pii import brute as private

SF = "/root/testdata/sf0.001"
TEXTS = {}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def test_op1(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    got = {}
    for r in sorted(run(spark, "op1_kmeans_tree"), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 50 == 0}
    hits = []
    ids = np.array(sorted(good))
    every = np.stack([good[i] for i in ids])
    for q, found in got.items():
        scores = ann.cosine(good[q][None], every)
        best = [int(i) for i in ids[np.lexsort((ids, -scores))] if i != q][:5]
        hits.append(len({i for i, _ in found} & set(best)) / 5)
        assert all(abs(s - float(ann.cosine(good[q][None], good[i][None])[0])) < 1e-12 for i, s in found)
    assert np.mean(hits) >= 0.9


def test_op2(spark):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    theirs = {r[0]: r[1:] for r in c.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({registry.ORACLES['op2_warc_zip']})").fetchall()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run(spark, "op2_warc_zip")} == theirs


def test_op3(spark, texts):
    rows = run(spark, "op3_private_spans")
    assert len(rows) == len(texts)
    for r in rows:
        counts, sha, said = private(texts[r.doc_id])
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (counts, sha)
        assert [s for s in r.spans.split(",") if s and not s.startswith("identifier")] == [s for s in said.split(",") if s]


def test_op4(spark, texts):
    for r in run(spark, "op4_ogg_media"):
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), binascii.crc32(padded[-64:]))


def test_op5(spark, texts):
    rows = run(spark, "op5_soft_mixing")
    assert {r.doc_id for r in rows} == set(texts) and all(abs(sum(r.posterior) - 1) < 1e-4 and r.rate >= 0 and np.floor(r.rate) <= r.copies <= np.floor(r.rate) + 1 for r in rows)
    n, p, rate = np.array([r.n_tokens for r in rows], float), np.array([r.posterior for r in rows]), np.array([r.rate for r in rows])
    share = (n @ p / (n @ p).sum()) ** 0.7
    assert np.allclose((n * rate) @ p / n.sum(), share / share.sum(), rtol=0.05)


def test_op6(spark, texts):
    truth = components(list(texts.items()), 3, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op6_ngram_join")} == truth


@pytest.mark.parametrize("name, label, folds, fold, threshold, least", [("op7_quality_pu", "quality", 5, 0, quality.THRESHOLD, 0.9), ("op10_toxicity", "toxic", 3, 1, toxicity.THRESHOLD, 0.85)])
def test_scores(spark, texts, name, label, folds, fold, threshold, least):
    rows = {r.doc_id: r for r in run(spark, name)}
    assert set(rows) == set(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) and r.held_out == (binascii.crc32(str(i).encode()) % folds == fold) for i, r in rows.items())
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r[label] is not None}
    judged = [rows[i].predicted == y for i, y in labels.items() if rows[i].held_out]
    assert np.mean(judged) >= least


def test_op8(spark, texts):
    processor = __import__("sentencepiece").SentencePieceProcessor(model_file=pieces.default_model_file())
    for r in run(spark, "op8_sentencepiece"):
        ids = processor.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(processor.decode(ids).encode()).hexdigest())


def test_op9(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in run(spark, "op9_url_filter"):
        found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (re.sub("[A-Z]", lambda m: m.group().lower(), found.group(1)), found.group(2)) if found else ("", "")
        fits = [(len(d + p), d + p, v) for v, d, p in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")) if (host == d or host.endswith("." + d)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None) and r.verdict in ("allow", "block")
        assert not fits or r.verdict == max(fits)[2]
