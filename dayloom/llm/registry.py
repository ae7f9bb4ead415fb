"""The training-data queries, and SQL for those that SQL can express."""

from __future__ import annotations

from dayloom.llm import ann, mixing, ngram_join, ogg, pieces, pii, quality, toxicity, urlfilter, warc

QUERIES = {
    "op1_kmeans_tree": ann.op1_kmeans_tree,
    "op2_warc_zip": warc.op2_warc_zip,
    "op3_private_spans": pii.op3_private_spans,
    "op4_ogg_media": ogg.op4_ogg_media,
    "op5_soft_mixing": mixing.op5_soft_mixing,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_quality_pu": quality.op7_quality_pu,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES: dict[str, str] = {
    "op2_warc_zip": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
        d AS (SELECT page_id, octet_length(raw) AS payload_bytes, sha1(raw) AS payload_digest FROM p),
        l AS (SELECT payload_digest, max(page_id) AS leader FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN l.leader IS NULL OR l.leader = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN l.leader <> d.page_id THEN l.leader END AS refers_to
        FROM d LEFT JOIN l ON d.payload_digest = l.payload_digest AND d.payload_bytes >= 1000
    """,
}
