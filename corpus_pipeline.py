"""The corpus pipeline: five stages, each written as Parquet and reread by the next.

quality      documents that the positive-unlabelled classifier scores under 0.3 go
near_copies  five-word shingles, similarity 0.8: one document of each component stays
private      private spans give way to tags; n_chars follows the text
mixing       documents are repeated until expected domain totals meet the targets; none goes
encode       SentencePiece ids of every document
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm import mixing, ngram_join, pieces, pii, quality
from dayloom.llm.common import Scratch, free_name, read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the stage's own documents as unlabelled text. Null scores do not occur."""
    scratch = Scratch(spark)
    shapes = scratch.put(quality.with_features(docs.select("doc_id", "text")), "shapes")
    model = quality.fit_pu(shapes, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scratch.drop(shapes)
    score = free_name(docs, "__score")
    kept = quality.score_documents(docs, model, out=score).where(F.col(score) >= quality.THRESHOLD)
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with a component's smallest id stays; documents without words and without
    an id are in no group and stay. Of rows that repeat an id one stays."""
    scratch = Scratch(spark)
    found = scratch.put(ngram_join.jaccard_components(docs, 5, 80, 100), "components")
    own = free_name(docs, "__id")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(own))
    repeated = kept.groupBy(own).count().where("count > 1").limit(1).count() > 0
    out = docs.join(kept.distinct() if repeated else kept, F.col("doc_id") == F.col(own), "left_semi")
    if repeated:
        out = out.dropDuplicates(["doc_id"])
    if found.where("doc_id is null").limit(1).count():
        out = out.unionByName(docs.where("doc_id is null"))
    return out.select(*docs.columns)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, read_table(spark, sf_dir, "labels").select("doc_id"), "lang", least=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs.select("doc_id", "text"), pieces.default_model_file(), with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("private", redact_private),
    ("mixing", mix_domains),
    ("encode", encode),
]

#: Trained models and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        new = scratch.put(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop(docs)
        docs = new
    return docs
