"""A corpus pipeline of five operators; every stage's rows are written as Parquet and read again by the next one.

1. quality classifier: documents it rejects go;
2. MinHash near-dedup: one document of each group stays;
3. benchmark decontamination: contaminated documents go;
4. personal data: spans become [KIND], and n_chars follows the text;
5. SentencePiece: ids of each text.

Defined results: a null text has no features of a good document or a bad one and is judged by the classifier like an empty
one; documents without words pass stages 2 to 4 as they are; texts of any length are worked on whole; of rows that agree in
doc_id and text one stays after stage 2 (ties); an empty table gives no rows; columns that a stage doesn't need pass
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, near_dedup, pii, quality_gam, sentencepiece_codec
from weftline.llm.common import free_name, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_gam.keep_good(docs, quality_gam.training_labels(spark, sf_dir))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = free_name(docs, "length")
    out = pii.redact(docs.withColumn(before, F.length("text")))
    changed = F.length("text") != F.col(before)
    return out.select(*[F.when(changed, F.length("text")).otherwise(F.col(c)).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.apply(docs, sentencepiece_codec.default_model())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", "parity")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("near_dedup", dedup),
    ("decontamination", clean),
    ("pii", redact),
    ("sentencepiece", encode),
]

#: Trained models and signatures have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
