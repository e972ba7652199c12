"""From raw documents to token ids: quality, near-duplicates, decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it has kept, as read back from Parquet. All but the
last return the columns of documents. Null or empty texts are documents like any other; the first stage decides on them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, containment, near_dup, pii, quality
from lexloom.llm.common import fresh, shared_dir, shared_table, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it is fitted on a bounded sample of the labelled ones.

    Each row is judged by its own text, a null one as an empty one and a long one whole: repeated rows stay or go together. An
    empty table stays empty. Columns of docs pass unchanged, whatever their names.
    """
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")
    return quality.score(docs, model, score, predicted).filter(F.col(predicted) == 1).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of five-word shingles, similarity 0.8 or more, hold together: that of the smallest doc_id
    (null ids last), of rows that share it the first.

    Rows are compared as rows, so repeated, shared or null ids make no difference. Rows with null, empty or blank text have no
    shingles and all stay; long texts are compared whole. An empty table stays empty; columns of docs pass unchanged.
    """
    row = fresh(docs, "row")
    staged = shared_table(spark, docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_dup.near_duplicates(staged.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias("r"), "component_id")
    several = shared_table(spark, found.join(found.filter("r <> component_id").select("component_id").distinct(), "component_id"), "groups")
    ids = staged.select(F.col(row).alias("r"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("r")).alias("first"))
    stays = several.join(ids, "r").groupBy("component_id").agg(F.min("first").alias("first")).select(F.col("first.r").alias("r"))
    goes = several.join(stays, "r", "left_anti").select(F.col("r").alias(row))
    return staged.join(goes, row, "left_anti").select(docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item (four fifths of its five-word shingles).

    Each row is judged by its own text, whatever its id: the texts are told apart by their MD5 digests. Null and empty texts hold
    nothing and stay; long texts are searched whole; repeated rows stay or go together. An empty table stays empty, an empty
    benchmark leaves all. Columns of docs pass unchanged.
    """
    found = containment.contaminated(docs.select(F.md5("text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    digest = fresh(docs, "digest")
    found = found.select(F.col("doc_id").alias(digest)).distinct()
    return docs.withColumn(digest, F.md5("text")).join(found, digest, "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each piece of personal data replaced by its kind in brackets; n_chars follows the text.

    A null text stays null, an empty one empty; long ones are searched whole; repeated rows are redacted alike. An empty table
    stays empty. Other columns of docs pass unchanged, whatever their names.
    """
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    A null text is encoded as an empty one, to no ids; long texts whole; repeated rows alike. An empty table gives an empty
    result; other columns of docs are not passed on.
    """
    docs = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode(docs, *bpe.public_vocabulary()).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("personal_data", redact_personal_data),
    ("tokens", encode_tokens),
]

#: The quality classifier and the encoder are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), None
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            out.write.parquet(f"{at}/{name}")
            docs = spark.read.parquet(f"{at}/{name}")
    return out
