"""Requests to a model, kept by content: what has been sent once is not sent again, whichever run meets it.

Each run is a partition of its own, so a run that is repeated replaces what it wrote. Texts are fetched
for new requests only; counting and comparing go by their hashes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import ner
from veilspan.sources.tables import with_text_sha

REQUEST_SCHEMA = "text_sha string, prompt string, n_docs bigint, kind string, run_id bigint"


def request_keys(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each distinct text: text_sha, the smallest id that has it, n_docs. No text is shuffled."""
    return with_text_sha(docs, text_col).groupBy("text_sha").agg(
        F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n_docs"))


def known_requests(spark: SparkSession, path: str, kind: str, before: int | None = None) -> DataFrame:
    """Hashes of the requests of one kind that runs (before one) have sent."""
    try:
        table = spark.read.schema(REQUEST_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "text_sha string")
    sent = table.filter(F.col("kind") == kind)
    if before is not None:
        sent = sent.filter(F.col("run_id") < before)
    return sent.select("text_sha").distinct()


def send_new(docs: DataFrame, path: str, run_id: int, kind: str = "ner", prompt=ner.prompt,
             text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the requests that no earlier run has sent, and return them: text_sha, prompt, n_docs.

    Null texts are no request. Of several texts under one id that of the hash counts.
    """
    spark = docs.sparkSession
    texts = with_text_sha(docs.filter(F.col(text_col).isNotNull()), text_col)
    new = request_keys(texts, text_col, id_col).join(
        known_requests(spark, path, kind, run_id), "text_sha", "left_anti")
    fetched = texts.select(F.col(id_col).alias("first_id"), "text_sha", F.col(text_col).alias("_text")).join(
        new, ["text_sha", "first_id"]).groupBy("text_sha").agg(
        F.any_value("_text").alias("_text"), F.any_value("n_docs").alias("n_docs"))
    rows = fetched.select("text_sha", prompt(F.col("_text")).alias("prompt"), "n_docs", F.lit(kind).alias("kind"),
                          F.lit(run_id).cast("bigint").alias("run_id"))
    rows.write.partitionBy("kind", "run_id").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").parquet(path)
    return spark.read.schema(REQUEST_SCHEMA).parquet(path).filter(
        (F.col("kind") == kind) & (F.col("run_id") == run_id)).select("text_sha", "prompt", "n_docs")


def first_responses(responses: DataFrame, ts_col: str = "ts") -> DataFrame:
    """The response that came first to each request of each kind; ties go to the smaller response.

    Later ones would make a rerun differ from what has been acted upon.
    """
    return responses.groupBy("text_sha", "kind").agg(
        F.min_by("response", F.struct(ts_col, "response")).alias("response"))
