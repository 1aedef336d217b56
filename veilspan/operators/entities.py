"""Requests to the entity model, and its responses as spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions import ner
from veilspan.operators.detect import explode_spans
from veilspan.operators.skew import hot_keys, spread_join
from veilspan.session import built_once
from veilspan.sources.tables import with_text_sha


@built_once
def _entities(text_col: str, min_confidence: float) -> Column:
    return ner.ner_spans(F.col(text_col), F.col("response"), min_confidence)


def ner_requests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One request per distinct text: text_sha, prompt, n_docs.

    Equal texts collapse before the shuffle, so a text with very many copies
    sends one row per task.
    """
    return (with_text_sha(docs, text_col).groupBy("text_sha")
            .agg(F.first(text_col).alias("text"), F.count(F.lit(1)).alias("n_docs"))
            .select("text_sha", ner.prompt(F.col("text")).alias("prompt"), "n_docs"))


def join_responses(docs: DataFrame, responses: DataFrame, kind: str = "ner",
                   requests: DataFrame | None = None, text_col: str = "text",
                   id_col: str = "doc_id") -> DataFrame:
    """Give every text the response to its request; null where there is none.

    Copies of one text share a key, so the key may be very hot. ``requests`` (as
    written by ``ner_requests``) tells the hot ones without reading the texts again.
    """
    keyed = with_text_sha(docs, text_col)
    answers = (responses.filter(F.col("kind") == kind)
               .groupBy("text_sha").agg(F.min("response").alias("response")))
    hot = (hot_keys(keyed, ["text_sha"]) if requests is None
           else hot_keys(requests, ["text_sha"], "n_docs"))
    return spread_join(keyed, answers, ["text_sha"], hot, id_col)


def with_ner_spans(answered: DataFrame, text_col: str = "text", out_col: str = "ner_spans",
                   min_confidence: float = fv.MIN_CONFIDENCE) -> DataFrame:
    """Parse the response column next to the text (no shuffle)."""
    return answered.withColumn(out_col, _entities(text_col, min_confidence))


def parse_ner(docs: DataFrame, responses: DataFrame, min_conf: float = fv.MIN_CONFIDENCE,
              text_col: str = "text", id_cols: Sequence[str] = ("doc_id",),
              requests: DataFrame | None = None) -> DataFrame:
    """Entities of the model's responses, one row per span."""
    answered = join_responses(docs, responses, requests=requests, text_col=text_col,
                              id_col=id_cols[0])
    return explode_spans(with_ner_spans(answered, text_col, min_confidence=min_conf),
                         id_cols, "ner_spans")


def response_previews(responses: DataFrame) -> DataFrame:
    """Length and first 500 characters of each response, for debugging."""
    return responses.select("text_sha", F.length("response").cast("bigint").alias("n_chars"),
                            ner.preview(F.col("response")).alias("preview"))
