"""Sources: texts, query log, model responses and dimensions."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions.patterns import DEFAULT_PATTERNS
from veilspan.functions.routing import AGENT_PROMPTS
from veilspan.functions.text import content_hash

RESPONSE_SCHEMA = "text_sha string, kind string, response string"
HEAD_CHARS = 200
ROWS_A_TASK = 4096


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of the data folder: one file, or a folder of part files.

    Its scan tasks are those of Spark's file settings, whatever its size.
    """
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))


def dealt(rows: DataFrame) -> DataFrame:
    """Short rows that each make much work, dealt to tasks by their number.

    Scan tasks are cut by bytes, and a file's row group is never cut: a million rows of
    some columns may be one task. Dealing is round robin, so equal or null keys do no harm.
    """
    n = rows.count()
    return rows if n <= ROWS_A_TASK else rows.repartition(-(-n // ROWS_A_TASK))


def documents(spark: SparkSession, directory: str) -> DataFrame:
    """Texts to protect: doc_id, text, lang, source, n_chars."""
    return table(spark, directory, "documents")


def queries(spark: SparkSession, directory: str) -> DataFrame:
    """User turns of the query log: session_id, query_id, text."""
    return (table(spark, directory, "conversations").filter(F.col("role") == "user")
            .select(F.col("conv_id").cast("string").alias("session_id"),
                    F.col("turn").alias("query_id"), "text"))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Model responses keyed by the hash of the submitted text: Parquet or JSON lines."""
    reader = spark.read.schema(RESPONSE_SCHEMA)
    return reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) \
        else reader.parquet(path)


def with_text_sha(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the request key of a text, unless the table already stores it."""
    return df if "text_sha" in df.columns else \
        df.withColumn("text_sha", content_hash(F.col(text_col)))


def doc_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Characters of each text, also with thousands separators."""
    n = F.length(text_col)
    return df.select(id_col, n.cast("bigint").alias("n_chars"),
                     F.format_number(n, 0).alias("n_chars_shown"))


def assembled_query(instruction: str, text: Column, head_chars: int | None = None) -> Column:
    """Instruction, a blank line, and the document or its first characters."""
    body = text if head_chars is None else F.left(text, F.lit(head_chars))
    return F.concat(F.lit(instruction + "\n\n"), body)


def build_query(df: DataFrame, instruction: str, text_col: str = "text",
                head_chars: int | None = None, out_col: str = "query") -> DataFrame:
    return df.withColumn(out_col, assembled_query(instruction, F.col(text_col), head_chars))


def dims(spark: SparkSession) -> dict[str, DataFrame]:
    """The fixed dimensions; each has a fixed, small number of rows."""
    priority = {}
    for i, p in enumerate(DEFAULT_PATTERNS):
        priority.setdefault(p.pii_type, i)
    return {
        "pii_type": spark.createDataFrame(
            [(c, label, icon, priority[c]) for c, (label, icon) in fv.PII_TYPES.items()],
            "code string, label string, icon string, priority int"),
        "ner_alias": spark.createDataFrame(
            list(fv.NER_ALIASES.items()), "alias string, pii_type string"),
        "agent": spark.createDataFrame(
            list(AGENT_PROMPTS.items()), "agent string, system_prompt string"),
        "pool": spark.createDataFrame(
            [(t, n, v) for t, pool in fv.ORDINAL_POOLS.items() for n, v in enumerate(pool)],
            "pii_type string, n int, synthetic string"),
    }
