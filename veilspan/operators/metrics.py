"""Counts of a run's stages, taken while it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STAGE_SCHEMA = "run_id string, stage string, n_rows bigint, n_items bigint"


class Stages:
    """Observes the stages of one run as its rows pass: no job and no pass over the data of its own.

    ``watch`` marks a place in the plan; ``table`` gives the counts once the action that runs the
    plan is through. An action that fails leaves no counts.
    """

    def __init__(self, run_id: str = "run") -> None:
        self.run_id = run_id
        self.seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, n_items: Column) -> DataFrame:
        if stage in self.seen:
            raise ValueError(f"stage {stage} is watched already")
        self.seen[stage] = Observation(f"{self.run_id}/{stage}")
        return df.observe(self.seen[stage], F.count(F.lit(1)).alias("n_rows"),
                          F.coalesce(n_items, F.lit(0)).cast("bigint").alias("n_items"))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each watched stage."""
        rows = [(self.run_id, stage, o.get["n_rows"], o.get["n_items"]) for stage, o in self.seen.items()]
        return spark.createDataFrame(rows, STAGE_SCHEMA)
