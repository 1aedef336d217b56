"""Privacy audit: session summary, leak check, reconciliation and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import unnest
from veilspan.operators.detect import with_regex_spans

STAGES = ("route", "pii", "cloud")
SHOWN_CHARS = 600
NO_RESPONSE = "(no cloud response)"


def session_summary(routed: DataFrame, id_col: str = "session_id") -> DataFrame:
    """Queries per session: total, local, cloud and the on-device share in whole percent."""
    local = F.count_if(F.col("route") == "local")
    total = F.count(F.lit(1))
    return routed.groupBy(id_col).agg(
        total.alias("total"), local.alias("local"),
        F.count_if(F.col("route") == "cloud").alias("cloud"),
        F.call_function("div", 100 * local, total).alias("on_device_pct"))


def item_counts(spans: DataFrame, scope_cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Occurrences and distinct values found, per scope.

    Exact distinct counts go through one row per distinct value, spread over all
    tasks, before the (few) scopes are summed up; a scope is never one task's.
    """
    if not exact:
        return spans.groupBy(*scope_cols).agg(
            F.count(F.lit(1)).alias("n_items"),
            F.approx_count_distinct("value").alias("n_distinct"))
    values = spans.groupBy(*scope_cols, "value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy(*scope_cols).agg(F.sum("n").alias("n_items"),
                                           F.count(F.lit(1)).alias("n_distinct"))


def density(found: DataFrame, *dims: str, spans_col: str = "spans") -> DataFrame:
    """Found items by type and further columns of the texts, with subtotals."""
    items = unnest(found, spans_col, "s", *dims).select(F.col("s.pii_type").alias("pii_type"), *dims)
    return items.rollup("pii_type", *dims).agg(
        F.count(F.lit(1)).alias("n_items"), F.grouping_id().cast("bigint").alias("level"))


def own_leaks(df: DataFrame, outbound_cols: Sequence[str], id_col: str = "doc_id",
              mappings_col: str = "mappings") -> DataFrame:
    """Warning level: outbound columns that contain a real value of their own row."""
    def leaked(c: str) -> Column:
        return F.size(F.filter(mappings_col, lambda m: F.contains(F.col(c), m["real"])))
    return df.select(id_col, *[leaked(c).cast("bigint").alias(f"{c}_leaks")
                               for c in outbound_cols])


def leak_check(outbound: DataFrame, vault: DataFrame, outbound_cols: Sequence[str]) -> DataFrame:
    """Real values of the vault that the detectors still find in outbound texts.

    Every outbound column counts, prompts included. Found values collapse to one
    row per value before they meet the vault, so a value in a third of all texts
    is no hot key. Spark would move a semi join below that count; the distinct
    values of the vault are joined instead, and never broadcast, since what Spark
    expects of their size leaves out that a text has many. Columns: outbound,
    pii_type, value, n_texts.
    """
    texts = unnest(outbound, F.array(*[
        F.struct(F.lit(c).alias("outbound"), F.col(c).alias("text")) for c in outbound_cols]),
        "o").select("o.outbound", "o.text")
    values = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(
        ":", s["pii_type"], s["value"])))
    found = (unnest(with_regex_spans(texts), values, "v", "outbound")
             .groupBy("outbound", "v").agg(F.count(F.lit(1)).alias("n_texts"))
             .select("outbound", F.substring_index("v", ":", 1).alias("pii_type"),
                     F.expr("substring(v, instr(v, ':') + 1)").alias("value"), "n_texts"))
    reals = vault.select(F.col("real").alias("value")).distinct()
    return found.join(reals.hint("merge"), "value")


def _words(text: Column) -> Column:
    """Lower-case words: what characters other than letters and digits separate."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def value_leaks(outbound: DataFrame, vault: DataFrame, outbound_cols: Sequence[str]) -> DataFrame:
    """Values of the vault that stand as whole words in outbound texts, whatever found them.

    Unlike the detectors this sees values that only the model knew. Texts are cut into runs of
    as many words as some value has; a run collapses to one row per task before it meets
    the values, by equality. Case, punctuation and spacing don't count; null texts and values
    without a word have no leaks. Only the distinct word counts of values come to the driver.
    Columns: outbound, pii_type, value, n_texts.
    """
    values = (vault.select("pii_type", F.col("real").alias("value")).distinct()
              .withColumn("_words", _words(F.col("value"))))
    values = values.select("pii_type", "value", F.size("_words").alias("_n"),
                           F.array_join("_words", " ").alias("run")).filter("_n > 0")
    lengths = sorted(r[0] for r in values.select("_n").distinct().collect())
    texts = unnest(outbound, F.array(*[
        F.struct(F.lit(c).alias("outbound"), F.col(c).alias("text")) for c in outbound_cols]),
        "o").select("o.outbound", _words(F.col("o.text")).alias("words"))

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
        return F.transform(places, lambda i: F.array_join(F.slice("words", i, n), " "))

    found = texts.select("outbound", F.array_distinct(F.flatten(F.array(
        *[runs(n) for n in lengths]).cast("array<array<string>>"))).alias("runs"))
    counted = (unnest(found, "runs", "run", "outbound")
               .groupBy("outbound", "run").agg(F.count(F.lit(1)).alias("n_texts")))
    return counted.join(values.hint("merge"), "run").select("outbound", "pii_type", "value", "n_texts")


def reconcile(df: DataFrame, id_col: str = "doc_id", detected_col: str = "merged",
              replaced_col: str = "named") -> DataFrame:
    """Items detected, located and replaced, which need not be equal."""
    located = F.filter(detected_col, lambda s: s["start"].isNotNull())
    return df.select(id_col, F.size(detected_col).cast("bigint").alias("n_detected"),
                     F.size(located).cast("bigint").alias("n_located"),
                     F.size(replaced_col).cast("bigint").alias("n_replaced"))


def mapping_report(vault: DataFrame, types: DataFrame) -> DataFrame:
    """Label, real value cut and padded to 30, synthetic value."""
    shown = F.rpad(F.left(F.col("real"), F.lit(30)), 30, " ")
    return vault.join(F.broadcast(types.select(F.col("code").alias("pii_type"), "label", "icon")),
                      "pii_type").select("session_id", "icon", "label", shown.alias("real_shown"),
                                         "synthetic")


def side_by_side(df: DataFrame, seen_col: str = "restored", cloud_col: str = "response",
                 id_col: str = "doc_id") -> DataFrame:
    """What the user sees beside what the cloud saw."""
    def shown(c: str) -> Column:
        return F.coalesce(F.left(F.nullif(F.col(c), F.lit("")), F.lit(SHOWN_CHARS)),
                          F.lit(NO_RESPONSE))
    return df.select(id_col, shown(seen_col).alias("user_sees"), shown(cloud_col).alias("cloud_saw"))


def stage_metrics(metrics: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Seconds per run and stage, side by side, with their total."""
    wide = metrics.groupBy("run_id").pivot("stage", list(stages)).agg(F.sum("seconds"))
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages[1:]),
                F.coalesce(F.col(stages[0]), F.lit(0.0)))
    return wide.select("run_id", *stages, total.alias("total"))


def render_spans(spans: DataFrame, types: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One line per span: icon, padded label, value cut at 45, confidence, source."""
    named = spans.join(F.broadcast(types.select(F.col("code").alias("pii_type"), "label", "icon")),
                       "pii_type")
    return named.select(id_col, "start", F.format_string(
        "%s %s '%s' (conf=%.2f) [%s]", "icon", F.rpad("label", 10, " "),
        F.left(F.col("value"), F.lit(45)), "confidence", "source").alias("line"))
