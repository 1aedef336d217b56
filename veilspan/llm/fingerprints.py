"""Document fingerprints by consistent weighted sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import Stored

SAMPLES = 32
LANES = 4  # samples that one row of a term computes
SPAN_BITS = 10  # 1,024 neighbouring ids are put in order together
BLANKS = "[\\x20\\x09-\\x0D]+"
NOTHING = "0" * 8  # sample of a text without words


def _bits(h: Column, low: int, width: int) -> Column:
    """Some bits of a hash as a number within (0, 1)."""
    part = F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << width) - 1))
    return (part + F.lit(0.5)) / F.lit(float(1 << width))


def sampled(term: Column, lane: Column, log_weights: list[Column]) -> list[Column]:
    """Sample of a weighted term for one lane, as a number whose order is that of the sample.

    Two gamma variates r, c and a uniform b are drawn from hashes of term and lane. The
    weight w is rounded down to y = exp(r (t - b)) with t = floor(ln w / r + b), and the term with
    the smallest c / (y exp r) is the text's sample, identified by term and t: texts
    agree in it as often as their generalised Jaccard similarity says. The high half of the number is
    the logarithm of that value, the low half the identity. Null for null weights.
    """
    h, g = F.xxhash64(term, lane), F.xxhash64(lane, term)
    r = -F.ln(_bits(h, 0, 24) * _bits(h, 24, 24))
    log_c = F.ln(-F.ln(_bits(g, 0, 24) * _bits(g, 24, 24)))
    b = _bits(h, 48, 16)
    out = []
    for log_w in log_weights:
        t = F.floor(log_w / r + b)
        value = log_c - r * (t - b + 1)
        identity = F.shiftrightunsigned(g, 32).bitwiseXOR(t.bitwiseAND(F.lit(0xFFFFFFFF)))
        out.append(F.shiftleft(F.floor((value + 64) * F.lit(float(1 << 24))), 32)
                   .bitwiseOR(identity))
    return out


def in_order(df: DataFrame, store: Stored, id_col: str, text_col: str) -> DataFrame:
    """Rows with their place among their span of ids, and the text that follows by descending id.

    Ids are whole numbers, so a span of them holds few rows and spans are put in order
    independently; the row that follows the last of a span is the first of the next
    lower one. Null ids come last. Returns span, place, doc_id, text, next_text and next_span.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Null ids get numbers below all others, spread by their texts.
    key = F.coalesce(F.col(id_col).cast("long"),
                     F.lit(-(1 << 62)) - F.pmod(F.xxhash64(text), F.lit(1 << 40)))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), key.alias("key")).withColumn(
        "span", F.shiftright("key", SPAN_BITS))
    spans = rows.select("span").distinct().withColumn("wide", F.shiftright("span", SPAN_BITS))
    within = Window.partitionBy("wide").orderBy(F.desc("span"))
    wide = spans.groupBy("wide").agg(F.max("span").alias("top"))
    # One row for about a million ids.
    everything = Window.orderBy(F.desc("wide"))
    wide = wide.select("wide", F.coalesce(
        F.lead("top").over(everything), F.first("top").over(everything)).alias("below"))
    following = (spans.withColumn("next_span", F.lead("span").over(within)).join(wide, "wide")
                 .select("span", F.coalesce("next_span", "below").alias("next_span")))
    order = Window.partitionBy("span").orderBy(F.desc("key"), F.xxhash64("text"), "doc_id")
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn(
        "next_text", F.lead("text").over(order))
    heads = placed.filter(F.col("place") == 1).select(F.col("span").alias("next_span"),
                                                      F.col("text").alias("head_text"))
    heads = store.put(following.join(heads, "next_span"))
    return placed.join(heads, "span").select(
        "span", "place", "doc_id", "text",
        F.coalesce("next_text", "head_text").alias("next_text"), "next_span")


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of texts and of their edits, and how like they are.

    The edit replaces the last half of a text's characters by the beginning of the text that follows by
    descending id. Terms are the words of a text, weighted by how often they occur. A
    fingerprint has for each sample eight hex digits that identify the term and its
    rounded weight; the likeness of two is the share of samples they agree in.

    A null text counts as empty; a text without words has a fingerprint of zeros, which is
    like another such. Whole texts count. Rows that repeat an id are documents of their own
    next to each other; null ids come last; a single row is followed by itself; an empty table gives no
    rows; extra columns are not passed on. Returns id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    store = Stored(df.sparkSession, "fingerprints")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = in_order(df, store, id_col, text_col).withColumn("edited", F.concat(
        F.left("text", n - half), F.left("next_text", half)))
    base = edited.select("span", "place", "doc_id", n.cast("long").alias("n_chars"),
                         F.sha2("edited", 256).alias("edited_sha256"), "next_span")
    words, others = F.split("text", BLANKS), F.split("edited", BLANKS)
    # "own" stands below the generator, lest it be computed again for every word.
    terms = (edited.select("span", "place", F.size(words).alias("own"),
                           F.concat(words, others).alias("words"))
             .select("span", "place", "own", F.posexplode("words").alias("at", "word"))
             .select("span", "place", F.xxhash64("word").alias("term"),
                     (F.col("at") < F.col("own")).alias("first"),
                     (F.col("word") != "").cast("int").alias("one")))
    weighed = terms.groupBy("span", "place", "term").agg(
        F.sum(F.when(F.col("first"), F.col("one")).otherwise(0)).alias("w"),
        F.sum(F.when(F.col("first"), 0).otherwise(F.col("one"))).alias("v"))
    # The logarithm of weight 0 is null: no sample.
    weighed = weighed.select("span", "place", "term", F.ln("w").alias("w"), F.ln("v").alias("v"))
    lanes = weighed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(samples - 1),
                                                            F.lit(LANES))))
    columns = []
    for k in range(LANES):
        own, other = sampled(F.col("term"), F.col("lane") + k, [F.col("w"), F.col("v")])
        columns += [own.alias(f"own{k}"), other.alias(f"other{k}")]
    smallest = lanes.select("span", "place", "lane", *columns).groupBy(
        "span", "place", "lane").agg(*[F.min(f"{side}{k}").alias(f"{side}{k}")
                                       for side in ("own", "other") for k in range(LANES)])

    def shown(value: str) -> Column:
        low = F.col(value).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.coalesce(F.lower(F.lpad(F.hex(low), 8, "0")), F.lit(NOTHING))

    parts = smallest.select("span", "place", "lane", *[
        F.concat(*[shown(f"{side}{k}") for k in range(LANES)]).alias(side)
        for side in ("own", "other")])
    prints = parts.groupBy("span", "place").pivot(
        "lane", list(range(0, samples, LANES))).agg(F.max("own").alias("own"),
                                                    F.max("other").alias("other"))
    starts = range(0, samples, LANES)
    prints = prints.select("span", "place", *[
        F.concat(*[F.col(f"{s}_{side}") for s in starts]).alias(name)
        for side, name in (("own", "fingerprint"), ("other", "edited_fingerprint"))])
    rows = store.put(base.join(prints, ["span", "place"]))
    heads = rows.filter(F.col("place") == 1).select(F.col("span").alias("next_span"),
                                                    F.col("fingerprint").alias("_head"))
    order = Window.partitionBy("span").orderBy("place")
    rows = rows.withColumn("_next", F.lead("fingerprint").over(order)).join(heads, "next_span")

    def likeness(a: Column, b: Column) -> Column:
        same = [(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int")
                for k in range(samples)]
        return sum(same[1:], same[0]) / F.lit(float(samples))

    return rows.select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("_next", "_head")).alias("near_next"))
