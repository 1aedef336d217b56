"""Quality classifier: compressed sizes under dictionaries of good and of bad text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import Stored

THRESHOLD = 0.7
LEVEL = 3
WINDOW = 384  # bytes compressed at a time, so that the dictionary counts all along a text
DICTIONARY_BYTES = 112_000
SAMPLE_CHARS = 2000  # of a sampled text in a dictionary's training set
DICTIONARY_ROWS = 2000  # most texts of each label that the dictionaries learn from
CALIBRATION_ROWS = 4000  # most texts that the calibration is fitted to


@dataclass(frozen=True)
class Model:
    """Dictionaries as bytes, and the weights of the calibration."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    words = zstandard.ZstdCompressionDict(content)
    words.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False,
                                    write_dict_id=False)


def measures(texts, good, bad) -> np.ndarray:
    """Per text: normalised size difference, size a byte with the good one, log of bytes."""
    out = np.empty((len(texts), 3))
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        with_good = with_bad = 0
        for at in range(0, max(1, len(data)), WINDOW):
            part = data[at:at + WINDOW]
            with_good += len(good.compress(part))
            with_bad += len(bad.compress(part))
        out[i] = ((with_bad - with_good) / (with_bad + with_good),
                  with_good / (len(data) + 16), np.log(len(data) + 16))
    return out


def design(m: np.ndarray) -> np.ndarray:
    """Terms of the calibration: the difference, with the size and length that it depends on."""
    d, size, length = m[:, 0], np.log(m[:, 1]), m[:, 2] / 10
    return np.column_stack([np.ones(len(m)), d, size, d * d, size * size, d * size,
                            length, d * length, size * length])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = probability(x @ w)
        slope = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(slope, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model:
    """Learn from labelled rows that aren't held out.

    At most DICTIONARY_ROWS of each label make the dictionaries, and CALIBRATION_ROWS others
    the calibration: those with the smallest hashes of their id, so that a rerun learns the
    same. A document labelled twice counts as bad if one label is; null labels and null
    texts don't count. Where the calibration's rows have one label alone, it is fitted to all
    chosen rows. Without a label of one kind the score is the share of good labels (0.5 without
    any).
    """
    spark = docs.sparkSession
    store = Stored(spark, "quality")
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
             .withColumn("_hash", F.xxhash64("_id"))
             .withColumn("_use", F.pmod("_hash", F.lit(4)) == 0)
             .filter(~held_out("_id")))
    few = [known.filter((F.col("_label") == y) & ~F.col("_use")).orderBy("_hash", "_id")
           .limit(DICTIONARY_ROWS) for y in (0, 1)]
    few.append(known.filter(F.col("_use")).orderBy("_hash", "_id").limit(CALIBRATION_ROWS))
    chosen = few[0].unionByName(few[1]).unionByName(few[2])
    # At most 2 x DICTIONARY_ROWS + CALIBRATION_ROWS ids.
    sample = store.put(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                       .filter(F.col("_text").isNotNull())
                       .join(F.broadcast(chosen), "_id"))
    start = F.pmod(F.col("_hash"), F.greatest(F.lit(1), F.length("_text") - SAMPLE_CHARS)) + 1
    cuts = (sample.filter(~F.col("_use"))
            .select("_label", "_id", F.substr("_text", start.cast("int"), F.lit(SAMPLE_CHARS))
                    .alias("cut")).dropDuplicates(["_id"]).orderBy("_id").collect())
    parts = {y: [r["cut"].encode("utf-8", "replace") for r in cuts if r["_label"] == y and r["cut"]]
             for y in (0, 1)}
    good, bad = dictionary(parts[1]), dictionary(parts[0])
    shared = spark.sparkContext.broadcast(Model(good, bad, ()))

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(measures(texts, *_compressors(shared.value))))

    def measured_rows(of: DataFrame) -> list:
        return (of.select("_id", "_label", measured("_text").alias("m"))
                .dropDuplicates(["_id"]).orderBy("_id").collect())

    rows = measured_rows(sample.filter(F.col("_use")))
    if parts[0] and parts[1] and len({r["_label"] > 0 for r in rows}) < 2:
        # Few or rare labels: the rows the dictionaries learnt from have both.
        rows = measured_rows(sample)
    y = np.array([float(r["_label"] > 0) for r in rows])
    if not parts[0] or not parts[1] or len(set(y)) < 2:
        n1, n0 = len(parts[1]) + (y == 1).sum(), len(parts[0]) + (y == 0).sum()
        share = (n1 + 1) / (n1 + n0 + 2)
        return Model(good, bad, (float(np.log(share / (1 - share))), *[0.0] * 8))
    return Model(good, bad, tuple(logistic(design(np.array([r["m"] for r in rows])), y)))


_kept: dict[int, tuple] = {}


def _compressors(model: Model) -> tuple:
    """A worker loads the dictionaries once."""
    key = hash((model.good, model.bad))
    if key not in _kept:
        _kept.clear()
        _kept[key] = (compressor(model.good), compressor(model.bad))
    return _kept[key]


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a text is good.

    A whole text counts, cut into windows; a null text scores as an empty one. Rows and
    other columns stay as they are (a column named ``out`` is replaced). Scoring knows
    nothing but the text, so equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        known = shared.value
        if not len(texts):
            return pd.Series([], dtype=float)
        x = design(measures(texts, *_compressors(known)))
        return pd.Series(probability(x @ np.array(known.weights)))

    return docs.withColumn(out, scored(F.col(text_col)))
