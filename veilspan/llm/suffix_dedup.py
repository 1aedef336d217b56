"""Passages repeated across documents, by a sparse suffix array over minimiser positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import Stored, column, ship
from veilspan.operators.skew import hot_keys, spread_join

LEAST_WORDS = 50  # shortest passage that counts
GRAM = 10  # words whose hash decides which place of a window is selected
TOGETHER = 4096  # different suffixes with one gram that a task sorts together; more go by their windows
EMITTED_ROWS = 1 << 16  # rows of a table that a Python worker returns
EMITTED_SUFFIXES = 1 << 12  # the same for suffixes, which hold words
SORTED_ROWS = 8192  # suffixes that are sorted at a time, in whole grams
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of a text, words being runs of anything but ASCII white space."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.encode("utf-8", "surrogatepass").split()],
                    dtype=np.uint64)


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` words: differences of a running polynomial sum."""
    n = len(words)
    if n < gram:
        return np.empty(0, dtype=np.uint64)
    sums, back = running_sums(words)
    h = (sums[gram:] - sums[:-gram]) * back[:n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def running_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial over the words, and what moves a difference of them to the front."""
    powers = np.cumprod(np.full(len(words), BASE, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * powers)])
    return sums, np.cumprod(np.full(len(words), INVERSE, dtype=np.uint64))


def chosen(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of hashes, the position of its leftmost smallest.

    Which position a window selects depends on its content alone: passages that agree in a
    window select the same place in it.
    """
    if len(hashes) < window:
        return np.empty(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    out = []
    for at in range(0, len(views), 1 << 14):  # bounds memory for very long texts
        part = views[at:at + (1 << 14)]
        out.append(part.argmin(axis=1) + np.arange(at, at + len(part)))
    return np.concatenate(out)


def anchors(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """The minimiser positions of a document, each with the windows of ``least`` words that select it.

    Such windows begin at consecutive words: ``lo`` and the ``n - 1`` after it; the selected gram begins ``off``
    words after the first of them. ``key`` is the gram's hash, ``context`` one of all words of these windows.
    """

    def of_text(doc: int, text: str) -> dict[str, np.ndarray]:
        words = word_hashes(text)
        hashes = gram_hashes(words, gram)
        at = chosen(hashes, least - gram + 1)
        lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, dtype=np.int64)
        n = np.diff(np.r_[lo, len(at)])
        off = at[lo] - lo
        sums, back = running_sums(words)
        context = (sums[lo + n - 1 + least] - sums[lo]) * back[lo] ^ (n * 64 + off).astype(np.uint64)
        context *= np.uint64(0xBF58476D1CE4E5B9)
        context ^= context >> np.uint64(31)
        return {"key": hashes[at[lo]].view(np.int64), "context": context.view(np.int64),
                "doc_id": np.full(len(lo), doc, dtype=np.int64), "lo": lo.astype(np.int32),
                "n": n.astype(np.int16), "off": off.astype(np.int16)}

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # One table for many texts: tables cost more than the rows of a short one.
            held, size = [], 0
            for doc, text in zip(batch["doc_id"], batch["text"]):
                found = of_text(doc, text)
                held.append(found)
                size += len(found["lo"])
                if size >= EMITTED_ROWS:
                    yield joined(held)
                    held, size = [], 0
            if size:
                yield joined(held)

    def joined(parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

    return docs.mapInPandas(emit, "key long, context long, doc_id long, lo int, n short, off short")


SUFFIX = "key long, context long, doc_id long, whole boolean, n short, off short, words binary"


def suffixes(docs: DataFrame, classes: DataFrame, least: int, gram: int) -> DataFrame:
    """The words around the minimiser positions that stand for the given classes."""
    wanted = classes.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(
        "key", "context", "whole", "first.lo", "first.n", "first.off")).alias("wanted"))

    names = [c.split()[0] for c in SUFFIX.split(", ")]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, wanted in zip(batch["doc_id"], batch["text"], batch["wanted"]):
                words = word_hashes(text)
                hashes = gram_hashes(words, gram).view(np.int64)
                for w in wanted:
                    at = w["lo"] + w["off"]
                    # Texts may share an id; the position belongs to one of them.
                    if at < len(hashes) and hashes[at] == w["key"]:
                        out.append((w["key"], w["context"], doc, w["whole"], w["n"], w["off"],
                                    words[w["lo"]:w["lo"] + w["n"] - 1 + least].tobytes()))
                        if len(out) >= EMITTED_SUFFIXES:
                            yield pd.DataFrame(out, columns=names)
                            out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInPandas(emit, SUFFIX)


def agreeing(rows: pd.DataFrame, least: int, gram: int) -> np.ndarray:
    """For each suffix, the windows (bits, by start) that another document has too.

    The suffixes are sorted from their last word on, one word further left at a time. In the order by
    the words from some start on, those that agree in ``least`` words lie beside each other; so
    neighbours are compared, for every start that a window around the gram can have.
    """
    reach = least - gram  # words that a window can have before the gram
    n, off = rows["n"].to_numpy(np.int64), rows["off"].to_numpy(np.int64)
    doc, whole = rows["doc_id"].to_numpy(np.int64), rows["whole"].to_numpy(bool)
    words = np.zeros((len(rows), reach + least), dtype=np.uint64)
    for i, data in enumerate(rows["words"]):
        own = np.frombuffer(data, dtype=np.uint64)
        first = reach - off[i]
        words[i, first:first + len(own)] = own[:reach + least - first]
    found = np.zeros(len(rows), dtype=np.int64)
    order = np.arange(len(rows))
    for start in range(reach + least - 1, -1, -1):
        order = order[np.argsort(words[order, start], kind="stable")]
        at = off - (reach - start)  # which of its windows begins here
        here = order[(at[order] >= 0) & (at[order] < n[order])] if start <= reach else order[:0]
        if len(here) < 2:
            continue
        own = words[here, start:start + least]
        fresh = np.r_[True, (own[1:] != own[:-1]).any(axis=1)]
        run, firsts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        shared = (np.minimum.reduceat(doc[here], firsts) != np.maximum.reduceat(doc[here], firsts)) | (
            np.logical_or.reduceat(whole[here], firsts))
        hit = here[shared[run]]
        found[hit] |= np.int64(1) << at[hit]
    return found


def neighbours(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """Windows (bits) of each open suffix that another document has; equal grams lie in one part."""

    enough = SORTED_ROWS

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def result(part: pd.DataFrame) -> pd.DataFrame:
            found = agreeing(part, least, gram)
            keep = (found != 0) & ~part["whole"].to_numpy(bool)
            return part.loc[keep, ["key", "context"]].assign(found=found[keep])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < enough:
                continue
            all_ = pd.concat(held, ignore_index=True)
            # The last gram may go on in the next batch; there are at most TOGETHER suffixes of it.
            cut = int(np.searchsorted(all_["key"].to_numpy(), all_["key"].iloc[-1]))
            if cut:
                yield result(all_.iloc[:cut].reset_index(drop=True))
            held, size = [all_.iloc[cut:]], size - cut
        if size:
            yield result(pd.concat(held, ignore_index=True))

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(
        compare, "key long, context long, found long")


def by_windows(rows: DataFrame, least: int, store: Stored) -> DataFrame:
    """The same for grams with more different suffixes than one task should sort: by hashes of the windows."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, context, doc, whole, n, words in zip(*(batch[c] for c in (
                    "key", "context", "doc_id", "whole", "n", "words"))):
                hashes = gram_hashes(np.frombuffer(words, dtype=np.uint64), least).view(np.int64)
                out.append(pd.DataFrame({"key": key, "window": hashes, "context": context, "doc_id": doc,
                                         "whole": whole, "at": np.arange(n, dtype=np.int32)}))
            if out:
                yield pd.concat(out)

    windows = store.put(rows.mapInPandas(
        emit, "key long, window long, context long, doc_id long, whole boolean, at int"))
    shared = windows.groupBy("key", "window").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.bool_or("whole").alias("w")).filter(
        "a < b or w").select("key", "window", F.lit(True).alias("shared"))
    keys = ["key", "window"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))
    return (spread_join(windows.filter("not whole"), shared, keys, hot_keys(windows, keys), "context", "inner")
            .groupBy("key", "context").agg(F.bit_or(bit).alias("found")))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      least: int = LEAST_WORDS, gram: int = GRAM) -> DataFrame:
    """Passages of at least ``least`` words that another document has as well.

    Every window of ``least`` words selects the run of ``gram`` words in it that has the smallest hash, so
    windows that agree select the same. Only suffixes at these positions are kept, about one in
    (least - gram) / 2 words, and of these only those whose gram two documents select. Positions that agree in
    all words of their windows are one class; if it has two documents, all its windows are repeated. One
    suffix of each class then stands for it: the suffixes of a gram are sorted, neighbours compared, and
    matches extended to the left and right until they have ``least`` words. Grams with very many different
    suffixes are not sorted in one task: their windows are counted by hash, with the same result.

    Words are what ASCII white space separates; they are compared by 64-bit hashes. Texts that are null,
    empty or shorter than ``least`` words, and rows without an id have no passages; rows that repeat an id are
    one document, to which their own repeats don't count. Texts may have any length. Extra columns are not
    passed on; an empty table gives no rows. Returns id, start_word (from 0), n_words.
    """
    if not 1 <= gram <= least <= gram + 62:
        raise ValueError("gram must lie between 1 and least, and least be at most 62 more")
    spark = df.sparkSession
    ship(spark)
    store = Stored(spark, "suffixes")
    docs = df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).filter(
        F.col("doc_id").isNotNull() & (F.length("text") >= 2 * least - 1))
    every = store.put(anchors(docs, least, gram))
    shared = store.put(every.groupBy("key").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("places"))
        .filter("a < b").select("key", "places"))
    # A gram of a very common passage may have a large share of all places.
    spread = every.withColumn("_place", F.xxhash64("doc_id", "lo"))
    kept = store.put(spread_join(spread, shared.select("key"), ["key"], hot_keys(shared, ["key"], "places"),
                                 "_place", "inner"))
    store.drop(every)
    store.drop(shared)
    classes = kept.groupBy("key", "context").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "lo", "n", "off")).alias("first"),
        (F.min("doc_id") < F.max("doc_id")).alias("whole"))
    classes = store.put(classes)
    sizes = classes.groupBy("key").agg(F.count("*").alias("size"), F.bool_and("whole").alias("settled"))
    undecided = sizes.filter("size > 1 and not settled").select("key", "size")
    asked = classes.join(undecided, "key")
    found = store.put(neighbours(suffixes(docs, asked.filter(F.col("size") <= TOGETHER), least, gram), least, gram))
    if undecided.filter(F.col("size") > TOGETHER).count():
        many = store.put(suffixes(docs, asked.filter(F.col("size") > TOGETHER), least, gram))
        found = found.unionByName(store.put(by_windows(many, least, store)))
        store.drop(many)
    all_ = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("first.n").cast("int")) - 1
    bits = found.unionByName(classes.filter("whole").select("key", "context", all_.alias("found")))
    copies = ["key", "context"]
    hits = spread_join(kept, bits, copies, hot_keys(classes, copies, "copies"), "_place", "inner")
    # Runs of bits: where one begins, and where it ends.
    one = F.lit(1).cast("long")
    places = F.sequence(F.lit(0), F.col("n").cast("int") - 1)

    def ends(step: int):
        def edge(i):
            def bit(k):
                return F.when((k >= 0) & (k < 63), F.call_function("shiftright", F.col("found"), k.cast("int")).bitwiseAND(one)).otherwise(0)
            return (bit(i) == 1) & (bit(i + step) == 0)
        return F.filter(places, edge)

    runs = hits.select("doc_id", "lo", F.explode(F.arrays_zip(ends(-1).alias("a"), ends(1).alias("b"))).alias("run"))
    starts = runs.select("doc_id", (F.col("lo") + F.col("run.a")).alias("first"), (F.col("lo") + F.col("run.b")).alias("last"))
    by_start = Window.partitionBy("doc_id").orderBy("first", "last")
    reached = F.max("last").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("first") - reached > least).cast("int"), F.lit(1))
    numbered = starts.withColumn("fresh", fresh).withColumn(
        "passage", F.sum("fresh").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "passage").agg(
        F.min("first").cast("long").alias("start_word"),
        (F.max("last") - F.min("first") + least).cast("long").alias("n_words")
    ).select(F.col("doc_id").alias(id_col), "start_word", "n_words")
