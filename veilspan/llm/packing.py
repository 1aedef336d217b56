"""Pack token sequences by minimum bin slack."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import Stored, ranked

CAPACITY = 2048
END_ID = 1
SPECIAL = "<|endoftext|>"
LONG_RUN = 100_000  # characters of white space in a row that the fast loop need not take


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library.

    The file's vocabulary is also its merge order, so its ids come faster from
    tiktoken's loop over the same vocabulary and pattern. Texts with the special token, and those
    with very long runs of white space, on which that loop's pattern runs out of stack, go to the
    tokenizers library itself.
    """

    def __init__(self, path: str) -> None:
        import json

        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()
                 if token != SPECIAL}
        self.path, self.whole = path, None
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if SPECIAL in text or self._blank(text):
            if self.whole is None:  # seldom needed, and as large as all the rest
                from tokenizers import Tokenizer
                self.whole = Tokenizer.from_file(self.path)
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    @staticmethod
    def _blank(text: str) -> bool:
        return len(text) >= LONG_RUN and any(
            m.end() - m.start() >= LONG_RUN for m in re.finditer(r"\s+", text))


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document's ids into full pieces of the capacity and what remains."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        ids_of = _encoders[tokenizer].ids
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = ids_of(text or "")
                ids.append(end_id)
                n, data = len(ids), np.array(ids, dtype="<u4").tobytes()
                for at in range(0, n, capacity):
                    rows.append((doc, at, min(capacity, n - at),
                                 zlib.crc32(data[4 * at:4 * (at + capacity)]), n))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32",
                                              "doc_tokens"])
            yield out.astype({"doc_id": batch["doc_id"].dtype})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text")).mapInPandas(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths that fills one window closest to its capacity.

    The longest length there is goes in first; then bit s of a set says that some
    multiset of the lengths seen so far sums to s. A length that occurs n times joins in steps of
    1, 2, 4, ... copies, at most as many as fit. The sets before each step are kept, and
    walking back through them from the best sum gives the counts.
    """
    lengths = np.flatnonzero(counts)[::-1]
    first = int(lengths[0])
    used = {first: 1}
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in lengths[np.searchsorted(-lengths, -room):]:
        length = int(length)
        left = min(int(counts[length]) - (length == first), room // length)
        copies = 1
        while left > 0:
            take = min(copies, left)
            steps.append((sums, length, take))
            sums |= (sums << (take * length)) & mask
            left, copies = left - take, copies * 2
        if sums >> room & 1:
            break
    best = sums.bit_length() - 1
    for before, length, take in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + take
            best -= take * length
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Windows for all lengths: (length, from_rank, to_rank, first_sequence, each, offset).

    A filling repeats as long as the counts allow, so its windows are one entry for each
    of its lengths. Each filling uses up a length, or leaves less of it than a window takes:
    the plan's size depends on the capacity, not on the number of documents.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    rank = np.zeros(capacity + 1, dtype=np.int64)
    sequence, entries = 0, []
    while counts.any():
        used = fill(counts, capacity)
        times = min(int(counts[length]) // each for length, each in used.items())
        offset = 0
        for length, each in sorted(used.items(), reverse=True):
            upto = int(rank[length]) + times * each
            entries.append((length, int(rank[length]), upto, sequence, each, offset))
            rank[length] = upto
            counts[length] -= times * each
            offset += each * length
        sequence += times
    return entries


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all tokens of all documents to sequences of at most ``capacity`` tokens.

    A document is cut at multiples of the capacity; the rests are packed by minimum bin
    slack. The driver sees the histogram of piece lengths, which has ``capacity`` rows at most;
    pieces of one length are numbered in parts. A null or empty text is the end
    id alone; repeated rows are packed each; extra columns are not passed on; an empty table
    gives no rows. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    store = Stored(spark, "packing")
    cut = store.put(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    counts = cut.groupBy("length").agg(F.count("*").alias("n"))
    entries = plan({r["length"]: r["n"] for r in counts.collect()}, capacity)
    windows = spark.createDataFrame(
        entries, "length long, _from long, _to long, _first long, _each long, _offset long")
    numbered = ranked(cut, counts, "length", ["doc_id", "start", "ids_crc32"],
                      ["doc_id", "start"])
    within = F.col("rank") - F.col("_from")
    return (numbered.join(F.broadcast(windows), "length")
            .filter((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")))
            .select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                    (F.col("_first") + F.floor(within / F.col("_each"))).alias("sequence_id"),
                    (F.col("_offset") + within % F.col("_each") * F.col("length"))
                    .alias("offset")))
