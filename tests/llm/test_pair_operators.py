"""Operators that compare documents or vectors with each other, against brute force."""

import glob
import os
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspan.llm import components as cc
from veilspan.llm import embeddings, simhash, suffix_dedup
from veilspan.llm.common import Stored

DOCS = "doc_id long, text string"


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    n = 60
    edges = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(40)], "none": []}[kind]
    found = cc.components(spark.createDataFrame(edges, "a long, b long"), Stored(spark, "t"))
    expected = roots(n, edges)
    got = {r.node: r.root for r in found.collect()}
    assert got == {i: expected[i] for e in edges if e[0] != e[1] for i in e}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def plain_fingerprint(text):
    ws = (text or "").encode().lower().split()
    shingles = [b" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def near_texts():
    rng = random.Random(2)
    base = [words(rng, 120) for _ in range(12)]
    texts = list(base)
    for t in base[:6]:
        ws = t.split()
        for _ in range(4):
            ws[rng.randrange(len(ws))] = "edited"
            texts.append(" ".join(ws))
    return texts + [base[0], base[0].upper(), base[1].replace(" ", "\t\n"), "", None, " \x0b ", "one",
                    "One two", "a b c d"]


def test_simhash_equals_brute_force(spark):
    texts = near_texts()
    rows = [(i + 3, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS + ", fingerprint string, key int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)
             if (prints[i] ^ prints[j]).bit_count() <= 2]
    expected = roots(len(texts), pairs)
    assert got == {i + 3: (f"{prints[i]:016x}", expected[i] + 3) for i in range(len(texts))}
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_simhash_links_all_within_two_bits_of_a_crowd(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(150):
        v = rng.choice(sorted(values))
        for _ in range(rng.choice((1, 2, 3, 5))):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values | {rng.getrandbits(64) for _ in range(50)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    store = Stored(spark, "t")
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in cc.components(simhash.links(df, store), store).collect()}
    pairs = [(i, j) for i in range(len(values)) for j in range(i)
             if (values[i] ^ values[j]).bit_count() <= 2]
    expected = roots(len(values), pairs)
    groups = {}
    for i, v in enumerate(signed):
        groups.setdefault(expected[i], []).append(v)
    assert found == {v: min(g) for g in groups.values() if len(g) > 1 for v in g}


def test_golay_words_two_bits_apart_share_an_index():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 1 << 23, 300)
    flips = rng.integers(0, 23, (300, 2))
    u = v ^ (1 << flips[:, 0]) ^ (1 << flips[:, 1])
    a, b = simhash.indices(v, 23), simhash.indices(u, 23)
    assert all(set(x) & set(y) for x, y in zip(a, b))
    assert max(len(set(x)) for x in a) <= 6


def test_simhash_edge_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == simhash.one_of_each(empty).count() == 0
    rng = random.Random(5)
    long = words(rng, 30000)
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (None, "a b c"), (None, "a b c")], DOCS)
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in
                 simhash.near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(False, 1, 1), (False, 1, 1)]
    assert sorted(r.text for r in simhash.one_of_each(df).collect()) == sorted([long, "a b c"])


def test_one_of_each_keeps_texts_that_share_an_id(spark):
    rng = random.Random(12)
    a, b, c = (words(rng, 200) for _ in range(3))
    near = a.split()
    near[7] = "edited"
    rows = [(1, a, "x"), (1, b, "y"), (2, c, "z"), (3, a, "w"), (4, " ".join(near), "v"), (None, c, "u"), (None, "q r s t", "s"),
            (None, "q r s t", "s")]
    df = spark.createDataFrame([(t, i, m) for i, t, m in rows], "text string, doc_id long, `_print` string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(df).collect()) == sorted(
        [(1, a), (1, b), (2, c), (0, "q r s t")] + ([(4, rows[4][1])] if (plain_fingerprint(a) ^ plain_fingerprint(
            rows[4][1])).bit_count() > 2 else []))
    # Near texts of one id are one document.
    twice = spark.createDataFrame([(9, a), (9, a), (9, b), (12, b)], DOCS)
    assert sorted((r.doc_id, r.text) for r in simhash.one_of_each(twice).collect()) == sorted([(9, a), (9, b)])


def brute_repeats(rows, least):
    seen = {}
    for doc, text in rows:
        if doc is None or text is None:
            continue
        ws = text.encode().split()
        for k in range(len(ws) - least + 1):
            seen.setdefault(tuple(ws[k:k + least]), set()).add(doc)
    out = {}
    for doc, text in rows:
        ws = (text or "").encode().split()
        for k in range(len(ws) - least + 1):
            if doc is not None and len(seen[tuple(ws[k:k + least])]) > 1:
                out.setdefault(doc, set()).update(range(k, k + least))
    return out


def covered(result):
    out = {}
    for r in result.collect():
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    return out


def test_passages_equal_brute_force(spark):
    rng = random.Random(6)
    passages = [words(rng, n) for n in (50, 51, 60, 75, 120, 49, 30)]
    rows = []
    for i in range(40):
        parts = [words(rng, rng.randrange(0, 80))]
        for p in rng.sample(passages, 2):
            parts += [p, words(rng, rng.randrange(0, 60))]
        rows.append((i, " ".join(parts)))
    rows += [(40, rows[3][1]), (41, rows[3][1] + " tail"), (42, "the " * 130), (43, "the " * 90 + "end"),
             (44, ""), (45, None), (None, rows[3][1]), (46, " ".join(passages[2:5])),
             (47, words(rng, 40000) + " " + passages[3])]
    df = spark.createDataFrame([(a, b, 9) for a, b in rows], DOCS + ", pos int").repartition(5)
    result = suffix_dedup.repeated_passages(df)
    assert result.columns == ["doc_id", "start_word", "n_words"]
    assert covered(result) == brute_repeats(rows, 50)


def test_a_common_passage_and_repeats_within_a_document(spark):
    rng = random.Random(7)
    passage = words(rng, 55)
    rows = [(i, f"{words(rng, 20)} {passage} {words(rng, 20)}") for i in range(300)]
    rows += [(900, f"{passage[:-1]}x {words(rng, 9)} " * 2)]
    df = spark.createDataFrame(rows, DOCS)
    assert covered(suffix_dedup.repeated_passages(df)) == brute_repeats(rows, 50)
    assert suffix_dedup.repeated_passages(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, f"{passage} {passage}"), (1, passage)], DOCS)
    assert suffix_dedup.repeated_passages(alone).count() == 0


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_a_run_of_one_document_longer_than_a_part(spark, parts):
    rng = random.Random(9)
    passage = words(rng, 55)
    rows = [(5, f"{passage} " * 500), (1, f"{words(rng, 20)} {passage} {words(rng, 20)}"),
            (9, f"{words(rng, 20)} {passage} {words(rng, 20)}"), (12, "the " * 3000), (13, "the " * 60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = covered(suffix_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_repeats(rows, 50)


def test_passages_of_many_edited_copies(spark):
    rng = random.Random(10)
    rows = []
    for group in range(6):
        base = words(rng, 300).split()
        for _ in range(60 if group < 2 else 20):
            rows.append((len(rows), " ".join(words(rng, 1) if rng.random() < 0.03 else w for w in base)))
    df = spark.createDataFrame(rows, DOCS)
    assert covered(suffix_dedup.repeated_passages(df)) == brute_repeats(rows, 50)


@pytest.mark.parametrize("together, at_once", [(3, 8192), (4096, 5), (1, 1)])
def test_grams_of_many_suffixes_and_small_sorts(spark, monkeypatch, together, at_once):
    """Both ways give what brute force does, also where a gram's suffixes come in several batches."""
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    monkeypatch.setattr(suffix_dedup, "SORTED_ROWS", at_once)
    rng = random.Random(11)
    passages = [words(rng, n) for n in (15, 40, 55, 90)]
    rows = [(i % 37, " ".join(f"{words(rng, rng.randrange(45))} {rng.choice(passages)}" for _ in range(4))) for i in range(60)]
    base = words(rng, 200).split()
    rows += [(100 + i, " ".join("x" if rng.random() < 0.02 else w for w in base)) for i in range(25)] + rows[-1:]
    df = spark.createDataFrame([(t, d, 1, "w") for d, t in rows], "body string, `key` long, words int, found string")
    got = suffix_dedup.repeated_passages(df, "key", "body")
    # Ids repeat: a passage of one text counts for its id; brute force sees the ids' texts one by one.
    found = {}
    for r in got.collect():
        found.setdefault(r.key, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert found == brute_repeats(rows, 50)


def vectors():
    rng = np.random.default_rng(8)
    x = [rng.standard_normal(16) for _ in range(150)]
    for base in list(x[:25]):
        near = base
        for _ in range(4):
            near = near + rng.standard_normal(16) * 0.3
            x.append(near)
    x += [x[0], x[0], 2 * x[1], -x[1]]
    return [v.tolist() for v in x]


def brute_vectors(rows, cosine=0.9):
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)
            for v in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(rows[i]) == len(rows[j]):
                a, b = np.array(rows[i]), np.array(rows[j])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    pairs.append((i, j))
    n = [sum(i in p for p in pairs) for i in range(len(rows))]
    return n, roots(len(rows), pairs)


@pytest.mark.parametrize("block", [embeddings.BLOCK, 4])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = [*vectors(), None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None],
            [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.1], [1e-300] * 16, [1e300] * 16]
    n, root = brute_vectors([[c / 1e300 for c in r] if r and r[0] == 1e300 else
                             [c * 1e300 for c in r] if r and r[0] == 1e-300 else r for r in rows])
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in enumerate(rows)],
                               "vec_id long, embedding array<double>, vector string, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == {i: (n[i], root[i], root[i] == i) for i in range(len(rows))}


def test_vectors_of_a_hot_class_and_an_empty_table(spark):
    df = spark.range(600).select(F.col("id").alias("vec_id"), F.array(
        *[F.lit(x).cast("float") for x in (1, 2, 3)]).alias("embedding"))
    got = embeddings.near_duplicates(df).agg(F.min("n_links"), F.max("n_links"), F.max("component_id"),
                                             F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (599, 599, 0, 1)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_vectors_that_share_an_id_or_have_none(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [1.0, 0.0, 0.1]), (1, [0.0, 0.0, 1.0]),
            (7, [0.0, 0.1, 1.0]), (None, [0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.1]), (None, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df).collect()
    assert sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got)) == [
        (0, 0, 0, False), (0, 1, 9, False), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False),
        (3, 2, 1, False), (7, 1, 1, False), (9, 1, 9, True)]


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {path: os.path.getsize(path) for folder in folders for path in
            glob.glob(f"{folder}/*/shuffle_*") if os.path.exists(path)}


def test_vectors_are_dealt_to_a_few_tables_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "ROUND", 0, raising=False)
    monkeypatch.setattr(embeddings, "FOLD", 0.4, raising=False)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 64))
    x[::3] = x[0] + rng.standard_normal((667, 64)) * 0.1
    x = x.astype(np.float32)
    known, left, put = set(shuffle_files(spark)), [], Stored.put

    def watched(store, df):
        table = put(store, df)
        for _ in range(50):  # files go a little later
            size = sum(n for path, n in shuffle_files(spark).items() if path not in known)
            if size < x.nbytes:
                break
            time.sleep(0.1)
        left.append(size)
        return table

    monkeypatch.setattr(Stored, "put", watched)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    # Never more than the vectors themselves, where each of them goes to some 20 tables.
    assert max(left) < x.nbytes
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    n = np.bincount(np.concatenate([i, j]), minlength=len(x))
    assert n.max() > 300
    assert got == {k: (n[k], r) for k, r in enumerate(roots(len(x), list(zip(i.tolist(), j.tolist()))))}


def test_codes_of_a_vector_do_not_depend_on_others():
    rng = np.random.default_rng(2)
    x, normals = embeddings.unit(rng.standard_normal((500, 33))), embeddings.planes(33, 5, 7)
    x[7] -= x[7] @ normals[:, 3] / (normals[:, 3] @ normals[:, 3]) * normals[:, 3]  # a sign in doubt
    together = embeddings.codes_of(x, normals, 5)
    assert together.shape == (500, 7) and together.min() >= 0 and together.max() < 32
    for i in range(0, 20):
        assert (embeddings.codes_of(x[i:i + 1], normals[:, 10:25], 5) == together[i, 2:5]).all()
        assert (embeddings.codes_of(x[i:i + 1], normals[:, :5], 5) == together[i, :1]).all()
