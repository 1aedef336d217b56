"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import (embeddings, fingerprints, html_text, mixing, packing, pii, prefix_trie, quality, sharding,
                          simhash, suffix_dedup, top_k, whitening)
from veilspan.llm.common import read_table

TOKENIZER = "byte_bpe_50k.json"


def op1_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read_table(spark, d, "documents"))


# A deployment passes its own secret; the registered query has a fixed one so that reruns agree.
QUERY_KEY = b"key of the registered query"


def op2_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.with_pseudonyms(read_table(spark, d, "documents"), QUERY_KEY,
                               counts_col="n_found").select(
        "doc_id", "text", *[F.col("n_found")[k].alias(f"n_{k}") for k in pii.KINDS])


def op3_sharding(spark: SparkSession, d: str) -> DataFrame:
    dealt = sharding.shard(read_table(spark, d, "documents"), 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                        "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, d, "documents"))


def op5_html(spark: SparkSession, d: str) -> DataFrame:
    return html_text.extract(read_table(spark, d, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op7_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.with_fingerprints(read_table(spark, d, "documents"))


def op8_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, d, "embeddings"))


def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read_table(spark, d, "documents"), public_tokenizers.path(TOKENIZER))


def op10_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    model = quality.train(docs, read_table(spark, d, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


WHITENED = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double")


def op11_whitening(spark: SparkSession, d: str) -> DataFrame:
    # A sum that leaves the range of a long is null, and so the vector no finite one.
    quantised = F.transform("embedding", lambda v: F.try_add(
        F.floor(v.cast("double") * 64), F.lit(1000000).cast("long")))
    found = whitening.whiten(read_table(spark, d, "embeddings").filter(whitening.is_finite(F.col("embedding")))
                             .select("vec_id", quantised.alias("x")), "x", 32)
    if found is None:
        return spark.createDataFrame([], WHITENED)
    off = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in found.sums]),
                     lambda x, s: F.lit(found.n).cast("long") * x - s)
    # Null where the exact sum has no place in a long.
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda a, x: F.try_add(a, F.try_multiply(x, x)))
    shares = F.array(*[F.lit(float(e / found.trace)) for e in found.eigenvalues])
    # Of a row, before it is exploded to one for each component.
    rows = found.rows.select("vec_id", deviation.alias("deviation"), "whitened").select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"),
                       "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"),
                       F.lit(found.identity_error).alias("identity_error"))


def op12_top_k(spark: SparkSession, d: str) -> DataFrame:
    vectors = read_table(spark, d, "embeddings").filter(whitening.is_finite(F.col("embedding"))).select(
        "vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 256)).alias("vector"))
    return top_k.top_k(vectors, F.col("vec_id") % 50 == 0, "vec_id", "vector", 5)


NOBODY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def op13_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    trie = prefix_trie.prefix_trie(read_table(spark, d, "conversations"), families=True)
    return trie.nodes.join(prefix_trie.ends_digest(trie.ends), list(prefix_trie.NODE), "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_pii": op2_pii,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_html": op5_html,
    "op6_mixing": op6_mixing,
    "op7_fingerprints": op7_fingerprints,
    "op8_embeddings": op8_embeddings,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_top_k": op12_top_k,
    "op13_prefix_trie": op13_prefix_trie,
}
# Every window of 50 words that another document has as well, merged where windows touch.
PASSAGES_SQL = r"""
with texts as (select doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')
                 as words from documents where doc_id is not null and text is not null),
windows as (select doc_id, k, hash(list_slice(words, k + 1, k + 50)) as h
            from (select doc_id, words, unnest(range(0, len(words) - 49)) as k from texts) w),
shared as (select h from windows group by h having count(distinct doc_id) > 1),
hits as (select doc_id, k, case when k - lag(k) over (partition by doc_id order by k) <= 50 then 0
           else 1 end as fresh from windows semi join shared using (h)),
runs as (select *, sum(fresh) over (partition by doc_id order by k) as run from hits)
select doc_id, min(k) as start_word, max(k) + 50 - min(k) as n_words from runs group by doc_id, run"""

# All pairs, and what they lead to.
VECTORS_SQL = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
good as (select * from v where len(list_filter(e, lambda x: x <> 0)) > 0
         and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0),
link as (select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id
         and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reached(vec_id, root) as (select vec_id, vec_id from v
                          union select link.b, root from reached join link on link.a = reached.vec_id),
lowest as (select vec_id, min(root) as component_id from reached group by 1),
counted as (select a as vec_id, count(*) as n from link group by 1)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from lowest left join counted using (vec_id)"""

# Every query against every other row.
TOP_SQL = """
with good as (select vec_id, row_number() over () as r, embedding from embeddings where vec_id is not null
  and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
v as (select vec_id, r, list_transform(embedding, lambda x: floor(cast(x as double) * 256)) as e from good),
scored as (select q.vec_id as query_id, q.r, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
           from v q join v c on q.r <> c.r where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5"""

# All prefixes as lists. The checksum (reflected polynomial 3988292384) goes over the digits of the id.
TRIE_SQL = """
with own as (select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                                  order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as l
             from conversations where conv_id is not null group by conv_id),
summed as (select conv_id, l, xor(list_reduce(list_concat([4294967295::bigint],
               list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ascii(x)::bigint)),
             lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
               lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)),
             4294967295::bigint) % 9 as h from own),
rebuilt as (select s.conv_id, list_concat(coalesce(p.l[:s.h], []), s.l[s.h + 1:]) as l
            from summed s left join own p on p.conv_id = s.conv_id - s.conv_id % 5),
prefixes as (select conv_id, len(l) as n, unnest(range(0, len(l) + 1)) as depth, l from rebuilt),
nodes as (select l[:depth] as k, depth, min(conv_id) as conv_id, count(*) as n_convs,
            sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = depth), ''))
              as ends_sha256
          from prefixes group by k, depth),
inner_nodes as (select n.k[:n.depth - 1] as k, count(*) as n_children from nodes n where depth > 0 group by 1),
counted as (select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join inner_nodes c on c.k = n.k),
above as (select unnest(range(0, depth + 1)) as up, k, n_children,
            case when depth = 0 then 0 else (n_convs - 1) * octet_length(encode(k[depth].text)) end as own_saving
          from counted),
sums as (select k[:up] as k, sum(own_saving) as saved, count(*) filter (n_children = 0) as n_leaves
         from above group by 1)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, s.n_leaves,
  cast(s.saved as bigint) as saved_tokens, c.ends_sha256
from counted c join sums s on s.k = c.k left join nodes p on p.depth = c.depth - 1 and p.k = c.k[:c.depth - 1]"""

ORACLES = {"op1_suffix_dedup": PASSAGES_SQL, "op8_embeddings": VECTORS_SQL, "op12_top_k": TOP_SQL,
           "op13_prefix_trie": TRIE_SQL}


def register(catalog) -> None:
    for name, query in QUERIES.items():
        catalog.add(name, query, ORACLES.get(name))
