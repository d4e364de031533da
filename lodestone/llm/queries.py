"""The queries of this subpackage: production parameters, whole tables. ORACLE_SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, minhash, ogg, packing, pii, suffixes, topk, toxicity, warc
from .common import table, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_in(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), 256.0)
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_media(written(ogg.store_media(table(spark, sf_dir, "documents")), "media"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_hard_case(spark, table(spark, sf_dir, "conversations"))
    return chat.digests(chat.read_conversations(chat.format_conversations(rows)))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 400 bytes; beside it, how much lies in repeated passages of over 50 words, which may be shorter."""
    return suffixes.removal_and_passages(table(spark, sf_dir, "documents"), 400)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc.write_bundles(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_minhash, op2_pii, op3_bpe, op4_topk, op5_ogg, op6_packing, op7_chat, op8_suffixes, op9_warc, op10_toxicity)}


ORACLE_SQL: dict[str, str] = {
    "op4_topk": """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id as vec_id,
           cast(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
""",
    "op7_chat": r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e as (
    select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
           length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')) as n_text,
           length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')) as n_role
    from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(n_text + case when before = role then 7 else n_role + 3 + 6 + 4 end) as bigint) as formatted_chars
from e group by conv_id
""",
    "op9_warc": """
with p as (select page_id, coalesce(html, '') as html, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha1(html) as h, min(page_id) over (partition by html) as first_id from p)
select page_id, cast(n as bigint) as payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + cast((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as int), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1)), 'string_agg', '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from d
""",
}
