"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import encoded_documents
from .classifier import judged_documents
from .common import table
from .fingerprint import edited_fingerprints
from .hmm import scored_documents
from .minhash import near_duplicates
from .packing import packed_documents
from .preference import preference_documents
from .sharding import sharded_documents
from .suffix import cut_documents
from .vectors import near_vectors


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_documents(table(spark, sf_dir, "documents"), shards=40)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_documents(table(spark, sf_dir, "conversations"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return encoded_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 85).drop("rid")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """byte_bpe_50k.tiktoken is the vocabulary of byte_bpe_50k.json as ranks without its added token, which packing knows; the ids are those of tokenizers (tested)."""
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def op8_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_documents(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_preference_formatting": op3_preference_formatting,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_hmm_scoring": op8_hmm_scoring,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_order_minhash": op10_order_minhash,
}

OP3_SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
r as (
  select conv_id as pair_id, true as first, turn, role, text from t
  union all
  select conv_id + 1 - 2 * (conv_id % 2), false, turn, role, text from t),
o as (select *, row_number() over (partition by pair_id, first order by turn nulls first, role, text) as pos from r),
s as (
  select pair_id, max(pos) filter (where first and role = 'assistant') as la, max(pos) filter (where first) as na,
         max(pos) filter (where not first and role = 'assistant') as lb
  from o group by pair_id having max(pos) filter (where first) is not null),
c as (select pair_id, pos, role, text from o join s using (pair_id) where first),
j as (
  select pair_id, pos, role, text from o join s using (pair_id) where first and pos < coalesce(la, na + 1)
  union all
  select pair_id, coalesce(la, na + 1) + pos - lb, role, text from o join s using (pair_id) where not first and pos >= lb),
n as (
  select s.pair_id, coalesce(
    (select min(c.pos) - 1 from c join j on c.pair_id = j.pair_id and c.pos = j.pos
     where c.pair_id = s.pair_id and (c.role <> j.role or c.text <> j.text)),
    least((select count(*) from c where c.pair_id = s.pair_id), (select count(*) from j where j.pair_id = s.pair_id))) as n
  from s),
cr as (select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as shown from c),
jr as (select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as shown from j),
cm as (
  select pair_id, pos, shown, role, length(role) + 5 as head, length(text) + 8 as body,
         coalesce(sum(length(shown)) over (partition by pair_id order by pos rows between unbounded preceding and 1 preceding), 0) as before
  from cr join n using (pair_id) where pos > n),
jm as (
  select pair_id, pos, shown, role, length(role) + 5 as head, length(text) + 8 as body,
         coalesce(sum(length(shown)) over (partition by pair_id order by pos rows between unbounded preceding and 1 preceding), 0) as before
  from jr join n using (pair_id) where pos > n),
p as (select pair_id, string_agg(shown, '' order by pos) as prompt from cr join n using (pair_id) where pos <= n group by pair_id),
ca as (select pair_id, string_agg(shown, '' order by pos) as chosen,
         string_agg(cast(before + head as bigint) || ':' || body, ',' order by pos) filter (where role = 'assistant') as chosen_mask from cm group by pair_id),
ja as (select pair_id, string_agg(shown, '' order by pos) as rejected,
         string_agg(cast(before + head as bigint) || ':' || body, ',' order by pos) filter (where role = 'assistant') as rejected_mask from jm group by pair_id)
select n.pair_id, cast(n.n as integer) as prompt_turns, coalesce(prompt, '') as prompt, coalesce(chosen, '') as chosen, coalesce(rejected, '') as rejected,
       coalesce(chosen_mask, '') as chosen_mask, coalesce(rejected_mask, '') as rejected_mask
from n left join p using (pair_id) left join ca using (pair_id) left join ja using (pair_id)
"""

ORACLES = {
    "op3_preference_formatting": OP3_SQL,
}
