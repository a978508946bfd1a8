"""The thin queries over the driver's tables: production parameters, whole tables, the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ssaflow.llm import embeddings, media, mixing, packing, pii, simhash, substrings, tokens, toxicity, warc
from ssaflow.llm.common import read_table, small_batches


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return media.media_columns(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    archive = warc.write_archive(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.read_summaries(spark, archive)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), threshold=0.95)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"), share=1.5, cap=2.0, weights=(3.0, 1.0, 2.0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.summary(pii.find(docs, pii.fit(spark)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"), width=3, radius=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_substring_dedup": op1_substring_dedup, "op2_warc": op2_warc, "op3_packing": op3_packing, "op4_media_columns": op4_media_columns, "op5_token_counts": op5_token_counts, "op6_embedding_dedup": op6_embedding_dedup, "op7_mixing": op7_mixing, "op8_toxicity": op8_toxicity, "op9_pii": op9_pii, "op10_simhash": op10_simhash}


OP1_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
     g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
     m as (select s, min(doc_id) as least from g group by s),
     f as (select distinct doc_id, p from (select g.doc_id, unnest(range(g.i, g.i + 13)) as p from g join m using (s) where m.least < g.doc_id)),
     u as (select doc_id, w[p] as x, p from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
     k as (select u.doc_id, string_agg(x, ' ' order by u.p) as kept, count(*) as n from u left join f on u.doc_id = f.doc_id and u.p = f.p where f.p is null group by u.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""

OP2_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
     o as (select html, max(page_id) as owner from p group by html)
select p.page_id, cast(octet_length(encode(p.html)) as bigint) as payload_bytes, sha1(p.html) as payload_digest,
       case when octet_length(encode(p.html)) >= 1000 and p.page_id < owner then 'revisit' else 'response' end as record_type,
       case when octet_length(encode(p.html)) >= 1000 and p.page_id < owner then owner end as refers_to
from p join o on p.html = o.html
"""


OP6_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where len(embedding) > 0 and list_count(embedding) = len(embedding) and isfinite(list_sum(embedding::double[])) and list_inner_product(embedding::double[], embedding::double[]) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by a),
n as (select a as vec_id, count(*) as n_links from l group by a)
select c.vec_id, coalesce(n_links, 0) as n_links, component_id, c.vec_id = component_id as kept from c left join n on c.vec_id = n.vec_id
"""


OP7_SQL = r"""
with w as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
d as (
  select doc_id, source, len(words) as size,
         coalesce((select count(*) from (select unnest(words) as x) where regexp_full_match(x, '\pL+[,.;:!?]?')), 0) as plain,
         (cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '') || ':' || text), 1, 13) as bigint) + 1) / 4503599627370496.0::double as u
  from w),
k as (select *, -ln(u) / case when size > 0 then 0.5::double + 1.5::double * plain / size else 0.5::double end as key from d),
s as (
  select source, sum(size)::double as size, [3.0, 1.0, 2.0][(row_number() over (order by source is null, source) - 1) % 3 + 1]::double as weight
  from k group by source),
o as (
  select *, 1.5::double * sum(size) over () as total, row_number() over (order by 2.0::double * size / weight, source) as n,
         coalesce(sum(2.0::double * size) over (order by 2.0::double * size / weight, source rows between unbounded preceding and 1 preceding), 0) as capped,
         sum(weight) over (order by 2.0::double * size / weight, source rows between current row and unbounded following) as free from s),
f as (select min(n) as n from o where weight * (total - capped) / free <= 2.0::double * size),
t as (
  select o.source, o.size, case when f.n is null or o.n < f.n then 2.0::double * o.size else o.weight * (p.total - p.capped) / p.free end as target
  from o cross join f left join o p on p.n = f.n),
b as (select *, case when size > 0 then floor(target / size) else 0 end as epochs from t),
r as (
  select k.doc_id, k.size, b.size as source_size, b.target, b.epochs, floor(b.target - b.epochs * b.size + 0.5) as budget,
         coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and 1 preceding), 0) as ahead
  from k join b on k.source is not distinct from b.source)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
       cast(epochs * size + greatest(0, least(size, budget - ahead)) as bigint) as taken from r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op6_embedding_dedup": OP6_SQL, "op7_mixing": OP7_SQL}
