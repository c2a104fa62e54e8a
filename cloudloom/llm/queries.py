"""The opN_ queries: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, html_text, language_id, near_dup, packing, quality, sharding, topk, toxicity, url_filter, warc, whitening
from .common import table
from .labels import fold

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "edits", "words", "first_word", "last_word")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
    return rows.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"), 16)
    return rows.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(fold("doc_id", 4) != 2))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    rows = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))
    return rows.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), 16)
    return rows.withColumn("deviation", F.expr("try_cast(deviation as long)"))  # null where beyond a long


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return rows.withColumnRenamed("id", "doc_id")


def op13_alignment(spark: SparkSession, sf_dir: str, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    aligned = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(a), public_tokenizers.path(b))
    rows = alignment.link_counts(aligned)
    return rows.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", F.col("count_sum").cast("long").alias("count_sum"), "groups_sha256")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_near_dup, op4_decontaminate, op5_html_text, op6_topk, op7_sharding, op8_language_id, op9_packing, op10_warc, op11_whitening, op12_quality, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.oracle(), "op3_near_dup": OP3, "op6_topk": OP6, "op7_sharding": op7_sql(), "op10_warc": OP10}


OP10 = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n::bigint as payload_bytes, p.d as payload_digest,
  case when f.first is null or f.first = page_id then 'response' else 'revisit' end as record_type,
  case when f.first is not null and f.first is distinct from page_id then f.first end as refers_to
from p left join f on p.d = f.d and p.n >= 100
"""

OP6 = """
with v as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
x as (select row, vec_id, unnest(e) as c, generate_subscripts(e, 1) as i, len(e) as dim from v),
s as (select q.row, q.vec_id as query_id, x.row as other, x.vec_id, sum(q.c * x.c)::bigint as score from x q join x on q.i = x.i and q.dim = x.dim and q.row <> x.row
  where q.vec_id % 20 = 0 group by all),
r as (select *, row_number() over (partition by row order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

OP3 = """
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
s as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g from d),
n as materialized (select doc_id, len(g) as n from s),
x as materialized (select doc_id, unnest(g) as g from s),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
both_ways as materialized (select a, b from link union select b, a from link),
reach as (select a as doc_id, b as other from both_ways union select r.doc_id, e.b from reach r join both_ways e on r.other = e.a),
far as (select doc_id, min(other) as m from reach group by doc_id)
select n.doc_id, n.n::bigint as n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) as component_id, least(n.doc_id, coalesce(m, n.doc_id)) = n.doc_id as kept from n left join far on n.doc_id = far.doc_id
"""


def op7_sql(shards: int = 16, slack: float = sharding.SLACK) -> str:
    """The law of assign_shards in window sums, with CRC-32 by its table."""
    return f"""
with bits as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, list_transform(range(8), lambda j: 0::bigint)), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
raw as materialized (select doc_id, md5(coalesce(text, '')) as digest, strlen(coalesce(text, '')) + 1 as size, hex(encode(coalesce(text, ''))) as hx from documents),
parts as materialized (select * exclude hx, list_transform(range(0, len(hx) // 2), lambda i: ('0x' || hx[2 * i + 1 : 2 * i + 2])::bigint) as bytes from raw),
p as materialized (select doc_id, digest, size, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, z: xor(c >> 8, t[(xor(c, z) & 255) + 1])), 4294967295) as crc,
  sum(size) over o - size as b, row_number() over o - 1 as r from parts, bits window o as (order by digest, doc_id nulls first rows unbounded preceding)),
a as (select sum(size) as total, max(size) as largest from p),
g as (select digest, min(b) as b0, max(b + size) as b1, min(r) as r0, max(r) + 1 as r1 from p group by digest),
t as (select total * i // {shards} as aim, greatest({slack} * total / {shards}, largest) as allowed from a, range(1, {shards}) x(i)),
e as (select aim, allowed, p.b, p.b + p.size as z, p.r, g.* from t join p on p.b <= aim and aim < p.b + p.size join g on g.digest = p.digest),
cuts as materialized (select case when least(abs(b0 - aim), abs(b1 - aim)) <= allowed then case when abs(b0 - aim) <= abs(b1 - aim) then r0 else r1 end when abs(b - aim) <= abs(z - aim) then r else r + 1 end as cut from e)
select p.doc_id, p.size::bigint as size, p.crc::bigint as text_crc32, 'bytes' as law, (select count(*) from cuts where cut <= p.r)::int as shard, (p.r - greatest(0, coalesce((select max(cut) from cuts where cut <= p.r), 0)))::bigint as slot, null::int as grown_shard from p
"""
