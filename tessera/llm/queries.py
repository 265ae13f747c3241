"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera._ship import ship
from tessera.llm import chat, embed_dedup, langid, lm, mixing, ngram_join, packing, quality, rules, warc
from tessera.llm._runtime import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


def op3_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.units().alias("size"))
    mixed = mixing.interleave(sized, size=F.col("size"))
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_pos", "mix_in")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.counted(_table(spark, sf_dir, "documents")), tokens=F.col("n_tokens"))
    return packed.select("doc_id", "n_tokens", "bucket", "padded_to", "batch", "batch_row")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    filters = langid.learn(docs.where(~langid.held_out("doc_id", 5)).select("text", "lang"), Scratch(spark, "langid"))
    found = langid.identify(docs, filters, ["doc_id"])
    return found.select("doc_id", langid.held_out("doc_id", 5).alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).where(~langid.held_out("doc_id", 5))
    scored = quality.classify(_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", langid.held_out("doc_id", 5).alias("held_out"), "score", "predicted")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(_table(spark, sf_dir, "conversations"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = warc.archive(pages, min_bytes=0).find(pages.select("url"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_join, op2_lm, op3_embed_dedup, op4_mixing, op5_packing, op6_langid, op7_quality, op8_rules, op9_chat, op10_warc]
    return {f.__name__: f for f in found}


_REACH = """
reach as (
  select id, id as other from nodes
  union
  select r.id, l.b as other from reach r join links l on r.other = l.a
)"""

_SQL = {
    "op1_ngram_join": f"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from words
), items as (select doc_id, len(s) as n, unnest(s) as t from sets),
pairs as (
  select x.doc_id as a, y.doc_id as b from items x join items y on x.t = y.t and x.doc_id <> y.doc_id
  group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), nodes as (select doc_id as id from documents), links as (select a, b from pairs),{_REACH}
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.other) as component_id
from sets s join reach r on r.id = s.doc_id group by s.doc_id, len(s.s)""",
    "op3_embed_dedup": f"""
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
), u as (
  select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v
), links as (
  select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id
  where x.norm > 0 and y.norm > 0 and list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.95
), nodes as (select vec_id as id from embeddings),{_REACH},
degree as (select a, count(*) as n from links group by a)
select n.id as vec_id, coalesce(max(d.n), 0) as n_links, min(r.other) as component_id, n.id = min(r.other) as kept
from nodes n join reach r on r.id = n.id left join degree d on d.a = n.id group by n.id""",
    # the tables have no tool calls; calls and results are tested against a brute-force version
    "op9_chat": """
select conv_id, turn, role, 'message' as kind,
  cast(to_json({'content': text, 'role': role}) as varchar) as message,
  cast(0 as bigint) as n_calls, cast(0 as bigint) as n_answered, cast(0 as bigint) as n_repeated,
  cast(null as boolean) as args_valid, cast(null as bigint) as call_turn,
  turn as order_turn, 0 as order_rank, 0 as order_pos
from conversations""",
    "op10_warc": """
with p as (
  select page_id, sha1(coalesce(html, '')) as h, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes from pages
), f as (select *, min(page_id) over (partition by h, payload_bytes) as first from p)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(1 + ((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as bigint), 5) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31) as bigint), 1)), 'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from f""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
