"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlode.llm import (
    ann, bpe, chat, conversation_trie, html_text, line_dedup, mixing, packing, periodic, sharding, simhash, toxicity, vector_dedup,
)
from offerlode.llm.common import durable, table


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    prints = durable(simhash.fingerprints(table(spark, folder, "documents")), "fingerprints")
    return simhash.near_duplicates(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    units = mixing.decisions(table(spark, folder, "documents"))
    rows = units.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source"
    )


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(key % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_digests(table(spark, folder, "documents"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_shared_lines(docs).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.perspectives(table(spark, folder, "conversations"))


def op7_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.extract(pages)


def op8_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents"), 8)


def op10_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.linked_vectors(table(spark, folder, "embeddings"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat": op6_chat,
    "op7_html": op7_html,
    "op8_ann": op8_ann,
    "op9_sharding": op9_sharding,
    "op10_vector_dedup": op10_vector_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_packing": op12_packing,
    "op13_periodic": op13_periodic,
}

LINES_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as body from documents),
lines as (
  select doc_id, body, i, parts[i] as line,
    translate(regexp_replace(parts[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, body, string_split(body, chr(10)) as parts from docs) s, unnest(range(1, len(parts) + 1)) as u(i)
), shared as (
  select key from lines where length(key) >= 1 group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(s.key) as n_dropped,
  sha256(coalesce(string_agg(case when s.key is null then line end, chr(10) order by i), '')) as kept_sha256
from lines left join shared s on lines.key = s.key group by doc_id
"""

LINKS_SQL = f"""
with recursive usable as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b
  on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= {vector_dedup.THRESHOLD}
), reached as (
  select vec_id as a, vec_id as b from embeddings
  union select reached.a, links.b from reached join links on reached.b = links.a
), least as (
  select a, min(b) as component_id from reached group by a
), counted as (
  select a, count(*) as n from links group by a
)
select e.vec_id, coalesce(c.n, 0) as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e join least l on e.vec_id = l.a left join counted c on e.vec_id = c.a
"""

ORACLES: dict[str, str] = {
    "op11_prefix_trie": conversation_trie.TRIE_SQL,
    "op10_vector_dedup": LINKS_SQL,
    "op5_line_dedup": LINES_SQL,
    "op6_chat": chat.PERSPECTIVES_SQL,
}
