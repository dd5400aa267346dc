"""The operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, exact_topk, language_id, license_scan, line_quality, ngram_join, packing, source_mix, substring_dedup, toxicity
from .common import crc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(parts: int, remainder: int):
    """False for a null doc_id, which has no remainder (and whose row is not learned from either)."""
    return F.coalesce(crc() % parts == remainder, F.lit(False)).alias("held_out")


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=75)


def op2_exact_top_k(spark, sf_dir):
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op3_source_mix(spark, sf_dir):
    return source_mix.taken_words(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.train(docs, docs.filter(crc() % 4 != 2).select("doc_id", F.col("lang").alias("label")))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_model(docs))
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score", "ambiguous")


def op5_substring_dedup(spark, sf_dir):
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def labelled(spark, sf_dir, name: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(crc() % 5 != 0).select("doc_id", F.col(name).alias("label"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, labelled(spark, sf_dir, "toxic")))
    return found.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = line_quality.score(docs, line_quality.train(docs, labelled(spark, sf_dir, "quality")))
    return found.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files(), window=1024, end=0)


def queries():
    found = [op1_ngram_jaccard_join, op2_exact_top_k, op3_source_mix, op4_language_id, op5_substring_dedup, op6_exact_dedup, op7_toxicity, op8_quality, op9_license_scan, op10_packing]
    return {f.__name__: f for f in found}


ORACLE = {
    "op2_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id, min(e) as e from v where vec_id % 50 = 0 group by vec_id),
s as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score
      from q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op6_exact_dedup": r"""
with n as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as k from documents),
r as (select doc_id, k, first_value(doc_id) over w as keep_id, count(*) over (partition by k) as group_size, row_number() over w as rn from n
      window w as (partition by k order by length(t) desc, doc_id))
select doc_id, keep_id, group_size, rn = 1 as kept, sha256(k) as text_sha256 from r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
