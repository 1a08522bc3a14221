"""Queries of the operators over the tables of one data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from chainrisk.llm.bottom_k import sketch_copies
from chainrisk.llm.byte_ppm import ppm_scores
from chainrisk.llm.hash_tree import tree_shards, tree_sql
from chainrisk.llm.host_rules import host_verdicts, verdict_sql
from chainrisk.llm.jaccard_join import components_sql, jaccard_classes
from chainrisk.llm.language_id import fit_languages, held_out, predict_languages
from chainrisk.llm.maxscore_search import maxscore_topk, whole_components
from chainrisk.llm.merge_dropout import encode_documents
from chainrisk.llm.neighbour_quality import fit_votes, vote_scores
from chainrisk.llm.prefix_trie import prefix_trie, trie_sql
from chainrisk.llm.source_mixing import mix_sql, poisson_mix, tempered_weights
from chainrisk.llm.spelling_variants import spelling_variants, variants_sql
from chainrisk.llm.suffix_dedup import cut_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op1_neighbour_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", held_out(5))
    labels = table(spark, folder, "labels").where(~held_out(5)).select("doc_id", F.col("quality").alias("label"))
    scored = vote_scores(docs, fit_votes(docs, labels), carry=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op2_maxscore_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", whole_components("embedding", 256).alias("v"))
    return maxscore_topk(vectors.where("vec_id % 50 = 0"), vectors, 5)


@query
def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return poisson_mix(docs, tempered_weights(docs))


@query
def op4_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return host_verdicts(table(spark, folder, "documents"))


@query
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_classes(table(spark, folder, "documents")).drop("text_hash", "part")


@query
def op6_hash_tree(spark: SparkSession, folder: str) -> DataFrame:
    return tree_shards(table(spark, folder, "documents"))


@query
def op7_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"))


@query
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = cut_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_byte_ppm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", held_out(10))
    return ppm_scores(docs, docs.where(~F.col("held_out")))


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", held_out(5))
    model = fit_languages(docs.where(~F.col("held_out")))
    return predict_languages(docs, model, carry=("doc_id", "held_out"))


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


@query
def op12_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return sketch_copies(table(spark, folder, "documents"))


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


QUERIES["pipeline"] = corpus_pipeline.run
ORACLE["op2_maxscore_search"] = """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
ORACLE["op3_source_mixing"] = mix_sql()
ORACLE["op4_host_rules"] = verdict_sql()
ORACLE["op5_jaccard_join"] = components_sql()
ORACLE["op6_hash_tree"] = tree_sql()
ORACLE["op11_spelling_variants"] = variants_sql()
ORACLE["op12_bottom_k"] = components_sql(2, 80, kept=True)
ORACLE["op13_prefix_trie"] = trie_sql()
