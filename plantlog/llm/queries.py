"""Queries of the operators over the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantlog.llm import exact_substrings, licences, manifest, mixing, packing, passages, pieces, pii, sql, topk, toxicity, whitening
from plantlog.llm.common import documents
from plantlog.llm.near_join import near_join
from plantlog.llm.quality_rules import apply_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn
    return add


@query(sql.QUALITY)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir).select("doc_id", "text"), clean=False).select(
        "row.doc_id", *[f"quality.{n}" for n in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            "kept", "n_lines_removed")])


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.col("pii.base")
    count = lambda i: F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{pii.NAMES[i]}") for i in pii.BASE],
        F.sha2(pii.label(base), 256).alias("base_sha256"), pii.label(F.col("pii.spans")).alias("spans"))


@query(sql.MIXING)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return rows.select("row.doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("repeats")).alias("taken"))


@query()
def op7_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


@query()
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(documents(spark, sf_dir).select("doc_id", "text"), decoded="decoded")
    return coded.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids",
        (F.col("decoded") == F.coalesce("row.text", F.lit(""))).alias("round_trip"))


@query(sql.TOP_K)
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query(sql.LICENCES)
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_lines(documents(spark, sf_dir))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, chain)
    p = {n: F.col("p")[i] for i, n in enumerate(chain.names)}
    return scored.select("row.doc_id", *[v.alias(f"p_{n}") for n, v in p.items()],
                         (p["toxic"] >= 0.5).alias("is_toxic"))


@query()
def op10_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substrings.dedup(documents(spark, sf_dir)).drop("spans")


@query()
def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(documents(spark, sf_dir))


@query(sql.MERKLE)
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return manifest.manifest(documents(spark, sf_dir), changed=touched, changes={
        "n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})


@query()
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
