"""The corpus operators as queries over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, divergence, licenses, line_dedup, oracles, quality_rules, sharding, simhash, tokens, topk, toxicity, trie, urls
from tidemark.llm.common import stored

#: The rules of the URL query: fixed values.
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), decode=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", F.col("hits.item_id").alias("item_ids"), F.col("hits.score").alias("scores"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, column="score")
    return out.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality_rules.statistics(table(spark, sf_dir, "documents"), keep=["doc_id"]), "statistics")
    rules = quality_rules.learn(stats, table(spark, sf_dir, "labels"))
    return quality_rules.judge(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=10, top=10)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trie.prefix_trie(table(spark, sf_dir, "conversations"), every=20, most=4)
    return out.drop("position", "subtree_end")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_exact_topk": op8_exact_topk,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
    "op11_quality_rules": op11_quality_rules,
    "op12_divergence": op12_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}
#: The others need the tokenizer, a trained model, XXH64 or alignment; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": oracles.OP5_URL_FILTER,
    "op7_line_dedup": oracles.OP7_LINE_DEDUP,
    "op8_exact_topk": oracles.OP8_EXACT_TOPK,
    "op12_divergence": oracles.OP12_DIVERGENCE,
    "op13_prefix_trie": oracles.OP13_PREFIX_TRIE,
}
