"""The queries of this subpackage and their SQL. One module for each operator holds the work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, chat, langid, lexical, maxent, mixing, neardup, quality, runs, secrets, topk, urls, winnow
from quillon.llm import sql as text_sql

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: F.Column, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["depth"] == 0)
    return found.select(
        "doc_id", *[count_of(base, k).alias(f"n_{k}") for k in secrets.KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["depth"] > 0)).cast("long").alias("n_decoded"), "truncated",
    )


@query("op2_near_duplicates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size", F.hex("class_key").alias("class_key"))


@query("op3_quality_rules", text_sql.QUALITY)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.apply_rules(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    host = ["host_docs", "host_failed", F.round("host_rate", 6).alias("host_rate"), "host_rejected"]
    return df.select("doc_id", *[F.col(f"measures.{n}").alias(n) for n in names], "base_failed", "kept", *host, F.round("posterior", 6).alias("posterior"))


@query("op4_winnowing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))


def remainder(n: int) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


@query("op5_maxent_score")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(read(spark, sf_dir, "documents").select("doc_id", "text", (remainder(5) == 1).alias("held_out")))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = remainder(4) == 2
    model, bounds = langid.fit(docs.where(~held).select(F.col("doc_id").alias("id"), "text", "lang"))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model, bounds).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)


@query("op8_url_filter", text_sql.URLS)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern")


@query("op9_mix_sources", text_sql.MIX)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixing.mix_report(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return df.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", "source")


@query("op10_chat_format")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = chat.conversations(read(spark, sf_dir, "conversations"))
    turns = [F.col(f"chat.{c}").alias(n) for n, c in (("turns", "turn"), ("parents", "parent_turn"), ("depths", "depth"))]
    return df.select("conv_id", F.col("part.root").alias("part_root"), F.col("part.turn").alias("part_turn"), "n_messages", *turns, "n_passages", "n_linked", "max_level", F.length("chat_text").cast("long").alias("chat_chars"), F.sha2(F.col("chat_text").cast("binary"), 256).alias("chat_sha256"))


@query("op11_topk_search", text_sql.TOPK)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, F.col("vec_id") % 50 == 0, k=5).select("query_id", "rank", "vec_id", "score")


@query("op12_lexical_search", text_sql.LEXICAL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text")
    return lexical.search(docs, items, k=50)


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    found = runs.find_runs(runs.with_repeats(docs, "h"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    hashes = [F.sha2(x.cast("binary"), 256).alias(n) for n, x in (("runs_sha256", F.array_join(line, "")), ("collapsed_sha256", F.col("collapsed")))]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, *hashes, "n_words")
