"""One query per operator of this package, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerframe.llm import (
    conversation_repair,
    decontaminate,
    divergence,
    extract,
    language,
    mixing,
    near_duplicates,
    neighbours,
    pseudonyms,
    secrets,
    token_counts,
    toxicity,
    url_filter,
)
from answerframe.llm.common import fold, table

# The rules that op3 applies.
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), n("net").alias("n_net"),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "net")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the quality labels, which name a page by the same number as a document."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES).withColumn("upper", F.round("upper", 6))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = language.train(docs.filter(~held_out))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_spans"
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return neighbours.search(vectors, F.col("vec_id") % 50 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs.filter(~held_out), labels.filter(~held_out))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"),
        F.when(F.col("toxic_score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pseudonyms.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key="op10")
    return docs.select("doc_id", "text", "pii", F.size("pii").alias("n_values"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    import public_tokenizers

    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    audits, mended = conversation_repair.repair(conversation_repair.damage(given))
    sums = conversation_repair.digests(mended, in_order=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    known = audits.withColumnRenamed("conv_id", "known_id")
    summed = sums.withColumnRenamed("conv_id", "summed_id")
    return (
        given.select("conv_id").distinct()
        .join(known, F.col("conv_id").eqNullSafe(F.col("known_id")), "left")
        .join(summed, F.col("conv_id").eqNullSafe(F.col("summed_id")), "left")
        .select(
            "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_extract": op2_extract,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_mix_sources": op6_mix_sources,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_neighbours": op8_neighbours,
    "op9_toxicity": op9_toxicity,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_divergence": op11_divergence,
    "op12_token_counts": op12_token_counts,
    "op13_repair_conversations": op13_repair_conversations,
}
