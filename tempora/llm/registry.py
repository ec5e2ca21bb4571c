"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import decontaminate, language, packing, pii, quality_rules, simhash, suffix_dedup, toxicity, warc, weak_quality
from tempora.llm import sql as S
from tempora.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens; one row per piece."""
    packed = packing.pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, posterior, score and verdict for every document."""
    return weak_quality.classify(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id's remainder is not 1."""
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    net = language.fit(docs, remainder != 1)
    held_out = F.coalesce(remainder == 1, F.lit(False)).alias("held_out")
    return language.predict(docs, net).select("doc_id", held_out, "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside any occurrence of a benchmark window."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back in the order of the merged index."""
    found = warc.archive_and_read(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and spans."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start anywhere else too; words in passages of over 50 words shared with other documents."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, passage=51)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        "n_passage_words", F.size("passages").cast("long").alias("n_passages"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the production policy's verdict for every document, from the stored ledger."""
    rows = quality_rules.stored_ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.mask(quality_rules.BASE_RULES)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_rules",
        (F.col("failed_rules").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        (~quality_rules.rejects(quality_rules.PRODUCTION)).alias("kept"),
    )


def rule_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version of the policy keeps, from one stored ledger."""
    rows = quality_rules.apply_policies(quality_rules.stored_ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "failed_rules", *[F.col(f"`kept_{p.version}`").alias(f"kept_{p.version.replace('-', '_')}") for p in quality_rules.POLICIES])


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version of the policy keeps with and without each of its rules, from one stored ledger."""
    return quality_rules.ablations(quality_rules.stored_ledger(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_pack_best_fit, op2_quality_classifier, op3_language_id, op4_decontaminate, op5_simhash, op6_warc, op7_personal_data,
        op8_suffix_dedup, op9_quality_rules, op10_toxicity, rule_policies, rule_ablations,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(S.ORACLES)
