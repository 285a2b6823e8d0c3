"""One query per operator, over the whole tables and with production parameters."""

from pyspark.sql import functions as F

from textscore.llm import (brown_lm, decontaminate, jaccard_tree, licenses, line_dedup, merkle_log, mixing,
                           periodic_runs, pii, quality_classifier, quality_rules, token_counts, toxicity)
from textscore.llm.text import documents, read, remainder


def line_dedup_query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs)


def jaccard_query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return jaccard_tree.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def quality_rules_query(spark, sf_dir):
    found = quality_rules.judge(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept")


def lm_query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = remainder("doc_id", 7) == 2
    model = brown_lm.learn(docs.filter(~held_out).select(F.col("text").alias("_text")))
    return brown_lm.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def decontamination_query(spark, sf_dir):
    found = decontaminate.matches(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "item_windows")


def toxicity_query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = toxicity.verdicts(docs, read(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("severity", 9).alias("severity"),
                        F.round("p_any", 9).alias("p_any"), "rejected")


def pii_query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.find_pii(docs)


def quality_query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = quality_classifier.classify(docs, read(spark, sf_dir, "labels"),
                                        learn=lambda key: remainder(key, 4) != 2)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def licenses_query(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def mixing_query(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


def token_counts_query(spark, sf_dir, vocabulary="byte_bpe_50k.json"):
    import public_tokenizers  # where the vocabulary files are; the operator takes any path

    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(vocabulary))


def periodic_runs_query(spark, sf_dir):
    docs = periodic_runs.with_cycles(documents(spark, sf_dir))
    found = periodic_runs.detect_runs(docs).withColumn("best", periodic_runs.longest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(periodic_runs.listing(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def merkle_query(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    proofs = merkle_log.build(documents(spark, sf_dir), claimed={"text": text}).proofs()
    folded = merkle_log.fold(F.col("path"), F.col("claimed"))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle_log.siblings(F.col("path")), 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_line_dedup": line_dedup_query,
    "op2_jaccard_join": jaccard_query,
    "op3_quality_rules": quality_rules_query,
    "op4_brown_lm": lm_query,
    "op5_decontamination": decontamination_query,
    "op6_toxicity": toxicity_query,
    "op7_pii": pii_query,
    "op8_quality_classifier": quality_query,
    "op9_licenses": licenses_query,
    "op10_mixing": mixing_query,
    "op11_token_counts": token_counts_query,
    "op12_periodic_runs": periodic_runs_query,
    "op13_merkle_manifest": merkle_query,
}
ORACLE = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_jaccard_join": jaccard_tree.ORACLE,
    "op9_licenses": licenses.oracle(),
    "op10_mixing": mixing.oracle(),
    "op13_merkle_manifest": merkle_log.oracle(),
}
