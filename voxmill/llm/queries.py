"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from voxmill.llm import chosen_path, decontam, lang_id, lm_score, merkle, ngram_join, quality_classifier, quality_rules, secret_scan, sentence_pieces, spelling, toxicity, url_filter
from voxmill.llm.common import Scratch, crc_mod, read
from voxmill.llm.oracles import ORACLES


def held_out(n: int, remainder: int = 0):
    """Whether an id is left out of training; a null id is not."""
    return F.coalesce(crc_mod(F.col("doc_id"), n) == remainder, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(~held_out(4, 2)))
    return lang_id.predict(docs, model).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.page_outcome(pages["html"])).select("page_id", "host", "path", "rule", "verdict")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", held_out(10))
    return lm_score.score(docs.withColumn("train", ~F.col("held_out")), Scratch(spark), keep=("doc_id", "held_out"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(read(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    rows = quality_classifier.scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(5), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    chain = toxicity.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    rows = toxicity.score(docs, chain)
    return rows.select("doc_id", held_out(5), "p_quality", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).alias("toxic"))


def op11_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One occurrence in 31, by a hash of id and word, loses a letter first."""
    word = F.col("word")
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.char_length(word)).cast("int")
    cut = F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.char_length(word)))
    words = spelling.runs(read(spark, sf_dir, "documents"), 7).select(F.when(h % 31 == 0, cut).otherwise(word).alias("word"))
    return spelling.variants(spelling.vocabulary(words))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 3 divides the hash of the id, the leaf in hand is of the text with A-Z lower-cased."""
    docs = read(spark, sf_dir, "documents")
    tampered = merkle.leaf_digest(docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], merkle.lowered(docs["text"]))
    manifest = merkle.build(docs, changed=F.when(crc_mod(docs["doc_id"], 3) == 0, tampered))
    return merkle.verified(manifest.rows).withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_lm_score, op4_quality_rules, op5_ngram_jaccard, op6_secret_scan, op7_decontamination, op8_sentence_pieces, op9_quality_classifier, op10_toxicity, op11_chosen_path, op12_spelling_variants, op13_merkle_manifest)}
QUERIES["pipeline"] = corpus_pipeline.run
