"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from folioworks.llm import ann, bpe, lexical, licences, lines, media, mixing, packing, phrases, secrets, simhash, toxicity, urls
from folioworks.llm.words import table

#: A file that every executor has.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).withColumn("shards", F.array_join("shards", ","))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_report(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.with_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op9_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.credential_links(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.with_tokens(docs, VOCABULARY, decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_urls": op2_urls, "op3_ann": op3_ann, "op4_mix": op4_mix, "op5_licences": op5_licences, "op6_simhash": op6_simhash, "op7_media": op7_media, "op8_toxicity": op8_toxicity, "op9_secrets": op9_secrets, "op10_bpe": op10_bpe, "op9_secret_links": op9_secret_links, "op11_phrases": op11_phrases, "op12_lexical": op12_lexical, "op13_packing": op13_packing}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": lines.ORACLE_SQL, "op2_urls": urls.ORACLE_SQL, "op5_licences": licences.ORACLE_SQL, "op9_secrets": secrets.ORACLE_SQL, "op9_secret_links": secrets.LINKS_SQL, "op11_phrases": phrases.ORACLE_SQL, "op12_lexical": lexical.ORACLE_SQL}
